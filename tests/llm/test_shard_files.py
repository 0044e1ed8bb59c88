import pyarrow.parquet as pq
from pyspark.sql import functions as F

from graphloom.llm import lexical


def test_a_shard_is_alone_in_its_row_group(spark):
    """Else a task's writer and reader hold all of its shards at once."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.sha2(F.concat("id", F.lit("-"), i).cast("binary"), 256)))
    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"))  # 39 MB in one task
    index = lexical.Index.of(docs)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.shards.inputFiles()]
    assert sum(m.num_rows for m in files) == 4
    assert all(m.row_group(i).num_rows == 1 for m in files for i in range(m.num_row_groups))
