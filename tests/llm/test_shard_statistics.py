from pathlib import Path

import pyarrow.parquet as pq

from graphloom.llm import lexical
from graphloom.workspace import shared_dir


def test_writers_keep_no_copies_of_shards(spark):
    """Statistics of a row group stay with its writer until the file ends."""
    top = Path(shared_dir(spark).removeprefix("file:"))
    was = set(top.glob("impacts-*"))
    lexical.Index.of(spark.createDataFrame([(i, f"word{i} again") for i in range(20)], "doc_id long, text string"))
    files = [f for d in set(top.glob("impacts-*")) - was for f in d.glob("*.parquet")]
    groups = [m.row_group(g) for m in (pq.ParquetFile(f).metadata for f in files) for g in range(m.num_row_groups)]
    assert groups and not any(g.column(c).is_stats_set for g in groups for c in range(g.num_columns))
