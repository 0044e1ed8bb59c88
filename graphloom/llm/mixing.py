"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

A source's target is ``min(max_epochs * size, level * weight)``, where ``level``
makes the targets sum to the budget: clamping sources at their maximum epochs
and resharing the excess by weight until nothing is above ends at exactly this
level. A source's documents are then taken ``floor(target / size)`` whole times,
and the fractional rest goes to a seeded prefix of them: documents are ordered
by a keyed digest, dealt into ``bins`` by its first digits so that no source is
ever sorted in one task, and taken while the running size stays nearest to goal.

Defined cases: null text has size 0; null source is a source of its own, last
in order; an empty table gives an empty result; a source of size 0 has target 0;
repeated rows count as documents of their own; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET, MAX_EPOCHS, SEED = 1.5, 2.0, "mix-1"


def size_of(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size)``, a row a source → the same with ``target``."""
    everything = W.partitionBy()  # a row for each source, after aggregation
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ordered = W.orderBy("ratio", "rank")
    df = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(budget))
        .withColumn("full", F.sum("cap").over(ordered.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(ordered.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    )
    return df.select("source", "source_size", F.round(F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")), 6).alias("target"))


def mix(docs: DataFrame, size_col=None, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS, seed: str = SEED, bins_hex: int = 3, keep=()) -> DataFrame:
    """A row for each document: doc_id, size, source, source_size, target, repeats, taken, and the columns in ``keep``."""
    spread = ["source", "bin"]
    base = docs.select(
        "doc_id",
        "source",
        (size_of() if size_col is None else size_col).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("key"),
        F.xxhash64("text").alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []),
    ).withColumn("bin", F.substring("key", 1, bins_hex))
    base = base.repartition(*spread)
    by_bin = base.groupBy(*spread).agg(F.sum("size").alias("bin_size"))
    goals = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, budget, max_epochs)
    along = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = by_bin.withColumn("before", F.sum("bin_size").over(along) - F.col("bin_size"))
    g = goals.withColumnRenamed("source", "s")
    bins = bins.join(g, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("bin").alias("b"), "before", "source_size", "target"
    )
    inside = W.partitionBy(*spread).orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        base.withColumn("upto", F.sum("size").over(inside))
        .join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
        .withColumn("rate", rate)
        .withColumn("goal", (F.col("rate") - F.floor("rate")) * F.col("source_size"))
        .withColumn("extra", (F.col("before") + F.col("upto") - F.col("size") / F.lit(2.0) <= F.col("goal")).cast("long"))
        .withColumn("repeats", F.least(F.floor("rate").cast("long") + F.col("extra"), F.lit(int(max_epochs)).cast("long")))
        .select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"), *(["kept"] if keep else []))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, columns as they came."""
    columns = docs.columns
    rows = mix(docs, keep=columns, **options)
    return rows.where("repeats > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*[F.col("kept").getField(c).alias(c) for c in columns])


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


OP10_SQL = r"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix-1:' || coalesce(doc_id::varchar, '')) as key
  from documents),
sizes as (select source, sum(size)::bigint as source_size from base group by source),
ranked as (select *, row_number() over (order by source nulls last) as rank from sizes),
weighed as (select *, case (rank - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 2.0::double as cap,
  sum(source_size) over () * 1.5::double as budget from ranked),
levels as (select *, cap / weight as ratio,
  (budget - (sum(cap) over (order by cap / weight, rank rows unbounded preceding) - cap))
  / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as lv from weighed),
lev as (select lv from levels where lv <= ratio order by ratio, rank limit 1),
goals as (select source, source_size, round(least(cap, coalesce((select lv from lev) * weight, cap)), 6) as target from levels),
run as (select b.*, g.source_size, g.target, sum(size) over (partition by b.source order by key, doc_id, size rows unbounded preceding) as upto,
  case when g.source_size > 0 then g.target / g.source_size else 0.0::double end as rate
  from base b join goals g on b.source is not distinct from g.source),
took as (select *, least(floor(rate)::bigint + (upto - size / 2.0::double <= (rate - floor(rate)) * source_size)::bigint, 2) as repeats from run)
select doc_id, size, source_size, target, (repeats * size)::bigint as taken, source, repeats::bigint as repeats from took
"""
