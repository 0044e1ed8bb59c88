"""Centroid clustering of integer vectors, with Elkan's bounds.

Each vector's row carries its centroid, an upper bound of the distance to it and
a lower bound of the distance to every centroid. A round moves the bounds by how
far the centroids moved, skips what the bounds or the distances between
centroids rule out, and writes the rows anew in the shared folder; the table of
the round before is then removed. Sums and counts of clusters are combined
before they are shuffled, so a cluster that holds all vectors does no harm; what
reaches the driver is a row for each centroid.

Bounds are doubles that every operation rounds outward, and a centroid is
skipped only where it is strictly farther, so ties are always decided by exact
squared distances of integers. What is reported is such a distance as well.

Defined cases: vectors that are null, of another length, or that hold null or
non-finite components are left out; with fewer vectors than centroids each
vector starts one; equal hashes of repeated rows go by their components, a null
vec_id comes last; repeated rows stay repeated; an empty table gives an empty
result; clusters may end empty and keep their centroid. Components beyond
``WIDEST`` in size could overflow a long, so that a run with such raises an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.workspace import new_path, removed, written

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, "1"
WIDEST = 1 << 27
STATE = "vec_id long, unnamed boolean, vector array<long>, cluster int, upper double, lower array<double>"


def quantised(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``(vec_id, unnamed, vector)`` of the vectors that count, in integers; a null vec_id is 0 and unnamed."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fit = (F.size(x) == size) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.where(fit).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("unnamed"), x.alias("x"))
    wide = F.exists("x", lambda v: F.abs(v) * scale > WIDEST)
    return rows.select("vec_id", "unnamed", F.when(wide, F.raise_error("a component is too large for exact distances")).otherwise(F.transform("x", lambda v: F.floor(v * scale).cast("long"))).alias("vector"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """Vectors with the smallest hashes, in order of the hash."""
    key = F.when(~F.col("unnamed"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    found = rows.select(key.alias("key"), "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(clusters).collect()
    return np.array([r.vector for r in found], dtype=np.int64) if found else np.zeros((0, 0), dtype=np.int64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def nearest(x: np.ndarray, centroids: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds of the rows of ``x``, and how many distances it took.

    ``a`` is each row's present cluster, ``upper`` and ``lower`` hold for ``centroids``.
    """
    a, upper, lower = a.copy(), upper.copy(), lower.copy()
    between = np.stack([apart(centroids, c) for c in centroids])
    half = down(down(np.sqrt(between.astype(np.float64))) / 2)
    np.fill_diagonal(half, np.inf)
    # Rows whose own centroid is nearer than half the way to any other keep it.
    open_rows = np.flatnonzero(upper >= half.min(axis=1)[a])
    taken = len(open_rows)
    if not taken:
        return a, upper, lower, 0
    mine, at = x[open_rows], a[open_rows]
    exact = apart(mine, centroids[at])
    root = np.sqrt(exact.astype(np.float64))
    up_, low = up(root), lower[open_rows]
    low[np.arange(len(at)), at] = down(root)
    for c in range(len(centroids)):
        ask = np.flatnonzero((at != c) & (up_ >= low[:, c]) & (up_ >= half[at, c]))
        if not len(ask):
            continue
        taken += len(ask)
        d = apart(mine[ask], centroids[c])
        r = np.sqrt(d.astype(np.float64))
        low[ask, c] = down(r)
        better = (d < exact[ask]) | ((d == exact[ask]) & (c < at[ask]))
        won = ask[better]
        at[won], exact[won], up_[won] = c, d[better], up(r[better])
    a[open_rows], upper[open_rows], lower[open_rows] = at, up_, low
    return a, upper, lower, taken


def _assigning(centroids: np.ndarray, moved: np.ndarray | None):
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vector"].to_numpy()).astype(np.int64)
            if moved is None:
                a = np.zeros(len(x), dtype=np.int64)
                upper, lower = np.full(len(x), np.inf), np.zeros((len(x), len(centroids)))
            else:
                a = pdf["cluster"].to_numpy().astype(np.int64)
                upper = up(pdf["upper"].to_numpy() + moved[a])
                lower = down(np.stack(pdf["lower"].to_numpy()) - moved)
            a, upper, lower, _ = nearest(x, centroids, a, upper, lower)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "unnamed": pdf["unnamed"], "vector": pdf["vector"], "cluster": a.astype(np.int32), "upper": upper, "lower": list(lower)})

    return run


def _moved(was: np.ndarray, now: np.ndarray) -> np.ndarray:
    return np.where(apart(was, now) > 0, up(np.sqrt(apart(was, now).astype(np.float64))), 0.0)


def _means(state: DataFrame, was: np.ndarray) -> np.ndarray:
    """Floors of the clusters' means; an empty cluster keeps its centroid."""
    sums = [F.sum(F.element_at("vector", i + 1)).alias(f"s{i}") for i in range(was.shape[1])]
    now = was.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        now[r.cluster] = [s // r.n for s in r[2:]]
    return now


def clusters(vectors: DataFrame, rounds: int = ROUNDS, k: int = CLUSTERS, seed: str = SEED, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, vector, cluster, distance)`` after ``rounds`` rounds and a last assignment, and the centroids."""
    spark = vectors.sparkSession
    path = new_path(spark, "vectors")
    rows = written(quantised(vectors, size, scale), "vectors", path=path)
    at = first_centroids(rows, k, seed)
    moved = None
    for _ in range(rounds if len(at) else 0):
        old, path = path, new_path(spark, "bounds")
        rows = written(rows.mapInPandas(_assigning(at, moved), STATE), "bounds", path=path)
        removed(spark, old)
        now = _means(rows, at)
        at, moved = now, _moved(at, now)
    last = rows.mapInPandas(_assigning(at, moved), STATE)
    return last.select(F.when(~F.col("unnamed"), F.col("vec_id")).alias("vec_id"), "vector", "cluster", _distance(at)), at


def _distance(centroids: np.ndarray) -> Column:
    """The exact squared distance to the row's own centroid."""
    table = F.array(*[F.array(*[F.lit(int(x)) for x in c]).cast("array<long>") for c in centroids]) if len(centroids) else F.lit(None).cast("array<array<long>>")
    gaps = F.zip_with("vector", F.element_at(table, F.col("cluster") + 1), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x).alias("distance")


def digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]


def op13(spark, sf_dir: str) -> DataFrame:
    rows, centroids = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = written(rows.select("vec_id", "cluster", "distance"), "clusters")
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = spark.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), d) for i, d in enumerate(digests(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op13_sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"near{r} as (select v.r, v.vec_id, v.x, arg_min(c.c, (d.d, c.c)) as c, min(d.d) as d from kept v, cent{r} c, "
            f"lateral (select list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::bigint as d) d group by v.r, v.vec_id, v.x)"
        )
        if r < ROUNDS:
            steps.append(
                f"sum{r} as (select c, i, floor(sum(x[i])::double / count(*))::bigint as m, sum(x[i])::hugeint as s, count(*) as n from near{r}, range(1, {SIZE + 1}) t(i) group by c, i), "
                f"mean{r} as (select c, list((case when s % n < 0 then s // n - 1 else s // n end)::bigint order by i) as x from sum{r} group by c), "
                f"cent{r + 1} as (select c.c, coalesce(m.x, c.x) as x from cent{r} c left join mean{r} m on c.c = m.c)"
            )
    return (
        f"with base as (select row_number() over () as r, vec_id, embedding as e from embeddings), "
        f"kept as (select r, vec_id, list_transform(e, lambda v: floor({SCALE} * v::double)::bigint) as x from base "
        f"where len(e) = {SIZE} and len(list_filter(e, lambda v: v is not null and isfinite(v))) = {SIZE}), "
        f"cent0 as (select row_number() over (order by sha256('{SEED}:' || vec_id::varchar) nulls last, x) - 1 as c, x from kept qualify c < {CLUSTERS}), "
        + ", ".join(steps)
        + f" select n.vec_id, n.c::int as cluster, n.d as distance, (sum(n.d) over (partition by n.c))::bigint as cluster_inertia, (sum(n.d) over ())::bigint as inertia, "
        f"sha256(array_to_string(c.x, ',')) as centroid_sha256 from near{ROUNDS} n join cent{ROUNDS} c on n.c = c.c"
    )


OP13_SQL = _op13_sql()
