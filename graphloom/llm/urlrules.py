"""URL filters: given rules of hosts and paths, and association rules that FP-growth mines.

A given rule names a host and the start of a path; it fits the host and all
subdomains, and the longest rule that fits a url decides it. What no rule fits is
judged by association rules: combinations of the url's tokens (parts of host,
path and query keys, digits folded) that go along with the label *block*.

Mining. Tokens that always occur together are one item, so they don't multiply
itemsets; one in fewer blocked urls than a rule needs is in no rule. A blocked url
of at most ``WIDTH`` items is a transaction of Spark's FP-growth, whose itemsets it
bounds by their subsets; wider ones are counted level by level, by joins. An
itemset with enough support among all blocked urls has the same share of one of
the two parts at least, so both together find every candidate, and a count over
all labelled urls decides. A rule stays if it has ``SUPPORT`` of the labelled urls
(``LEAST`` at least), if the lower end of its confidence's Wilson interval reaches
``CONFIDENCE``, and if no part of it has as high a confidence. The fit is bounded by
``FIT_URLS`` labelled urls by hash and ``LENGTH`` items in a rule; within that, all
tokens and all items of a url count. Few reach the driver: the tokens over
``SUPPORT`` of a url's, and the combinations over it that are blocked as often as
``CONFIDENCE`` asks.

Judging. An inverted index holds each rule under its rarest token. A url asks it
for each of its tokens and checks what it finds for the rest of the tokens; all
urls and tokens are judged, whatever the bounds of the fit.

Defined cases: a null url and one without ``://`` have an empty host and path and
no tokens, so they are allowed; null labels aren't learnt from; repeated labels
of an id count as block if one of them does; repeated rows are judged each;
without labels, or without a rule worth keeping, all is allowed; empty tables
give empty results; other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.workspace import Scratch, new_path, removed, written

FIT_URLS = 200_000
SUPPORT, LEAST, CONFIDENCE, Z = 0.005, 5, 0.5, 2.576
WIDTH, LENGTH = 12, 3

#: ``(verdict, host, start of the path)``
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2], r[0]))
    found = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def tokens(url: Column) -> Column:
    """Distinct parts of host, path and query keys, with a mark of where they stand."""

    def parts(text: Column, mark: str) -> Column:
        folded = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[0-9]+", "9")
        return F.transform(F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.array_join(F.transform(F.split(query, "&"), lambda kv: F.element_at(F.split(kv, "="), 1)), "&")
    found = F.array_sort(F.array_distinct(F.concat(parts(host(url), "h:"), parts(path(url), "p:"), parts(keys, "q:"))))
    return F.coalesce(found, F.array().cast("array<string>"))


@dataclass(frozen=True)
class Rule:
    """If a url has all of ``tokens``, it is blocked."""

    tokens: tuple[str, ...]
    support: int
    confidence: float


def least_confidence(hits: int, n: int, z: float = Z) -> float:
    """The lower end of Wilson's interval."""
    p, q = hits / n, z * z / n
    return (p + q / 2 - z * math.sqrt(p * (1 - p) / n + q / (4 * n))) / (1 + q)


def _items(sample: DataFrame, n: int, least: int) -> list[list[str]]:
    """Groups of tokens that always occur together and are in ``least`` blocked urls, the rarest first."""
    x = F.xxhash64("row")
    seen = sample.select("row", "block", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("block").cast("long")).alias("hits"), F.bit_xor(x).alias("x"), F.sum(F.shiftright(x, 24)).alias("s"))
    groups = seen.where((F.col("hits") >= least) & (F.col("n") < n)).groupBy("n", "hits", "x", "s").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return [list(r.tokens) for r in groups.orderBy("n", "tokens").select("tokens").toLocalIterator()]


def mine(labelled: DataFrame) -> list[Rule]:
    """Rules of ``labelled(url, block)``, most confident first."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col("block").isNotNull()).select(tokens(F.col("url")).alias("tokens"), "block", F.pmod(F.xxhash64(F.lit(11), "url", *[c for c in labelled.columns if c == "id"]), F.lit(1 << 20)).alias("h"))
    at = new_path(spark, "urls")
    labels = rows.count()
    if labels > FIT_URLS:
        rows = rows.where(F.col("h") < int((1 << 20) * FIT_URLS / labels))
    sample = written(rows.select("tokens", "block", F.monotonically_increasing_id().alias("row")), "urls", path=at)
    n = sample.count()
    least = max(LEAST, math.ceil(SUPPORT * n))
    items = _items(sample, n, least) if n >= least else []
    rules = _grown(sample, items, n, least) if items else []
    removed(spark, at)
    return rules


_BODY = [f"c{k}" for k in range(LENGTH)]  # a body's items in ascending order, then nulls


def _bodies(items: DataFrame) -> DataFrame:
    """``items(items)`` as the columns ``_BODY``."""
    return items.select(*[F.get(F.array_sort("items"), F.lit(k)).alias(c) for k, c in enumerate(_BODY)])


def _by_levels(held: DataFrame, share: float, scratch: Scratch) -> DataFrame:
    """``(items)``: sets of at most ``LENGTH`` items with ``share`` of the urls of ``held(row, item)``, longer ones from shorter."""
    often = lambda level: scratch.written(level.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("items"), "level")
    least = max(1, math.ceil(share * held.select("row").distinct().count() - 1e-6))
    level = held.select("row", F.array("item").alias("items"))
    known = found = often(level)
    held = held.join(known.select(F.col("items")[0].alias("item")), "item", "left_semi")
    for _ in range(1, LENGTH):
        level = scratch.written(level.join(known, "items", "left_semi"), "rows")
        longer = level.join(held, "row").where(F.col("item") > F.element_at("items", -1)).select("row", F.concat("items", F.array("item")).alias("items"))
        level, known = longer, often(longer)
        found = found.unionByName(known)
    return found


def _grown(sample: DataFrame, items: list[list[str]], n: int, least: int) -> list[Rule]:
    spark, scratch = sample.sparkSession, Scratch(sample.sparkSession)
    place = spark.createDataFrame([(group[0], i) for i, group in enumerate(items)], "token string, item int")
    held = scratch.written(sample.select("row", "block", F.explode("tokens").alias("token")).join(place, "token").select("row", "block", "item"), "held")
    baskets = scratch.written(held.where("block").groupBy("row").agg(F.collect_list("item").alias("items")), "baskets")
    share = (least - 0.5) / sample.where("block").count()  # below ``least``, so that no rounding loses a set
    narrow = baskets.where(F.size("items") <= WIDTH)
    sets = FPGrowth(itemsCol="items", minSupport=share).fit(narrow).freqItemsets.where(F.size("items") <= LENGTH).select("items")
    wide = baskets.where(F.size("items") > WIDTH).select("row", F.explode("items").alias("item"))
    if not wide.isEmpty():
        sets = sets.unionByName(_by_levels(wide, share, scratch))
    bodies = scratch.written(_bodies(sets).distinct(), "bodies")
    rows = held.withColumnRenamed("item", _BODY[0]).join(bodies, _BODY[0])  # by the rarest item
    for c in _BODY[1:]:
        rows = rows.where(F.col(c).isNull()).unionByName(rows.join(held.select("row", F.col("item").alias(c)), ["row", c], "left_semi"))
    counted = rows.groupBy(*_BODY).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("block").cast("long")).alias("hits"))
    told = {}
    for r in counted.where((F.col("hits") >= least) & (F.col("hits") >= F.col("n") * F.lit(CONFIDENCE))).toLocalIterator():
        if least_confidence(r.hits, r.n) >= CONFIDENCE:
            told[frozenset(r[c] for c in _BODY if r[c] is not None)] = (r.hits, r.hits / r.n)
    scratch.clear()
    rules = []
    for body, (hits, confidence) in told.items():
        parts = (frozenset(c) for k in range(1, len(body)) for c in combinations(body, k))
        if all(told.get(p, (0, 0.0))[1] < confidence for p in parts):
            rules.append(Rule(tuple(sorted(t for i in body for t in items[i])), hits, confidence))
    return sorted(rules, key=lambda r: (-r.confidence, -r.support, r.tokens))


class Filter:
    """Rules by an inverted index: each stands under the token that fewest rules have."""

    def __init__(self, rules: list[Rule]) -> None:
        often = defaultdict(int)
        for r in rules:
            for t in r.tokens:
                often[t] += 1
        self.index: dict[str, list[tuple[frozenset, Rule]]] = defaultdict(list)
        for r in rules:
            self.index[min(r.tokens, key=lambda t: (often[t], t))].append((frozenset(r.tokens), r))

    def matches(self, found: set[str]) -> list[Rule]:
        return [r for t in found for body, r in self.index.get(t, ()) if body <= found]


def blocks(url: Column, rules: list[Rule]) -> Column:
    """Whether a rule matches."""
    if not rules:
        return F.lit(False)
    known = Filter(rules)

    @F.pandas_udf("boolean")
    def matched(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: bool(known.matches(set(x))))

    return matched(tokens(url))


def judged(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """``pages(page_id, url)`` → ``(page_id, host, path, rule, verdict)``; a rule's verdict, or that of the mined rules."""
    url = F.col("url")
    mined = F.when(blocks(url, mine(labelled)), "block").otherwise("allow")
    df = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path"))
    df = df.withColumn("given", rule_of(F.col("host"), F.col("path"), rules)).withColumn("mined", mined)
    return df.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "mined").alias("verdict"))


def labels_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, url, block)``: pages whose id is labelled; of low quality or toxic ones are to be blocked."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")
    by_id = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select(F.col("doc_id").alias("id"), bad).groupBy("id").agg(F.max("bad").alias("block"))
    return pages.select(F.col("page_id").alias("id"), "url").join(by_id, "id")


def op11(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    pages = pages.select("page_id", "url")
    return judged(pages, labels_of(pages, labels.select("doc_id", "quality", "toxic")))
