"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over the words of a text and their beginnings (four to seven
letters, so that inflected forms count together). Every labelled text gets a
counterfactual twin: where it names a group, each identity term is replaced by
another of its group; where it names none, a term is put into it, chosen by a
checksum of the text. The loss adds ``FAIR`` times the squared change of the
score between the twins, taken before the sigmoid, so that the mention of a
group by itself moves no score. Identity terms and their beginnings are always features, whether or not
labels favour them.

Features are chosen on the same sample by how much their presence tells about
the label; there are at most ``FEATURES`` of them. The fit uses about
``FIT_DOCS`` labelled rows, chosen by a hash of doc_id.

Defined cases: null and empty texts get the score of a text without features;
with no labelled row, or labels of one kind only, scores are the smoothed share
of toxic labels; conflicting labels of a document all count; repeated rows are
scored alike; extra columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import bound

FIT_DOCS, FEATURES, FAIR, RIDGE, CUT = 30_000, 4096, 1.0, 1e-3, 0.7
LEAST_DOCS, LEAST_GAIN, PRUNE = 5, 8.0, 2
WORD = re.compile(r"[^\W\d_]+")

#: Groups whose members may stand for one another, in the languages of the corpus.
IDENTITY = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY for i, t in enumerate(g)}


def features_of(words) -> set[str]:
    """Words and, marked by a bar, their beginnings."""
    found = set(words)
    for w in list(found):
        for n in (4, 5, 6, 7):
            if len(w) > n:
                found.add(w[:n] + "|")
    return found


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def counterfactual(text: str | None, words: set[str]) -> set[str]:
    """The words of a text's twin."""
    if words.isdisjoint(SWAP):
        terms = sorted(SWAP)
        return words | {terms[zlib.crc32((text or "").encode("utf-8", "surrogatepass")) % len(terms)]}
    return {SWAP.get(w, w) for w in words}


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def gain(a: np.ndarray, b: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Log-likelihood ratio of presence in ``a`` of ``pos`` and ``b`` of ``neg`` documents."""

    def h(x, n):
        p = np.clip(x / n, 1e-12, 1 - 1e-12)
        return x * np.log(p) + (n - x) * np.log1p(-p)

    return 2 * (h(a, pos) + h(b, neg) - h(a + b, pos + neg))


def fit(rows: list[tuple[int, list[int], list[int], list[int]]], n: int, ridge: float = RIDGE, fair: float = FAIR, rounds: int = 1200) -> np.ndarray:
    """Weights, the last of them the bias, by accelerated gradient descent on the mean loss.

    ``rows``: label, features, and the features that the twin has beyond them and lacks.
    """
    y = np.array([r[0] for r in rows], dtype=float)
    idx = np.concatenate([np.array(r[1], dtype=np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    t_idx = np.concatenate([np.array([*r[2], *r[3]], dtype=np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    t_row = np.repeat(np.arange(len(rows)), [len(r[2]) + len(r[3]) for r in rows])
    sign = np.concatenate([np.repeat([1.0, -1.0], [len(r[2]), len(r[3])]) for r in rows]) if rows else np.zeros(0)
    share = y.mean()
    weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(y)
    w, v = np.zeros(n + 1), np.zeros(n + 1)
    most = np.bincount(row, minlength=len(rows)).max(initial=0) + 1
    apart = np.bincount(t_row, minlength=len(rows)).max(initial=0)
    step = 1.0 / (0.25 * most + ridge + 8 * fair * apart)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for k in range(rounds):
        u = v
        g_row = weight * (sigmoid(np.bincount(row, weights=u[idx], minlength=len(rows)) + u[n]) - y)
        moved = np.bincount(t_row, weights=sign * u[t_idx], minlength=len(rows)) * (2 * fair / len(y))
        grad = np.append(np.bincount(idx, weights=g_row[row], minlength=n)[:n] + ridge * u[:n], g_row.sum())
        grad[:n] += np.bincount(t_idx, weights=sign * moved[t_row], minlength=n)[:n]
        after = u - 4 * step * grad
        v = after + (k / (k + 3)) * (after - w)
        w = after
    return w


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fair: float = FAIR) -> tuple[dict[str, float], float]:
    """Feature weights and the bias, from labelled rows that aren't held out."""
    bound(docs.sparkSession)
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out())
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        p = (pos + 1) / (pos + neg + 2)
        return {}, float(np.log(p / (1 - p)))
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30))
    chosen = known.where(key <= F.lit(min(1.0, fit_docs / (pos + neg)) * (1 << 30)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # fit_docs ids and labels

    def count(batches):
        total: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for pdf in batches:
            for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
                total[toxic].update(features_of(words_of(text)))
                n[toxic] += 1
        found = [f for f in total[0].keys() | total[1].keys()]
        if sum(n):
            yield pd.DataFrame({"feature": ["", *found], "pos": [n[1], *[total[1][f] for f in found]], "neg": [n[0], *[total[0][f] for f in found]]})

    counted = texts.mapInPandas(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # what is clearly more often in toxic texts than in others, or the other way round
    rate = (F.col("pos") + 0.5) / F.lit(pos + 1.0) / ((F.col("neg") + 0.5) / F.lit(neg + 1.0))
    strong = counted.where((F.col("feature") == "") | ((F.col("pos") + F.col("neg") >= LEAST_DOCS) & ((rate > PRUNE) | (rate < 1 / PRUNE))))
    strength = F.abs(F.log(rate)) * F.sqrt(F.col("pos") + F.col("neg"))
    got = strong.orderBy(F.col("feature") != "", F.desc(strength), "feature").limit(4 * FEATURES).toPandas()
    total = got[got["feature"] == ""]
    n_pos, n_neg = int(total["pos"].sum()), int(total["neg"].sum())
    if not n_pos or not n_neg:
        p = (pos + 1) / (pos + neg + 2)
        return {}, float(np.log(p / (1 - p)))
    got = got[got["feature"] != ""]
    got = got.assign(gain=gain(got["pos"].to_numpy(float), got["neg"].to_numpy(float), n_pos, n_neg))
    got = got[got["gain"] >= LEAST_GAIN].sort_values(["gain", "feature"], ascending=[False, True]).head(FEATURES)
    names = list(dict.fromkeys([*got["feature"], *sorted(features_of(SWAP))]))
    number = {f: i for i, f in enumerate(names)}

    def encode(batches):
        for pdf in batches:
            rows = []
            for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
                words = words_of(text)
                here = {number[f] for f in features_of(words) if f in number}
                there = {number[f] for f in features_of(counterfactual(text, words)) if f in number}
                rows.append((toxic, sorted(here), sorted(there - here), sorted(here - there)))
            yield pd.DataFrame(rows, columns=["toxic", "x", "more", "less"])

    rows = texts.mapInPandas(encode, "toxic int, x array<int>, more array<int>, less array<int>").collect()
    w = fit(sorted((r["toxic"], r["x"], r["more"], r["less"]) for r in rows), len(names), fair=fair)
    return {f: float(w[i]) for f, i in number.items()}, float(w[-1])


def score(docs: DataFrame, weights: dict[str, float], bias: float, keep=("doc_id",)) -> DataFrame:
    """``docs`` with score; columns in ``keep`` come along."""
    bound(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    starts = {f[:-1]: x for f, x in weights.items() if f.endswith("|")}
    whole = {f: x for f, x in weights.items() if not f.endswith("|")}
    model = docs.sparkSession.sparkContext.broadcast((whole, starts, bias))  # FEATURES and the identity terms

    def run(batches):
        whole, starts, bias = model.value
        for pdf in batches:
            z = []
            for text in pdf["text"]:
                words = words_of(text)
                heads = {w[:n] for w in words for n in (4, 5, 6, 7) if len(w) > n}
                z.append(bias + sum(whole[w] for w in words & whole.keys()) + sum(starts[h] for h in heads & starts.keys()))
            out = pdf[[f.name for f in fields]].copy()
            out["score"] = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -40, 40)))
            yield out

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    weights, bias = train(docs, labels)
    scored = score(docs, weights, bias)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
