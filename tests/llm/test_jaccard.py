"""The pipeline's near dedup against Jaccard groups by brute force."""

import random

import corpus_pipeline
from graphloom.llm import jaccard

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Least doc_id by row, linked by exact Jaccard similarity of five-word shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {(d, least[top(i)]) for i, (d, _) in enumerate(rows)}


def planted():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    passage, texts = [word() for _ in range(40)], [None, " ", "Two Words", "two  words", "a b c d e"]
    for n in (6, 12, 40, 150, 700):
        for _ in range(6):
            base = passage * (n > 40) + [word() for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.005, 0.01, 0.02, 0.03, 0.05):  # far beyond and just around the limit
                t = list(base)
                for i in r.sample(range(len(t)), max(1, round(share * len(t)))):
                    t[i] = word()
                texts.append(" ".join(t))
            texts.append(" ".join(base[: -max(1, n // 6)]))
    r.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_near_dedup_keeps_one_of_each_jaccard_group(spark):
    rows = planted()
    want = brute(rows)
    assert 30 < len({c for _, c in want}) < len(rows) - 60
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {tuple(r) for r in jaccard.similar_groups(docs).collect()} == want
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})


def test_order_of_shingles_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "COMMON", 3)
    rows = planted()
    assert {tuple(r) for r in jaccard.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_near_dedup_of_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in jaccard.similar_groups(docs).collect()} == brute(rows)
    assert jaccard.similar_groups(docs.limit(0)).count() == 0


def test_large_components_are_split_in_blocks(spark, monkeypatch):
    """Shards above two sets are chained whole, components above four go through blocks."""
    for name, value in (("SAMPLE", 1), ("MOST", 2), ("NODES", 4), ("PIVOTS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rows = planted()
    assert {tuple(r) for r in jaccard.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_one_group_of_near_copies_and_a_chain(spark, monkeypatch):
    """A third of all rows are near copies of one text; a chain is linked only from one to the next."""
    monkeypatch.setattr(jaccard, "NODES", 16)
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    base, texts = [word() for _ in range(120)], []
    for _ in range(60):
        t = list(base)
        t[r.randrange(120)] = word()
        texts.append(" ".join(t))
    long = [word() for _ in range(700)]
    texts += [" ".join(long[i : i + 120]) for i in range(0, 580, 10)] + [" ".join(word() for _ in range(40)) for _ in range(60)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert len({c for _, c in want}) == 62
    assert {tuple(x) for x in jaccard.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_one_doc_id_with_unlike_texts(spark):
    r = random.Random(2)
    a, b = ([f"{x}{r.randrange(999)}" for _ in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (2, " ".join(a[:-1])), (3, " ".join(b[:-1])), (None, "x")]
    got = sorted((tuple(x) for x in jaccard.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (None, None)]
