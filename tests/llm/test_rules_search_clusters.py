"""URL rules, lexical search and Elkan clusters against brute force and odd rows."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import entries, kmeans, lexical, urlrules

# -- 11 -----------------------------------------------------------------------------------------------------------


def urls(n=1200):
    rng = random.Random(3)
    for i in range(n):
        words = [rng.choice(["news", "win", "casino", "shop", "blog", "free"]) for _ in range(3)]
        url = f"http://{words[0]}.site{rng.randrange(4)}.net/{words[1]}/{words[2]}/{i}.html?ref={i}"
        bad = {"win", "casino"} <= set(words) or rng.random() < 0.05
        yield i, url, bad


def brute_rules(rows):
    """Every combination of up to LENGTH tokens, counted one by one."""
    n, least = len(rows), max(urlrules.LEAST, math.ceil(urlrules.SUPPORT * len(rows)))
    extent = defaultdict(set)
    for i, (found, _) in enumerate(rows):
        for t in found:
            extent[t].add(i)
    groups = defaultdict(list)
    for t, at in extent.items():
        if least <= len(at) < n:
            groups[frozenset(at)].append(t)
    bad = {i for i, (_, b) in enumerate(rows) if b}
    told = {}
    for k in range(1, urlrules.LENGTH + 1):
        for some in combinations(groups, k):
            at = frozenset.intersection(*some)
            if len(at & bad) >= least and urlrules.least_confidence(len(at & bad), len(at)) >= urlrules.CONFIDENCE:
                told[frozenset(some)] = len(at & bad) / len(at), len(at & bad)
    return {
        (tuple(sorted(t for g in body for t in groups[g])), hits)
        for body, (c, hits) in told.items()
        if all(told.get(frozenset(p), (0,))[0] < c for k in range(1, len(body)) for p in combinations(body, k))
    }


def test_mined_rules_equal_all_combinations(spark):
    rows = [(i, u, b) for i, u, b in urls()]
    df = spark.createDataFrame(rows, "id long, url string, block boolean")
    found = [(set(r.t), r.block) for r in df.select(urlrules.tokens(F.col("url")).alias("t"), "block").collect()]
    assert max(len(t) for t, _ in found) <= urlrules.WIDTH
    rules = urlrules.mine(df)
    assert {(r.tokens, r.support) for r in rules} == brute_rules(found) and rules
    known = urlrules.Filter(rules)
    for t, _ in found:
        assert set(known.matches(t)) == {r for r in rules if set(r.tokens) <= t}
    hits = [b == bool(known.matches(t)) for t, b in found]
    assert sum(hits) > 0.9 * len(hits)


def by_hand(url, rules=urlrules.RULES):
    host = path = ""
    if "://" in (url or ""):
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_given_rules_decide_before_mined_ones(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "http://example.org/en/12", "http://example.org", "x://org/", "http://corg/", "http://É.com/de/?q", "http://a.com/fr/#x", "http://a.com/de",
           "http://b.net?x=://org/es/", "http://win.net/casino", "line://\nhost.com/de/\n", "http://org:80/"]
    pages = spark.createDataFrame(list(enumerate(odd)) + [(None, odd[4]), (None, odd[4])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit("x")).withColumn("a.b", F.lit(2))
    labelled = spark.createDataFrame([(u, b) for _, u, b in urls()] + [(None, True), ("http://x", None)], "url string, block boolean")
    got = urlrules.judged(pages, labelled).collect()
    assert len(got) == len(odd) + 2
    for r in got:
        url = odd[r.page_id] if r.page_id is not None else odd[4]
        host, path, rule, verdict = by_hand(url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if "casino" in (url or "") else "allow"))
    assert {r.verdict for r in urlrules.judged(pages, labelled.limit(0)).collect()} == {"allow", "block"}
    assert urlrules.judged(pages.limit(0), labelled).count() == 0


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, 1, None), (3, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted((r.id, r.block) for r in urlrules.labels_of(pages, labels).collect()) == [(1, True), (2, False)]


# -- 12 -----------------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    out = []
    for item, text in items:
        score = Counter()
        for t in terms(text):
            df = sum(t in c for _, c, _ in held)
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
            for i, (_, c, size) in enumerate(held):
                if t in c:
                    score[i] += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (100 - 75 + (75 * size * n) // total)))
        best = sorted((-s, held[i][0] is None, held[i][0] or 0) for i, s in score.items() if s > 0)[:k]
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(best)]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("Alpha beta,gamma ünï-x 7up the the the \U0001f600 zeta".split(" ")) + rng.choice([" ", "", "\n"]) for _ in range(n))
    docs = [(rng.randrange(400), text(rng.randrange(1, 40))) for _ in range(600)] + [(None, "alpha beta"), (None, None), (700, ""), (701, "-- ++"), (702, "Alpha " * 50000), (5, "same same"), (5, "same same")]
    items = [(1, "alpha the the"), (1, "alpha the the"), (2, None), (3, "???"), (4, "unknown words"), (5, "SAME \U0001f600 zeta"), (None, "beta 7UP")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1)).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    monkeypatch.setattr(lexical, "PIECE", 1000)
    index = lexical.Index.of(df)
    want = brute_search(docs, items)
    assert sorted(map(tuple, index.search(asked).collect()), key=repr) == want
    monkeypatch.setattr(lexical, "ITEMS", 2)
    assert sorted(map(tuple, index.search(asked).collect()), key=repr) == want
    assert lexical.Index.of(df.limit(0)).search(asked).count() == 0 == index.search(asked.limit(0)).count()


def test_shards_are_whole_and_small(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(lexical, "SHARD_BYTES", 100)
    pdf = pd.DataFrame({"doc_id": range(50), "unnamed": False, "data": [b"some words %d" % i for i in range(50)]})
    shards = pd.concat(list(lexical._sharded([pdf])))
    assert len(shards) == 7 and shards.n_docs.sum() == 50 and shards.n_terms.sum() == 150


def test_top_keeps_ties_in_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(0, 6, rng.integers(0, 40))
        want = sorted((i for i in range(len(s)) if s[i] > 0), key=lambda i: (-s[i], i))[:10]
        assert lexical.top(s, 10).tolist() == want


# -- 13 -----------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3):
    kept = [(v, np.floor(64 * np.array(x, dtype=np.float64)).astype(np.int64)) for v, x in rows if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) for c in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist()))[:k]
    c = [x for _, x in first]
    for last in [False] * rounds + [True]:
        at = [min(range(len(c)), key=lambda j: (int(((x - c[j]) ** 2).sum()), j)) for _, x in kept]
        if not last:
            for j in range(len(c)):
                mine = [x for a, (_, x) in zip(at, kept, strict=True) if a == j]
                c[j] = np.array([sum(map(int, col)) // len(mine) for col in zip(*mine, strict=True)]) if mine else c[j]
    far = [int(((x - c[a]) ** 2).sum()) for a, (_, x) in zip(at, kept, strict=True)]
    per = Counter()
    for a, d in zip(at, far, strict=True):
        per[a] += d
    sha = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return sorted(((v, a, d, per[a], sum(far), sha[a]) for (v, _), a, d in zip(kept, at, far, strict=True)), key=repr)


@pytest.mark.parametrize("spread", [0.02, 1.0, 50.0])
def test_clusters_equal_brute_force(spark, tmp_path, spread):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) * spread).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i % 7, rows[0][1]) for i in range(100)] + [(None, rows[1][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("-inf")] + [0.0] * 63), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit(9)).withColumn("vector", F.lit(9)).repartition(6)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, kmeans.op13(spark, str(tmp_path)).collect()), key=repr) == brute_clusters(rows)


def test_few_and_no_vectors(spark, tmp_path):
    rows = [(i, [float(i)] * 64) for i in range(3)] * 2
    for n in (6, 0):
        at = tmp_path / str(n)
        spark.createDataFrame(rows[:n], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
        assert sorted(map(tuple, kmeans.op13(spark, str(at)).collect()), key=repr) == brute_clusters(rows[:n])


def test_bounds_skip_most_distances_and_no_tie():
    rng = np.random.default_rng(4)
    centers = rng.integers(-300, 300, (16, 64))
    x = centers[rng.integers(0, 16, 4000)] + rng.integers(-5, 6, (4000, 64))
    a, upper, lower, taken = kmeans.nearest(x, centers, np.zeros(4000, dtype=np.int64), np.full(4000, np.inf), np.zeros((4000, 16)))
    assert taken < 4000 * 16
    now = centers + rng.integers(-1, 2, centers.shape)
    moved = kmeans._moved(centers, now)
    b, _, _, again = kmeans.nearest(x, now, a, kmeans.up(upper + moved[a]), kmeans.down(lower - moved))
    want = np.argmin(np.stack([kmeans.apart(x, c) for c in now]), axis=0)
    assert (b == want).all() and again < 100
    tied = np.repeat(centers[:1], 16, axis=0)
    assert (kmeans.nearest(x, tied, np.full(4000, 7), np.full(4000, np.inf), np.zeros((4000, 16)))[0] == 0).all()


# -- SQL ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_elkan_clusters"])
def test_query_equals_sql(spark, sf_dir, name):
    df = entries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    r = con.execute(entries.SQL[name])
    at = [d[0] for d in r.description]
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(repr(tuple(x[at.index(c)] for c in columns)) for x in r.fetchall())
