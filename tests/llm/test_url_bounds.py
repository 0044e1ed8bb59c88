"""Rules of urls with many tokens, and of tokens that tell little by themselves: none is cut off."""

import random

from pyspark.sql import functions as F

from graphloom.llm import urlrules
from tests.llm.test_rules_search_clusters import brute_rules


def test_rules_beyond_any_bound_of_tokens(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        # 24 words that tell a lot, each with half of the blocked urls, and three that tell only together
        bad = i % 2 == 0
        plain = [f"w{chr(97 + k)}" for k in range(24) if rng.random() < (0.5 if bad else 0.2)]
        three = ["xa", "xb", "xc"] if i % 12 == 0 else rng.sample(["xa", "xb", "xc"], 2)
        few = rng.sample(plain, min(len(plain), 4)) if i % 3 else plain
        rows.append((i, "http://h.net/" + "/".join(few + three), bad))
    df = spark.createDataFrame(rows, "id long, url string, block boolean")
    found = [(set(r.t), r.block) for r in df.select(urlrules.tokens(F.col("url")).alias("t"), "block").collect()]
    widths = [len(t) for t, b in found if b]
    assert min(widths) <= urlrules.WIDTH < max(widths)  # both ways of counting have work
    want = brute_rules(found)
    assert any({"p:xa", "p:xb", "p:xc"} <= set(t) for t, _ in want)
    assert {(r.tokens, r.support) for r in urlrules.mine(df)} == want


def test_rules_where_every_blocked_url_is_wide(spark):
    rng, words = random.Random(6), [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(i, "http://h.net/" + "/".join(rng.sample(words, 16 if i % 3 == 0 else 5)), i % 3 == 0) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, url string, block boolean")
    found = [(set(r.t), r.block) for r in df.select(urlrules.tokens(F.col("url")).alias("t"), "block").collect()]
    assert min(len(t) for t, b in found if b) > urlrules.WIDTH
    want = brute_rules(found)
    assert want and {(r.tokens, r.support) for r in urlrules.mine(df)} == want
