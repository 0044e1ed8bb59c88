import random

import pytest

from graphloom.graph import KG
from graphloom.operators import iterate
from graphloom.workspace import Scratch


def test_a_round_writes_a_row_for_a_block(spark, monkeypatch):
    sizes, was = [], Scratch.renewed
    monkeypatch.setattr(Scratch, "renewed", lambda self, df, name: sizes.append((found := was(self, df, name)).count()) or found)
    monkeypatch.setattr(iterate, "FEW", 8, raising=False)
    monkeypatch.setattr(iterate, "LINKS", 30, raising=False)
    rng = random.Random(4)
    ids = [f"n{i:02}" for i in range(40)] + ["alone"]
    edges = [(rng.choice(ids[:40]), rng.choice(ids[: rng.choice((3, 40))])) for _ in range(150)] + [("n00", "n00"), ("n01", "gone"), ("gone", "n02")]
    kg = KG(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "source string, target string"))
    near = {i: [t for s, t in edges if s == i] + [s for s, t in edges if t == i] for i in ids}
    score = dict.fromkeys(ids, 1 / 41)
    lost = [i for i in ids if not near[i]]
    for _ in range(4):
        rest = sum(score[i] for i in lost)
        new = dict.fromkeys(ids, 0.15 / 41 + 0.85 * rest / 41)
        for i in ids:
            for j in near[i]:
                if j in new:
                    new[j] += 0.85 * score[i] / len(near[i])
        score = new
    rows = iterate.pagerank(kg, rounds=4, tolerance=0.0).collect()
    assert {r["id"]: r["score"] for r in rows} == pytest.approx(score, abs=1e-12)
    assert {r["id"]: r["degree"] for r in rows} == {i: len(near[i]) for i in ids}
    assert 0 < max(sizes) <= 8  # blocks, not nodes
