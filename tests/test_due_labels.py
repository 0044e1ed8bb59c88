import random

from pyspark.sql import functions as F

from graphloom.graph import KG
from graphloom.operators import community
from graphloom.workspace import Scratch


def test_labels_are_numbers_and_go_as_in_plain_rounds(spark, monkeypatch):
    kept, was = [], Scratch.renewed
    monkeypatch.setattr(Scratch, "renewed", lambda self, df, name: kept.append((name, dict((found := was(self, df, name)).dtypes))) or found)
    rng = random.Random(6)
    ids = [f"n{i:02}" for i in range(24)]
    edges = [(a, b, float(rng.randint(1, 4))) for a, b in (rng.sample(ids[: rng.choice((6, 23))], 2) for _ in range(60))] + [("n00", "n00", 9.0), ("n00", "gone", 9.0)]
    kg = KG(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "source string, target string, weight double"))
    near = {i: {} for i in ids}
    for a, b, w in edges:
        if a != b and b in near:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    turns = {r.id: r.h for r in kg.nodes.select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) for k in range(30)]).alias("h")).collect()}
    label, quiet, k = {i: i for i in ids}, 0, 0
    while True:
        goes = {}
        for i in ids:
            if turns[i][k // 2] == k % 2 and near[i]:
                w = {}
                for j, x in near[i].items():
                    w[label[j]] = w.get(label[j], 0) + x
                best = max((x, c) for c, x in w.items())
                if best[0] > w.get(label[i], 0):
                    goes[i] = best[1]
        quiet = 0 if goes else quiet + 1
        if quiet >= 2 and k % 2:
            break
        label.update(goes)
        k += 1
    part, seen = {}, set()
    for i in ids:
        todo = [i] if i not in seen else []
        seen.add(i)
        while todo:
            x = todo.pop()
            part[x] = i
            new = {j for j in near[x] if label[j] == label[x]} - seen
            seen |= new
            todo += new
    found = {r.node_id: r.community for r in community.propagate(kg).collect()}
    assert set(found) == set(ids)
    assert {(a, b): found[a] == found[b] for a in ids for b in ids} == {(a, b): part[a] == part[b] for a in ids for b in ids}
    assert {t["c"] for name, t in kept if name == "labels"} == {"bigint"}
