from graphloom.sources.tables import STAR_EDGES, derived, star


def _keys(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line.split("], [")[0] for line in plan.splitlines() if "Aggregate" in line]


def test_pairs_are_distinct_as_numbers(spark, sf_dir):
    edges, plain = star(spark, sf_dir).edges, derived(spark, sf_dir, STAR_EDGES)
    assert edges.columns == plain.columns and edges.count() == plain.count()
    assert edges.exceptAll(plain).isEmpty() and plain.exceptAll(edges).isEmpty()
    assert all("concat" not in keys for keys in _keys(edges))
