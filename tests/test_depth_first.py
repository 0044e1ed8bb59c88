"""Depth-first search against an explicit stack, and a question's text."""

import random

import pytest

from graphloom.operators import traverse
from graphloom.tools import Tools
from tests.test_graph import graph


def stack_search(near, starts, depth):
    """Depths by first push; the least neighbour is popped first, of starts the last."""
    pushed, stack, order = {}, [], []
    for s in starts:
        if s in near:
            pushed.setdefault(s, 0)
            stack.append((s, 0))
    steps = []
    while stack:
        at, d = stack.pop()
        if at not in order:
            order.append(at)
        if d >= depth:
            continue
        for x in sorted(near[at], reverse=True):
            steps.append((at, x))
            if x not in pushed:
                pushed[x] = d + 1
                stack.append((x, d + 1))
    return order, pushed, set(steps)


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_stack(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(16)]
    edges = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(22)]
    near = {i: {t for s, t in edges if s == i} | {s for s, t in edges if t == i} for i in ids}
    kg = graph(spark, ids, edges)
    starts, depth = [*rnd.sample(ids, 3), "gone"], 2 + seed % 3
    order, depths, steps = stack_search(near, starts, depth)
    tree = traverse.dfs_tree(kg, starts, depth)
    rows = tree.orderBy("place").collect()
    assert [r["id"] for r in rows] == order
    assert {r["id"]: r["depth"] for r in rows} == depths
    assert {(r["src"], r["dst"]) for r in traverse.steps_of(kg, tree, depth).collect()} == steps


def test_deep_first_reaches_less(spark):
    kg = graph(spark, "abcdx", [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "x")])
    assert {r["id"]: r["depth"] for r in traverse.dfs_tree(kg, ["a"], 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    kg = graph(spark, "abcsx", [("a", "b"), ("b", "c"), ("s", "c"), ("c", "x")])
    reached = {r["id"]: r["depth"] for r in traverse.dfs_tree(kg, ["s", "a"], 2).collect()}
    assert reached == {"a": 0, "s": 0, "b": 1, "c": 2}  # c was pushed deep from a, so x is not reached from s
    assert traverse.bfs(kg, ["s", "a"], 2).count() == 5
    assert traverse.dfs_tree(kg, [], 2).count() == 0 and traverse.dfs_tree(kg, ["a"], 0).count() == 1


def test_question_text(spark):
    kg = graph(spark, ["a", "b", "bridge", "c"], [("bridge", "a"), ("bridge", "a"), ("bridge", "b"), ("b", "c")], {"a": 0, "b": 0, "bridge": 0, "c": 1})
    for first in (False, True):
        text = Tools(kg).query("the bridge", depth_first=first)
        assert text.startswith("=== Knowledge Graph Context (4 nodes, ") and text.count("- **") == 4
        assert text.count("- bridge -> a\n") == 1 and "- b -> c\n" in text and "truncated" not in text
        short = Tools(kg).query("the bridge", depth_first=first, budget=20)
        assert short.endswith("(truncated due to token budget)\n") and "## Relationships" not in short
    assert Tools(kg).query("zebra of") == "No matching nodes found."
