"""Ignore files as git reads them, papers by bytes, listings of differences, index validity, idle services."""

import json
import re
import time

import pytest

from graphloom.graph import KG
from graphloom.operators import analyze as A
from graphloom.operators import build, docs, export, search
from graphloom.sources import files
from graphloom.streaming import watch
from tests.test_graph import LINES, graph


@pytest.mark.parametrize(
    "rule, yes, no",
    [
        ("a[bc].py", ["ab.py", "x/ac.py"], ["ad.py", "a[bc].py"]),
        ("a[!b-d]", ["ae", "ax/y"], ["ab", "ac", "a/x"]),
        ("[]x]", ["]", "x"], ["y"]),
        (r"\#note", ["#note", "d/#note"], ["note"]),
        (r"\!keep", ["!keep"], ["keep"]),
        (r"a\*b", ["a*b"], ["axb"]),
        ("end   ", ["end"], ["end   "]),
        (r"end\ ", ["end "], ["end"]),
        ("a[b", ["a[b"], ["ab"]),
        ("/top/*.py", ["top/x.py"], ["d/top/x.py", "top/d/x.py"]),
        ("**/deep/", ["a/deep/x", "deep/x"], ["deep"]),
    ],
)
def test_ignore_rules(rule, yes, no):
    regex, negated = files.rule_regex(rule)
    assert not negated and all(re.search(regex, p) for p in yes) and not any(re.search(regex, p) for p in no)


def test_rules_that_are_none_or_take_back():
    assert files.rule_regex("# x") is None and files.rule_regex("   ") is None and files.rule_regex("!a")[1] and files.rule_regex("!!a")[0].endswith("!a(?:/.*)?$")


def test_papers_by_their_first_bytes(spark):
    signs = "arxiv doi abstract"
    rows = [("a.md", signs), ("b.md", "é" * 1480 + " " + signs), ("c.md", "é" * 1495 + " " + signs), ("d.md", "e" * 2970 + " " + signs)]
    got = {r.path: r.k for r in spark.createDataFrame(rows, "path string, text string").select("path", files.classify("path", "text").alias("k")).collect()}
    assert got == {"a.md": "paper", "b.md": "paper", "c.md": "document", "d.md": "paper"}
    raw = spark.createDataFrame([(bytearray(b"ok \xff\xfe"),)], "content binary")
    assert raw.select(files.readable(raw.content)).first()[0].startswith("ok ")


def test_listings_of_differences(spark):
    old, new = graph(spark, ["a", "b"], [("a", "b")]), graph(spark, ["a", "c"], [("a", "c"), ("a", "c", "uses")])
    lines = [r.line for r in build.diff_lines(old, new).orderBy("ord").collect()]
    assert lines == ["+ node c", "- node b", "+ edge a --calls--> c", "+ edge a --uses--> c", "- edge a --calls--> b"]
    rows = [json.loads(r.line) for r in build.diff_lines(old, new, "json").orderBy("ord").collect()]
    assert rows[0] == {"change": "added", "kind": "node", "id": "c"} and rows[-1] == {"change": "removed", "kind": "edge", "source": "a", "target": "b", "relation": "calls"}


def test_a_stale_index_is_refused(spark):
    kg = graph(spark, *LINES)
    index = spark.createDataFrame([("north", [1.0, 0.0])], "node_id string, embedding array<double>")
    facts = search.index_facts(kg, "m", 2)
    assert search.checked_index(index, facts, kg, "m", 2) is index
    shuffled = KG(kg.nodes.orderBy("label", ascending=False).repartition(3), kg.edges.repartition(5))
    assert search.fingerprint(shuffled) == facts["fingerprint"]
    fewer = KG(kg.nodes.where("id <> 'depot'"), kg.edges.where("target <> 'depot'"))
    gone, none = KG(kg.nodes.where("id = 'depot'"), kg.edges.where("target = 'depot'")), KG(kg.nodes.where("false"), kg.edges.where("false"))
    assert search.moved_digest(search.set_digest(kg), none, gone) == search.set_digest(fewer)
    assert search.moved_digest(search.set_digest(fewer), gone, none) == search.set_digest(kg)
    for args in ((fewer, "m", 2), (kg, "other", 2), (kg, "m", 3)):
        with pytest.raises(ValueError, match="stale"):
            search.checked_index(index, facts, *args)
    with pytest.raises(ValueError, match="unsound"):
        search.checked_index(index.unionByName(spark.createDataFrame([("x", [float("nan"), 0.0])], index.schema)), facts, kg, "m", 2)


def test_an_idle_timer_fires_without_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"key": k, "change": c}) for k, c in rows))
    put("1.json", [("open", 1), ("brief", 1), ("brief", -1)])
    seen = []
    stream = watch.idle(spark.readStream.schema("key string, change long").json(str(tmp_path / "in")), 2)
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").foreachBatch(lambda df, i: seen.extend(tuple(r) for r in df.collect())).start()
    try:
        until = time.time() + 90
        while ("brief", 0, True) not in seen and time.time() < until:
            time.sleep(0.5)
        assert ("brief", 0, True) in seen and ("open", 1, False) in seen
        assert not any(k == "open" and idle for k, _, idle in seen)
    finally:
        q.stop()


def test_project_documents(spark):
    rows = [
        ("p", "Purpose", "README.md", "concept", {"doc_level": "1", "doc_text": "why\nhow"}), ("a", "Architecture goals", "docs/x.md", "concept", {"doc_level": "2"}), ("b", "Other", "docs/PRODUCT.md", "concept", {"doc_level": "3"}),
        ("deep", "Purpose", "README.md", "concept", {"doc_level": "4"}), ("none", "Purpose", "README.md", "concept", None), ("odd", "Purpose", "README.md", "concept", {"doc_level": "one"}),
        ("code", "Purpose", "README.md", "class", {"doc_level": "1"}), ("src", "Purpose", "src/a.md", "concept", {"doc_level": "1"}),
    ]
    nodes = spark.createDataFrame([(*r, 0) for r in rows], "id string, label string, source_file string, node_type string, extra map<string,string>, community int")
    edges = spark.createDataFrame([], "source string, target string, relation string, confidence string, confidence_score double, weight double, edge_seq long")
    kg = KG(nodes, edges)
    assert [(r["id"], r["rank"]) for r in A.project_documents(kg).collect()] == [("p", 49), ("a", 43), ("b", 17)]
    assert A.project_documents(KG(nodes.drop("extra"), edges)).count() == 0
    texts = spark.createDataFrame([("README.md", "# Purpose\n\nTo join.\n\n#### Purpose in depth\n\nNo.\n")], "path string, text string")
    found = A.project_documents(KG(docs.markdown(texts)[0], edges)).collect()
    assert [(r["label"], r["rank"], r["doc_text"]) for r in found] == [("Purpose", 49, "To join.")]
    pack = export.context_pack(kg)
    assert pack.index("### Purpose") < pack.index("### Architecture goals") and "  why\n  how\n" in pack
