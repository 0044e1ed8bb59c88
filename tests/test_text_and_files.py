from pyspark.sql import functions as F

from graphloom.functions import quality as Q
from graphloom.functions import text as X
from graphloom.operators import code, docs, semantic, sqlcode
from graphloom.sources import files, nodelink, web


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("r")).first().r


def test_make_id(spark):
    rows = [("Foo", "bar.Baz"), ("_x_", ""), ("中文", "é!"), ("__", "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(X.make_id("a", "b")).collect()] == ["foo_bar_baz", "x", "中文_é", "a"]
    assert [code.identifier(*r) for r in rows] == ["foo_bar_baz", "x", "中文_é", "a"]


def test_text_helpers(spark):
    assert one(spark, "a\r\nb\n", F.size(X.lines_of("v"))) == 2
    assert one(spark, " a \n\n b ", X.compact_text("v", 2)) == "a\n…"
    assert one(spark, "abcde", X.estimate_tokens("v")) == 2
    assert one(spark, "<p>a</p><script>x</script>", X.strip_html("v")) == "a"
    assert one(spark, "crates/geo/src/lib.rs", X.disambiguated(F.lit("lib"), "v")) == "geo::lib"
    assert one(spark, "src/lib.rs", X.disambiguated(F.lit("lib"), "v")) == "src::lib"


def test_quality(spark):
    rows = [("a", "A", "src/a.go"), ("b", "B", "src/b_test.go"), ("c", "C", "./docs/readme.md"), ("d", "D", "x/gen/a.pb.go")]
    got = {r.id: (r.source_kind, round(r.source_priority, 4)) for r in Q.annotate(spark.createDataFrame(rows, "id string, label string, source_file string")).collect()}
    assert got == {"a": ("source", 1.0), "b": ("test", 0.58), "c": ("project_context", 1.25), "d": ("generated", 0.42)}
    assert one(spark, "// Code generated by x. DO NOT EDIT.", Q.looks_generated("v"))
    assert one(spark, "x" * 600, Q.looks_minified("v")) and not one(spark, "", Q.looks_minified("v"))


def test_file_rules(spark):
    df = spark.createDataFrame([(p,) for p in ("src/a.py", "node_modules/a.js", ".git/x.py", ".planning/p.md", "conf/my-secret.yml", "a/.env", "src/tokenizer.rs")], "path string")
    assert {r.path for r in df.where(files.in_noise()).collect()} == {"node_modules/a.js", ".git/x.py"}
    assert {r.path for r in df.where(files.is_sensitive()).collect()} == {"conf/my-secret.yml", "a/.env"}
    ig = {r.path: r.ignored for r in files.ignored(df, ["*.py", "conf/"], ["!src/a.py"]).collect()}
    assert not ig["src/a.py"] and ig[".git/x.py"] and ig["conf/my-secret.yml"]
    text = "arXiv preprint\nabstract: we propose"
    d = spark.createDataFrame([("p.md", text), ("q.md", "hello"), ("r.xyz", "")], "path string, text string")
    assert [r[0] for r in d.select(files.classify("path", "text")).collect()] == ["paper", "document", None]


def test_detect_and_changes(spark, tmp_path):
    for p, t in (("a.py", "x = 1"), ("b.md", "two words"), ("node_modules/c.js", "no"), ("k/x.pem", "K=1"), ("z.unknown", "?")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    found = files.detect(files.scan(spark, str(tmp_path)))
    rows = {r.path: (r.file_type, r.words, r.sensitive) for r in found.collect()}
    assert rows["a.py"] == ("code", 3, False) and rows["b.md"] == ("document", 2, False) and rows["k/x.pem"][2]
    assert set(rows) == {"a.py", "b.md", "k/x.pem"}
    s = files.summary(found).first()
    assert (s.total_files, s.total_words, s.needs_graph, s.warning) == (2, 5, True, None)


def test_markdown(spark):
    text = "intro\n# One\nbody\n\n```\n# no\n```\n## `Two`\nend\n"
    nodes, edges = docs.markdown(spark.createDataFrame([("d.md", text)], "path string, text string"))
    assert sorted((r.label, r.source_location, r.level, r.doc_text) for r in nodes.collect()) == [("One", "L2", 1, "body"), ("Two", "L8", 2, "end")]
    assert sorted(r.relation for r in edges.collect()) == ["contains", "contains", "next_section"]


SOURCES = {
    "a.py": "import os\nclass A:\n    def go(self):\n        return helper()\n\ndef helper():\n    return 1\n",
    "a.rs": "use std::fs;\npub struct A {}\nimpl Run for A {}\nfn helper() {}\npub fn go() {\n helper(); }\n",
    "a.go": 'import "fmt"\ntype A struct {}\nfunc helper() {}\nfunc (a A) go1() {\n helper() }\n',
    "a.ts": "import { B } from './b';\nexport class A {}\nfunction helper() {}\nexport function go() {\n helper(); }\n",
    "a.java": "import x.B;\npublic class A {\n  private int helper() { return 1; }\n  public int go() {\n return helper(); }\n}\n",
    "a.c": "#include <stdio.h>\nstruct A { int x; };\nint helper(int a) {\n return a; }\nint go(void) {\n return helper(1); }\n",
    "a.rb": "require 'set'\nclass A\n  def helper()\n  end\n  def go\n    helper()\n  end\nend\n",
    "a.cs": "using System;\npublic class A {\n  int helper() { return 1; }\n  int go() {\n return helper(); }\n}\n",
    "a.kt": "import x.B\nclass A\nfun helper() = 1\nfun go() =\n helper()\n",
    "a.swift": "import Foundation\nclass A {}\nfunc helper() {}\nfunc go() {\n helper() }\n",
}


def test_extract_languages(spark):
    nodes, edges = code.extract(spark.createDataFrame(list(SOURCES.items()), "path string, text string"))
    e = {(r.source_file, r.relation) for r in edges.collect()}
    n = {(r.source_file, r.label) for r in nodes.collect()}
    for path in SOURCES:
        assert {(path, "defines"), (path, "imports"), (path, "calls")} <= e, path
        assert (path, "A") in n, path
    ids = {r.id for r in nodes.collect()}
    assert all(r.source in ids and r.target in ids for r in edges.collect())
    assert ("a.rs", "implements") in e


def test_sql():
    text = "-- x;\nCREATE TABLE app.users (id int primary key, team_id int REFERENCES teams(id), name varchar(10));\nCREATE VIEW v AS SELECT * FROM users u JOIN other.t ON true;\nnonsense here;\nINSERT INTO log SELECT 1 FROM v;\n"
    nodes, edges = sqlcode.from_sql("db/schema.sql", text)
    got = {(e["source"], e["relation"], e["target"]) for e in edges}
    base = "db_schema_sql"
    assert (f"{base}_v", "reads_from", f"{base}_app_users") in got
    assert (f"{base}_v", "reads_from", "sql_other_t") in got
    assert (f"{base}_app_users", "references", "sql_teams") in got
    assert (base, "writes_to", "sql_log") in got
    assert {n["label"] for n in nodes} >= {"app.users.id", "app.users.name", "v"}
    ids = {n["id"] for n in nodes}
    assert all(e["source"] in ids and e["target"] in ids for e in edges)


def test_register_extractor():
    code.register_extractor(".foo", lambda p, t: ([{"id": p}], []))
    assert code.extract_one("x.foo", "") == ([{"id": "x.foo"}], [])


def test_replies(spark):
    df = spark.createDataFrame([("a", 'x {"entities": [{"name": "N"}], "relationships": []} y'), ("b", "no json"), ("c", '```json\n{"entities": []}\n```')], "path string, reply string")
    nodes, edges = semantic.parse_replies(df)
    assert [r.id for r in nodes.collect()] == ["a_n"] and edges.count() == 0
    asked = semantic.ask(spark.createDataFrame([("d", "Alpha meets Beta")], "path string, text string"), semantic.capitalised_provider)
    assert {r.label for r in semantic.parse_replies(asked)[0].collect()} == {"Alpha", "Beta"}


def test_nodelink(spark, tmp_path):
    doc = '{"nodes": [{"id": "a", "label": "A"}, {"id": "a", "label": "B"}, {"id": "b"}], "links": [{"source": "a", "target": "b"}, {"source": "a", "target": "zz"}]}'
    kg = nodelink.parse(spark.createDataFrame([(doc,), ("{}",)], "value string"))
    assert {r.id: r.label for r in kg.nodes.collect()} == {"a": "A", "b": None}
    assert [(r.weight, r.confidence_score) for r in kg.edges.collect()] == [(1.0, 1.0)]
    nodelink.write(kg, str(tmp_path / "g.json"))
    again = nodelink.read(spark, str(tmp_path / "g.json"))
    assert again.nodes.count() == 2 and again.edges.count() == 1


def test_urls():
    good = ["http://example.com/a", "https://8.8.8.8/"]
    bad = ["ftp://example.com", "http://localhost", "http://127.0.0.1", "http://10.1.2.3", "http://2130706433/", "http://0x7f.1/", "http://0177.0.0.1/", "http://[::1]/", "http://169.254.1.1", "http://100.64.0.1", "nonsense", None]
    assert all(map(web.is_safe, good)) and not any(map(web.is_safe, bad))
    assert web.fnv1a64_of("") == 0xCBF29CE484222325 - (1 << 64)
    assert web.safe_path("a/b", "/r") and not web.safe_path("../x", "/r")
