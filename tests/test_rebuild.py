"""A watched folder: edits, additions, deletions and restarts against a full build."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.sources import folder
from graphloom.streaming import rebuild


def put(root, path, text):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)


def once(spark, tmp):
    q = rebuild.watched(spark, str(tmp / "src"), str(tmp / "store"), str(tmp / "cp"), once=True)
    q.awaitTermination(240)
    return rebuild.Store(spark, str(tmp / "store"))


def plain(kg):
    n = sorted((r.id, r.label, r.source_file, r.node_type, r.community) for r in kg.nodes.collect())
    e = sorted((r.source, r.target, r.relation, r.confidence, r.source_file) for r in kg.edges.collect())
    return n, e


def test_grown_graph_equals_full_build(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    put(src, "pkg/a.py", "from pkg.b import Bee\nclass Ant:\n    def go(self):\n        return make()\ndef make():\n    return 1\n")
    put(src, "pkg/b.py", "class Bee:\n    pass\n")
    put(src, "web/c.ts", "import { Dee } from 'd';\nexport class Cee {}\n")
    put(src, ".planning/p.py", "def plan():\n    return 1\n")
    for noise in ("node_modules/x.js", ".git/y.py", "my_venv/z.py", ".hidden/h.py"):
        put(src, noise, "class Noise {}\n")
    put(src, "notes.txt", "no code")
    put(src, "secret.py", "KEY = 1\n")
    store = once(spark, tmp_path)
    assert store.current()["facts"] == {"parsed": 4, "changed": 4} and store.current()["version"] == 1
    assert plain(store.graph()) == plain(rebuild.full(spark, str(src)))
    assert {r.source_file for r in store.read("nodes").collect()} == {"pkg/a.py", "pkg/b.py", "web/c.ts", ".planning/p.py"}

    put(src, "web/d.ts", "export class Dee {}\n")  # added: c's import finds it
    put(src, "pkg/a.py", "class Ant:\n    def stay(self):\n        return 2\n")  # changed
    os.remove(src / "pkg/b.py")  # deleted
    os.utime(src / ".planning/p.py", (1, 1))  # touched, same content
    real = rebuild.derive
    monkeypatch.setattr(rebuild, "derive", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        once(spark, tmp_path)  # breaks before its commit
    assert store.current()["version"] == 1
    monkeypatch.setattr(rebuild, "derive", real)
    store = once(spark, tmp_path)
    assert store.current()["facts"] == {"parsed": 2, "changed": 3} and store.current()["version"] == 2
    assert plain(store.graph()) == plain(rebuild.full(spark, str(src)))
    assert any(r.relation == "uses" and r.source_file == "web/c.ts" for r in store.read("edges").collect())

    assert once(spark, tmp_path).current()["version"] == 2  # nothing changed
    rebuild.rebuild(store, spark.createDataFrame([], folder.SCHEMA), store.current()["batch"])
    assert store.current()["version"] == 2  # a batch that comes again
    put(src, "pkg/a.py", "def f3():\n    return 1\n")
    store = once(spark, tmp_path)
    assert store.current()["version"] == 3 and store.current()["facts"]["parsed"] == 1
    assert len([x for x in os.listdir(tmp_path / "store") if x.startswith("v")]) == rebuild.KEEP
    assert len(os.listdir(f"{tmp_path}/cp-snapshots")) <= 2


def test_folder_is_listed_without_noise(spark, tmp_path, monkeypatch):
    for path in ("a/x.py", "a/y.md", ".planning/z.py", "node_modules/n.js", "a/.venv/v.py", "a/b/c/deep.py"):
        put(tmp_path, path, path)
    opened = []
    real = folder.is_noise
    monkeypatch.setattr(folder, "is_noise", lambda d: opened.append(d) or real(d))
    assert sorted(folder.listing(str(tmp_path))) == [".planning/z.py", "a/b/c/deep.py", "a/x.py", "a/y.md"]
    assert "n.js" not in opened and set(opened) == {"a", ".planning", "node_modules", ".venv", "b", "c"}
    df = folder.files(spark, str(tmp_path))
    assert {(r.path, bytes(r.content).decode(), r.length) for r in df.collect()} == {(p, p, len(p)) for p in (".planning/z.py", "a/b/c/deep.py", "a/x.py", "a/y.md")}
    some = df.where(F.col("path").endswith(".py") & (F.col("length") > 6))
    assert {r.path for r in some.collect()} == {".planning/z.py", "a/b/c/deep.py"}
    reader = folder.FolderReader({"root": str(tmp_path)})
    left = list(reader.pushFilters([folder.StringEndsWith(("path",), ".py"), folder.GreaterThan(("length",), 6)]))
    assert not left and [f[0] for p in reader.partitions() for f in p.files] == [".planning/z.py", "a/b/c/deep.py"]
    assert folder.files(spark, str(tmp_path / "none")).count() == 0


def test_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(folder, "PART_BYTES", 10)
    got = folder.parts([(str(i), "added", n, 0) for i, n in enumerate((4, 4, 4, 30, 1))])
    assert [[f[2] for f in p.files] for p in got] == [[4, 4], [4], [30], [1]]
