"""Source code to nodes and edges: island grammars by language, and the syntax tree for Python."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import ascii_lower
from graphloom.operators import island
from graphloom.workspace import written

# Languages by extension.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "php": "php",
    "swift": "swift", "lua": "lua", "toc": "lua", "zig": "zig", "ps1": "powershell", "ex": "elixir", "exs": "elixir", "m": "objc", "mm": "objc", "jl": "julia", "dart": "dart", "sql": "sql",
}

Rows = tuple[list[dict], list[dict]]
_custom: dict[str, Callable[[str, str], Rows]] = {}


def register_extractor(extension: str, fn: Callable[[str, str], Rows]) -> None:
    """``fn(path, text)`` gives node and edge rows for files of this extension."""
    _custom[extension.lstrip(".")] = fn


def identifier(*parts: str) -> str:
    """The same identifier as ``functions.text.make_id``."""
    s = "_".join(p.strip("_.") for p in parts if p)
    return re.sub(r"[\W_]+", "_", s).strip("_").lower()


class _Out:
    def __init__(self, path: str) -> None:
        self.path, self.nodes, self.edges = path, [], []
        self.ids: set[str] = set()
        self.links: set[tuple[str, str, str]] = set()
        name = path.rsplit("/", 1)[-1]
        self.file = identifier(path)
        self.node(self.file, name.rsplit(".", 1)[0] or name, "file", None)

    def node(self, id_: str, label: str, kind: str, line: int | None) -> str:
        if id_ not in self.ids:
            self.ids.add(id_)
            self.nodes.append({"id": id_, "label": label, "source_file": self.path, "source_location": f"L{line}" if line else None, "node_type": kind, "node_seq": len(self.nodes)})
        return id_

    def edge(self, a: str, b: str, relation: str, confidence: str = "EXTRACTED") -> None:
        if (a, b, relation) not in self.links:
            self.links.add((a, b, relation))
            score = {"EXTRACTED": 1.0, "INFERRED": 0.7, "AMBIGUOUS": 0.4}[confidence]
            self.edges.append({"source": a, "target": b, "relation": relation, "confidence": confidence, "confidence_score": score, "weight": 1.0, "source_file": self.path, "edge_seq": len(self.edges)})

    def imported(self, name: str, line: int, kind: str = "module", relation: str = "imports") -> None:
        self.edge(self.file, self.node(identifier(self.path, "import", name), name, kind, line), relation)

    def calls(self, functions: list[tuple[str, str, str]], bare: bool = False) -> None:
        """``(name, id, body)``: a function's name before a bracket in another's body; ``bare``: or without one."""
        known: dict[str, list[str]] = {}
        for name, callee, _ in functions:
            known.setdefault(name, []).append(callee)
        for _, caller, body in functions:
            said = dict.fromkeys(re.findall(r"(?<!\w)(\w+[?!=]?)" + ("" if bare else r"\s*\("), body))
            for name in said:
                for callee in known.get(name, ()):
                    if callee != caller:
                        self.edge(caller, callee, "calls", "INFERRED")

    def rows(self) -> Rows:
        return self.nodes, self.edges


def from_python(path: str, text: str) -> Rows:
    """By the syntax tree; functions are labelled ``name()``, methods ``.name()``."""
    tree, out = ast.parse(text), _Out(path)
    functions: list[tuple[str, str, str]] = []
    lines = text.splitlines()

    def walk(body: list, parent: str, in_class: bool) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                cid = out.node(identifier(path, n.name), n.name, "class", n.lineno)
                out.edge(parent, cid, "defines")
                walk(n.body, cid, True)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                fid = identifier(parent, n.name) if in_class else identifier(path, n.name)
                out.node(fid, f".{n.name}()" if in_class else f"{n.name}()", "method" if in_class else "function", n.lineno)
                out.edge(parent, fid, "defines")
                functions.append((n.name, fid, "\n".join(lines[n.lineno : n.end_lineno])))
            elif isinstance(n, ast.Import):
                for a in n.names:
                    out.imported(a.name, n.lineno)
            elif isinstance(n, ast.ImportFrom):
                for a in n.names:
                    out.imported(f"{n.module}.{a.name}" if n.module else a.name, n.lineno)

    walk(tree.body, out.file, False)
    out.calls(functions)
    return out.rows()


#: What the quick way says of imports, where it differs: relation or kind of node by language.
QUICK = {"c": ("includes", "module"), "cpp": ("includes", "module"), "objc": ("includes", "module"), "csharp": ("imports", "namespace"), "go": ("imports", "package")}


def from_islands(path: str, text: str, language: str, quick: bool = False) -> Rows:
    """By the language's island grammar.

    Functions are labelled ``name()``, methods ``.name()``; a method's id is that
    of its type and its name. ``quick``: as where there is no syntax tree, ids of
    methods don't name their types, and what C includes is included, not imported.
    """
    out, starts = _Out(path), [i for i, c in enumerate(text) if c == "\n"]
    line = lambda at: bisect_left(starts, at) + 1
    functions, found = [], island.declarations(text, language)
    types = {f.name: f.kind for f in found if f.what == "type"}
    for f in found:
        if f.what == "type":
            owner = identifier(path, f.inside) if f.inside in types and not quick else out.file
            out.edge(owner, out.node(identifier(path, f.name), f.name, f.kind, line(f.at)), "defines")
        elif f.what == "function":
            owner = identifier(path, f.inside) if f.inside is not None and not quick else None
            fid = out.node(identifier(owner, f.name) if owner else identifier(path, f.name), f".{f.name}()" if f.kind == "method" else f"{f.name}()", f.kind, line(f.at))
            out.edge(owner if owner and f.inside in types else out.file, fid, "defines")
            functions.append((f.name, fid, f.body))
        elif f.what == "import":
            relation, kind = QUICK.get(language, ("imports", f.kind)) if quick else ("imports", f.kind)
            out.imported(f.name, line(f.at), kind, relation)
    for f in found:
        if f.what == "implements" and f.inside in types:
            out.edge(identifier(path, f.inside), out.node(identifier(path, f.name), f.name, "trait", line(f.at)), "implements")
    out.calls(functions, bare=language == "ruby")
    return out.rows()


def extract_one(path: str, text: str, quick: bool = False) -> Rows:
    """Rows of one file: a registered extractor, SQL, the Python tree, else islands."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in _custom:
        return _custom[ext](path, text)
    language = LANGUAGES.get(ext)
    if language is None:
        return [], []
    if language == "sql":
        from graphloom.operators.sqlcode import from_sql

        return from_sql(path, text)
    if language == "python" and not quick:
        try:
            return from_python(path, text)
        except (SyntaxError, ValueError, RecursionError):
            pass
    return from_islands(path, text, language, quick)


NODE = "id string, label string, source_file string, source_location string, node_type string, node_seq long"
EDGE = "source string, target string, relation string, confidence string, confidence_score double, weight double, source_file string, edge_seq long"


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files(path, text)`` → nodes and edges, deduplicated within each file.

    Files are dealt out first: a small table of them is read by one task, and parsing takes far longer than reading.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for pdf in batches:
            rows = [extract_one(p, t or "") for p, t in zip(pdf["path"], pdf["text"], strict=True)]
            yield pd.DataFrame({"nodes": [r[0] for r in rows], "edges": [r[1] for r in rows]})

    both = files.select("path", "text").repartition(parts, "path").mapInPandas(run, f"nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>")
    both = written(both, "extracted", "zstd")  # so that files are parsed once, for nodes and edges
    return both.select(F.inline("nodes")), both.select(F.inline("edges"))


def language_of(path: str = "path"):
    """The language of a path's extension; null for others."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return known[ascii_lower(F.regexp_extract(path, r"\.([^./]+)$", 1))]


def calls_by_word(functions: DataFrame) -> DataFrame:
    """``functions(path, id, name, body)`` → ``(path, source, target)``: a whole name before a bracket.

    Called names are taken out of each body once and joined, so work follows the text, not the pairs.
    """
    called = functions.select("path", F.col("id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(\w+)\s*\("), 1))).alias("name"))
    known = functions.select("path", F.col("id").alias("target"), "name")
    return called.join(known, ["path", "name"]).where("source <> target").select("path", "source", "target").distinct()


def calls_by_part(functions: DataFrame) -> DataFrame:
    """The same, where any text that ends in the name counts, so ``add(`` is found in ``readd(``."""
    body = F.lower("body")
    words = F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(r"(\w+)\("), 1))).alias("word")
    called = functions.select("path", F.col("id").alias("source"), words)
    known = functions.select("path", F.col("id").alias("target"), F.lower("name").alias("name"))
    ends = called.withColumn("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.length("word")))))
    return ends.join(known, ["path", "name"]).where("source <> target").select("path", "source", "target").distinct()
