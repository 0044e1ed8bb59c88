"""Graphs as text in common formats, lines made by columns and written in order."""

from __future__ import annotations

import html as _html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import cypher_escape, sanitize_filename, sanitize_var, xml_escape
from graphloom.graph import KG
from graphloom.operators import analyze as A
from graphloom.sources import linefiles
from graphloom.workspace import ranked


def numbered(nodes: DataFrame) -> DataFrame:
    """``(id, n)``: places by id, dealt by ranges so that no task sorts everything."""
    return nodes.select("id").orderBy("id").withColumn("n", F.monotonically_increasing_id())


def graphml(kg: KG) -> DataFrame:
    """``(ord, line)`` of a GraphML document's body."""
    e = xml_escape
    n = kg.nodes.select(F.concat(F.lit("n"), "id").alias("ord"), F.format_string('<node id="%s"><data key="label">%s</data><data key="type">%s</data></node>', e("id"), e("label"), e("node_type")).alias("line"))
    x = kg.edges.select(F.format_string("x%020d", "edge_seq").alias("ord"), F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data><data key="weight">%s</data></edge>', e("source"), e("target"), e("relation"), F.col("weight")).alias("line"))
    return n.unionByName(x)


def cypher(kg: KG) -> DataFrame:
    """``(ord, line)``: CREATE statements; equal variable names get numbers."""
    named = kg.nodes.select("id", "label", "node_type", sanitize_var("id").alias("v"))
    w = W.partitionBy("v")
    place = F.row_number().over(w.orderBy("id")) - 1
    named = named.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("i", place).withColumn("var", F.when(F.col("k") > 1, F.concat("v", F.lit("_"), "i")).otherwise(F.col("v")))
    n = named.select(F.concat(F.lit("n"), "id").alias("ord"), F.format_string("CREATE (%s:%s {id: '%s', label: '%s'})", "var", F.initcap("node_type"), cypher_escape("id"), cypher_escape("label")).alias("line"))
    a, b = named.select(F.col("id").alias("source"), F.col("var").alias("a")), named.select(F.col("id").alias("target"), F.col("var").alias("b"))
    x = kg.edges.join(a, "source").join(b, "target").select(F.format_string("x%020d", "edge_seq").alias("ord"), F.format_string("CREATE (%s)-[:%s {confidence: '%s'}]->(%s)", "a", F.upper(sanitize_var("relation")), "confidence", "b").alias("line"))
    return n.unionByName(x)


def circle(kg: KG) -> DataFrame:
    """``(id, label, x, y)``: places of all nodes on a circle, in order of ids."""
    places = ranked(kg.nodes.select("id", "label"), "id")
    rows = places.crossJoin(F.broadcast(places.agg(F.count(F.lit(1)).alias("n"))))  # one row
    angle = F.col("i") * 2 * 3.141592653589793 / F.col("n") - 3.141592653589793 / 2
    return rows.select("id", "label", F.round(400 + 350 * F.cos(angle), 3).alias("x"), F.round(400 + 350 * F.sin(angle), 3).alias("y"))


def svg(kg: KG) -> str:
    """A picture; labels are drawn for fifty nodes at most."""
    at = {r["id"]: r for r in circle(kg).toLocalIterator()}
    edges = [e for e in kg.edges.orderBy("edge_seq").select("source", "target").toLocalIterator() if e["source"] in at and e["target"] in at]
    out = ['<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 800 800">']
    out += [f'<line x1="{at[e["source"]]["x"]}" y1="{at[e["source"]]["y"]}" x2="{at[e["target"]]["x"]}" y2="{at[e["target"]]["y"]}" stroke="#999"/>' for e in edges]
    for r in at.values():
        out.append(f'<circle cx="{r["x"]}" cy="{r["y"]}" r="5"/>')
        if len(at) <= 50:
            out.append(f'<text x="{r["x"]}" y="{r["y"]}">{_html.escape(r["label"] or "")}</text>')
    return "\n".join([*out, "</svg>"])


#: A page draws its nodes on a circle and its edges as lines, names by the nodes.
_HEAD = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><canvas id="graph" width="900" height="900"></canvas><ul id="list"></ul>
<script>const nodes = [], edges = [], pages = [];"""
_TAIL = """const at = {}, c = document.getElementById("graph").getContext("2d"), list = document.getElementById("list");
nodes.forEach((n, i) => { const a = 2 * Math.PI * i / nodes.length - Math.PI / 2; at[n.id] = [450 + 380 * Math.cos(a), 450 + 380 * Math.sin(a)]; });
edges.forEach(e => { if (at[e.from] && at[e.to]) { c.beginPath(); c.moveTo(...at[e.from]); c.lineTo(...at[e.to]); c.strokeStyle = "#bbb"; c.stroke(); } });
nodes.forEach(n => { const [x, y] = at[n.id]; c.beginPath(); c.arc(x, y, 4, 0, 7); c.fillStyle = "hsl(" + 47 * n.group % 360 + ",60%,50%)"; c.fill(); if (nodes.length <= 200) { c.fillStyle = "#000"; c.fillText(n.label, x + 6, y + 3); } });
pages.forEach(p => { const a = document.createElement("a"), li = document.createElement("li"); a.href = p.file; a.textContent = p.label + " (" + p.size + ")"; li.append(a); list.append(li); });
</script></body></html>"""


def _pushed(name: str, row) -> Column:
    """A line that adds a row to one of the page's lists; ``</`` can't end its script."""
    return F.concat(F.lit(f"{name}.push("), F.replace(F.to_json(row), F.lit("</"), F.lit("<\\/")), F.lit(");"))


def _page_lines(nodes: DataFrame, edges: DataFrame, titles: DataFrame) -> DataFrame:
    """``(file, ord, line)`` of ``nodes(file, id, label, community)``, ``edges(file, source, target, relation, edge_seq)`` and ``titles(file, title)``."""
    head = titles.select("file", F.lit("0").alias("ord"), F.replace(F.lit(_HEAD), F.lit("{title}"), xml_escape("title")).alias("line"))
    n = nodes.select("file", F.concat(F.lit("1"), "id").alias("ord"), _pushed("nodes", F.struct("id", "label", F.col("community").alias("group"))).alias("line"))
    e = edges.select("file", F.format_string("2%020d", "edge_seq").alias("ord"), _pushed("edges", F.struct(F.col("source").alias("from"), F.col("target").alias("to"), F.col("relation").alias("label"))).alias("line"))
    return head.unionByName(n).unionByName(e).unionByName(titles.select("file", F.lit("9").alias("ord"), F.lit(_TAIL).alias("line")))


def html(kg: KG, limit: int = 2000) -> DataFrame:
    """``(file, ord, line)`` of one page with the pruned graph."""
    keep = A.html_prune(kg, limit)
    file = F.lit("graph.html").alias("file")
    nodes = kg.nodes.join(keep, "id", "left_semi").select(file, "id", "label", "community")
    edges = kg.edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi").select(file, "source", "target", "relation", "edge_seq")
    return _page_lines(nodes, edges, kg.nodes.sparkSession.createDataFrame([("graph.html", "Graph")], "file string, title string"))


def split_html(kg: KG) -> DataFrame:
    """``(file, ord, line)``: a page for each community with what is inside it, and an overview that links them."""
    file = F.format_string("community_%d.html", "community").alias("file")
    held = kg.nodes.where("community is not null")
    inside = kg.with_ends("community").where("s_community = t_community").withColumnRenamed("s_community", "community")
    labels = A.community_labels(kg)
    lines = _page_lines(held.select(file, "id", "label", "community"), inside.select(file, "source", "target", "relation", "edge_seq"), labels.select(file, F.col("label").alias("title")))
    over = F.lit("index.html").alias("file")
    sized = held.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(labels, "community")
    nodes = sized.select(over, F.col("community").cast("string").alias("id"), "label", "community")
    links = A.community_links(kg).select(over, F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), F.col("n").cast("string").alias("relation"), (F.col("a").cast("long") * F.lit(1 << 31) + F.col("b")).alias("edge_seq"))
    pages = sized.select(over, F.format_string("3%020d", "community").alias("ord"), _pushed("pages", F.struct(file, "label", "size")).alias("line"))
    title = kg.nodes.sparkSession.createDataFrame([("index.html", "Communities")], "file string, title string")
    return lines.unionByName(_page_lines(nodes, links, title)).unionByName(pages)


def wiki(kg: KG) -> DataFrame:
    """``(file, text)``: a page for each community and each hub."""
    rows = kg.nodes.where("community is not null").join(kg.degrees(), "id")
    members = F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "id", "label")))
    listed = F.array_join(F.transform("m", lambda x: F.concat(F.lit("- "), x["label"], F.lit(" ("), (-x["d"]).cast("string"), F.lit(")"))), "\n")
    pages = rows.groupBy("community").agg(members.alias("m")).join(A.community_labels(kg), "community")
    pages = pages.select(F.format_string("community_%d.md", "community").alias("file"), F.concat(F.lit("# "), "label", F.lit("\n\n"), listed).alias("text"))
    hubs = A.wiki_hubs(kg).join(kg.nodes.select("id", "label", "source_file"), "id")
    hubs = hubs.select(F.concat(sanitize_filename("id"), F.lit(".md")).alias("file"), F.format_string("# %s\n\n%s, %d edges", "label", "source_file", "degree").alias("text"))
    return pages.unionByName(hubs)


def vault(kg: KG) -> DataFrame:
    """``(file, text)``: a note for each node with links to its neighbours; equal names get numbers."""
    named = kg.nodes.select("id", "label", "source_file", "node_type", sanitize_filename("label").alias("f"))
    place = F.row_number().over(W.partitionBy(F.lower("f")).orderBy("id"))
    named = named.withColumn("i", place).withColumn("file", F.when(F.col("i") > 1, F.concat("f", F.lit("_"), F.col("i") - 1)).otherwise(F.col("f")))
    near = kg.sym("relation").join(named.select(F.col("id").alias("dst"), F.col("file").alias("to")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "relation", F.lit(" [["), "to", F.lit("]]")))), "\n").alias("links"))
    text = F.concat(F.lit("---\ntype: "), "node_type", F.lit("\nfile: "), "source_file", F.lit("\n---\n\n# "), "label", F.lit("\n\n"), F.coalesce("links", F.lit("")))
    return named.join(near, "id", "left").select(F.concat("file", F.lit(".md")).alias("file"), text.alias("text"))


def report(kg: KG) -> str:
    """Hubs, surprises, confidence, thin communities and open questions as Markdown."""
    stats = A.graph_stats(kg).first()
    out = ["# Graph report", "", f"{stats['node_count']} nodes, {stats['edge_count']} edges, {stats['community_count']} communities", "", "## Hubs", ""]
    out += [f"- {r['label']} ({r['degree']})" for r in A.god_nodes(kg).collect()]
    out += ["", "## Surprising connections", "", *[f"- {r['source']} {r['relation']} {r['target']} ({r['score']})" for r in A.surprising_connections(kg).collect()]]
    out += ["", "## Confidence", "", *[f"- {r['confidence']}: {r['n']} ({r['percent']:.1f} %)" for r in A.confidence_breakdown(kg).orderBy("confidence").collect()]]
    out += ["", "## Isolated nodes", "", *[f"- {r['label']}" for r in A.isolated_nodes(kg).orderBy("id").limit(30).collect()]]
    out += ["", "## Thin communities", "", *[f"- {r['community']}: {r['size']}" for r in A.thin_communities(kg).orderBy("community").limit(30).collect()]]
    out += ["", "## Questions", "", *[f"- {r['question']}" for r in A.suggest_questions(kg).collect()]]
    return "\n".join(out) + "\n"


def context_pack(kg: KG, text_chars: int = 900) -> str:
    """What to read first: project documents, entry points, key communities, and what to leave aside."""
    out = ["# Context", "", "## Project documents", ""]
    for r in A.project_documents(kg).withColumn("doc_text", F.substring("doc_text", 1, text_chars)).collect():
        out += [f"### {r['label']}", "", f"- file: `{r['source_file']}`", *[f"  {line}" for line in (r["doc_text"] or "").splitlines()[:8]], ""]
    out += ["## Entry points", "", *[f"- {r['label']} ({r['source_file']})" for r in A.entrypoints(kg).collect()], "", "## Communities", ""]
    out += [f"- {r['community']}: {r['id']}" for r in A.key_communities(kg).orderBy(F.desc("priority"), "community", "place").collect()]
    out += ["", "## Low signal", "", *[f"- {r['source_kind']}: {r['n']}" for r in A.low_signal_histogram(kg).orderBy("source_kind").collect()]]
    return "\n".join(out) + "\n"


def memory_note(question: str, answer: str, nodes: list[str]) -> str:
    """A question with its answer, for keeping."""
    return f"---\nquestion: {json.dumps(question)}\nnodes: {json.dumps(nodes)}\n---\n\n{answer}\n"


def write_lines(lines: DataFrame, folder: str, file: str, head: str = "", tail: str = "") -> None:
    """``lines(ord, line)`` in order as one file, written by an executor."""
    ends = lines.sparkSession.createDataFrame([("", head), ("\U0010ffff", tail)], "ord string, line string").where("line <> ''")
    linefiles.write(lines.select("ord", "line").unionByName(ends).withColumn("file", F.lit(file)), folder)


def write_pages(pages: DataFrame, folder: str) -> None:
    """``pages(file, text)`` as files, or ``(file, ord, line)`` line by line, written by executors."""
    linefiles.write(pages if "line" in pages.columns else pages.select("file", F.lit("0").alias("ord"), F.col("text").alias("line")), folder)


def render(value, form: str = "text") -> str:
    """A result as text, JSON, or a compact table of rows."""
    if form == "json":
        return json.dumps(value, ensure_ascii=False, default=str)
    if form == "toon" and isinstance(value, list) and value and isinstance(value[0], dict):
        keys = list(value[0])
        return "\n".join([f"[{len(value)}]{{{','.join(keys)}}}:", *["  " + ",".join(str(r.get(k, "")) for k in keys) for r in value]])
    if isinstance(value, list):
        return "\n".join(", ".join(f"{k}={v}" for k, v in r.items()) if isinstance(r, dict) else str(r) for r in value)
    return "\n".join(f"{k}: {v}" for k, v in value.items()) if isinstance(value, dict) else str(value)
