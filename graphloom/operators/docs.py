"""Documents to nodes and edges, with columns only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import ascii_lower, compact_text, extension, file_name, lines_of, make_id

TEXT_CHARS, PLAIN_CHUNKS, PLAIN_BYTES, GATE_BYTES = 1600, 12, 40, 512 * 1024
# Extensions of documents, and beginnings of headings that are comments of shell examples.
DOC_EXTENSIONS = (".md", ".mdx", ".rst", ".txt")
SHELL_STARTS = ("(", "install ", "build a ", "query the ", "explore ", "short-lived ", "optional embedding", "model2vec semantic")


def gate(files: DataFrame) -> DataFrame:
    """``files(path, text)`` that are documents of at most half a mebibyte with something in them."""
    return files.where(extension("path").isin(*DOC_EXTENSIONS) & (F.octet_length("text") <= GATE_BYTES) & (F.regexp_replace("text", r"\s+", "") != ""))


def headings(files: DataFrame) -> DataFrame:
    """``(path, line, level, title, doc_text, id, seq)``: a row for each section, fenced blocks apart."""
    lines = files.select("path", F.posexplode(lines_of("text")).alias("pos", "raw"))
    w = W.partitionBy("path").orderBy("pos")
    fence = F.regexp_replace("raw", r"^\s+", "").rlike("^(```|~~~)")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(F.col("fence").cast("int")).over(w)).where(~F.col("fence") & (F.col("fences") % 2 == 0))
    raw = F.regexp_extract("raw", r"^(#{1,6})\s+(.+?)\s*$", 2)
    title = F.trim(F.btrim(F.trim(F.btrim(F.trim(raw), F.lit("#"))), F.lit("`")))
    lines = lines.withColumn("is_heading", F.col("raw").rlike(r"^#{1,6}\s+.+?\s*$")).withColumn("title", F.when(F.col("is_heading"), title))
    low = ascii_lower("title")
    shell = F.coalesce(F.exists(F.array(*[F.lit(s) for s in SHELL_STARTS]), lambda s: low.startswith(s)), F.lit(False))
    lines = lines.withColumn("shell", F.col("is_heading") & shell).withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w)).where("section > 0")
    level = F.length(F.regexp_extract("raw", r"^(#{1,6})", 1))
    sections = lines.groupBy("path", "section").agg(
        F.max(F.when(F.col("is_heading"), F.struct(F.col("pos"), "title", level.alias("level"), "shell"))).alias("h"),
        F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "raw")))).alias("body"),
    )
    body = F.array_join(F.transform("body", lambda x: x["raw"]), "\n")
    out = sections.where("not h.shell and trim(h.title) <> ''").select("path", (F.col("h.pos") + 1).alias("line"), "h.level", "h.title", compact_text(body, TEXT_CHARS).alias("doc_text"))
    return out.withColumn("id", make_id("path", F.lit("heading"), F.col("line").cast("string"), "title"))


def markdown(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: file contains section, sections follow each other."""
    h = headings(files).withColumn("file_id", make_id("path"))
    nodes = h.select("id", F.col("title").alias("label"), F.col("path").alias("source_file"), F.concat(F.lit("L"), "line").alias("source_location"), F.lit("concept").alias("node_type"), "level", "doc_text")
    inside = h.select(F.col("file_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"), F.col("path").alias("source_file"), F.col("line").alias("edge_seq"))
    before = F.lag("id").over(W.partitionBy("path").orderBy("line"))
    after = h.select(before.alias("source"), F.col("id").alias("target"), F.lit("next_section").alias("relation"), F.col("path").alias("source_file"), F.col("line").alias("edge_seq")).where("source is not null")
    return nodes, inside.unionByName(after)


def plain_chunks(files: DataFrame, separator: str = "\n\n", most: int = PLAIN_CHUNKS) -> DataFrame:
    """``(path, part, label, id, doc_text)``: the first paragraphs of more than forty bytes."""
    trimmed = F.transform(F.split("text", separator, -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    kept = F.slice(F.filter(trimmed, lambda p: F.octet_length(p) > PLAIN_BYTES), 1, most)
    stem = F.regexp_replace(file_name("path"), r"\.[^.]*$", "")
    rows = files.select("path", stem.alias("stem"), F.posexplode(kept).alias("pos", "chunk"))
    label = F.when(F.col("pos") == 0, F.col("stem")).otherwise(F.concat("stem", F.lit(" part "), F.col("pos") + 1))
    rows = rows.select("path", (F.col("pos") + 1).alias("part"), label.alias("label"), compact_text("chunk", TEXT_CHARS).alias("doc_text"))
    return rows.withColumn("id", make_id("path", F.lit("text"), F.col("part").cast("string"), "label"))
