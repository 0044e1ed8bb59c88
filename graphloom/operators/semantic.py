"""Entities and relations that a language model names, read out of its replies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import make_id

INPUT_BYTES, PROMPT_VERSION = 100_000, "1"
REPLY = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,relation:string>>"


def prompt(text: str) -> str:
    """The question asked about a text, cut to a bounded length."""
    cut = text.encode()[:INPUT_BYTES].decode("utf-8", "ignore")
    return 'Name the entities of the text and their relationships as JSON {"entities": [{"name", "type", "description"}], "relationships": [{"source", "target", "relation"}]}.\n\n' + cut


def json_block(column: str = "reply"):
    """A fenced block, or from the first to the last brace."""
    fenced = F.regexp_extract(column, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(column, r"(?s)(\{.*\})", 1))


def parse_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``replies(path, reply)`` → nodes and edges, all INFERRED at 0.7; the default relation is ``related_to``."""
    d = replies.select("path", F.from_json(json_block(), REPLY).alias("d")).where("d is not null")
    e = d.select("path", F.explode("d.entities").alias("e")).where("e.name is not null and e.name <> ''")
    nodes = e.select(make_id("path", F.col("e.name")).alias("id"), F.col("e.name").alias("label"), F.col("path").alias("source_file"), F.lower(F.coalesce("e.type", F.lit("concept"))).alias("node_type"), F.col("e.description").alias("doc_text"))
    r = d.select("path", F.explode("d.relationships").alias("r")).where("r.source is not null and r.target is not null")
    edges = r.select(make_id("path", F.col("r.source")).alias("source"), make_id("path", F.col("r.target")).alias("target"), F.coalesce("r.relation", F.lit("related_to")).alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.7).alias("confidence_score"), F.lit(0.7).alias("weight"), F.col("path").alias("source_file"))
    return nodes, edges


def ask(docs: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """``docs(path, text)`` → ``(path, reply)`` by any callable that answers a prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "reply": [provider(prompt(t or "")) for t in pdf["text"]]})

    return docs.select("path", "text").mapInPandas(run, "path string, reply string")


def capitalised_provider(text: str) -> str:
    """An offline stand-in: capitalised words are entities, neighbours are related."""
    names = list(dict.fromkeys(re.findall(r"\b[A-Z]\w{3,}", text.split("\n\n", 1)[-1])))[:20]
    return json.dumps({"entities": [{"name": n, "type": "Concept"} for n in names], "relationships": [{"source": a, "target": b} for a, b in zip(names, names[1:], strict=False)]})
