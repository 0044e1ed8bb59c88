"""Files that executors write: whole and in order, or none."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import export
from graphloom.sources import linefiles
from tests.test_graph import LINES, graph


def test_files_are_whole_and_in_order(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i % 7}.txt", f"{i:05d}", f"line {i} é") for i in range(500)]
    linefiles.write(spark.createDataFrame(rows, "file string, ord string, line string").repartition(8), str(tmp_path / "out"))
    for file in {r[0] for r in rows}:
        assert (tmp_path / "out" / file).read_text().splitlines() == [x for f, _, x in rows if f == file]
    assert not [d for d in os.listdir(tmp_path / "out") if d.startswith(".")]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(200).select(F.format_string("f%d.txt", F.col("id") % 5).alias("file"), F.col("id").cast("string").alias("ord"), F.when(F.col("id") == 150, F.raise_error("lost")).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="lost"):
        linefiles.write(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_pages_of_communities(spark, tmp_path):
    kg = graph(spark, *LINES, communities={"north": 0, "mid": 0, "east": 1, "south": 1})
    kg.nodes.where("false")
    export.write_pages(export.split_html(kg), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["community_0.html", "community_1.html", "index.html"]
    page = (tmp_path / "community_0.html").read_text()
    pushed = lambda kind: [json.loads(x) for x in re.findall(rf"^{kind}\.push\((.*)\);$", page, re.M)]
    assert [n["id"] for n in pushed("nodes")] == ["mid", "north"] and pushed("edges") == [{"from": "north", "to": "mid", "label": "calls"}]
    page = (tmp_path / "index.html").read_text()
    assert [p["file"] for p in pushed("pages")] == ["community_0.html", "community_1.html"] and len(pushed("edges")) == 1
    export.write_pages(export.html(kg), str(tmp_path))
    page = (tmp_path / "graph.html").read_text()
    assert page.startswith("<!DOCTYPE html>") and len(pushed("nodes")) == 5 and len(pushed("edges")) == 5 and "canvas" in page
    export.write_lines(export.graphml(kg), str(tmp_path), "g.graphml", "<graphml>", "</graphml>")
    text = (tmp_path / "g.graphml").read_text().splitlines()
    assert text[0] == "<graphml>" and text[-1] == "</graphml>" and len(text) == 12
