"""Analyses that rank, group and count nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.quality import annotate, is_low_signal, is_summary_candidate
from graphloom.graph import KG, is_file_node, is_method_stub
from graphloom.workspace import cut

# Labels that say nothing by themselves, the length of a report, and the ranks of node types as a community's name.
GENERIC_LABELS = ("lib", "mod", "main", "index", "init")
GENERIC_NAMES = ("lib", "super::*", "main", "mod", "tests")
REPORT = 10_000
NAME_RANK = {"function": 3, "class": 3, "struct": 3, "module": 1, "file": 0}


def _annotated(kg: KG) -> DataFrame:
    return kg.nodes if "source_priority" in kg.nodes.columns else annotate(kg.nodes)


def god_nodes(kg: KG, top_n: int = 10) -> DataFrame:
    """The nodes with most edges that are code of their own: no files, stubs or low-signal sources."""
    generic = F.col("label").isin(*GENERIC_LABELS)
    rows = _annotated(kg).join(kg.degrees(), "id").where(~is_file_node() & ~is_method_stub() & (is_summary_candidate() | ((F.col("node_type") == "module") & generic)))
    label = F.when(generic, X.disambiguated("label", "source_file")).otherwise(F.col("label"))
    return rows.select("id", label.alias("label"), "degree", "community").orderBy(F.desc("degree"), "label", "id").limit(top_n)


def surprising_connections(kg: KG, top_n: int = 5) -> DataFrame:
    """Edges across communities and files, uncertain ones first; ``edge_seq`` may repeat, so the ends decide last."""
    nodes = _annotated(kg).join(kg.degrees(), "id").where(~is_file_node() & ~is_method_stub() & ~is_low_signal())
    rows = KG(nodes, kg.edges).with_ends("community", "source_file")
    far = (F.coalesce("s_community", F.lit(-1)) != F.coalesce("t_community", F.lit(-1))).cast("double") * 2.0
    other = ((F.col("s_source_file") != F.col("t_source_file")) & (F.col("s_source_file") != "") & (F.col("t_source_file") != "")).cast("double")
    doubt = F.when(F.col("confidence") == "AMBIGUOUS", 3.0).when(F.col("confidence") == "INFERRED", 1.5).otherwise(0.0)
    scored = rows.withColumn("score", far + other + doubt).where("score > 0")
    return scored.orderBy(F.desc("score"), "edge_seq", "source", "target", "relation").limit(top_n).select("source", "target", "relation", "score", "edge_seq")


def cohesion(kg: KG, rounded: bool = False) -> DataFrame:
    """``(community, size, hits, cohesion)``: edges inside by possible pairs; 1 for a single node."""
    m = kg.membership()
    sizes = m.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    inside = KG(kg.nodes, kg.edges).with_ends("community").where("s_community = t_community").groupBy(F.col("s_community").alias("community")).agg(F.count(F.lit(1)).alias("hits"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    value = F.when(F.col("size") <= 1, F.lit(1.0)).otherwise(F.coalesce("hits", F.lit(0)) / pairs)
    return sizes.join(inside, "community", "left").select("community", "size", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), (F.round(value, 2) if rounded else value).alias("cohesion"))


def community_bridges(kg: KG, top_n: int = 10) -> DataFrame:
    """Nodes by the share of their neighbours in other communities; neighbours without one count as own.

    All nodes are ranked by counts alone; only those of the report get the set of what they touch.
    """
    own = kg.nodes.where(F.col("community").isNotNull() & ~is_file_node()).select(F.col("id").alias("src"), "label", F.col("community").alias("own"))
    other = kg.nodes.select(F.col("id").alias("dst"), F.col("community").alias("theirs"))
    key, theirs = ["src", "label", "own"], F.coalesce("theirs", "own")
    counted = kg.sym().join(other, "dst").join(own, "src").groupBy(*key).agg(F.count(F.lit(1)).alias("total_edges"), F.sum((theirs != F.col("own")).cast("long")).alias("cross_edges"))
    ratio = F.col("cross_edges") / F.col("total_edges")
    top = cut(counted.where("cross_edges > 0").withColumn("bridge_ratio", ratio).orderBy(F.desc("bridge_ratio"), F.col("src")).limit(top_n))
    near = cut(kg.sym().join(F.broadcast(top.select(*key)), "src"))  # a table, as its size decides how it meets the nodes
    touched = near.join(other, "dst").groupBy(*key).agg(F.array_sort(F.array_distinct(F.concat(F.collect_set(theirs), F.array("own")))).alias("communities_touched"))
    same = F.col("t.src").eqNullSafe(F.col("n.src")) & F.col("t.label").eqNullSafe(F.col("n.label")) & F.col("t.own").eqNullSafe(F.col("n.own"))
    rows = F.broadcast(top.alias("t")).join(touched.alias("n"), same)
    return rows.select(F.col("t.src").alias("id"), "t.label", F.col("t.own").alias("community"), "total_edges", "cross_edges", "bridge_ratio", "communities_touched").orderBy(F.desc("bridge_ratio"), "id").limit(top_n)


def suggest_questions(kg: KG, labels: DataFrame | None = None, top_n: int = 7) -> DataFrame:
    """Questions by category: ambiguous edges, bridges, uncertain hubs, isolated nodes, loose communities.

    Categories come one after the other, so if ambiguous edges fill a report of at most ``REPORT`` questions, no other is looked for.
    """
    nodes = _annotated(kg)
    kg = KG(nodes, kg.edges)
    s = F.format_string
    doubt = kg.edges.where("confidence = 'AMBIGUOUS'").select(
        F.lit(1).alias("rank"), F.lit("ambiguous_relationship").alias("category"), F.col("edge_seq").alias("seq"), F.col("source").alias("subject"), s("What is the exact relationship between '%s' and '%s'? (marked as %s)", "source", "target", "relation").alias("question")
    )
    order = ["rank", "seq", "subject", "question"]
    if top_n <= REPORT:
        first = cut(doubt.orderBy(*order).limit(top_n))
        if first.count() == top_n:
            return first.orderBy(*order)
        doubt = first  # all there are
    theirs = kg.membership().select(F.col("node_id").alias("dst"), "community")
    many = kg.sym().join(theirs, "dst").groupBy("src").agg(F.count_distinct("community").alias("n")).where("n >= 3")
    bridges = nodes.where(~is_file_node() & ~is_low_signal()).join(many, F.col("id") == F.col("src")).select(
        F.lit(2).alias("rank"), F.lit("bridge_node").alias("category"), F.lit(0).cast("long").alias("seq"), F.col("id").alias("subject"), s("How does '%s' relate to %d different communities?", "id", "n").alias("question")
    )
    inferred = kg.edges.where("confidence = 'INFERRED'").select(F.explode(F.array("source", "target")).alias("id")).distinct()
    gods = god_nodes(kg, 5).join(inferred, "id", "left_semi").select(
        F.lit(3).alias("rank"), F.lit("verification").alias("category"), (-F.col("degree")).alias("seq"), F.col("id").alias("subject"), s("Can you verify the inferred relationships of '%s' (degree %d)?", "label", "degree").alias("question")
    )
    alone = nodes.join(kg.degrees(), "id").where((F.col("degree") == 0) & ~is_file_node()).select(
        F.lit(4).alias("rank"), F.lit("isolated_node").alias("category"), F.lit(0).cast("long").alias("seq"), F.col("id").alias("subject"), s("What role does '%s' play? It has no connections in the graph.", "label").alias("question")
    )
    loose = cohesion(kg).where("size > 1 and cohesion < 0.3")
    if labels is not None:
        loose = loose.join(labels.select("community", F.col("label").alias("name")), "community", "left")
    name = F.coalesce(F.col("name") if labels is not None else F.lit(None).cast("string"), F.concat(F.lit("community-"), F.col("community")))
    loose = loose.select(
        F.lit(5).alias("rank"), F.lit("low_cohesion").alias("category"), F.col("community").cast("long").alias("seq"), F.col("community").cast("string").alias("subject"),
        s("Why is '%s' (%d nodes) loosely connected (cohesion %.2f)? Should it be split?", name, F.col("size"), F.col("cohesion")).alias("question"),
    )
    everything = doubt.unionByName(bridges).unionByName(gods).unionByName(alone).unionByName(loose)
    return everything.orderBy(*order).limit(top_n)


def graph_stats(kg: KG) -> DataFrame:
    """One row: nodes, edges, communities, greatest and mean degree."""
    n = kg.degrees().agg(F.count(F.lit(1)).alias("node_count"), F.max("degree").alias("max_degree"), F.sum("degree").alias("d"))
    e = kg.edges.agg(F.count(F.lit(1)).alias("edge_count"))
    c = kg.nodes.agg(F.count_distinct("community").alias("community_count"))
    mean = F.when(F.col("node_count") > 0, F.format_string("%.2f", F.col("d") / F.col("node_count")))
    return n.crossJoin(e).crossJoin(c).select("node_count", "edge_count", "community_count", "max_degree", mean.alias("avg_degree"))


def histogram(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``(value, n)`` by count."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def confidence_breakdown(kg: KG) -> DataFrame:
    """Edges and per cent by confidence."""
    by = kg.edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    return by.select("confidence", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 4).alias("percent"))


def community_summary(kg: KG) -> DataFrame:
    """``(community, size, representative)``: the node with most edges, of equals the last by id."""
    rows = kg.nodes.where("community is not null").join(kg.degrees(), "id")
    return rows.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.max_by("label", F.struct("degree", "id")).alias("representative"))


def community_links(kg: KG) -> DataFrame:
    """Edges between each two communities, undirected."""
    rows = kg.with_ends("community").where("s_community <> t_community")
    return rows.groupBy(F.least("s_community", "t_community").alias("a"), F.greatest("s_community", "t_community").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def architecture_summary(kg: KG) -> DataFrame:
    """Nodes by folder."""
    return kg.nodes.groupBy(X.parent_dir("source_file").alias("dir")).agg(F.count(F.lit(1)).alias("n"))


def architecture_links(kg: KG) -> DataFrame:
    """Edges between each two folders, undirected."""
    nodes = kg.nodes.select("id", X.parent_dir("source_file").alias("dir"))
    rows = KG(nodes, kg.edges).with_ends("dir").where("s_dir <> t_dir")
    return rows.groupBy(F.least("s_dir", "t_dir").alias("a"), F.greatest("s_dir", "t_dir").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def get_community(kg: KG, community: int) -> DataFrame:
    """Members by degree."""
    return kg.nodes.where(F.col("community") == community).join(kg.degrees(), "id").select("id", "label", "degree").orderBy(F.desc("degree"), "id")


def get_node(kg: KG, node_id: str) -> DataFrame:
    """A node with its neighbours and degree."""
    own = kg.nodes.where(F.col("id") == node_id)
    near = kg.sym().where(F.col("src") == node_id).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))
    one = KG(own, kg.edges.where((F.col("source") == node_id) | (F.col("target") == node_id)))
    return own.join(one.degrees(), "id").join(near, F.col("id") == F.col("src"), "left").select("id", "label", "source_file", "node_type", "degree", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"))


def wiki_hubs(kg: KG) -> DataFrame:
    """Nodes with at least ``floor(max(2 * mean degree, 3))`` edges."""
    d = kg.degrees()
    cut = d.agg(F.floor(F.greatest(F.avg("degree") * 2, F.lit(3.0))).alias("cut"))
    return d.crossJoin(F.broadcast(cut)).where("degree >= cut").select("id", "degree")  # one row on the right


def html_prune(kg: KG, limit: int = 2000) -> DataFrame:
    """At most ``limit`` nodes: those with most edges, and the best of each community."""
    rows = kg.nodes.join(kg.degrees(), "id").select("id", "community", "degree")
    groups = rows.where("community is not null").agg(F.count_distinct("community").alias("n")).first()["n"]
    slots = min(groups, limit // 4)
    top = rows.orderBy(F.desc("degree"), "id").limit(limit - slots).select("id", F.lit(0).alias("tier"), "degree")
    w = W.partitionBy("community").orderBy(F.desc("degree"), "id")
    best = rows.where("community is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", F.lit(1).alias("tier"), "degree").join(top.select("id"), "id", "left_anti")
    return top.unionByName(best).orderBy("tier", F.desc("degree"), "id").limit(limit).select("id")


def community_labels(kg: KG) -> DataFrame:
    """``(community, label)``: a telling member's label; repeated labels get the number."""
    rows = _annotated(kg).where("community is not null")
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in NAME_RANK.items() for x in kv])[F.col("node_type")], F.lit(2))
    telling = ~F.col("label").isin(*GENERIC_NAMES) & ~F.col("label").contains("::") & is_summary_candidate()
    best = rows.groupBy("community").agg(F.max_by("label", F.when(telling, F.struct(rank.alias("r"), "id"))).alias("best"), F.min_by("label", "id").alias("first"))
    named = best.select("community", F.coalesce("best", "first").alias("label"))
    w = W.partitionBy("label").orderBy("community")
    again = F.row_number().over(w) > 1
    return named.withColumn("again", again).select("community", F.when(F.col("again"), F.concat("label", F.lit(" ("), F.col("community"), F.lit(")"))).otherwise(F.col("label")).alias("label"))


def isolated_nodes(kg: KG) -> DataFrame:
    return kg.nodes.join(kg.degrees(), "id").where((F.col("degree") == 0) & ~is_file_node()).select("id", "label")


def thin_communities(kg: KG, below: int = 3) -> DataFrame:
    return kg.membership().groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") < below)


# What marks a document that explains the project, and what it counts.
PROJECT_PATHS = (20, ("product.md", "readme.md"), ("project.md",))
PROJECT_LABELS = ((30, ("purpose", "goal", "what this is", "core value")), (15, ("architecture", "how it works")))
DEEPEST, NO_LEVEL = 3, 9


def project_documents(kg: KG, top_n: int = 8) -> DataFrame:
    """Concepts from project documents whose heading is no deeper than ``DEEPEST``: those that explain most first.

    Points come from the path's end, the label's words and the heading's level: the
    column ``level`` or ``extra['doc_level']``. One without a level that can be read counts as deep.
    """
    rows = _annotated(kg)

    def told_by(column: str, key: str) -> Column:
        """The value of a node's own column, else that in its extras."""
        some = [F.col(column).cast("string")] if column in kg.nodes.columns else []
        some += [F.col("extra")[key]] if "extra" in kg.nodes.columns else []
        return F.coalesce(*some, F.lit(None).cast("string"))

    level = F.coalesce(told_by("level", "doc_level").try_cast("int"), F.lit(NO_LEVEL))
    rows = rows.withColumn("doc_text", told_by("doc_text", "doc_text"))
    rows = rows.where((F.col("node_type") == "concept") & F.array_contains("source_flags", "project_context")).withColumn("level", level).where(F.col("level").between(0, DEEPEST))
    path, label = (X.ascii_lower(F.coalesce(c, F.lit(""))) for c in ("source_file", "label"))
    points, ends, parts = PROJECT_PATHS
    told = F.lit(False)
    for e in ends:
        told = told | path.endswith(e)
    for e in parts:
        told = told | path.contains(e)
    rank = F.when(told, points).otherwise(0)
    for points, words in PROJECT_LABELS:
        said = F.lit(False)
        for w in words:
            said = said | label.contains(w)
        rank = rank + F.when(said, points).otherwise(0)
    return rows.select("id", "label", "source_file", (rank - F.col("level")).alias("rank"), "doc_text").orderBy(F.desc("rank"), "source_file", "label", "id").limit(top_n)


def entrypoints(kg: KG, top_n: int = 12) -> DataFrame:
    """Summary candidates by degree times priority."""
    rows = _annotated(kg).join(kg.degrees(), "id").where(~is_file_node() & ~is_method_stub() & is_summary_candidate())
    score = (F.col("degree") * F.col("source_priority").cast("double") * 100).cast("long")
    return rows.select("id", "label", "source_file", score.alias("score")).orderBy(F.desc("score"), "id").limit(top_n)


def key_communities(kg: KG, top_n: int = 8, members: int = 8) -> DataFrame:
    """The communities with most priority, and their first members by degree."""
    rows = _annotated(kg).where("community is not null").join(kg.degrees(), "id")
    best = rows.groupBy("community").agg(F.round(F.sum(F.col("source_priority").cast("double")), 4).alias("priority")).orderBy(F.desc("priority"), "community").limit(top_n)
    w = W.partitionBy("community").orderBy(F.desc("degree"), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= members).join(best, "community").select("community", "priority", "place", "id")


def low_signal_histogram(kg: KG) -> DataFrame:
    return _annotated(kg).where(is_low_signal()).groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"))


def temporal_risk(churn: DataFrame, kg: KG, today, top_n: int = 10) -> DataFrame:
    """``churn(source_file, changed_on)``, a row a change: often changed files with many edges.

    Ages are in true days; ``today`` is a date. Risk = changes a day times degree by the greatest degree.
    """
    per = churn.groupBy("source_file").agg(F.count(F.lit(1)).alias("change_count"), F.max(F.to_date("changed_on")).alias("last_modified"))
    d = kg.with_degree().groupBy("source_file").agg(F.max("degree").alias("degree"))
    most = d.agg(F.max("degree").alias("most"))
    age = F.greatest(F.lit(1), F.datediff(F.lit(today).cast("date"), F.col("last_modified")))
    rows = per.join(d, "source_file").crossJoin(F.broadcast(most)).withColumn("age_days", age)  # one row on the right
    rate = F.col("change_count") / F.col("age_days")
    risk = rate * F.col("degree") / F.col("most")
    return rows.select("source_file", "change_count", "last_modified", "age_days", F.round(rate, 9).alias("churn_rate"), F.round(risk, 9).alias("risk_score")).where("risk_score > 0").orderBy(F.desc("risk_score"), "source_file").limit(top_n)


def token_benchmark(kg: KG, questions: list[str]) -> DataFrame:
    """For each question the tokens of a graph answer: five matches by label and their neighbours.

    Without a match the answer costs a fifth of the graph's tokens.
    """
    from graphloom.operators.search import score_nodes

    spark = kg.nodes.sparkSession
    text = F.concat_ws(" ", "id", "label", "source_file")
    total = kg.nodes.agg(F.sum(X.estimate_tokens(text)).alias("n")).first()["n"] or 0
    out = None
    for i, q in enumerate(questions):
        hits = score_nodes(kg, q.split(), 5).select("id")
        near = kg.sym().join(hits.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        ids = hits.unionByName(near).distinct()
        row = kg.nodes.join(ids, "id", "left_semi").agg(F.coalesce(F.sum(X.estimate_tokens(text)), F.lit(total // 5)).alias("tokens"))
        row = row.select(F.lit(i).alias("question"), "tokens", F.round(F.lit(float(total)) / F.greatest("tokens", F.lit(1)), 4).alias("reduction"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "question int, tokens long, reduction double")
