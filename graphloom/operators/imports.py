"""Import edges resolved to the entities that they mean, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import file_name

MOST_PAIRS, MOST_FALLBACK = 500, 50


def stem(path: str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def resolve_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Import edges whose target is some node's label point to that node, of the same file if there is one;
    a star import gives ``uses`` edges to all entities defined in files of that name."""
    imports, rest = edges.where("relation = 'imports'"), edges.where("relation <> 'imports'")
    label_of = nodes.groupBy("id").agg(F.min_by("label", "node_seq").alias("import_label"))
    imports = imports.join(label_of.withColumnRenamed("id", "target"), "target", "left")
    star = F.coalesce(F.col("import_label"), F.lit("")).contains("*")
    named = nodes.select(F.col("label").alias("target"), F.col("id").alias("to"), F.col("source_file").alias("in_file"), "node_seq")
    w = W.partitionBy("source_file", "edge_seq", "source", "target").orderBy(F.desc(F.col("in_file") == F.col("source_file")), "node_seq", "to")
    plain = imports.where(~star).join(named, "target", "left").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    plain = plain.withColumns({"target": F.coalesce("to", "target"), "confidence": F.when(F.col("to").isNotNull(), F.lit("EXTRACTED")).otherwise(F.col("confidence"))})
    defined = edges.where("relation = 'defines'").select(F.col("target").alias("id")).distinct()
    by_stem = nodes.join(defined, "id", "left_semi").select(stem("source_file").alias("module"), F.col("id").alias("to"))
    module = F.regexp_replace(F.regexp_replace("import_label", r"(\.\*)+$", ""), r"( \*)+$", "")
    stars = imports.where(star)
    used = edges.where("relation = 'uses'").select("source", "target")
    more = stars.withColumn("module", module).join(by_stem, "module").withColumn("target", F.col("to")).join(used, ["source", "target"], "left_anti")
    more = more.withColumns({"relation": F.lit("uses"), "confidence": F.lit("INFERRED"), "confidence_score": F.lit(0.7), "weight": F.lit(0.7)}).dropDuplicates(["source", "target"])
    columns = edges.columns
    return rest.select(*columns).unionByName(plain.select(*columns)).unionByName(stars.select(*columns)).unionByName(more.select(*columns))


def candidates(ext: Column, label: Column) -> Column:
    """Names to look an import up by, the best first: ``array<struct<name, only>>``; ``only`` bounds the label of what is found."""

    def c(name: Column, only: Column | None = None) -> Column:
        return F.struct(name.alias("name"), (F.lit(None).cast("string") if only is None else only).alias("only"))

    def last(parts: Column, k: int = 1) -> Column:
        return F.when(F.size(parts) >= k, F.element_at(parts, F.greatest(-F.size(parts), F.lit(-k))))

    js = F.split(F.element_at(F.split(label, " as "), 1), "/")
    whole = F.element_at(F.split(label, " as "), 1)
    javascript = F.array(
        c(F.when(F.size(js) >= 2, F.regexp_replace(js[0], r"^\.+", ""))), c(F.regexp_replace(last(js), r"^\.+", "")), c(F.regexp_replace(whole, r"^(\./)*(\.\./)*", "")),
        c(F.when(whole.contains("/") | whole.startswith("."), F.lit("index"))),
    )
    go_label = F.regexp_replace(label, r"^(\. |_ )+", "")
    go = last(F.split(F.when(go_label.contains('"'), F.get(F.split(go_label, '"'), F.lit(1))).otherwise(go_label), "/"))
    rs = F.split(F.regexp_replace(label, "^pub use ", ""), "::")
    rust = F.array(c(F.when(last(rs) == "*", last(rs, 2))), c(F.when(last(rs) != "*", last(rs))), c(last(rs, 2), last(rs)))
    dotted = F.regexp_replace(F.regexp_replace(label, "^(import |static )", ""), "^.* = ", "")
    dots = F.split(F.trim(dotted), r"\.")
    dot = F.array(c(last(dots)), c(last(dots, 2), last(dots)))
    include = F.array(c(F.regexp_replace(last(F.split(F.regexp_replace(label, '[<>"]', ""), "/")), r"(?<=.)\.[^.]*$", "")))
    slashes = F.split(F.regexp_replace(label, "^use ", ""), r"\\")
    php = F.array(c(last(slashes)), c(last(slashes, 2)))
    dart = F.array(c(F.regexp_replace(last(F.split(F.regexp_replace(F.regexp_replace(label, "^(import|export|part) ", ""), "( as | deferred).*$|['\"]", ""), "[/:]")), r"\.dart$", "")))
    return (
        F.when(ext.isin("js", "jsx", "ts", "tsx"), javascript)
        .when(ext == "go", F.array(c(F.concat(F.lit("go:"), go)), c(go)))
        .when(ext == "rs", rust)
        .when(ext.isin("java", "cs", "kt", "kts", "scala", "swift"), dot)
        .when(ext.isin("c", "h", "cpp", "cc", "cxx", "hpp"), include)
        .when(ext == "php", php)
        .when(ext == "dart", dart)
    )


def resolve_cross_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ``uses`` edges that imports across files add.

    An import is looked up by its candidate names, the first that is known
    counts. With more than 500 pairs of local and target entities, files use
    files; else an entity uses its namesake, or up to fifty of the targets. All
    tables grow with the files, but compress so well that Spark takes them for
    small ones and would broadcast them through the driver, so the joins ask for a sort-merge.
    """
    nodes, edges = nodes.hint("merge"), edges.hint("merge")
    defines = edges.where("relation = 'defines'")
    defined = nodes.join(defines.select(F.col("target").alias("id")).distinct(), "id", "left_semi").where("node_type <> 'file'")
    folder = F.regexp_extract("source_file", r"([^/]+)/[^/]+\.go$", 1)
    names = F.array_compact(F.array(stem("source_file"), F.when(folder != "", F.concat(F.lit("go:"), folder))))
    entity = defined.select(F.explode(names).alias("name"), F.col("id").alias("to"), F.col("label").alias("to_label"), "node_seq")
    label_of = nodes.groupBy("id").agg(F.min_by("label", "node_seq").alias("import_label"))
    imports = edges.where("relation = 'imports'").join(label_of.withColumnRenamed("id", "target"), "target").where("import_label <> ''")
    key = ["source_file", "edge_seq", "source"]
    ext = F.regexp_extract("source_file", r"\.([^./]+)$", 1)
    tries = imports.select(*key, F.posexplode(candidates(ext, F.col("import_label"))).alias("pos", "c")).select(*key, "pos", "c.name", "c.only").where("name <> ''")
    known = tries.join(entity.select("name").distinct().hint("merge"), "name", "left_semi")
    first = known.groupBy(*key).agg(F.min(F.struct("pos", "name", "only")).alias("m")).select(*key, "m.name", "m.only")
    hits = first.join(entity.hint("merge"), "name").withColumn("fits", (F.col("only").isNotNull() & (F.col("only") == F.col("to_label"))).cast("int"))
    hits = hits.withColumn("any", F.max("fits").over(W.partitionBy(*key))).where("fits = any").select(*key, "to", "to_label", "node_seq")
    local = defines.select("source_file", F.col("target").alias("local")).distinct()
    sizes = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("n_to")).join(local.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_local")).hint("merge"), "source_file")
    wide = sizes.where(F.col("n_to") * F.col("n_local") > MOST_PAIRS).select(*key).hint("merge")
    narrow = sizes.where(F.col("n_to") * F.col("n_local") <= MOST_PAIRS).select(*key).hint("merge")
    file_of = defines.groupBy(F.col("target").alias("to")).agg(F.min("source").alias("file_id"))
    by_file = hits.join(wide, key, "left_semi").join(file_of, "to").where("source <> file_id").select("source_file", F.col("source").alias("a"), F.col("file_id").alias("b"))
    local_label = local.join(label_of.select(F.col("id").alias("local"), F.col("import_label").alias("local_label")), "local")
    pairs = hits.join(narrow, key, "left_semi").join(local_label.hint("merge"), "source_file")
    pairs = pairs.withColumn("same", (F.col("local_label") == F.col("to_label")).cast("int")).withColumn("has", F.max("same").over(W.partitionBy(*key, "local")))
    used = edges.where("relation = 'uses'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    namesake = pairs.where("has = 1 and same = 1").select(*key, F.col("local").alias("a"), F.col("to").alias("b"))
    rank = F.row_number().over(W.partitionBy(*key, "a").orderBy("node_seq", "b"))
    fallback = pairs.where("has = 0").select(*key, F.col("local").alias("a"), F.col("to").alias("b"), "node_seq").where("a <> b").join(used, ["a", "b"], "left_anti")
    fallback = fallback.withColumn("rn", rank).where(F.col("rn") <= MOST_FALLBACK)
    found = by_file.unionByName(namesake.select("source_file", "a", "b")).unionByName(fallback.select("source_file", "a", "b")).where("a <> b")
    found = found.join(used, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min("source_file").alias("source_file"))
    return found.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("uses").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("confidence_score"), F.lit(0.8).alias("weight"), "source_file")
