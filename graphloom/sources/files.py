"""Finding, filtering and classifying files; caches and manifests keyed by content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import ascii_lower, extension, file_name, word_count

# Extensions by kind.
CODE = (
    ".py", ".ts", ".js", ".jsx", ".tsx", ".go", ".rs", ".java", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".rb", ".swift", ".kt", ".kts", ".cs", ".scala", ".php", ".lua",
    ".toc", ".zig", ".ps1", ".ex", ".exs", ".m", ".mm", ".jl", ".dart", ".sql",
)
DOCS = (".md", ".txt", ".rst")
PAPERS = (".pdf",)
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")
OFFICE = (".docx", ".xlsx")
# Folders that are never walked.
SKIP_DIRS = (
    "venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "site-packages", "lib64", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", ".eggs",
)
SKIP_ENDS = ("_venv", "_env", ".egg-info")
# What secrets are called.
SENSITIVE_EXTENSIONS = (".pem", ".key", ".p12", ".pfx", ".cert", ".crt", ".der", ".p8")
SENSITIVE_NAMES = (
    ".env", ".envrc", ".netrc", ".pgpass", ".htpasswd", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa.pub", "id_dsa.pub", "id_ecdsa.pub", "id_ed25519.pub",
    "aws_credentials", "gcloud_credentials",
)
SENSITIVE_WORDS = (
    "credentials", "secret", "passwd", "password", "private_key", "service.account", "access_token", "auth_token", "refresh_token", "id_token", "api_token", "oauth_token",
    "bearer_token",
)
SENSITIVE_DIRS = ("secrets", "credentials", ".ssh", ".gnupg", ".aws", ".kube")
# Signs of a paper; three of them in the first 3000 bytes make one.
PAPER_SIGNS = (
    r"arxiv", r"\bdoi\b", r"\babstract\b", r"proceedings", r"\bjournal\b", r"preprint", r"\\cite\{", r"\[\d+\]", r"\beq\.", r"\bequation\b", r"\d{4}\.\d{4,5}", r"we propose", r"literature",
)
PAPER_LEAST, PAPER_PEEK = 3, 3000
WARN_WORDS, MANY_WORDS, WARN_FILES = 50_000, 500_000, 200


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content, length)`` below ``root``, paths relative to it; files whose names start with a dot aren't listed."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/"))
    return df.select(F.regexp_replace("path", rf"^(?:\w+:(?://)?)?{base}/", "").alias("path"), "content", "length")


def parts(path: str = "path") -> Column:
    return F.split(path, "/")


def in_noise(path: str = "path", hidden: bool = False) -> Column:
    """A folder on the way is one that is never walked; hidden ones too, but for ``.planning``."""
    folders = F.slice(parts(path), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0)))

    def skip(d: Column) -> Column:
        out = d.isin(*SKIP_DIRS)
        for e in SKIP_ENDS:
            out = out | d.endswith(e)
        return out if hidden else out | (d.startswith(".") & ~d.isin(".planning", ".", ".."))

    return F.exists(folders, skip)


def _words(c: Column) -> Column:
    return c.rlike("(^|[_.-])(" + "|".join(re.escape(w) for w in SENSITIVE_WORDS) + ")($|[_.-])")


def is_sensitive(path: str = "path") -> Column:
    """By extension, name, a word between boundaries in the stem, or a folder."""
    name = ascii_lower(file_name(path))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    folders = F.slice(parts(path), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    return (
        extension(path).isin(*SENSITIVE_EXTENSIONS) | name.isin(*SENSITIVE_NAMES) | _words(stem) | _words(F.replace(stem, F.lit("-"), F.lit("_"))) | F.exists(folders, lambda d: ascii_lower(d).isin(*SENSITIVE_DIRS))
    )


def readable(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes a replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def paper_signs(text: str = "text") -> Column:
    """How many signs of a paper stand in the first ``PAPER_PEEK`` bytes."""
    head = readable(F.substring(F.encode(text, "UTF-8"), 1, PAPER_PEEK))
    total = F.lit(0)
    for p in PAPER_SIGNS:
        total = total + head.rlike("(?i)" + p).cast("int")
    return total


def classify(path: str = "path", text: str | None = None) -> Column:
    """code, paper, document or image; null for other files."""
    ext = extension(path)
    doc = F.when(paper_signs(text) >= PAPER_LEAST, F.lit("paper")).otherwise(F.lit("document")) if text else F.lit("document")
    asset = F.col(path).contains(".xcassets/") | F.col(path).contains(".imageset/")
    return F.when(ext.isin(*CODE), "code").when(ext.isin(*PAPERS) & ~asset, "paper").when(ext.isin(*DOCS), doc).when(ext.isin(*IMAGES), "image").when(ext.isin(*OFFICE), "document")


def rule_regex(pattern: str) -> tuple[str, bool] | None:
    """A line of an ignore file as a regular expression over paths, and whether it takes back.

    As git reads them: classes in brackets, a backslash before what is meant
    literally, white space at the end that doesn't count unless it has one.
    """
    p = re.sub(r"(?<!\\)\s+$", "", pattern.rstrip("\n"))
    if not p or p.startswith("#"):
        return None
    negated, p = p.startswith("!"), p[p.startswith("!") :]
    folder, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        close = p.find("]", i + 2 + (p[i + 1 : i + 2] in ("!", "^"))) if p[i] == "[" else -1
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        elif close > 0:
            inside, no = p[i + 1 : close], p[i + 1] in "!^"
            out, i = out + "(?!/)[" + "^" * no + re.sub(r"([\[\]\\&^])", r"\\\1", inside[no:]) + "]", close + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if folder else "(?:/.*)?$"), negated


def ignored(files: DataFrame, *rule_lists: list[str]) -> DataFrame:
    """Adds ``ignored``: the last rule that matches counts, later lists after earlier ones."""
    rules = [r for lines in rule_lists for line in lines if (r := rule_regex(line))]
    state = F.lit(False)
    for regex, negated in rules:
        state = F.when(F.col("path").rlike(regex), F.lit(not negated)).otherwise(state)
    return files.withColumn("ignored", state)


def detect(files: DataFrame) -> DataFrame:
    """``files(path, content)`` → ``(path, file_type, words, sha256, sensitive)`` of what is to be read."""
    rows = files.where(~in_noise()).withColumn("sensitive", is_sensitive()).withColumn("text", readable(F.col("content")))
    rows = rows.withColumn("file_type", classify("path", "text")).where("sensitive or file_type is not null")
    binary = F.col("file_type").isin("image") | extension("path").isin(*PAPERS, *OFFICE)
    return rows.select("path", "file_type", F.when(~binary, word_count("text")).otherwise(0).cast("long").alias("words"), F.sha2("content", 256).alias("sha256"), "sensitive")


def summary(detected: DataFrame) -> DataFrame:
    """One row: files, words, whether a graph is worth it, and a warning."""
    r = detected.where(~F.col("sensitive")).agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("total_words"))
    warning = F.when(F.col("total_words") > MANY_WORDS, "very large corpus").when((F.col("total_words") > WARN_WORDS) | (F.col("total_files") > WARN_FILES), "large corpus")
    return r.select("total_files", "total_words", (F.col("total_files") >= 2).alias("needs_graph"), warning.alias("warning"))


def changes(detected: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(path, change)`` against ``manifest(path, sha256)``: added, changed, same, deleted."""
    now, old = detected.select("path", F.col("sha256").alias("now")), manifest.select("path", F.col("sha256").alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("old"), "same").otherwise("changed")
    return now.join(old, "path", "full_outer").select("path", kind.alias("change"))


def updated_manifest(detected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Current entries over old ones; entries of deleted files stay."""
    old = manifest.join(detected.select("path"), "path", "left_anti").select("path", "file_type", "sha256")
    return detected.where(~F.col("sensitive")).select("path", "file_type", "sha256").unionByName(old)


def cache_misses(detected: DataFrame, cache: DataFrame) -> DataFrame:
    """What ``cache(sha256, path)`` doesn't hold; the path counts, so that copies don't share a source."""
    return detected.join(cache.select("sha256", "path"), ["sha256", "path"], "left_anti")


def llm_cache_hits(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """``sources(path, sha256)`` with ``extraction`` from ``cache(path, sha256, provider, prompt_version, generated_at, extraction)``.

    An entry of the same content counts; else the latest of the path, marked stale.
    """
    exact = cache.groupBy("path", "sha256").agg(F.max_by("extraction", "generated_at").alias("current"))
    latest = cache.groupBy("path").agg(F.max_by("extraction", "generated_at").alias("latest"))
    both = sources.join(exact, ["path", "sha256"], "left").join(latest, "path", "left")
    return both.select("path", "sha256", F.coalesce("current", "latest").alias("extraction"), (F.col("current").isNull() & F.col("latest").isNotNull()).alias("llm_stale_preserved"))


def first_by_path(files: DataFrame) -> DataFrame:
    """Sorted paths, each once."""
    w = W.partitionBy("path").orderBy("length")
    return files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").orderBy("path")
