"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower case for A-Z only."""
    return F.translate(col(c), UPPER, LOWER)


def make_id(*parts: Column | str) -> Column:
    """A stable identifier from parts: empty parts go, the rest is joined, folded to ``_`` and lower-cased."""
    trimmed = F.transform(F.filter(F.array(*map(col, parts)), lambda x: x != ""), lambda x: F.btrim(x, F.lit("_.")))
    folded = F.regexp_replace(F.array_join(trimmed, "_"), r"[^\p{IsAlphabetic}\p{N}]+", "_")
    return F.lower(F.btrim(folded, F.lit("_")))


def xml_escape(c: Column | str) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(col(c), F.lit(a), F.lit(b))
    return c


def sanitize_label(c: Column | str, limit: int = 256) -> Column:
    """No control characters, at most ``limit`` characters, five characters escaped."""
    c = F.substring(F.regexp_replace(col(c), r"\p{Cntrl}", ""), 1, limit)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cypher_escape(c: Column | str) -> Column:
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(col(c), F.lit(a), F.lit(b))
    return c


def sanitize_var(c: Column | str) -> Column:
    """A variable name: other characters become ``_``, a leading figure gets ``n``."""
    v = F.regexp_replace(col(c), r"[^A-Za-z0-9_]", "_")
    return F.when(v == "", F.lit("n")).when(v.rlike(r"^[0-9]"), F.concat(F.lit("n"), v)).otherwise(v)


def sanitize_filename(c: Column | str, limit: int = 240) -> Column:
    v = F.btrim(F.regexp_replace(col(c), r'[/\\:*?"<>|\x00-\x1f]', "_"), F.lit(" ."))
    return F.when(v == "", F.lit("untitled")).otherwise(F.substring(v, 1, limit))


def lines_of(c: Column | str) -> Column:
    """Lines without their ends; an empty last line is no line."""
    parts = F.split(F.regexp_replace(col(c), "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def compact_text(c: Column | str, limit: int) -> Column:
    """Trimmed lines without blank ones, cut at ``limit`` characters with an ellipsis."""
    kept = F.filter(F.transform(F.split(col(c), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    whole = F.array_join(kept, "\n")
    return F.when(F.length(whole) > limit, F.concat(F.substring(whole, 1, limit), F.lit("…"))).otherwise(whole)


def truncate_chars(c: Column | str, limit: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def estimate_tokens(c: Column | str) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(col(c)) / 4).cast("long")


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(col(c), r"\s+"), lambda x: x != "")).cast("long")


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def strip_html(c: Column | str) -> Column:
    """Scripts, styles and tags removed, blanks and empty lines collapsed."""
    for pattern, to in ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"<[^>]*>", " "), (r"[ \t]+", " "), (r"\n\s*\n+", "\n\n")):
        c = F.regexp_replace(col(c), pattern, to)
    return F.trim(c)


def html_title(c: Column | str) -> Column:
    return F.trim(F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title>", 1))


def cosine(a: Column | str, b: Column | str) -> Column:
    """In double precision; 0 for different lengths or a zero vector."""
    a, b = col(a), col(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) for v in (a, b)]
    return F.when((F.size(a) == F.size(b)) & (norm[0] > 0) & (norm[1] > 0), dot / (norm[0] * norm[1])).otherwise(F.lit(0.0))


def parent_dir(path: Column | str) -> Column:
    """``.`` for an empty path, the empty string for a bare file name."""
    path = col(path)
    return F.when(path == "", F.lit(".")).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """With its dot, lower-cased; empty if there is none."""
    return ascii_lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def disambiguated(label: Column | str, path: Column | str) -> Column:
    """``parent::label``: the folder before ``src``, else the folder of the file."""
    parts = F.filter(F.split(col(path), "/"), lambda x: x != "")
    at = F.array_position(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "src").cast("int")
    label = col(label)
    return (
        F.when(at > 0, F.concat(F.element_at(parts, F.greatest(at, F.lit(1))), F.lit("::"), label))
        .when(F.size(parts) >= 2, F.concat(F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1))), F.lit("::"), label))
        .otherwise(label)
    )
