"""Web pages: where an address leads, what a page says, which addresses are safe to fetch."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import html_title, strip_html


def route(url: str = "url") -> Column:
    """arxiv, tweet, pdf or webpage."""
    low = F.lower(url)
    tweet = low.rlike(r"^https?://(www\.)?(twitter\.com|x\.com)/")
    return F.when(low.contains("arxiv.org"), "arxiv").when(tweet, "tweet").when(F.regexp_replace(low, r"[?#].*$", "").endswith(".pdf"), "pdf").otherwise("webpage")


def page_markdown(pages: DataFrame) -> DataFrame:
    """``(page_id, url, title, body, document)`` with front matter."""
    body, title = strip_html("html"), html_title("html")
    front = F.concat(F.lit("---\nurl: "), "url", F.lit("\ntitle: "), "title", F.lit("\n---\n\n"), "body")
    return pages.select("page_id", "url", title.alias("title"), body.alias("body")).withColumn("document", front)


def arxiv_id(url: str = "url") -> Column:
    return F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf)/([\w.\-/]+?)(?:v\d+)?(?:\.pdf)?(?:[?#].*)?$", 1)


def arxiv_abstract(feed: str = "feed") -> Column:
    """Title and summary out of a feed."""
    part = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(feed, rf"(?s)<entry>.*?<{tag}>(.*?)</{tag}>", 1), r"\s+", " "))
    return F.struct(part("title").alias("title"), part("summary").alias("summary"))


def tweet_text(oembed: str = "oembed") -> Column:
    """Author and text out of an embedding answer."""
    d = F.from_json(oembed, "author_name string, html string")
    return F.struct(d["author_name"].alias("author"), strip_html(d["html"]).alias("text"))


_BLOCKED = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4", "::1/128", "fc00::/7", "fe80::/10", "::/128")]


def _number(s: str) -> int | None:
    try:
        return int(s, 16) if s.lower().startswith("0x") else int(s, 8) if len(s) > 1 and s.startswith("0") else int(s)
    except ValueError:
        return None


def host_address(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address a host spells, in any of the usual forms."""
    host = host.strip("[]")
    try:
        return ipaddress.ip_address(host)
    except ValueError:
        pass
    numbers = [_number(p) for p in host.split(".")]
    if not 1 <= len(numbers) <= 4 or any(n is None or n < 0 for n in numbers):
        return None
    *front, last = numbers
    if any(n > 255 for n in front) or last >= 256 ** (5 - len(numbers)):
        return None
    value = last
    for i, n in enumerate(front):
        value += n << (8 * (3 - i))
    return ipaddress.IPv4Address(value)


def is_safe(url: str | None) -> bool:
    """http or https to a host that isn't private, local or reserved."""
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").rstrip(".").lower()
    except ValueError:
        return False
    if u.scheme not in ("http", "https") or not host or host == "localhost" or re.search(r"\.(localhost|local|internal)$", host):
        return False
    a = host_address(host)
    if a is not None and getattr(a, "ipv4_mapped", None):
        a = a.ipv4_mapped
    return a is None or not any(a in n for n in _BLOCKED if n.version == a.version)


def safe_url(url: str = "url") -> Column:
    return F.pandas_udf(lambda urls: urls.map(is_safe), "boolean")(F.col(url))


def fnv1a64_of(s: str | None) -> int:
    h = 0xCBF29CE484222325
    for b in (s or "").encode():
        h = (h ^ b) * 0x100000001B3 & (2**64 - 1)
    return h - (1 << 64) if h >> 63 else h


def fnv1a64(text: str = "text") -> Column:
    """FNV-1a of the UTF-8 bytes, as a signed number."""
    return F.pandas_udf(lambda texts: texts.map(fnv1a64_of), "long")(F.col(text))


def safe_path(path: str, root: str) -> bool:
    """Stays below its root."""
    depth = 0
    for p in path.split("/"):
        depth += 0 if p in ("", ".") else -1 if p == ".." else 1
        if depth < 0:
            return False
    return not path.startswith("/") or path == root or path.startswith(root.rstrip("/") + "/")


def links(pages: DataFrame) -> DataFrame:
    """``(page_id, host, href)`` for each link of a page."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1))
    return pages.select("page_id", F.regexp_extract("url", r"^\w+://([^/:?#]+)", 1).alias("host"), href.alias("href"))
