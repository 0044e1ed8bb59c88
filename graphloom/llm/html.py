"""Main text of pages through wrappers inferred for each host.

A wrapper is a union-free regular expression over the pages' tokens: elements
with ordered children, where a child may be optional (``?``) or repeated (``+``)
and text is a slot. A page's token stream is folded first (a child that stands
several times in a row is a repetition), then aligned with the wrapper so far:
children that match are merged, the rest become optional. Each task aligns the
pages that it sees; partial wrappers are aligned by host and salt, then by host,
so every page counts and a host with a third of all pages meets no single task.

The wrapper decides what is the article:

* Slots with one text on all pages are template and weigh nothing. From the root
  down, the main element is the child that holds most of the varying text
  outside links, or several such children that exclude each other on the host's
  pages (templates side by side). Repeated groups, and elements with headings or
  paragraphs of their own, are not entered further.
* Inside it, lists of links go, by the links of all pages. Nothing goes for being
  the same on all pages: headings are.
* Kinds of elements that are never an article (navigation, forms, scripts,
  hidden ones) go. Words in classes only break ties: such an element goes if the
  wrapper has it as optional, repeated or small beside the main element; reader
  comments always go.

Where less than ``VARIES`` of a host's text varies (one page, or copies of it),
alignment can't tell, and a page that has none of its host's main elements isn't
aligned; such go by their own elements: article, main, class words, then text.
Elements deeper than ``DEPTH`` count as parts of the one above, those that are
never an article go there too.

Defined cases: null or empty html gives an empty text; a null or odd url belongs
to the host ""; unclosed and stray tags are mended like browsers do; repeated
rows are repeated in the result; extra columns are not looked at.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import bound
from graphloom.workspace import written

BROADCAST_BYTES = 16_000_000
DEPTH, HOLD, SMALL, VARIES, SALTS = 64, 0.7, 0.15, 0.5, 64
#: A tag ends at ``>``; one that is never closed ends at the next ``<``, so it costs its own length only.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|[\"']|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|aria-label|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SECTION = frozenset("article section div main body html aside nav header footer form ul ol dl table tbody thead tfoot tr blockquote figure fieldset details".split())
#: An opening tag closes open elements of these kinds.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An unclosed list item or cell is closed inside the nearest of these only.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
BOILER_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg math object button select option textarea input dialog menu title".split())
BOILER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted menu nav navbar navigation navi breadcrumb breadcrumbs sidebar side rail widget widgets "
    "footer foot header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies "
    "respond discussion disqus share sharing social related recommended recommendations more-stories outbrain taboola pagination pager skip toolbar search copyright legal disclaimer paywall hidden".split()
)
BOILER_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
MAIN_WORDS = frozenset("article content main post entry story body text article-body post-content entry-content main-content".split())


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def signature(tag: str, attrs: str) -> str:
    """Tag, role, id without figures and classes; hidden elements are marked."""
    if not attrs.strip():
        return tag
    found = {m[0].lower(): m[1].strip("\"'") for m in ATTR.findall(attrs)}
    words = sorted(set(re.sub(r"\d+", "#", w.lower()) for w in f"{found.get('class', '')} {found.get('id', '')}".split()))
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    return tag + "".join(f".{w}" for w in words) + (f"@{found['role'].lower()}" if found.get("role") else "") + ("!" if hidden else "")


def _words(sig: str) -> list[str]:
    return [w for c in sig.partition("@")[0].rstrip("!").split(".")[1:] for w in (c, *re.split(r"[-_#]+", c))]


def is_furniture(sig: str) -> bool:
    """By the element's kind or role, or because it is hidden."""
    return _tag(sig) in BOILER_TAGS or sig.endswith("!") or sig.partition("@")[2].rstrip("!") in BOILER_ROLES


def is_boilerplate(sig: str) -> bool:
    """By the element's kind, role or words in its class and id."""
    if is_furniture(sig):
        return True
    return _tag(sig) not in ("html", "body", "article", "main") and any(w in BOILER_WORDS for w in _words(sig))


def _tag(sig: str) -> str:
    return re.split(r"[.@!]", sig, maxsplit=1)[0]


_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


def events(page: str):
    """``(kind, value)``: open or close with a signature, text, a link's begin or end, or a break between blocks."""
    stack: list[tuple[str, str]] = []
    open_tags: Counter[str] = Counter()
    at, n = 0, len(page)

    def shut_to(size: int):
        while len(stack) > size:
            tag, sig = stack.pop()
            open_tags[tag] -= 1
            yield "close", sig

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            if stack or page[at:].strip():
                yield "text", page[at:]
            break
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            yield ("link" if tag == "a" else "inline"), m[1]
            continue
        if m[1]:
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                yield from shut_to(k)
            elif tag == "p":
                yield "break", ""
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in SECTION:
            yield "break", ""
            continue
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in PARAGRAPH_ENDS else set())
        if any(open_tags[t] > 0 for t in shut):
            stop, k = SCOPE.get(tag, SECTION), len(stack)
            while k and stack[k - 1][0] not in stop:
                k -= 1
            inner = next((i for i in range(k, len(stack)) if stack[i][0] in shut), None)
            if inner is not None:
                yield from shut_to(inner)
        sig = signature(tag, m[3])
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
            yield "open", sig
            yield "close", sig
            continue
        stack.append((tag, sig))
        open_tags[tag] += 1
        yield "open", sig
    yield from shut_to(0)


def clean(raw: str) -> str:
    return SPACE.sub(" ", _html.unescape(raw)).strip()


# A wrapper's node: [signature, children, slot, least, most, pages]
# slot: [letters, letters in links, checksum of the text or -1 if it differs]; least and most: times in a row.


def _node(sig: str) -> list:
    return [sig, [], [0, 0, None], 1, 1, 1]


def _slot(a: list, b: list) -> list:
    same = a[2] if b[2] is None else b[2] if a[2] is None or a[2] == b[2] else -1
    return [a[0] + b[0], a[1] + b[1], same]


def merge(a: list, b: list) -> list:
    """One node for two with one signature; children that only one has become optional."""
    return [a[0], align(a[1], b[1]), _slot(a[2], b[2]), min(a[3], b[3]), max(a[4], b[4]), a[5] + b[5]]


def _optional(n: list) -> list:
    return [*n[:3], 0, *n[4:]]


def align(a: list, b: list) -> list:
    """Children of two nodes in one order, by the longest common runs of their signatures."""
    x, y = [n[0] for n in a], [n[0] for n in b]
    if x == y:
        return [merge(p, q) for p, q in zip(a, b, strict=True)]
    out = []
    for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            out += [merge(p, q) for p, q in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [_optional(n) for n in [*a[i:j], *b[k:m]]]
    return refold(out)


def refold(children: list) -> list:
    """Neighbours with one signature are one repeated child; alternating pairs too."""
    out: list = []
    for n in children:
        same = next((k for k in (1, 2) if len(out) >= k and out[-k][0] == n[0]), 0)
        if same:
            p = out[-same]
            out[-same] = [p[0], align(p[1], n[1]), _slot(p[2], n[2]), min(p[3], n[3]), p[4] + n[4], max(p[5], n[5])]
        else:
            out.append(n)
    return out


def fold(found) -> list:
    """The tree of a page or its events, its repetitions folded."""
    found = events(found) if isinstance(found, str) else found
    root = _node("")
    stack, link, below = [root], False, []
    texts: list[list[str]] = [[]]
    for kind, value in found:
        if kind == "open":
            if len(stack) > DEPTH:
                below.append(below[-1:] == [True] or is_boilerplate(value))
                texts[-1].append(" ")
                continue
            node = _node(value)
            stack[-1][1].append(node)
            stack.append(node)
            texts.append([])
        elif kind == "close":
            if below:
                below.pop()
                texts[-1].append(" ")
                continue
            node = stack.pop()
            whole = clean("".join(texts.pop()))
            node[2][2] = zlib.crc32(whole.encode("utf-8", "surrogatepass")) if whole else None
            node[1] = refold(node[1])
        elif kind == "link":
            link = not value
        elif below and below[-1]:
            continue
        elif kind == "text":
            k = len(SPACE.sub("", value))
            stack[-1][2][0] += k
            stack[-1][2][1] += k * link
            texts[-1].append(value)
        else:
            texts[-1].append(" ")
    root[1] = refold(root[1])
    return root


def is_constant(n: list) -> bool:
    """One text in all the pages that have the element."""
    return n[5] > 1 and n[2][2] not in (None, -1)


def _mass(node: list, skip) -> float:
    """Varying letters outside links below a node."""
    if skip(node[0]):
        return 0.0
    own = 0 if is_constant(node) else node[2][0] - node[2][1]
    return own + sum(_mass(c, skip) for c in node[1])


def main_elements(n: list) -> list[list]:
    """The smallest elements of a wrapper that hold most of the varying text, one for each template."""
    while True:
        total = _mass(n, is_furniture)
        if total <= 0 or _tag(n[0]) == "article" or any(_tag(c[0]) in HEADINGS and _mass(c, is_furniture) > 0 for c in n[1]):
            return [n]
        inside = sorted(((_mass(c, is_furniture), c) for c in n[1] if _tag(c[0]) in SECTION and c[4] == 1), key=lambda x: -x[0])
        chosen, pages, held = [], 0, 0.0
        for mass, c in inside:
            if mass / c[5] >= HOLD * total / n[5] and pages + c[5] <= 1.02 * n[5]:
                chosen.append(c)
                pages, held = pages + c[5], held + mass
        if held < HOLD * total:
            return [n]
        if len(chosen) > 1:
            return [m for c in chosen for m in main_elements(c)]
        n = chosen[0]


MAINS = (
    lambda n: _tag(n[0]) == "article",
    lambda n: _tag(n[0]) == "main" or n[0].partition("@")[2].rstrip("!") in ("main", "article"),
    lambda n: _tag(n[0]) in ("div", "section", "td") and any(c in MAIN_WORDS for c in n[0].partition("@")[0].split(".")[1:]),
)


def main_elements_alone(root: list) -> list[list]:
    """The main elements of a tree by their kind and words, where there is nothing to align."""

    def look(n: list, wanted) -> list[list]:
        if is_boilerplate(n[0]):
            return []
        return [n] if wanted(n) else [m for c in n[1] for m in look(c, wanted)]

    total = _mass(root, is_boilerplate)
    for wanted in MAINS:
        found = look(root, wanted)
        if found and sum(sum(_mass(c, is_boilerplate) for c in n[1]) + n[2][0] - n[2][1] for n in found) >= 0.25 * total:
            return found
    n = root
    while True:  # down to the smallest element that holds most of the text
        best = max(n[1], key=lambda c: _mass(c, is_boilerplate), default=None)
        if best is None or _tag(best[0]) not in SECTION or _mass(best, is_boilerplate) < HOLD * _mass(n, lambda sig: is_boilerplate(sig) and sig != n[0]):  # noqa: B023
            return [n]
        n = best


def _letters(node: list) -> int:
    """Letters outside links and furniture below a node, the same on all pages or not."""
    return 0 if is_furniture(node[0]) else node[2][0] - node[2][1] + sum(map(_letters, node[1]))


def rules(root: list, alone: bool = False) -> dict[str, bool]:
    """Which element paths hold text of the article; paths outside the main elements are left out.

    A wrapper tells what is the article by what varies, if ``VARIES`` of the text
    does; else (one page, copies of it) by the elements alone. Inside the main
    elements nothing goes for being the same on all pages.
    """
    alone = alone or _mass(root, is_furniture) < VARIES * _letters(root) or max((c[5] for c in root[1]), default=0) < 2
    found: dict[str, bool] = {}
    mains = {id(n): _mass(n, is_furniture) / n[5] for n in (main_elements_alone(root) if alone else main_elements(root))}

    def goes(n: list, up: list, weight: float) -> bool:
        """Whether an element inside a main element is no part of the article."""
        tag = _tag(n[0])
        if tag == "header" and not n[0].partition("@")[2]:
            return False  # an article's own heading
        if is_furniture(n[0]):
            return True
        letters, links = _sums(n)
        if tag in ("ul", "ol", "div", "section", "table") and letters and links > 0.8 * letters:
            return True
        if not is_boilerplate(n[0]):
            return False
        small = _mass(n, is_furniture) / n[5] < SMALL * weight
        return alone or small or n[3] == 0 or n[4] > 1 or n[5] < up[5] or any(w in COMMENT_WORDS for w in _words(n[0]))

    def walk(n: list, up: list | None, path: str, weight: float | None) -> None:
        here = f"{path}/{n[0]}" if n[0] else path
        main = id(n) in mains
        weight = mains[id(n)] if main else weight
        if weight is not None:
            keep = main or not goes(n, up, weight)
            found[here] = found.get(here, False) or keep
            if not keep:
                return
        for c in n[1]:
            walk(c, n, here, weight)

    walk(root, None, "", None)
    return found


def _sums(n: list) -> tuple[int, int]:
    a, b = n[2][0], n[2][1]
    for c in n[1]:
        x, y = _sums(c)
        a, b = a + x, b + y
    return a, b


def blocks(found):
    """``(path, signature, text)`` of a page's runs of text, in order, and ``(path, signature, None)`` where an element opens.

    A run is what stands between the begins and ends of elements; breaks in it part its blocks.
    """
    paths, below, now, lines = [("", "")], [], [], []

    def line() -> None:
        if now and (t := clean("".join(now))):
            lines.append(t)
        now.clear()

    for kind, value in found:
        if kind == "text":
            if below[-1:] != [True]:
                now.append(value)
            continue
        if kind in ("link", "inline"):
            continue
        line()
        if kind == "break":
            continue
        if lines:
            yield (*paths[-1], " ".join(lines))
            lines.clear()
        if kind == "open":
            if len(paths) > DEPTH:
                below.append(below[-1:] == [True] or is_boilerplate(value))
                continue
            paths.append((f"{paths[-1][0]}/{value}", value))
            yield (*paths[-1], None)
        elif below:
            below.pop()
        else:
            paths.pop()
    line()
    if lines:
        yield (*paths[-1], " ".join(lines))


def extract(found, keep: dict[str, bool]) -> str | None:
    """The article's text; None if the page has no main element. ``keep``: paths; unknown ones follow their parents."""
    known: dict[str, bool | None] = {"": keep.get("")}
    out, some = [], known[""] is not None
    for path, sig, text in found:
        if text is None:
            if path not in known:
                up = known[path[: len(path) - len(sig) - 1]]
                known[path] = keep.get(path, None if up is None else up and not is_boilerplate(sig))
            some = some or known[path] is not None
        elif known[path]:
            out.append(text)
    return " ".join(out) if some else None


def main_text_of(page: str | None, keep: dict[str, bool]) -> str:
    if not page:
        return ""
    found = list(events(page))
    text = extract(blocks(found), keep)
    return extract(blocks(found), rules(fold(found), alone=True)) or "" if text is None else text


TOLD = "host string, salt int, wrapper string"


def told_by(batches):
    """A wrapper of a task's pages for each host."""
    trees: dict[str, list] = {}
    salt = TaskContext.get().partitionId() % SALTS
    for pdf in batches:
        for host, page in zip(pdf["host"], pdf["html"], strict=True):
            if page:
                tree = fold(page)
                trees[host] = merge(trees[host], tree) if host in trees else tree
    if trees:
        some = [json.dumps(w, separators=(",", ":")) for w in trees.values()]
        yield pd.DataFrame({"host": list(trees), "salt": salt, "wrapper": some})


def _aligned(pdf: pd.DataFrame) -> list:
    tree = None
    for w in sorted(pdf["wrapper"]):
        tree = json.loads(w) if tree is None else merge(tree, json.loads(w))
    return tree


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, rules)``: paths of each host's wrapper as JSON."""

    def by_salt(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(_aligned(pdf), separators=(",", ":"))]})

    def by_host(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "rules": [json.dumps(rules(_aligned(pdf)), separators=(",", ":"))]})

    bound(pages.sparkSession)
    told = pages.select(host_of().alias("host"), "html").mapInPandas(told_by, TOLD)
    some = told.groupBy("host", "salt").applyInPandas(by_salt, "host string, wrapper string")
    return written(some.groupBy("host").applyInPandas(by_host, "host string, rules string"), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``."""
    known = wrappers(pages)
    size = known.agg(F.sum(F.octet_length("rules"))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    rows = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")

    def run(batches):
        compiled: dict[str, dict[str, bool]] = {}
        for pdf in batches:
            texts = []
            for page, host, rule in zip(pdf["html"], pdf["host"], pdf["rules"], strict=True):
                if not page or not isinstance(rule, str):
                    texts.append("")
                    continue
                if host not in compiled:
                    if len(compiled) > 256:
                        compiled.clear()
                    compiled[host] = json.loads(rule)
                texts.append(main_text_of(page, compiled[host]))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.select("page_id", "url", "html", "host", "rules").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op5(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
