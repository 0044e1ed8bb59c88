"""Hosts whose pages have more than one template."""

import pytest

from graphloom.llm import html

BODY = "<h1>Head {i}</h1><p>First words of page {i} that say enough.</p><p>More words of page {i}.</p>"
KINDS = {"article": "<article>{}</article>", "div": '<div class="content">{}</div>', "path": '<div class="xyz">{}</div>', "path2": '<div class="zyx"><div class="k">{}</div></div>'}


@pytest.mark.parametrize("url", ["https://a.example/p", None, "no url"])
@pytest.mark.parametrize("first, second, share", [("article", "div", 4), ("article", "div", 1), ("div", "article", 2), ("path", "path2", 2), ("article", "path", 4)])
def test_each_template_of_a_host_keeps_its_text(spark, url, first, second, share):
    rows = []
    for i in range(20):
        kind = KINDS[first if i % 10 < share else second]
        rows.append((i, url, f"<html><body><nav><a href=x>Home</a></nav>{kind.format(BODY.format(i=i))}<footer>Ours</footer></body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got == {i: f"Head {i} First words of page {i} that say enough. More words of page {i}." for i in range(20)}


def neutral(host, i, noise):
    """No kind or class tells what is what; notices stand in the content's own tags."""
    words = " ".join(f"{noise}{i}w{k}" for k in range(60))
    if host == "q.example":
        return f'<div class="xa"><p>{"All rights to the house of Q are kept by Q. " * 10}</p></div><div class="xb"><div class="xc"><h2>T{i}</h2><p>{words}</p><p>Please read our note on the use of this place.</p><p>{words} b</p></div></div><div class="xd"><p>Q{i % 3}</p></div>'
    many = "".join(f"<div class=zi>{words} {k}</div>" for k in range(i % 4 + 1))
    side = f'<div class="legal">{words} legal</div>' if i % 2 else ""
    return f'<div class="za"><div class="zb">{many}<div class="legal notice">{words} of the law, which varies and is long. {words}</div>{side}</div></div><div class="zc">Z is a fine place to be and to stay.</div>'


def expected(host, i, noise):
    words = " ".join(f"{noise}{i}w{k}" for k in range(60))
    if host == "q.example":
        return f"T{i} {words} Please read our note on the use of this place. {words} b"  # inside the article, in its own tags
    return " ".join([*(f"{words} {k}" for k in range(i % 4 + 1)), f"{words} of the law, which varies and is long. {words}"])


def test_wrappers_decide_where_words_say_nothing(spark):
    rows = []
    for i in range(24):
        for host in ("q.example", "z.example"):
            rows.append((len(rows), f"http://{host}/{i}", f"<html><body>{neutral(host, i, 'n')}</body></html>", expected(host, i, "n")))
    for _ in range(40):  # copies of one page don't make its text a template
        rows.append((len(rows), "http://q.example/0", rows[0][2], rows[0][3]))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got == {r[0]: r[3] for r in rows}
    alone = [html.main_text_of(r[2], {}) for r in rows]
    assert sum(a != r[3] for a, r in zip(alone, rows, strict=True)) == len(rows)  # each page by itself comes out wrong


@pytest.mark.parametrize("n", [1, 2, 4, 5, 12, 500])
@pytest.mark.parametrize("tag", ["article", 'div class="x1"'])
def test_headings_that_all_pages_have_stay(spark, n, tag):
    rows, want = [], {}
    for i in range(n):
        words = [" ".join(f"w{i}x{j}y{k}" for k in range(30)) for j in range(2)]
        body = f"<h2>Background</h2><p>{words[0]}</p><p>Same words on every page.</p><h2>Results</h2><div>Constant box</div><p>{words[1]}</p>"
        rows.append((i, "http://h.example/x", f"<body><nav><a href=x>Home</a></nav><{tag}>{body}</{tag.split()[0]}><footer>Ours</footer></body>"))
        want[i] = f"Background {words[0]} Same words on every page. Results Constant box {words[1]}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html.main_text(df).collect()} == want


def test_near_copies_of_one_page_keep_their_text(spark):
    body = "".join(f"<div class=s{i}><p>Section {i} of the text, the same in all copies.</p></div>" for i in range(6))
    rows = [(i, "http://c.example/", f"<body><div class=content>{body}<div class=last><p>Edited {i}.</p></div></div></body>") for i in range(9)]
    rows += [(9 + i, "http://one.example/", rows[0][2]) for i in range(9)]
    got = [r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    whole = " ".join(f"Section {i} of the text, the same in all copies." for i in range(6))
    assert got == [f"{whole} Edited {i}." for i in range(9)] + [f"{whole} Edited 0."] * 9


@pytest.mark.parametrize("deep", [1, 63, 64, 65, 200])
def test_menus_go_at_any_depth(deep):
    page = "<div>" * deep + "<nav><ul><li>Menu</li></ul></nav><p>Kept.</p><form>Name<p>Send</p></form><p>Too.</p>" + "</div>" * deep
    assert html.main_text_of(page, {}) == "Kept. Too."


def test_odd_pages(spark):
    big = "İ" * 40 + " words"
    rows = [
        (1, "http://a/1", f"<body><article><p>{big}</p><script>var a='</p>'</SCRIPT ><p>after</p></article></body>"),
        (2, "http://a/2", "<div>" * 10_000 + "deep &amp; <b>down</b>" + "</div>" * 10_000),
        (3, "http://a/3", "<article><p>start</p>" + "<a " * 350_000),
        (4, "http://a/4", "<article><p>kept</p>" + '<p title="x' * 20_000),
        (5, None, "<article>" + "<p>word</p>" * 50_000 + "</article>"),
        (6, "http://a/6", None),
        (6, "http://a/6", ""),
        (7, "::", "no tags at all"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", html.F.lit("h")).withColumn("rules", html.F.lit(1)).withColumn("template", html.F.lit("t"))
    got = [(r.page_id, r.text, r.n_chars) for r in html.main_text(df).collect()]
    assert all(n == len(t) for _, t, n in got) and len(got) == len(rows)
    text = dict((p, t) for p, t, _ in got)
    assert text[1] == f"{big} after" and text[2] == "deep & down" and text[3] == "start" and text[4] == "kept"
    assert text[5] == " ".join(["word"] * 50_000) and text[6] == "" and text[7] == "no tags at all"
    assert html.main_text(df.limit(0)).count() == 0
