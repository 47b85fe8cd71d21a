import hashlib
import html
import re
from collections import defaultdict

import pytest
from helpers import SMALL, rows_of

from keyloom.llm import htmltext, warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SMALL}/pages.parquet")


@pytest.fixture(scope="module")
def odd_pages(spark, pages):
    rows = [(None, None, None), (7001, None, None), (7002, "http://a.b/ c\n", ""), (7003, "http://[bad", "x" * 999), (7004, "http://[bad", "x" * 999), (7005, "//h", "é" * 500), (7006, "http://h:8080/p?q", "é" * 500), (None, "http://h/", "é" * 500), (7007, "http://h/", "<p>" + "word " * 200_000)]
    return spark.createDataFrame(rows + rows[:2], PAGES).union(pages).union(pages.selectExpr("page_id + 100000", "url", "html").limit(20))


def test_round_trip(spark, odd_pages):
    folder, parts = warc.write(odd_pages)
    shown = lambda v: -1 if v is None else v
    got = sorted((shown(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], shown(r["refers_to"])) for r in warc.read_back(folder, parts, warc.captures(odd_pages)).collect())
    rows, latest = odd_pages.collect(), defaultdict(lambda: -1)
    for r in rows:
        latest[r["html"] or ""] = max(latest[r["html"] or ""], r["page_id"] if r["page_id"] is not None else -1)
    want = []
    for r in rows:
        data = (r["html"] or "").encode()
        again = len(data) >= 1000 and latest[r["html"] or ""] >= 0 and r["page_id"] != latest[r["html"] or ""]
        want.append((r["page_id"] if r["page_id"] is not None else -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", latest[r["html"] or ""] if again else -1))
    assert got == sorted(want)


def test_round_trip_equals_sql(spark, duck):
    from keyloom.llm import queries

    assert rows_of(queries.op7_warc_index(spark, SMALL).toPandas()) == rows_of(duck.execute(warc.ORACLE).df())


def test_lookup_by_bisection(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 4)
    folder, blocks = warc.write(pages)
    assert sum(r["n_blocks"] for r in blocks.collect()) > pages.count() / 8
    rows = pages.collect()
    for r in rows[::17]:
        found = warc.lookup(spark, folder, blocks, [r["url"]])
        assert r["page_id"] in {x["page_id"] for x in found}
        assert {x["page_id"] for x in found} == {y["page_id"] for y in rows if warc.url_key(y["url"]) == warc.url_key(r["url"])}
    assert warc.lookup(spark, folder, blocks, ["http://nowhere.zz/", ""]) == []


def test_damage_is_found(spark, pages):
    record = warc._record({"payload": b"abc", "digest": hashlib.sha1(b"abd").hexdigest(), "kind": "response", "page_id": 1, "url": "u", "refers_to": None, "date": "2024-01-01T00:00:00Z"})
    with pytest.raises(ValueError):
        warc.parse(record)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    assert htmltext.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_url_keys_in_expressions(spark, odd_pages):
    urls = [None, "", " ", "http://h/ a\tb\x7f", "HTTP://u:p@Www.Example.COM:8080/a/b?c=d#e?f", "//h", "mailto:a@b", "no url", "http://h?q", "http://h#f\ng", "https://x.y:443", "http://é.ü/ñ", "http://[bad", "http://a.b:/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").union(odd_pages.select("url"))
    for r in df.select("url", warc.key_column(df["url"]).alias("key")).collect():
        assert r["key"] == warc.url_key(r["url"])


def test_one_url_with_many_pages_and_equal_payloads(spark, monkeypatch):
    """All pages have one URL and nearly all one payload; few lines in a block."""
    monkeypatch.setattr(warc, "LINES", 7)
    df = spark.range(3000).selectExpr("id page_id", "'http://h/' url", "if(id % 100 = 0, concat(repeat('x', 2000), id), repeat('y', 2000)) html").repartition(5)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert got == {i: ("response", None) if i % 100 == 0 or i == 2999 else ("revisit", 2999) for i in range(3000)}


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.url_key("https://h.org:8080") == "org,h:8080)/" and warc.url_key(None) == "-"


def test_articles(pages, odd_pages):
    for r in htmltext.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br|article)>", body)]
        assert r["text"] == "\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])
    assert htmltext.extract(odd_pages).count() == odd_pages.count()


PARTS = {
    "<nav><a href=/>Home</a> <a href=/x>More</a></nav>": "", "<header><h1>Site name</h1></header>": "", "<footer>&copy; all of it, and quite a long text that goes on for many words</footer>": "",
    "<aside>Beside the text there are many words, as long as an article's paragraph could be</aside>": "", "<div class='cookie-notice'>We use cookies to make this page better for you and all others</div>": "",
    "<div id=ad-top>Buy this thing now, it is the best thing that you have ever bought</div>": "", "<form><label>Name</label><input><p>Please fill in all of the fields of this form today</p></form>": "",
    "<script>if (a < b) { '<p>' }</script>": "", "<style>p > b {}</style>": "", "<!-- <p>a comment</p> -->": "",
    "<section id='comments'><article class='comment'><p>I read this with joy and have to say that it is the best of all articles.</p></article></section>": "",
    "<p>First <b>par</b>agraph &amp; more\n of&nbsp;it</p>": "First paragraph & more of it", "<p>One<br>two 1 < 2": "One\ntwo 1 < 2", "<p>Short.</p>": "Short.", "<table><tr><td>a<td>b</table>": "a\nb",
}


@pytest.mark.parametrize("order", [1, -1])
def test_parts_of_a_page(order):
    inside = [(k, v) for k, v in PARTS.items() if v][::order]
    outside = [k for k, v in PARTS.items() if not v][::order]
    page = "<html><head><title>T</title></head><body>" + "".join(outside[:6]) + "<main><article><h1>Title</h1>" + outside[3] + "".join(k for k, _ in inside) + "</article></main>" + "".join(outside[6:]) + "</body></html>"
    assert htmltext.main_text(page) == "\n".join(["Title", *[v for _, v in inside]])


def test_captions_and_formulas_of_an_article():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='tex'>x = 1</annotation></semantics></math>"
    caption = "<figure><img src=a><figcaption>A heron at the lake in the early morning of a cold day.</figcaption></figure>"
    page = f"<nav>{formula}</nav><article><h1>Title</h1><p>So it follows that {formula} holds for every one of the cases above.</p>{caption}</article><figure><figcaption>Shop now</figcaption></figure>"
    want = ["Title", "So it follows that x=1 holds for every one of the cases above.", "A heron at the lake in the early morning of a cold day."]
    assert htmltext.main_text(f"<html><body>{page}</body></html>") == "\n".join(want)


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<", ""), ("<!-- x", ""), ("<script>x", ""), ("<article>open <p>text", "open\ntext"), ("<article>a<di", "a"), ("<nav><ul><li>Menu<article>Text of it.</article>", "Text of it.")])
def test_broken_pages(page, text):
    assert htmltext.main_text(page) == text


def test_pages_without_marks():
    line = "this paragraph of the page has quite a few words and no link at all in it "
    page = "<div><a href=1>Home</a><a href=2>News</a></div><div><a href=3>Old</a></div><h2>A title of it</h2><div>" + line * 3 + "</div><div>" + line * 2 + "</div><div><a href=4>Next page</a></div>"
    assert htmltext.main_text(page) == "A title of it\n" + " ".join((line * 3).split()) + "\n" + " ".join((line * 2).split())


LINE = "this paragraph of the page has quite a few words and no link at all in it"
WHOLE = f"<h1>Title</h1><p>{LINE}</p><p>{LINE} too</p>"
TEXT = f"Title\n{LINE}\n{LINE} too"


@pytest.mark.parametrize("page", [
    f"<body class='home right-sidebar'><article>{WHOLE}</article><div class=right-sidebar><p>{LINE}</p></div></body>",
    f"<body class='search comments-open'><div class='layout with-sidebar'><article>{WHOLE}</article></div></body>",
    f"<body><form id=aspnetForm><nav><a href=/>Home</a></nav><article>{WHOLE}</article><input type=submit></form></body>",
    f"<body><form id=aspnetForm><div><a href=/>Home</a></div><div>{WHOLE}<p>{LINE} again</p></div></form></body>",
    f"<article class='post category-search tag-advert comments-open'>{WHOLE}</article>",
    f"<div class='right-sidebar search-page'><div class=post>{WHOLE}</div></div>",
    f"<header><h1>Site</h1></header><div role=main>{WHOLE}</div><div role=complementary><p>{LINE}</p></div>",
    f"<a name=top><article>{WHOLE}</article>",
    f"<nav><ul><li>Menu<main>{WHOLE}</main>",
    f"<div class=related><article><p>{LINE}</p></article></div><main>{WHOLE}</main>",
    f"<main><nav><a href=/>Home</a></nav><article>{WHOLE}</article><ul><li><a href=/1>one</a><li><a href=/2>two</a></ul></main>",
    f"<article>{WHOLE}<section id=comments><article class=comment><p>{LINE}, they say.</p></article></section></article>",
    f"<article>{WHOLE}<div class=share><a href=/t>Tell</a> <a href=/m>Mail</a></div><form><p>{LINE}</p></form></article>",
    f"<article>{WHOLE}</article><p>{LINE} outside</p><div>Made by us, all of it and with love</div>",
    f"<article hidden=until-found>{WHOLE}</article>", f"<body style='display:none'><article>{WHOLE}</article></body>",
])
def test_wrappers_do_not_empty_a_page(page):
    assert htmltext.main_text(page).removesuffix(f"\n{LINE} again") == TEXT


@pytest.mark.parametrize("page,text", [
    (f"<article>{WHOLE}<p><a href=/1>All of a list of links</a> <a href=/2>and more</a></p></article>", TEXT + "\nAll of a list of links and more"),
    (f"<article>{WHOLE}<ul><li><a href=/1>one</a></li><li><a href=/2>two</a></li></ul></article>", TEXT + "\none\ntwo"),
    ("<html><body><p>Hello world.</p></body></html>", "Hello world."), ("<div>Just a text</div>", "Just a text"), ("Bare", "Bare"), ("<h1>Title</h1><p>Short.</p>", "Title\nShort."),
    ("<article><p>" + "İ" * 120 + "</p><script>x</script><p>rest</p></article>", "İ" * 120 + "\nrest"),
    ("<article><p>Text.</p><script src=a.js/>code</script><p>more</p></article>", "Text.\nmore"), ("<article><p>Text.</p><SCRIPT>a</scripted></ScRipt ><p>more</p></article>", "Text.\nmore"),
    ("<article><p>Text <svg><title>t</title><path d=1/>junk</svg> end</p><object>no</object><p>after</p></article>", "Text end\nafter"),
    ("<article><p>Text.</p><svg/><p>after</p></article>", "Text.\nafter"),
    (f"<article><section id=discussion><h2>Discussion</h2><p>{LINE} {LINE}</p></section></article>", f"Discussion\n{LINE} {LINE}"),
    (f"<div id=comments><div class=comment><p>{LINE} {LINE}</p></div></div><div><p>{LINE}</p></div>", LINE), (f"<div class=cookie-notice><p>{LINE} {LINE} {LINE}</p></div><p>Hello.</p>", "Hello."),
    (f"<h1>Title</h1><article><p>{LINE}</p></article>", f"Title\n{LINE}"), (f"<h1>Site</h1><article><h2>Title</h2><p>{LINE}</p></article>", f"Title\n{LINE}"),
    ("<nav><a href=/1>One</a> <a href=/2>Two</a></nav>", ""), ("<ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul>", ""),
])
def test_contract_of_the_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_generated_pages_without_an_article():
    """Against the parts that they are made of: furniture of ten kinds around and between paragraphs, titles and list items."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    furniture = [
        lambda: "<nav>" + "".join(f"<a href=/{word()}>{word()}</a>" for _ in range(5)) + "</nav>", lambda: f"<div class='site-header'>{text(2, 8)}</div>", lambda: f"<footer><p>{text(5, 60)}</p></footer>",
        lambda: f"<aside><p>{text(20, 80)}</p></aside>", lambda: f"<div id=cookieNotice><p>{text(10, 40)}</p></div>", lambda: f"<div class=ad-box>{text(3, 50)}</div>", lambda: f"<form><p>{text(3, 20)}</p><label>{word()}</label></form>",
        lambda: f"<script>var x = '<p>{text(5, 9)}</p>'</script>", lambda: "<ul class=menu>" + "".join(f"<li><a href=/{word()}>{text(1, 3)}</a>" for _ in range(4)) + "</ul>", lambda: f"<div class='comments'><div class=comment><p>{text(10, 60)}</p></div></div>",
    ]
    for _ in range(300):
        parts, want = [], []
        for _ in range(rng.randint(3, 9)):
            parts += [rng.choice(furniture)() for _ in range(rng.randint(0, 2))]
            kind = rng.choice(["p", "p", "div", "h2"])
            body = text(25, 120) if kind == "div" else text(6, 90) if kind == "p" else text(5, 9)
            parts.append(f"<{kind}>{body}</{kind}>" + (f"<p>{(more := text(20, 60))}</p>" if kind == "h2" else ""))
            want += [body, more] if kind == "h2" else [body]
        around = rng.choice(["{}", "<div class='page with-sidebar'>{}</div>", "<form name=f>{}</form>", "<div id=wrapper><div class='col left-sidebar'>{}</div></div>"])
        page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + around.format("".join([furniture[0](), furniture[1]()] + parts + [furniture[2]()])) + "</body></html>"
        assert htmltext.main_text(page) == "\n".join(want), page
