import html
import random
import re

from pyspark.sql import functions as F

from sparkloom.llm import html_extraction
from sparkloom.llm.html_extraction import Partial, digest, parse, reader_of, skeleton, united
from tests.compare import SF

SCHEMA = "page_id long, url string, html string"


def read_all(pages, alone=False):
    """Pages of one host by their wrapper, or each by its own skeleton."""
    reader = None if alone else reader_of(united([Partial(skeleton(parse(p)), {digest(p)}) for p in pages]).dump())
    return [html_extraction.read(p, reader) for p in pages]


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_pages(spark):
    got = {r.page_id: r for r in html_extraction.op3_html(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h\d)>", article))
        assert got[p.page_id].text == "\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)


def template_a(rnd, i):
    """No article element and no telling names: constants, a list of links and an optional box."""
    title, parts = prose(rnd, 4), [prose(rnd, rnd.randrange(20, 60)) for _ in range(rnd.randrange(1, 5))]
    links = "".join(f"<li><a href=/{j}>{prose(rnd, 3)}</a></li>" for j in range(6))
    box = f"<div class=x><p>{prose(rnd, 3)}</p></div>" if i % 3 else ""
    page = (f"<html><head><title>{title}</title></head><body><div class=t><span>The Daily Page</span></div><div class=c><p>You are reading the best site.</p><h1>{title}</h1>"
            + "".join(f"<p>{x}</p>" for x in parts) + f"<ul class=z>{links}</ul><div class=e><p>All texts are ours.</p></div></div>{box}<div class=f>Made in 1999</div></body></html>")
    return page, "\n".join([title, *parts])


def template_b(rnd, i):
    """A table layout in one form, with broken markup and references."""
    parts = [prose(rnd, 40) + " &amp; &lt;b&gt;" for _ in range(3)]
    page = f"<body class='has-sidebar'><form><table><tr><td class=l><a href=x>Home</a><td class=m><h2>T{i}</h2><p>" + "<p>".join(parts) + f"<td class=comments><p>nice {i}</table></form>"
    return page, "\n".join([f"T{i}", *(html.unescape(x) for x in parts)])


def test_templates_without_article():
    rnd = random.Random(4)
    for template in (template_a, template_b):
        pages, want = zip(*(template(rnd, i) for i in range(9)), strict=True)
        assert read_all(pages) == list(want)


def test_alignment_decides():
    """Without the other pages of the host, constants and menus stay in."""
    rnd = random.Random(4)
    pages, want = zip(*(template_a(rnd, i) for i in range(9)), strict=True)
    alone = read_all(pages, alone=True)
    assert all(a != w and "You are reading the best site." in a for a, w in zip(alone, want, strict=True))
    # below the needed number of different pages nothing counts as a constant, and copies are no different pages
    assert all("You are reading" in x for x in read_all(pages[:4])) and all("You are reading" in x for x in read_all(pages[:4] * 3))


def test_a_title_that_all_pages_share_stays():
    rnd = random.Random(1)
    pages = [f"<title>Report</title><article><h1>Report</h1><p>{prose(rnd, 30)}</p><p class=k>Share it</p></article>" for _ in range(6)]
    assert all(x.startswith("Report\n") and "Share it" not in x for x in read_all(pages))


def test_names_of_frames_and_comments():
    one = lambda page: html_extraction.read(page, None)
    assert one("<body class='has-sidebar'><main class='content with-sidebar'><p>a b c</main>") == "a b c"
    assert one("<article class='post social'><p>x y</p><div class='social-bar'>tweet</div></article>") == "x y"
    assert one("<form><div><article><p>x</p></article></div><input></form>") == "x"
    assert one("<article><p>short</p></article><ol class=comment-list><li><article class=comment><p>a much longer remark than the text</p></article></ol>") == "short"
    assert one("<article><header><h1>T</h1></header><p>x<br>y</p><form>Mail <input></form></article><footer>c</footer>") == "T\nx y"


def test_alignment_finds_optional_and_repeated_groups():
    shape = lambda h: skeleton(parse(h)).children
    both = html_extraction.align(shape("<div><h1>a</h1><p>b</p><i>s</i></div>"), shape("<div><p>b</p><p>c</p><h3>d</h3><i>s</i></div>"))
    assert html_extraction.expression(both) == "div(= h1(=)? p(#)+ h3(=)?)"


def test_wrappers_and_odd_pages(spark):
    page = lambda i: (
        f"<html><body><div id=top-menu><a href=x>Home</a></div><div class=wrap><div class='post p{i}'><h2>T{i}</h2><p>Running text of page {i} &lt;b&gt; goes on.<p>And on<br>and on.<ul><li>x<li>y</ul>"
        f"<form>Mail <input></form></div><div class='comments'><p>nice {i}</div></div><div class=footer>c</div>")
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(4)] + [(7, None, None), (8, "", ""), (9, "http://b/", "plain & <b>text"), (10, "http://b/", "<p a='<unclosed"), (11, "http://b/2", "<script>x<p>"), (9, "http://b/", "plain & <b>text")]
    df = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA + ", value string")
    found = html_extraction.extract(df).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and got[3] == "T3\nRunning text of page 3 <b> goes on.\nAnd on and on.\nx\ny"
    assert got[7] == got[8] == got[11] == "" and got[9] == "plain & text"
    w = {r.host: r for r in html_extraction.wrappers(df).collect()}
    assert "li(#)+" in w["a.example"].wrapper and "div.post.p0(" in w["a.example"].wrapper
    assert html_extraction.extract(df.limit(0)).count() == 0
    spread = html_extraction.extract(df.repartition(7, "page_id")).groupBy("text").agg(F.count("*").alias("n")).collect()
    assert {r.text: r.n for r in spread} == {x: [r.text for r in found].count(x) for x in {r.text for r in found}}


def test_deep_and_long_pages(spark):
    n = 10_000
    deep = "<body><article>" + "".join(f"<div>a{i}" for i in range(n)) + "<p>core</p>" + "</div>" * n + "</article>z"
    long = "<article>" + "<h2>h</h2><p>q</p>" * 20_000 + "</article>"
    inline = "<article><p>" + "<b>" * n + "x" + "</b>" * n + " y</p></article>"
    df = spark.createDataFrame([(1, "http://d/", deep), (2, "http://d/", long), (3, "http://d/", inline)], SCHEMA)
    got = {r.page_id: r.text for r in html_extraction.extract(df).collect()}
    assert got[1] == "\n".join([*(f"a{i}" for i in range(n)), "core"]) and got[2] == "\n".join(["h", "q"] * 20_000)
    assert " ".join(got[3].split()) == "x y"
