import random
import re
import time
from html import unescape

import pytest
from gridquarry.llm.html import extract, main_text
from gridquarry.llm.queries import op5_html

SF = "/root/testdata/sf0.01"


def from_template(page):
    """The tables' pages keep the text in <article>, one block for each h1 or p."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in b[:0] else "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", inside))
    return "\n".join(b for b in blocks if b)


def test_query_equals_the_template(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op5_html(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == from_template(pages[r.page_id])
        assert r.n_chars == len(r.text)


LONG = "A sentence with commas, clauses, and enough words to count as text. " * 4


def test_boilerplate_is_cut():
    page = f"""<html><head><title>T</title></head><body><header><h1>Site</h1></header>
    <div id="sidebar"><p>{LONG}</p></div><div class="cookie-notice"><p>{LONG}</p></div>
    <div class="main"><h2>Head &amp; line</h2><p>First &eacute;&#33;  {LONG}<p>Second<br>line {LONG}<ul><li>one, two, three<li>four</ul></div>
    <div class="comments"><p>{LONG}</p></div><form><p>{LONG}</p></form><script>if (a < b) "<p>x</p>"</script><!-- <p>no</p> --><footer>F</footer>"""
    body = LONG.strip()
    assert main_text(page).split("\n") == ["Head & line", f"First é! {body}", f"Second line {body}", "one, two, three", "four"]


def test_link_lists_lose():
    links = "".join(f'<li><a href="/{k}">A long link, with, many, commas number {k}</a></li>' for k in range(50))
    assert main_text(f"<body><div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div></body>") == "\n".join([LONG.strip()] * 2)


def test_odd_pages(spark):
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    pages = [None, "", "   ", "<p>unclosed <b>bold", deep, "<p>" + LONG * 3000, "<article>x", "a < b & c > d", "<!-- never closed <p>x", "<script>x"]
    frame = spark.createDataFrame([(k, "u", p, "t") for k, p in enumerate(pages)] + [(4, "u", deep, "t")], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in extract(frame).collect()}
    assert extract(frame).count() == len(pages) + 1
    assert [got[k] for k in (0, 1, 2, 8, 9)] == [""] * 5
    assert got[3] == "unclosed bold"
    assert got[4] == LONG.strip()
    assert got[5] == (LONG * 3000).strip()
    assert got[6] == "x"
    assert got[7] == "a < b & c > d"
    assert extract(frame.limit(0)).count() == 0


B = LONG.strip()
LAYOUTS = {
    "related work": (f"<article><p>{LONG}</p><section class='related-work'><h2>Related work</h2><p>{LONG}</p></section></article>", f"{B}\nRelated work\n{B}"),
    "share price": (f"<article><p>{LONG}</p><div class='share-price'><p>It fell, then it rose. {LONG}</p></div></article>", f"{B}\nIt fell, then it rose. {B}"),
    "social history": (f"<article><p>{LONG}</p><section id='social-history'><p>{LONG}</p></section></article>", f"{B}\n{B}"),
    "menu items": (f"<article><p>{LONG}</p><div class='menu-items'><ul><li>Soup</li><li>Bread</li></ul></div></article>", f"{B}\nSoup\nBread"),
    "a toolbar shown": (f"<article><p>{LONG}</p><div class='toolbar-demo'><pre>bar = Toolbar(parent=window, position=top)</pre></div></article>", f"{B}\nbar = Toolbar(parent=window, position=top)"),
    "related links": (f"<article><p>{LONG}</p><div class='related-posts'><ul><li><a href=a>One more</a><li><a href=b>And another</a></ul></div><div class='share-buttons'>Share this</div></article>", B),
    "a long and a short article": (f"<main><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>Short.</p></article></main>", f"{B}\n{B}\n{B}\nShort."),
    "a long and a short post": (f"<div id=all><div class='post'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='post'><p>Short.</p></div></div>", f"{B}\n{B}\n{B}\nShort."),
    "parts beside each other": (f"<body><div><h1>T</h1><div>{LONG}</div><div><p>BBBB ok.</p></div></div></body>", f"T\n{B}\nBBBB ok."),
    "references": (f"<div class='post'><p>{LONG}</p><ul><li><a href=a>First</a><li><a href=b>Second</a><li><a href=c>Third</a></ul></div>", f"{B}\nFirst\nSecond\nThird"),
    "heading of comments": (f"<div class='post'><p>{LONG}</p><p>{LONG}</p><h3>Comments</h3><div class='comments'><p>{LONG}</p></div></div>", f"{B}\n{B}"),
    "unquoted apostrophe": (f"<p class=x'>It is one {LONG}</p><p>don't {LONG}</p>", f"It is one {B}\ndon't {B}"),
    "a section called discussion": (f"<article><h1>T</h1><p>{LONG}</p><section class='discussion'><h2>Discussion</h2><p>{LONG}</p></section></article>", f"T\n{B}\nDiscussion\n{B}"),
    "entry header": (f"<article><div class='entry-header'><h1>T</h1></div><p>{LONG}</p></article>", f"T\n{B}"),
    "side by side": (f"<article><p>{LONG}</p><div class='side-by-side'><p>{LONG}</p></div></article>", f"{B}\n{B}"),
    "label": (f"<article><p>{LONG}</p><label>Name of it</label></article>", f"{B}\nName of it"),
    "two articles in main": (f"<main><article><p>{LONG}</p></article><article><p>{LONG}</p></article></main>", f"{B}\n{B}"),
    "two articles": (f"<body><article><p>{LONG}</p></article><article><p>{LONG}</p></article></body>", f"{B}\n{B}"),
    "lines of one link": (f"<body><div><p>{LONG}</p><p>{LONG}</p><p><a href=x>A link</a></p></div><div class=content><p>{LONG}</p><p><a href=x>A link</a></p></div></body>", f"{B}\n{B}\nA link\n{B}\nA link"),
    "form around the page": (f"<form id=aspnet><div id=page><h1>T</h1><p>{LONG}</p></div></form>", f"T\n{B}"),
    "flat": (f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Us</a></ul><h1>T</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></body>", f"T\n{B}\nShort.\n{B}"),
    "named divisions": (
        f"<div id=wrap><div id=header>Site</div><div id=nav><a href=x>a</a></div><div id=content><h1>T</h1>{LONG}<br><br>{LONG}</div><div id=sidebar><p>{LONG}</p></div><div class=comments>{f'<p>{LONG}</p>' * 3}</div><div id=footer>F</div></div>",
        f"T\n{B} {B}",
    ),
    "layout by table": (f"<table><tr><td><a href=x>m1</a><br><a href=y>m2</a></td><td><h1>T</h1><p>{LONG}</p><p>{LONG}</p></td></tr></table>", f"T\n{B}\n{B}"),
    "comments as articles": (f"<article><h1>T</h1><p>{LONG}</p><div id='comments'><h3>2 comments</h3>{f'<article class=comment><p>{LONG}</p></article>' * 2}</div></article>", f"T\n{B}"),
    "main without article": (f"<main><h1>T</h1><div class=a><p>{LONG}</p><p>{LONG}</p></div><div class=b><p>short one</p></div><aside>{LONG}</aside></main>", f"T\n{B}\n{B}\nshort one"),
    "states in names": (f"<body class='menu-open'><div class='content has-sidebar'><p>{LONG}</p></div></body>", B),
    "header of a post": (f"<div class='post'><header><h1>T</h1></header><p>{LONG}</p><p>{LONG}</p></div>", f"T\n{B}\n{B}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert main_text(page) == want


def test_generated_layouts():
    """Pages put together at random: each paragraph carries a word that says whether it is main text."""
    boilerplate = ["<nav>{}</nav>", "<aside>{}</aside>", "<div class='ad'>{}</div>", "<div id='sidebar'>{}</div>", "<section class='user-comments'>{}</section>", "<div class='cookie-notice'>{}</div>", "<form>{}</form>", "<footer>{}</footer>", "<div class='newsletter box'>{}</div>", "<div role='alert'>{}</div>", "<div hidden>{}</div>"]
    around = ["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>", "<div>{}</div>", "<section id='content'><div>{}</div></section>", "<main><article>{}</article></main>", "<table><tr><td>{}</td></tr></table>"]
    blocks = ["<p>{}</p>", "<p>{}", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<h2>{}</h2>", "<div>{}</div>", "<p>a <b>{}</p>", "<figure><figcaption>{}</figcaption></figure>"]
    for seed in range(150):
        rng = random.Random(seed)
        told = []
        body = []
        for k in range(rng.randrange(3, 12)):
            told.append(f"main{k} " + LONG * rng.randrange(1, 3))
            body.append((blocks[0] if k < 3 else rng.choice(blocks)).format(told[-1]))
            if rng.random() < 0.2:
                body.append(rng.choice(boilerplate[:7]).format(f"<p>junk {LONG}</p>"))
        parts = [rng.choice(boilerplate).format(f"<p>junk {LONG}</p>") for _ in range(rng.randrange(0, 6))] + [rng.choice(around).format("".join(body))]
        rng.shuffle(parts)
        page = "<html><body>" + "".join(parts) + "</body></html>"
        got = main_text(page)
        assert "junk" not in got, (seed, page)
        assert [w for w in got.split() if w.startswith("main")] == [f"main{k}" for k in range(len(told))], (seed, page)


def test_names_of_parts_of_articles():
    """Sections of an article under all kinds of names stay; the same names around lists of links go."""
    words = ["related", "share", "social", "menu", "toolbar", "navigation", "promotion", "sponsor", "modal", "recommended"]
    for seed in range(60):
        rng = random.Random(seed)
        word, other = rng.choice(words), rng.choice(["work", "value", "history", "items", "design", "theory"])
        name = rng.choice([f"{word}-{other}", f"{other}-{word}", f"{word}{other.title()}"])
        around = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>"])
        links = "".join(f"<li><a href=x{k}>junk link {k}</a></li>" for k in range(4))
        page = around.format(f"<p>main0 {LONG}</p><section class='{name}'><p>main1 {LONG}</p></section><div class='{name}'><ul>{links}</ul></div><p>main2 {LONG}</p>")
        got = main_text(page)
        assert "junk" not in got and [w for w in got.split() if w.startswith("main")] == ["main0", "main1", "main2"], (seed, page)


@pytest.mark.parametrize("bad", ['<p class="x', "<a href='", "<!-", "<p a=", "</x", "<b>", "<i><p>", "</i>", "<div>", "<div><p>", "<", "&#"])
def test_long_malformed_pages_take_time_in_proportion(bad):
    page = (bad + " ") * (1_000_000 // (len(bad) + 1)) + f"<p>{LONG}</p>"
    begin = time.process_time()
    main_text(page)
    assert time.process_time() - begin < 30


def test_ten_megabytes_of_unclosed_quotes():
    begin = time.process_time()
    main_text('<p class="x> word ' * 600_000)
    assert time.process_time() - begin < 30
