"""Main text of pages of several builds."""

from keystrata.llm.htmltext import extract, main_text

LONG = [f"Paragraph {i} of the story, with commas, and words that go on for a while so it has some length." for i in range(4)]
BODY = "".join(f"<p>{x}</p>" for x in LONG)


def test_article_with_boilerplate():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a href=1>Home</a></nav>
    <main><article><h1>Head &amp; more</h1>{BODY}<div class="ad">Buy</div><aside>see also</aside><!-- note --><script>var t="</p>";</script>
    <p>Fish&nbsp;<b>and</b>
    chips<br>twice</p><section class="comments"><p>A reader writes, at length, and with commas, that this was fine.</p></section></article></main>
    <form><p>Sign up, please</p></form><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == "\n".join(["Head & more", *LONG, "Fish and chips twice"])


def test_divs_without_semantic_tags():
    page = f"""<body><div id=header><h2>Site</h2></div><div id=nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>
    <div class=wrap><div class=post><h1>Title</h1>{BODY}<ul><li>one<li>two</ul></div><div class=sidebar><p>{LONG[0]}</p></div></div>
    <div id=comments><p>{LONG[1]} {LONG[2]}</p></div><div class=cookie-notice>We use cookies</div></body>"""
    assert main_text(page) == "\n".join(["Title", *LONG, "one", "two"])


def test_siblings_and_links():
    page = f"<body><div><h1>T</h1><div>{BODY}</div><div><p>{LONG[0]}</p></div><div>" + "".join(f"<a href={i}>link number {i}, here</a>" for i in range(30)) + "</div></div></body>"
    assert main_text(page) == "\n".join(["T", *LONG, LONG[0]])


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<script>x</script>") == ""
    assert main_text("no markup < at all & so") == "no markup < at all & so"
    assert main_text("<div>" * 5000 + "<p>deep</p>") == "deep"
    assert main_text("<article><p>one<p>two <i>three</article>") == "one\ntwo three"
    assert main_text("<p title='a>b'>x</p><p title=\"open>y</p>") == "x\ny"
    long = "word " * 200_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_boilerplate_names_around_the_article():
    for head in ("div class='content has-sidebar'", "div class=content-sidebar-wrap", "div class='post comments-open'", "main class=has-sidebar", "div class='entry social'", "form action=x", "div class=has-sidebar"):
        end = head.split()[0]
        page = f"<body><div id=top><a href=1>Home</a></div><{head}><div>{BODY}</div><div class=sidebar><p>{LONG[0]}</p></div></{end}><div class=footer>us</div></body>"
        assert main_text(page) == "\n".join(LONG), head
    assert main_text(f"<body><div>{BODY}</div><div class=comments>{BODY * 3}</div></body>") == "\n".join(LONG)
    assert main_text(f"<body><div hidden class=post>{BODY}</div><p>Short one.</p></body>") == "Short one."


def test_names_that_only_sound_like_boilerplate():
    for open_, close in (("<div class='legal article'>", "</div>"), ("<article><div class=discussion>", "</div></article>"), ("<main><div class='notice-board'>", "</div></main>"), ("<div class=widget><div class=text>", "</div></div>")):
        assert main_text(f"<body><nav><a href=1>Home</a></nav>{open_}{BODY}{close}<footer>us</footer></body>") == "\n".join(LONG), open_


def test_short_parts_beside_the_article():
    page = f"<body><div class=wrap><header><a href=1>Site</a></header><div><h2>One</h2>{BODY}</div><p>The end.</p><section><h2>Two</h2><p>Short.</p></section><div><a href=2>More</a></div></div></body>"
    assert main_text(page) == "\n".join(["One", *LONG, "The end.", "Two", "Short."])
    page = f"<body><header><h1>Site</h1></header><div class=post><header><h1>Title</h1></header>{BODY}</div></body>"
    assert main_text(page) == "\n".join(["Title", *LONG])


def test_boilerplate_in_deep_pages():
    for depth in (10, 310, 20_000):
        page = "<div>" * depth + f"<nav><a href=1>Home</a> and more</nav><article>{BODY}<aside>see also</aside></article><form><p>Sign up</p></form>" + "</div>" * depth + "<footer>us</footer>"
        assert main_text(page) == "\n".join(LONG), depth
    assert main_text("<b>" * 3000 + f"<p>{LONG[0]}" + "</i>" * 3000) == LONG[0]


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "u", "")]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = spark.createDataFrame([("x", 7, "u", "<p>a</p>", "y", "z")], "text string, page_id long, url string, html string, n_chars string, id string")
    assert [tuple(r) for r in extract(clash).collect()] == [(7, "u", "a", 1)]


def test_pages_table(spark):
    """On the given pages: whole articles, nothing of what stands around them."""
    import html
    import re

    from tests.conftest import SF_DIR

    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract(pages).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", raw[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|article)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p)
