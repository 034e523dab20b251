import pytest

from ledgerlens.llm.html_extract import extract, extract_main_text

PROSE = "This is a long sentence, with commas, about something that matters to the reader of the page."


def test_article_without_the_rest():
    page = f"""<html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><p>{PROSE} head</p></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>{PROSE} cookies</p></div><!-- <p>{PROSE}</p> -->
    <article><h1>Title &amp; more</h1><p><b>{PROSE}<br>next<p>Second   &eacute;&#33;
    line</p><div class="ad">Buy {PROSE}</div><ul><li>one<li>two</ul><form><p>{PROSE} form</p></form><aside>{PROSE}</aside>
    <section id="comments"><p>{PROSE} I agree</p></section></article><div class="sidebar"><p>{PROSE} side</p></div><footer><p>{PROSE} foot</p></footer></body></html>"""
    assert extract(page) == f"Title & more\n{PROSE} next\nSecond é! line\none\ntwo"


def test_container_without_article_and_siblings():
    links = "".join(f'<p><a href="/{i}">{PROSE}</a></p>' for i in range(9))
    page = f"<body><div>{links}</div><div><div><p>{PROSE}</p><p>{PROSE} 2</p></div><div><p>{PROSE} 3</p><p>{PROSE} 4</p></div></div></body>"
    assert extract(page) == f"{PROSE}\n{PROSE} 2\n{PROSE} 3\n{PROSE} 4"


def test_the_whole_article_around_the_best_container():
    body = "".join(f"<p>{PROSE} {i}</p>" for i in range(60))
    page = f"<body><main><article><h1>Head</h1><div>{body}</div><figure><img src=x><figcaption>A caption</figcaption></figure><table><tr><td>cell</table></article></main></body>"
    want = ["Head", *(f"{PROSE} {i}" for i in range(60)), "A caption", "cell"]
    assert extract(page).split("\n") == want


def test_odd_markup():
    assert extract(None) == extract("") == extract("<div></div>") == ""
    assert extract("plain, text < 5 &lt; 6") == "plain, text < 5 < 6"
    assert extract("<p>never <i>closed") == "never closed"
    assert extract("<div>" * 20_000 + "<p>deep, text" + "</div>" * 20_000) == "deep, text"
    assert extract("<p>" + "word, " * 200_000 + "</p>").count("word,") == 200_000


@pytest.mark.parametrize("before, after", [
    ('<article style="overflow:hidden">', "</article>"), ('<body style="overflow-x: hidden"><main style="overflow:hidden">', "</main></body>"),
    *((f'<div class="{c}">', "</div>") for c in ("no-sidebar", "has-sidebar", "content-sidebar-wrap", "with-ads", "overflow-hidden")),
    *((f'<div class="{c}"><article>', "</article></div>") for c in ("no-sidebar", "sidebar", "page with-ads")),
    ("<form action=x>", "</form>"), ("<form><div><article>", "</article></div></form>"), ('<div style="display:none">', "</div>"),
])
def test_what_holds_the_article_is_not_noise(before, after):
    page = f'<nav><a href="/">Home</a></nav>{before}<p>{PROSE}</p><p>{PROSE} 2</p>{after}<div class="site-footer"><p>foot</p></div>'
    assert extract(page) == f"{PROSE}\n{PROSE} 2"


def test_noise_beside_the_article_goes():
    noise = "".join(f"<{x}><p>{PROSE} no</p></div>" for x in (
        'div class="cookie-notice"', 'div class="sidebar left"', 'div id="site-footer"', 'div class="ad_box"', 'div style="color:red; display: none"',
        'div style="visibility:hidden!important"'))
    comments = f'<div id="comments"><article class="comment-body"><p>{PROSE} no</p></article></div>'
    assert extract(f"<body><article><p>{PROSE}</p>{noise}{comments}</article>{noise}{comments}</body>") == PROSE


@pytest.mark.parametrize("page, want", [
    ('<article><p class="a"">Hello</p><p class="b">More</p></article>', "Hello\nMore"),
    ("<article><p title=it's>Hello</p><p>More</p></article>", "Hello\nMore"),
    ('<article><p "stray" x=\'1\' y = "a>b" checked / z>Hello</p><p id=a"b>More</p></article>', "Hello\nMore"),
    ('<article><p =x class= ad>Hello</p><p class=>More</p></article>', "More"),
    ('<article><p class=a class=ad>Hello<!--> there<!---> you</article>', "Hello there you"),
    (f'<div><p>{PROSE}</p></div><div class="comments"><p>{PROSE} {PROSE} {PROSE}</p></div>', PROSE),
    (f'<div><p>{PROSE}</p></div><div id="footer"><p>{PROSE * 5}</p></div><div class="ads"><p>{PROSE * 5}</p></div>', PROSE),
    (f"<div><section><p>{PROSE * 3}</p></section><section><p>short</p></section></div>", f"{PROSE * 3}\nshort"),
    (f"<div><h2>Head</h2><ul><li>one<li>two</ul><div><p>{PROSE}</p></div><p>End.</p></div>", f"Head\none\ntwo\n{PROSE}\nEnd."),
    (f'<div><div><p>{PROSE}</p></div><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div>', PROSE),
])
def test_markup_and_siblings(page, want):
    assert extract(page) == want


class Model:
    """Pages built from a tree whose kept text is known: an article of sections, noise around and inside it, odd attributes."""

    QUOTES = ['class="a""', "title=it's", 'data-x=\'"\'', 'x="a > b"', "y = 'c'", '"', "k=v/", ""]

    def __init__(self, seed):
        import random
        self.rng, self.kept, self.count = random.Random(seed), [], 0

    def prose(self):
        self.count += 1
        return f"Text {self.count}, with some words " * self.rng.randrange(1, 6)

    def block(self, keep):
        tag, text = self.rng.choice(["p", "h2", "blockquote", "li"]), self.prose()
        if keep:
            self.kept.append(" ".join(text.split()))
        return f"<{tag} {self.rng.choice(self.QUOTES)}>{text}</{tag}>"

    def noise(self):
        name = self.rng.choice(['div class="comments"', "nav", "aside", 'div id="footer"', 'section class="ad"', "form", "footer"])
        return f"<{name}>" + "".join(self.block(False) for _ in range(self.rng.randrange(1, 12))) + f"</{name.split()[0]}>"

    def section(self, depth):
        parts = []
        for _ in range(self.rng.randrange(1, 5)):
            roll = self.rng.random()
            parts.append(self.noise() if roll < 0.2 else self.section(depth - 1) if roll < 0.5 and depth else self.block(True))
        tag = self.rng.choice(["div", "section"])
        return f"<{tag} {self.rng.choice(self.QUOTES)}>" + "".join(parts) + f"</{tag}>"

    def page(self):
        return f"<html><body>{self.noise()}<article {self.rng.choice(self.QUOTES)}>{self.block(True)}{self.section(3)}{self.section(3)}</article>{self.noise()}</body></html>"


@pytest.mark.parametrize("seed", range(200))
def test_generated_pages(seed):
    model = Model(seed)
    page = model.page()
    assert extract(page) == "\n".join(model.kept)


@pytest.mark.parametrize("part", ["<div>text here ", "</b><p>text", "<b><p>x</p>", "<a href=x>t", "<div class=ads>t", "<p a='", "<li>t<ul>"])
def test_time_grows_with_the_page(part):
    import time

    def seconds(n):
        page, start = part * n, time.perf_counter()
        extract(page)
        return time.perf_counter() - start

    seconds(1000)
    assert min(seconds(40000) for _ in range(3)) < 3.5 * min(seconds(20000) for _ in range(3)) + 0.02


def test_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None)],
                                  "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url, r.text) for r in extract_main_text(pages).collect()) == [(0, None, ""), (1, "u", "a"), (1, "u", "a")]
    assert extract_main_text(pages.where("false")).count() == 0


def test_query_against_the_page_structure(spark):
    """The table's pages hold one article; a plain cut of it gives the same text."""
    import html
    import re

    from ledgerlens.llm import queries
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.html_extraction(spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", inner)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts]
        assert r.text == "\n".join(w for w in want if w)
