"""Which nodes the tag paths choose, what names and attributes may refuse, and every page against a parser of another kind."""

from html.parser import HTMLParser

import duckdb
import pytest

from quarry.llm import html_text, queries

P = "<p>First paragraph, with some words in it, and more of them.</p><p>Second one, it has text, too; and so on.</p>"
TEXT = "First paragraph, with some words in it, and more of them.\nSecond one, it has text, too; and so on."


@pytest.mark.parametrize("body,want", [
    (f'<div class="page has-sidebar"><article>{P}</article></div>', TEXT),
    (f'<div data-id="related">{P}</div>', TEXT),
    (f'<article><div class="post-header"><h1>My Title</h1></div>{P}</article>', f"My Title\n{TEXT}"),
    (f'<article>{P}<p hidden>Not shown, at all.</p><div style="display: none">No.</div></article>', TEXT),
    (f"<article><div><a href=a>Home</a> <a href=b>About</a> <a href=c>Contact</a></div>{P}</article>", TEXT),
    (f"<main>{P}{P}</main><article><p>Teaser, short.</p></article>", f"{TEXT}\n{TEXT}"),
    (f"<main>{P}{P}<article><p>Teaser, short.</p></article></main>", f"{TEXT}\n{TEXT}"),
    (f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By me, yesterday.</p></header>{P}</article>", f"Title\n{TEXT}"),
    (f"<form><div>{P}</div></form>", TEXT),
    ("<div class=menu><ul><li><a>One</a><li><a>Two</a></ul></div>", ""),
    (f'<div class="related"><article><p>Teaser, see.</p></article></div><div>{P}</div>', TEXT),
    (f'<p title="class=menu hidden id=ad">{P[3:]}', TEXT),
    (f"<div><div><a>Home</a> | <a>News</a></div></div><div>{P}</div><div class='comments'><p>Great, really!</p></div>", TEXT),
])
def test_cases(body, want):
    assert html_text.main_text(f"<html><body>{body}</body></html>") == want


def test_paths_decide():
    body = f"<html><body><div><div><a>Home</a> <a>News</a></div><div>12 May</div></div><div>{P}</div></body></html>"
    assert html_text.main_text(body) == TEXT
    assert html_text.main_text(body, choose=set) != TEXT  # every path taken


def test_depth_and_length():
    assert html_text.main_text("<article>Words, here.</article>" + "<div>" * 30_000 + "word") == "Words, here."
    assert html_text.main_text("<div class=a>" * 30_000 + "deep, text") == "deep, text"
    assert html_text.main_text("<a " + "x=1 " * 50_000 + ">" + "text, " * 50_000).count("text,") == 50_000


class Article(HTMLParser):
    """Blocks of the text in an article element, by the events of the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.mark(tag)

    def handle_endtag(self, tag):
        self.mark(tag)
        self.depth -= tag == "article"

    def mark(self, tag):
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "a"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_every_page(spark, sf):
    want = {}
    for page_id, url, html in duckdb.sql(f"SELECT page_id, url, html FROM read_parquet('{sf}/pages.parquet')").fetchall():
        p = Article()
        p.feed(html or "")
        p.close()
        text = "\n".join(x for b in p.blocks if (x := " ".join(b.split())))
        want[page_id] = (url, text, len(text))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.queries()["op5_html_text"](spark, sf).collect()}
    assert got == want


def test_text_ids(spark):
    df = spark.createDataFrame([("a", "u", "<p>x</p>", 1), (None, None, None, 2)], "page_id string, url string, html string, text int")
    assert sorted((str(r["page_id"]), r["text"]) for r in html_text.extract(df).collect()) == [("None", ""), ("a", "x")]
