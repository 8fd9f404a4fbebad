"""Pages whose text stands in several containers, or beside an article that holds little of it."""

import pytest

from quarry.llm import html_text

A, B, C = (f"Paragraph {k} of the page, with words enough, and signs: so it counts as text." for k in "ABC")
MENU = "<div class=menu><a>Home</a></div>"


@pytest.mark.parametrize("body,want", [
    (f"{MENU}<div id=post><div>{A}</div><div>{B} And more.</div></div>", f"{A}\n{B} And more."),
    (f"{MENU}<div><p>{A}</p></div><div><p>{B}</p><p>{C}</p></div><div id=sidebar><p>{C}</p></div>", f"{A}\n{B}\n{C}"),
    (f"<article><p>See this, too, it is good.</p></article><div><p>{A}</p><p>{B}</p></div><div><p>{C}</p></div>", f"See this, too, it is good.\n{A}\n{B}\n{C}"),
    (f"<article><p>{A}</p><p>{B}</p></article><div><p>See this, too, it is good.</p></div>", f"{A}\n{B}"),
])
def test_containers(body, want):
    assert html_text.main_text(f"<html><body>{body}</body></html>") == want
