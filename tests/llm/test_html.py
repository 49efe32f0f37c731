"""Block rules against pages whose main text is known, and with each pass switched off."""

import random

import pytest
from pyspark.sql import functions as F

from locuspark.llm import html_blocks

PROSE = "the cat is on the mat and it was in the house with all of them " * 4
LINE = PROSE.strip()


def sentence(rng: random.Random, n: int) -> str:
    words = ["the", "of", "and", "to", "in", "that", "was", "with", "house", "river", "stone", "window", "yellow", "carried", "été", "漢字", "AT&T", "a<b"]
    return " ".join(rng.choice(words) for _ in range(n))


def page_of(rng: random.Random, holder: str, closed: bool) -> tuple[str, str]:
    """A page and its main text: paragraphs, lists and headings, boilerplate before, within and behind."""
    import html

    text: list[str] = []
    body = ""
    for _ in range(rng.randint(2, 9)):
        kind = rng.choice(["p", "p", "p", "h2", "li", "aside", "ad"])
        said = sentence(rng, rng.choice([2, 25, 60]) if kind != "p" else rng.randint(30, 90))
        if kind == "aside":
            body += f"<aside>{html.escape(said)}</aside>"
        elif kind == "ad":
            body += f'<div class="ad-box">{html.escape(said)}</div>'
        else:
            text.append(said)
            end = f"</{kind}>" if closed or kind == "h2" else ""
            part = f"<{kind}>{html.escape(said).replace(' ', rng.choice([' ', '  ', chr(10), '&#32;']), 1)}{end}"
            body += f"<ul>{part}</ul>" if kind == "li" else part
    first = sentence(rng, 40)
    lead = f"<p>{html.escape(first)}</p>"
    page = f'<!DOCTYPE html><html lang="en"><head><title>t</title><script>"<p>no</p>"</script></head><body class="has-sidebar"><nav><ul><li><a href=/>home</a></ul></nav><div class="cookie-notice"><p>{PROSE}</p></div>{holder}{lead}{body}</{holder[1:].split(">")[0].split(" ")[0]}><section id="comments"><article class="comment"><p>{PROSE}</p></article></section><footer>&copy; all</footer></body></html>'
    return page, "\n".join([first, *text])


@pytest.mark.parametrize("holder", ["<article>", '<main class="has-sidebar">', '<div id="content" class="with-sidebar">', '<div class="layout no-footer"><article class="post">'])
def test_known_main_text(holder):
    rng = random.Random(holder)
    for closed in (True, False):
        for _ in range(60):
            page, want = page_of(rng, holder, closed)
            assert html_blocks.main_text(page) == want, page


def test_end_tags_may_be_left_out():
    assert html_blocks.main_text(f'<article><p class="ad">buy<p>{PROSE}</article>') == LINE
    assert html_blocks.main_text(f"<article><p hidden>x<p>{PROSE}</article>") == LINE
    assert html_blocks.main_text(f'<article><ul><li class="share">x<li>one<li>two</ul><p>{PROSE}') == f"one\ntwo\n{LINE}"
    assert html_blocks.main_text(f'<article><dl><dt>a<dd class="ad">b<dt>c<dd>d</dl><table><tr><td class="ad">x<td>y<tr><td>z</table>{PROSE}') == f"a\nc\nd\ny\nz\n{LINE}"


def test_names_are_outvoted():
    """A wrapper's name goes by what is in it; layouts aren't names; readers' comments stay out."""
    for wrapper in ("content has-sidebar", "sidebar", "widget"):
        assert html_blocks.main_text(f'<div class="{wrapper}"><article><p>{PROSE}</article></div>') == LINE
        assert html_blocks.main_text(f'<div class="{wrapper}"><h1>Head</h1><p>{PROSE}</div>') == f"Head\n{LINE}"
    assert html_blocks.main_text(f'<p>{PROSE}</p><div class="sidebar"><p>{PROSE}</p></div>') == LINE


def test_labels_decide_among_articles():
    teasers = "<article><h2>More</h2><p>Short line.</article>" * 3
    assert html_blocks.main_text(f"{teasers}<article><p>{PROSE}{PROSE}<p>End.</article>") == f"{LINE} {LINE}\nEnd."
    # An article without a single good block doesn't keep out good text that far outweighs it.
    assert html_blocks.main_text(f"<article><p>Teaser.</article><div><p>{PROSE}<p>{PROSE}</div>") == f"Teaser.\n{LINE}\n{LINE}"


def test_both_passes_decide(monkeypatch):
    """Density and inheritance each change what is found, on pages with and without article elements."""
    low = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    pages = [
        f'<html lang="en"><body><p>menu</p><p>{low}</p><p>{low}</p><p>So it was.</p><p>{PROSE}</p><p>The end.</p></body>',
        f'<html lang="en"><article><p>{low}</p></article><article><p>{PROSE}</p><p>The end.</p></article><article><p>{low}</p></article>',
    ]
    found = [html_blocks.main_text(p) for p in pages]
    assert found == [f"So it was.\n{LINE}\nThe end.", f"{LINE}\nThe end."]
    for density in (0.0, 1.0):
        with monkeypatch.context() as m:
            m.setattr(html_blocks, "stop_density", lambda text, known, d=density: d)
            assert all(html_blocks.main_text(p) != f for p, f in zip(pages, found, strict=True))
    monkeypatch.setattr(html_blocks, "inherit", lambda found: None)
    assert all(html_blocks.main_text(p) != f for p, f in zip(pages, found, strict=True))


def test_pages_with_little_to_tell():
    assert html_blocks.main_text("<body><p>Brief.</p><p>Very brief.</p><p><a href=x>a link</a></p></body>") == "Brief.\nVery brief."
    other = "Ylä oli ja se talo jossa asui vanha mies joka ei koskaan lähtenyt ulos ennen kuin kello löi"
    assert html_blocks.main_text(f'<html lang="fi"><body><nav>x</nav><p>{other}</p>') == other
    assert html_blocks.main_text("<article><p>One.<p><a href=x>All of it a link.</a><p>Two.</article>") == "One.\nAll of it a link.\nTwo."
    assert html_blocks.main_text(f"<article><p>{PROSE}" + "<ul>" + "<li><a href=x>Related</a>" * 5 + "</ul></article>") == LINE


def test_time_is_linear_in_the_page():
    import time

    for unit in ("<b>", "<p class=ad>", "<div>", "</p>", "<a href='", "<li><a>x", "&amp", "<td>"):
        began = time.time()
        html_blocks.main_text("<article><p>" + unit * (600_000 // len(unit)))
        assert time.time() - began < 20, unit


def test_pages_table(spark):
    rows = [("a", "u", f"<article><p>{PROSE}<p>é"), ("b", None, None), ("c", "v", ""), ("d", "w", "<p"), ("a", "u", f"<article><p>{PROSE}<p>é"), (None, "x", "<p>" + PROSE * 3000)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").select("*", *(F.lit("clash").alias(c) for c in ("text", "n_chars", "label")))
    got = html_blocks.extract(pages).collect()
    assert sorted((r["page_id"] or "", r["text"], r["n_chars"]) for r in got) == sorted((i or "", t := html_blocks.main_text(h), len(t)) for i, _, h in rows)
    assert got[0]["text"] == f"{LINE}\né" and max(r["n_chars"] for r in got) > 500_000
    assert html_blocks.extract(pages.limit(0)).count() == 0


ROAD = "<p>The road that leads out of the town is one of the oldest in the country, and it was long the only one there.</p>"


def test_anchors_that_lead_nowhere_are_text():
    got = html_blocks.main_text(f'<article><h1>Road</h1><a name="top">{ROAD * 4}</article>')
    assert got.count("The road") == 4
    got = html_blocks.main_text(f'<article><h1>Road</h1><div><a href="x">a link that never ends</div>{ROAD * 4}</article>')
    assert got.count("The road") == 4


def test_depth_has_no_bound():
    for n in (100, 600, 5000):
        got = html_blocks.main_text("<article>" + "<div>" * n + f"<nav>menu of things</nav><span hidden>unseen</span>{ROAD}" + "</div>" * n + "</article>")
        assert got.startswith("The road") and "menu" not in got and "unseen" not in got
