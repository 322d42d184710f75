"""Lines by score: against a plain version of the formula, lists of links, names that mark nothing, deep pages."""

import math
import random
import time

import pytest

from keyweave.llm import html

A, B = " ".join(f"first{i}" for i in range(60)), " ".join(f"second{i}" for i in range(40))


def line(n, links=0, tags=1):
    return html.Line([], tags, links, 0, -1, False, "x" * n)


def by_hand(lines):
    """Ratios, their Gaussian over two lines either way, and the smaller of mean and deviation."""
    ratios = [max(0, len(x.text) - x.links) / x.tags for x in lines]
    smooth = []
    for i in range(len(ratios)):
        above = below = 0.0
        for j in range(len(ratios)):
            if abs(i - j) <= 2:
                weight = math.e ** (-((i - j) ** 2) / 2)
                above, below = above + weight * ratios[j], below + weight
        smooth.append(above / below)
    mean = sum(smooth) / len(smooth)
    return smooth, min(mean, (sum(x * x for x in smooth) / len(smooth) - mean**2) ** 0.5 if len(set(smooth)) > 1 else 0.0)


def test_scores_by_brute_force():
    r = random.Random(9)
    for _ in range(300):
        lines = [line(n := r.randint(1, 400), r.choice([0, 0, n // 2, n]), r.randint(1, 9)) for _ in range(r.randint(1, 30))]
        smooth, limit = html.scored(lines)
        want, least = by_hand(lines)
        assert smooth == pytest.approx(want) and limit == pytest.approx(least, abs=1e-4)
        listed = html.in_link_lists(lines)
        mostly = [2 * x.links >= len(x.text) for x in lines]
        assert listed == [m and ((i > 0 and mostly[i - 1]) or (i + 1 < len(lines) and mostly[i + 1])) for i, m in enumerate(mostly)]
        # in one region: content, and what is no link for the most part beside it
        kept = html.chosen(lines, [(-1, "page")])
        some = any(s >= limit and not o and len(x.text) > x.links for s, o, x in zip(smooth, listed, lines))
        assert kept == [some and not o and (s >= limit or not m) for s, o, m in zip(smooth, listed, mostly)]


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content no-sidebar'><p>{A}</p></div>",
        f"<div class='post has-comments'><p>{A}</p></div>",
        f"<div class='with-header'><article><p>{A}</p></article></div>",
        f"<div class='sidebar-page'><article><p>{A}</p></article></div>",
        f"<div class='header-blog'><h1>{A}</h1></div>",
        f"<body class='comments'><main class='menu'><p>{A}</p></main></body>",
        f"<div class='promo-box'><p>{A}</p></div>",
        f"<form id='aspnetForm'><div><article><p>{A}</p></article></div></form>",
    ],
)
def test_names_that_only_tell_the_layout_mark_nothing(page):
    assert html.main_text(page) == A


@pytest.mark.parametrize(
    "part",
    [
        f"<div class='comment-list'><article class='comment'><p>{B}</p></article></div>",
        f"<div class='cookie-banner'><p>{B}</p></div>",
        f"<form><p>{B}</p><p>{B}</p></form>",
        f"<div id='sidebar-left'><p>{B}</p></div>",
        f"<div class='widget ad-slot'><p>{B}</p></div>",
        "<ul>" + "".join(f"<li><a href=x>Another page {i}</a></li>" for i in range(6)) + "</ul>",
    ],
)
def test_compound_names_and_lists_of_links_go(part):
    assert html.main_text(f"<body><article><p>{A}</p>{part}<p>{A}</p></article></body>") == f"{A}\n{A}"
    assert html.main_text(f"<body><div><p>{A}</p></div>{part}<div><p>{A}</p></div></body>") == f"{A}\n{A}"


def test_a_linked_sentence_and_linked_headings_stay():
    page = f"<article><h2><a href=x>One</a></h2><h3><a href=x>Two</a></h3><p>{A}</p><p><a href=x>All of the report</a></p><p>{B}</p></article>"
    assert html.main_text(page) == f"One\nTwo\n{A}\nAll of the report\n{B}"


@pytest.mark.parametrize("tag", ["div", "article", "b", "ul", "div class='side-menu'"])
def test_deep_pages_take_linear_time(tag):
    name = tag.split()[0]
    started = time.process_time()
    text = html.main_text(f"<{tag}>" * 40_000 + f"<p>{A}</p>" + f"</i></{name}>" * 40_000)
    assert time.process_time() - started < 8
    assert text in (A, "")
