"""Class, id and role words that mark what is not the article, on parts of it."""

import pytest

from keyweave.llm import html

A, B = " ".join(f"first{i}" for i in range(60)), " ".join(f"second{i}" for i in range(40))
LINKS = "".join(f"<li><a href=x>Another page {i}</a></li>" for i in range(4))


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><p>{A}</p><section id='discussion'><h2>Discussion</h2><p>{B}</p></section></article>", f"{A}\nDiscussion\n{B}"),
        (f"<article><h2 id='how-to-share-files'>How to share files</h2><p>{A}</p><h2 id='related-work'>Related work</h2><p>{B}</p></article>", f"How to share files\n{A}\nRelated work\n{B}"),
        (f"<article><div class='entry-header'><h1>Title</h1><p>By someone</p></div><p>{A}</p><p>{B}</p></article>", f"Title\n{A}\n{B}"),
        (f"<div class='post'><p>{A}</p><div class='notice'><div class='related'><p>{B}</p></div></div></div>", f"{A}\n{B}"),
        (f"<body><h2 id='comments-on-law'>Comments on law</h2><p>{A}</p></body>", f"Comments on law\n{A}"),
    ],
)
def test_marked_parts_of_the_article_stay(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "part",
    [
        f"<div class='related'><h3>Related</h3><ul>{LINKS}</ul></div>",
        "<div class='share'><p>Share this</p><p>Mail</p></div>",
        f"<section class='comments discussion'><p>{B}</p></section>",
        f"<div class='notice' role='dialog'><p>{B}</p></div>",
        f"<div class='related' hidden><p>{B}</p></div>",
        f"<div class='header'><div class='share'><h4>Share</h4><ul>{LINKS}</ul></div></div>",
    ],
)
def test_marked_parts_that_links_or_ratio_speak_against_go(part):
    assert html.main_text(f"<article><h1>T</h1><p>{A}</p><p>{A}</p>{part}<p>{B}</p></article>") == f"T\n{A}\n{A}\n{B}"
