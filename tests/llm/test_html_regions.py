"""Main text that is spread over several regions of a page."""

import pytest

from keyweave.llm import html


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


A, B, C = words("first", 60), words("second", 40), words("third", 12)
MENU = "<nav><a href=x>Home</a><a href=y>News</a></nav>"
LINKS = "<div>" + "".join(f"<p><a href=x>Another page {i}</a></p>" for i in range(8)) + "</div>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body>{MENU}<div><p>{A}</p></div><div><p>{B}</p></div><footer>f</footer></body>", f"{A}\n{B}"),
        (f"<body><section><h2>One</h2><p>{A}</p></section><section><h2>Two</h2><p>{B}</p></section></body>", f"One\n{A}\nTwo\n{B}"),
        (f"<body><article><p>{A}</p></article><article><p>{C}</p></article></body>", f"{A}\n{C}"),
        (f"<body><article><p>{C}</p></article><div><p>{A}</p></div></body>", f"{C}\n{A}"),
        (f"<body><main><p>{B}</p></main><section><h2>More</h2><p>{A}</p></section></body>", f"{B}\nMore\n{A}"),
        (f"<body><div class=content><p>{A}</p></div><div><p>{B}</p></div></body>", f"{A}\n{B}"),
        (f"<body><div><div><p>{A}</p></div><div><div><p>{B}</p></div></div></div>{LINKS}</body>", f"{A}\n{B}"),
        (f"<body><div class=ad><p>{C}</p></div><div><p>{A}</p></div><aside><p>{B}</p></aside><div><p>{B}</p></div></body>", f"{A}\n{B}"),
    ],
)
def test_content_of_all_regions_is_kept(page, text):
    assert html.main_text(page) == text


def test_short_lines_beside_an_article_stay_out():
    assert html.main_text(f"<body><div>{LINKS}</div><article><h1>T</h1><p>{A}</p><p>Short.</p><p>{B}</p></article>{LINKS}</body>") == f"T\n{A}\nShort.\n{B}"
