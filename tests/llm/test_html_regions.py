"""Articles that are not one element, or whose parts bear the names of menus."""

import pytest

from surfaudit.llm.html_text import main_text
from tests.llm.test_operators import CLEAN, LONG, PARA


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<body><div class=title><h1>T</h1></div><div class=body>{PARA * 4}</div>", "\n".join(["T", *[CLEAN] * 4])),
        (f"<body><div class=lead>{PARA}</div><div class=body>{PARA * 6}</div>", "\n".join([CLEAN] * 7)),
        (f"<body><div id=x><div>{PARA * 6}<p>x</p></div><div>{PARA}</div></div>", "\n".join([*[CLEAN] * 6, "x", CLEAN])),
        (f"<main><h1>T</h1><article>{PARA}<p>x</p></article></main>", f"T\n{CLEAN}\nx"),
        (f"<body><article><h2>A</h2>{PARA * 3}</article><article><h2>B</h2>{PARA * 2}</article>", "\n".join(["A", *[CLEAN] * 3, "B", *[CLEAN] * 2])),
        (f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div>{PARA * 4}</div>", "\n".join([CLEAN] * 4)),
    ],
)
def test_regions(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<article><h1>T</h1>{PARA}<section id='discussion'><h2>D</h2>{PARA}</section></article>", f"T\n{CLEAN}\nD\n{CLEAN}"),
        (f"<article><h1 id=search>T</h1>{PARA}<h2 id='related-work'>R</h2>{PARA}<h2 id='search-methods'>S</h2>{PARA}</article>", f"T\n{CLEAN}\nR\n{CLEAN}\nS\n{CLEAN}"),
        (f"<div class=story>{PARA}<p class='notice'>{CLEAN}</p><section id='social-impact'>{PARA}</section>{PARA * 2}</div>", "\n".join([CLEAN] * 5)),
        (f"<article>{PARA}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be</p></article>", f"{CLEAN}\nLet x=1 be"),
        (f"<article>{PARA}<div class=related><a href=1>{CLEAN}</a></div><div class='ad'>Buy</div>{PARA}</article>", f"{CLEAN}\n{CLEAN}"),
        (f"<article>{PARA}<p>{LONG}<span class=share>Share</span></p></article>", f"{CLEAN}\n{CLEAN}"),
        (f"<article>{PARA}<section id=comments>{PARA}</section></article>", CLEAN),
    ],
)
def test_names_inside_the_article(html, text):
    assert main_text(html) == text
