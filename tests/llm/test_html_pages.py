"""Main text of varied pages whose text is known, and of hostile pages in bounded time."""

import time

import pytest

from headway.llm import html_text

SENTENCES = [
    "The river rose, as it does in most springs, and the mill stood in water up to its lower windows.",
    "Nobody had expected it so early, said the keeper, who had lived there for thirty years.",
    "Barges could not pass the bridge, and the market, which depends on them, was half empty.",
    "In the end the water fell within a week, leaving mud, driftwood and a good deal of work.",
    "Old maps show the same bend, the same ford, and a chapel of which nothing is left.",
]
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/b>Sport, culture</a></li><li><a href=/c>Weather, travel, food</a></li></ul>"
LONG = "Get our letter, every day, with news, views, offers, and more, for free, forever, and ever, really."
PARAGRAPHS = "".join(f"<p>{s}</p>" for s in SENTENCES)
PLAIN = "\n".join(SENTENCES)

#: name: (page, its text)
PAGES = {
    "article between menus": (f"<nav>{MENU}</nav><article>{PARAGRAPHS}</article><footer>{LONG}</footer>", PLAIN),
    "main with a heading": (f"<header>{MENU}</header><main><h1>High water</h1>{PARAGRAPHS}</main><aside>{LONG}</aside>", "High water\n" + PLAIN),
    "named containers": (f"<div id=menu>{MENU}</div><div id=content>{PARAGRAPHS}</div><div id=footer><p>{LONG}</p></div>", PLAIN),
    "class of a blog": (f"<div class='site-header'>{MENU}</div><div class='post hentry'><div class='entry-content'>{PARAGRAPHS}</div></div><div class='widget'><p>{LONG}</p></div>", PLAIN),
    "no names at all": (f"<div>{MENU}</div><div><div>{PARAGRAPHS}</div></div>", PLAIN),
    "table layout": (f"<table><tr><td>{MENU}</td><td>{PARAGRAPHS}</td></tr></table>", PLAIN),
    "paragraphs by line breaks": (f"<div class=story>{'<br><br>'.join(SENTENCES)}</div><div class=sidebar><p>{LONG}</p></div>", " ".join(SENTENCES)),
    "unclosed paragraphs": (f"<nav>{MENU}</nav><article>{''.join('<p>' + s for s in SENTENCES)}</article>", PLAIN),
    "comments below": (f"<article>{PARAGRAPHS}</article><section id=comments><h2>Comments</h2><p>{LONG}</p><p>{LONG}</p></section>", PLAIN),
    "comments inside": (f"<article>{PARAGRAPHS}<div class=comments><p>{LONG}</p></div></article>", PLAIN),
    "advert inside": (f"<article><p>{SENTENCES[0]}</p><div class=ad><p>{LONG}</p></div>{''.join(f'<p>{s}</p>' for s in SENTENCES[1:])}</article>", PLAIN),
    "form inside": (f"<article>{PARAGRAPHS}<form><p>{LONG}</p><input name=mail></form></article>", PLAIN),
    "cookie notice first": (f"<div class='cookie-banner'><p>{LONG}</p></div><div>{PARAGRAPHS}</div>", PLAIN),
    "references are text": (f"<article>{PARAGRAPHS}<ul><li><a href=1>First source, 1990</a></li><li><a href=2>Second source, 1991</a></li></ul></article>", PLAIN + "\nFirst source, 1990\nSecond source, 1991"),
    "tags are text in an article": (f"<article>{PARAGRAPHS}<div class=tags><p>Filed under rivers</p></div></article>", PLAIN + "\nFiled under rivers"),
    "mathematics": (f"<article>{PARAGRAPHS}<p>So <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation encoding=x>a+b</annotation></math> holds.</p></article>", PLAIN + "\nSo a+b holds."),
    "quotes and lists": (f"<main>{PARAGRAPHS}<blockquote><p>Never again, they said.</p></blockquote><ol><li>One</li><li>Two</li></ol></main>", PLAIN + "\nNever again, they said.\nOne\nTwo"),
    "a table of figures": (f"<article>{PARAGRAPHS}<table><tr><th>Year<th>Level<tr><td>1990<td>3 m</table></article>", PLAIN + "\nYear\nLevel\n1990\n3 m"),
    "references of characters": ("<article><p>Caf&eacute; &amp; bar, &#8364;5, &#x41;&#00000066;, &notanentity; &#99999999999;</p></article>", "Café & bar, €5, AB, ¬anentity; �"),
    "hidden parts": (f"<article>{PARAGRAPHS}<p hidden>no</p><p style='display: none'>no</p><div aria-hidden=true>no</div></article>", PLAIN),
    "scripts and styles": (f"<style>p > a {{}}</style><article>{PARAGRAPHS}<script>if (a < b) document.write('<p>no</p>')</script></article><script>no", PLAIN),
    "quotes in attributes": (f"<article><p title='a > b' data-x=\"it's\">{SENTENCES[0]}</p><a name=x'y></a>{''.join(f'<p>{s}</p>' for s in SENTENCES[1:])}</article>", PLAIN),
    "a quote that never ends": (f"<article><p title=\"x>{SENTENCES[0]}</p>{''.join(f'<p>{s}</p>' for s in SENTENCES[1:])}</article>", PLAIN),
    "comments of markup": (f"<!-- <article>no</article> --><!--><article><!-- a -- b --!>{PARAGRAPHS}</article><!-- no", PLAIN),
    "upper case": (f"<DIV CLASS=SIDEBAR><P>{LONG}</P></DIV><ARTICLE>{PARAGRAPHS}</ARTICLE>", PLAIN),
    "two articles": (f"<main><article>{''.join(f'<p>{s}</p>' for s in SENTENCES[:3])}</article><article>{''.join(f'<p>{s}</p>' for s in SENTENCES[3:])}</article></main>", PLAIN),
    "header of the article": (f"<header>{MENU}</header><article><header><h1>High water</h1></header>{PARAGRAPHS}<footer><p>{LONG}</p></footer></article>", "High water\n" + PLAIN),
    "white space": (f"<article><p>\n  {SENTENCES[0].replace(' ', chr(10) + chr(9))}\xa0 </p>{''.join(f'<p>{s}</p>' for s in SENTENCES[1:])}</article>", PLAIN),
}


@pytest.mark.parametrize("name", PAGES)
def test_text_of_varied_pages(name):
    page, text = PAGES[name]
    assert html_text.extract(f"<!DOCTYPE html><html><head><title>No</title></head><body>{page}</body></html>") == text


def test_a_deep_article_is_found():
    page = f"<div>{MENU}</div>" + "<div>" * 400 + PARAGRAPHS + "</div>" * 400 + f"<div><p>{LONG}</p></div>"
    assert html_text.extract(page) == PLAIN


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='post-content'>{}</div>", "<div>{}</div>", "<div><div>{}</div></div>", "<section><div>{}</div></section>"])
def test_lists_and_paragraphs_of_links_stay_in_any_container(wrap):
    links = "<ul><li><a href='a'>First reference</a></li><li><a href='b'>Second reference</a></li></ul>"
    more = "<p><a href='c'>Third source</a> <a href='d'>Fourth source</a></p>"
    menu = "<ul><li><a href='1'>Home page</a></li><li><a href='2'>Latest news</a></li></ul>"
    page = f"<html><body>{menu}{wrap.format(f'<p>{LONG}</p>{links}<p>{LONG}</p>{more}')}{menu}</body></html>"
    assert html_text.extract(page).split("\n") == [LONG, "First reference", "Second reference", LONG, "Third source Fourth source"]


HOSTILE = {
    "open tags": lambda n: "<a " * n, "open quotes": lambda n: '<a x="' * n, "stray ends": lambda n: "<b>" * n + "</i>" * n,
    "ends behind a barrier": lambda n: "<b><div>" + "<i>" * n + "</b>" * n, "script ends": lambda n: "<script>" + "</script " * n,
    "unpaired quotes": lambda n: '<a ">" "<a>"' * n, "cells": lambda n: "<table>" + "<tr><td>x" * n, "nested": lambda n: "<div>" * n + "x",
    "paragraphs": lambda n: "<p>x, " * n, "a reference": lambda n: "&#" + "9" * n, "comments": lambda n: "<!-- " * n, "less than": lambda n: "<" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_bounded_time(name):
    page = HOSTILE[name](1_000_000 // len(HOSTILE[name](2)) * 2)
    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 20  # quadratic work would take hours
