"""Where elements end whose text is not read."""

import pytest

from prefmill.llm import htmltext
from tests.llm.test_htmltext import text_of

SENTENCES = " ".join(f"This is sentence number {k} of the article, and it says a little more than the last." for k in range(12))
ARTICLE = f'<article class="post-content"><h1>A heading</h1><p>{SENTENCES}</p><p>{SENTENCES}</p></article>'


def read(html):
    page = htmltext.Page(html)
    return page.text([1.0] * len(page.parent))


@pytest.mark.parametrize("n", [1, 9, 40])
def test_characters_that_grow_in_lower_case_move_no_end(n):
    page = f"<html><head><title>{'İ' * n}</title></head><body><script>var a = '{'İ' * n}';</SCRIPT>{ARTICLE}</body></html>"
    assert SENTENCES in text_of(page)
    assert read("İ" * n + "<style>p {}</style>one<textarea>x</textarea> two") == "İ" * n + " one two"


@pytest.mark.parametrize("start", ["<body>", "<body class=x>", "", "<div>", "<BODY><main>"])
def test_a_head_without_end_stops_at_what_it_cannot_hold(start):
    page = f"<!doctype html><html><head><meta charset=utf-8><title>Title</title><link rel=x><style>p {{}}</style>{start}{ARTICLE}"
    assert SENTENCES in text_of(page) and "Title" not in text_of(page)
    assert read("<head><title>t</title>\n text <b>bold</b>") == "text bold"
    assert read("<head><title>t</title><script>s</script><noscript><img src=x>no</noscript><style>s</style></head><p>yes") == "yes"


def test_foreign_elements_closed_by_a_slash_swallow_nothing():
    assert read("<p>one <svg/> two <math /> three <svg width='1' class=\"a=b\"/>four</p>") == "one two three four"
    assert read("<p>one <svg><title/><style/><path d='m'/>lost</svg> two</p>") == "one two"
    assert read("<p>one <svg data-x=a/>lost</svg> two <svg>lost</svg> three</p>") == "one two three"
    assert SENTENCES in text_of(f"<html><body><div><svg class=icon />{ARTICLE}</div></body></html>")


def test_raw_text_ends_only_at_its_own_name():
    assert read("<p>one <script>'</scripts>' <b>lost</b></script> two") == "one two"


HOSTILE = {
    "nested": "<div>" * 200_000, "stray ends": "<div></span>" * 80_000, "no end": "<a " * 330_000, "cells": "<p><td>" * 140_000, "lists": "<ul><li>" * 120_000,
    "open quotes": '<a =" ' * 160_000, "foreign": "<svg><g/>" * 110_000, "brackets": "<" * 1_000_000, "comments": "<!-" * 300_000, "quotes": "<a b='" * 160_000 + ">",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_of_anything_takes_linear_time(name):
    import time

    html = HOSTILE[name]

    def took(page):
        start = time.process_time()
        htmltext.Page(page)
        return time.process_time() - start

    assert took(html) < 8 * took(html[: len(html) // 4]) + 1
