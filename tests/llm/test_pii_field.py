"""Candidates and parts of the field in op9_pii."""

from __future__ import annotations

import random

import pytest

from tarnwick.llm import pii

FOUND = {
    "jan [at] host.net please call me": "jan [at] host.net",
    "write to a.b.smith (at) host.org today": "a.b.smith (at) host.org",
    "jan (at) host (dot) co (dot) uk and then come with us to town": "jan (at) host (dot) co (dot) uk",
    "jan [at] host.net. Please call me today or write": "jan [at] host.net",
}


@pytest.mark.parametrize("text", FOUND)
def test_words_around_written_out_addresses(text):
    got = pii.field_spans(text, pii.trained())
    assert [(text[s:e], y) for s, e, y in got] == [(FOUND[text], 0)]


def test_template_addresses_before_plain_words():
    r, field = random.Random(5), pii.trained()
    word = lambda: "".join(r.choice(["on", "er", "la", "ti", "en"]) for _ in range(r.randint(1, 3)))
    hit = 0
    for _ in range(100):
        own = r.choice([f"{word()}[at]{word()}.net", f"{word()} (at) {word()} (dot) org", f"{word()}.{word()}.{word()} (at) {word()}.org"])
        text = "mail " + own + " " + " ".join(word() for _ in range(r.randint(3, 8)))
        hit += (5, 5 + len(own), 0) in pii.field_spans(text, field)
    assert hit >= 95


def test_every_gold_span_is_a_candidate():
    for text, spans in pii.sentences(500, 4):
        tok = pii.tokens_of(text, 0, len(text))
        assert {(s, e) for s, e, _ in spans} <= {(tok[i][1], tok[j - 1][2]) for i, j, _ in pii.candidates(tok)}


def test_parts_are_as_good_as_the_whole_text():
    r, field = random.Random(3), pii.trained()
    some = lambda: " ".join(t for t, _ in pii.sentences(2, r.randrange(10**6)))
    texts = [some() + " zz yy" * r.randint(0, 40) + " " + some() for _ in range(100)] + ["q" * 50 + "_1" + "w" * 300 + " 1" * 30, "", "1" * 500]
    for t in texts:
        tok = pii.tokens_of(t, 0, len(t))
        assert [(tok[i][1], tok[j - 1][2], y) for i, j, y in field.decode(len(tok), pii.candidates(tok))] == pii.field_spans(t, field)
