"""Ids by word are the tokenizer's own: every letter before stops, all kinds of blanks, mixed scripts."""

import random
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from threatloom.llm import packing
from threatloom.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def ids():
    return packing.WordIds(TOKENIZER)


def check(ids, texts):
    for text, raw in zip(texts, ids(pa.array(texts, pa.string()))):
        want = ids.tokenizer.encode(text or "", add_special_tokens=False).ids
        got = np.frombuffer(raw, dtype="<u4").tolist()
        if got != want:
            words = [w for w in text.split() if ids.encode(w) != ids(pa.array([w]))[0]]
            raise AssertionError(f"{[(w, [hex(ord(c)) for c in w]) for w in words[:5]]}")


def test_every_letter_before_stops_and_within_words(ids):
    stops = packing._TAIL
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
    assert len(letters) > 100_000
    odd = [c for c in letters if ord(c) < 0x250 or unicodedata.normalize("NFC", c.lower()) != c.lower() or len(c.lower()) > 1
           or unicodedata.decomposition(c)]
    texts = [" ".join(f"{c}{stops[i % len(stops)]} a{c}a x{c}{c}" for i, c in enumerate(letters[at:at + 500], at)) for at in range(0, len(letters), 500)]
    texts += [" ".join(f"{c}{s}" for c in odd[at:at + 50] for s in stops) for at in range(0, len(odd), 50)]
    check(ids, texts)


def test_the_reported_words(ids):
    check(ids, ["\u0130,", "\u0958.", "\u09dc) x", "\ufb2a!", "é, É. ΣΑΣ, ß; ﬁ,"])


def test_blanks_marks_and_odd_words(ids):
    rng = random.Random(6)
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()] + ["​", "﻿", "᠎", "\x00"]
    parts = ["don't", "we'll", "'s", "x1y", "42", "é", "́", "하", "ᆫ", "Ω", "ﬀ", "a,b", "...", "--", "(x)", "\U0001f600", "日本語,", "ñ", "İ",
             "<|endoftext|>", "<|startoftext|>x", "𝒜.", "ǆ!", "Ꙁ?"]
    texts = ["".join(rng.choice(parts) + rng.choice(blanks) for _ in range(rng.randrange(30))) for _ in range(600)]
    check(ids, [*texts, "", None, " ", "\n\n", *blanks])


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    small = packing.WordIds(TOKENIZER)
    check(small, ["one two, three. four; five", "two, six seven! one eight, nine."] * 3)
    assert len(small.known) < 20


def test_letters_that_normalisation_takes_apart_are_not_safe(ids):
    assert [ids.letters[ord(c)] for c in "\u0130\u0958\ufb2a"] == [" "] * 3
    assert " " not in "".join(ids.letters[ord(c)] for c in "éÉñжΩ")
