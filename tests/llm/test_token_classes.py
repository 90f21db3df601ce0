"""Token counts of characters whose class differs between Unicode tables, against the tokenizer library."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from cargolens.llm import token_counts as T

PATH = T.vocabulary("word_bpe_49k.json")
CODES = [c for a, b in ((0, 0x3500), (0xA000, 0xD800), (0xF900, 0x1F000), (0xE0000, 0xE0200)) for c in range(a, b)]


@pytest.fixture(scope="module")
def own():
    return T.PrefixCounter(PATH), Tokenizer.from_file(PATH)


def differing(own, texts):
    counter, library = own
    return [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if int(np.frombuffer(counter.changes(t), np.int8).sum(dtype=np.int64)) != len(e.ids)]


@pytest.mark.parametrize("context", ["ñ{}", "º{}", "{}'s"])
def test_every_character_in_context(own, context):
    assert differing(own, [context.format(chr(c)) for c in CODES]) == []


def test_random_characters(own):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("aéñº 's\nI1") if rnd.random() < 0.5 else chr(rnd.choice(CODES)) for _ in range(rnd.randint(1, 12))) for _ in range(20_000)]
    assert differing(own, texts) == []


def test_classes_cover_all_code_points():
    classes = T.char_classes(Tokenizer.from_file(PATH))
    assert sum(b - a + 1 for ranges in classes.values() for a, b in ranges) == 0x110000 - 0x800
    of = {c: kind for kind, ranges in classes.items() for a, b in ranges for c in range(a, b + 1)}
    assert [of[ord(c)] for c in "aÑº日1²½  \n!_"] == list("LLLLNNNSSSOO")
