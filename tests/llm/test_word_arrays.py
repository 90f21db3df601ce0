"""Words and parts of texts as arrays."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cargolens.llm import word_arrays as A

SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
CLASSES = A.byte_classes(SPACES, BREAKS)


def test_equal_words_have_equal_hashes():
    texts = ["ab  cd\tab. CD é,ñandú".encode(), b"", b"cd", ("x" * 70000 + " ab").encode()]
    w = A.Words(texts, CLASSES)
    found = [w.data[a:b] for a, b in zip(w.starts, w.ends, strict=True)]
    assert found == [b"ab", b"cd", b"ab", b"CD", "é".encode(), "ñandú".encode(), b"cd", b"x" * 70000, b"ab"]
    assert w.text.tolist() == [0, 0, 0, 0, 0, 0, 2, 3, 3]
    assert w.piece[0] == w.piece[2] != w.piece[3] == w.piece[4] != w.piece[5]
    for k in (0, 1):
        h, low = w.hashes(k).tolist(), w.hashes(k, lower=True).tolist()
        assert h[0] == h[2] == h[8] and h[1] == h[6] and len(set(h)) == 6 and low[3] == low[1]
    assert w.phrase(0, 3) == "ab cd ab"


@pytest.mark.parametrize("size", [7, 20, 64])
def test_every_phrase_begins_in_one_part(size):
    rnd = random.Random(size)
    for trial in range(200):
        text = "".join(rnd.choice("ab  .c\t" if trial % 2 else "ab c ") for _ in range(rnd.randint(0, 150))).encode()
        want = phrases(A.Words([text], CLASSES), np.array([len(text)]))
        parts = list(A.windows(text, BREAKS, size, 4))
        w = A.Words([p for p, _ in parts], CLASSES)
        assert sorted(phrases(w, np.array([n for _, n in parts]))) == sorted(want)


def phrases(w, counted):
    begins = w.starts - w.text_starts[w.text] < counted[w.text]
    return [w.phrase(i, k) for k in range(1, 6) for i in range(len(w) - k + 1) if w.piece[i] == w.piece[i + k - 1] and begins[i]]


def test_chunks_hold_all_texts():
    texts = [b"a " * n for n in (0, 3, 500, 1, 40)]
    owners = [i for own, parts, counted in A.chunks(texts, BREAKS, 4, 64) for i in own]
    assert sorted(set(owners)) == [0, 1, 2, 3, 4]
