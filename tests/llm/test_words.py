import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserix.llm.words import LOWER, NOT_ALNUM, Words

TEXTS = st.lists(st.text(alphabet="aB é\n\t😀9-.", max_size=30), max_size=6)


def spans(words, i):
    data = words.raw.tobytes()
    return [data[s:e].decode() for s, e in zip(words.start[words.bounds[i] : words.bounds[i + 1]], words.end[words.bounds[i] : words.bounds[i + 1]])]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    for separators, pattern in ((None, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        kw = {"fold": LOWER} | ({"separators": separators} if separators is not None else {})
        words = Words(pa.array(texts, pa.string()), **kw)
        for i, t in enumerate(texts):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
            assert [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in spans(words, i)] == re.findall(pattern, low)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_windows_hash_alike_when_they_are_alike(texts, size):
    words = Words(pa.array(texts, pa.string()))
    starts, hashes = words.windows(size)
    want = []
    for i in range(len(texts)):
        w = spans(words, i)
        want += [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
    assert len(want) == len(starts)
    by_hash = {}
    for h, w in zip(hashes.tolist(), want):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(want))


def test_no_collisions_among_many_words():
    random.seed(1)
    names = list({"".join(random.choice("abcdef") for _ in range(random.randint(1, 9))) for _ in range(200_000)})
    assert len(np.unique(Words(pa.array([" ".join(names)])).hash)) == len(names)


def test_nulls_and_nothing():
    assert Words(pa.array([None, "", "a"], pa.string())).counts().tolist() == [0, 0, 1]
    assert len(Words(pa.array([], pa.string()))) == 0
    assert hashlib.sha256(b"").hexdigest()[:6] == "e3b0c4" and pytest
