import random
import re

import numpy as np
import pyarrow as pa

from riskframe.llm import words as W
from llm_rows import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def arrays(texts):
    return W.utf8(pa.array(texts, pa.string()))


def test_words_are_those_of_the_pattern():
    r = random.Random(4)
    texts = [None, "", " ", "a", *["".join(r.choice("ab \n\té\x0b\x0c") for _ in range(r.randint(0, 40))) for _ in range(300)]]
    data, offsets = arrays(texts)
    for lo, hi in W.blocks(offsets, 200):
        part = offsets[lo : hi + 1]
        own = data[part[0] : part[-1]]
        found = W.words(own, part - part[0])
        for i in range(lo, hi):
            a, b = found.bounds[i - lo], found.bounds[i - lo + 1]
            assert [own[s:e].tobytes().decode() for s, e in zip(found.start[a:b], found.end[a:b], strict=True)] == WORD.findall(texts[i] or "")


def test_equal_words_hash_alike_and_others_do_not():
    texts = [prose(k, 400) for k in range(20)] + [prose(0, 400).upper().replace("É", "é")]
    data, offsets = arrays(texts)
    found = W.words(data, offsets)
    seen = {}
    for s, e, h in zip(found.start, found.end, found.hash.tolist(), strict=True):
        word = data[s:e].tobytes().lower()
        assert seen.setdefault(h, word) == word
    assert len(set(seen.values())) == len(seen)


def test_prefixes_are_those_of_the_words():
    data, offsets = arrays(["abcdef abcxyz ab ABCq"])
    found = W.words(data, offsets)
    long, hashes = W.prefix_hashes(data, found, 3)
    assert long.tolist() == [0, 1, 3] and len(set(hashes.tolist())) == 1


def test_shingles_of_short_texts():
    data, offsets = arrays(["a b c", "a b c d e", "a b c d e f", "", "a b c d e a b c d e"])
    found = W.words(data, offsets)
    sets = [W.shingles(found.hash[a:b]) for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
    assert [len(s) for s in sets] == [1, 1, 2, 0, 5]
    assert np.isin(sets[1], sets[2]).all() and not np.isin(sets[0], sets[1]).any()


def test_slices_of_a_column():
    column = pa.array(["zero", "one two", None, "three"]).slice(1, 3)
    data, offsets = W.utf8(column)
    assert data.tobytes() == b"one twothree" and offsets.tolist() == [0, 7, 7, 12]
