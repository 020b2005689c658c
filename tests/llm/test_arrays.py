import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywright.llm import byte_words as bw
from tallywright.llm.quality_rules import Rules, BITS, judge
from tallywright.llm.minhash import similar

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet="ab \n\té#\x1c", max_size=30), min_size=1, max_size=8)


def binary(texts):
    return pa.array([None if t is None else t.encode() for t in texts], pa.binary())


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, limit):
    seen = {}
    for part in bw.slices(binary(texts), limit):
        found = bw.words(part)
        for i in range(part.last - part.first):
            a, b = found.bounds[i], found.bounds[i + 1]
            words = [bytes(part.data[s:e]) for s, e in zip(found.start[a:b], found.end[a:b])]
            assert words == WORD.findall(texts[part.first + i].encode())
            for word, key in zip(words, found.hashes[a:b]):
                assert seen.setdefault(word, key) == key
    assert len(set(seen.values())) == len(seen)


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, earlier, copies = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_counted_rules(texts):
    rules = Rules(np.zeros((3, 1 << BITS), np.float32), 0.0, 0.0)
    out = judge(binary(texts), rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(out[n][i]) for n in names) for i in range(len(texts))] == [brute_rules(t) for t in texts]


def shingles(text, size):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from("abc"), max_size=12).map(" ".join)] * 2), min_size=1, max_size=6))
def test_similarity_on_full_sets(pairs):
    got = similar(binary([a for a, _ in pairs]), binary([b for _, b in pairs]), 3, 80)
    for (a, b), linked in zip(pairs, got):
        x, y = shingles(a, 3), shingles(b, 3)
        assert linked == bool(x | y and 100 * len(x & y) >= 80 * len(x | y))


def test_index_finds_what_it_holds():
    keys = np.unique(bw.randoms(5000, 77))
    index = bw.HashIndex(keys[::2])
    place = index.find(keys)
    assert (place[::2] == np.arange(len(keys[::2]))).all() and (place[1::2] == -1).all()
    assert (bw.HashIndex(keys[:0]).find(keys) == -1).all()
    ends = np.array([0, 1, 2**64 - 1], np.uint64)
    assert (bw.HashIndex(ends).find(ends) == [0, 1, 2]).all()
