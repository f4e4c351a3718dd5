"""Properties of the byte primitives and of pure parts of the operators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bytetext as bt
from graphloom.llm import html_extract, langid, line_dedup, mixing, near_dup
from tests.llm.test_operators import words

texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB1 \n\té漢-\x00\x0b"), max_size=40), st.text(max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(rows):
    data, offs = bt.column_bytes(pa.array(rows, pa.string()))
    hashes, starts, ends, at = bt.words(data, offs)
    low = bt.LOWER[data]
    got = [[low[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(at[:-1], at[1:], strict=True)]
    assert got == [words(t) for t in rows]
    by_word = {}
    for word, h in zip([w for t in got for w in t], hashes.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 4))
def test_keys_of_lines(rows, least):
    data, offs = bt.column_bytes(pa.array(rows, pa.string()))
    lines = line_dedup._Lines(data, offs, least)
    want = [line for t in rows for line in (t or "").split("\n")]
    keys = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r")) for x in want]
    assert [data[a:b].tobytes().decode() for a, b in zip(lines.starts, lines.ends, strict=True)] == want
    assert [lines.low[a:b].tobytes().decode() for a, b in zip(lines.key_starts, lines.key_ends, strict=True)] == keys
    assert lines.long.tolist() == [len(k) >= least for k in keys]


@settings(max_examples=60, deadline=None)
@given(texts)
def test_slices_change_nothing(rows):
    data, offs = bt.column_bytes(pa.array(rows, pa.string()))
    *whole, at = near_dup.shingle_sets(data, offs)
    parts = [near_dup.shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in bt.slices(offs, 7)]
    assert [w.tolist() for w in whole] == [[x for p in parts for x in p[k].tolist()] for k in (0, 1)] and len(at) == len(rows) + 1
    ids, owner = langid.subwords(data, offs)
    assert len(ids) == len(owner) and (len(owner) == 0 or owner.max() < len(rows))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=9))
def test_targets(sizes):
    out = mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert math.isclose(sum(out), 1.5 * sum(sizes), abs_tol=1e-6) and all(t <= 2 * s + 1e-9 for t, s in zip(out, sizes, strict=True))
    for size, target in zip(sizes, out, strict=True):
        full, blocks, slots, last = mixing.slot_plan(size, math.floor(target), 16)
        assert full * 16 <= size and blocks >= full and slots >= 0 and 0 <= last < 32


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/!-abp \"'=&;x"), max_size=80))
def test_any_markup_is_read_to_its_end(page):
    for text, _, _ in html_extract.blocks(page):
        assert text == " ".join(text.split()) and text


def test_pruning_keeps_what_can_be_similar():
    fewest = near_dup.fewest_matches()
    n = np.arange(near_dup.STEP, near_dup.VALUES + 1, near_dup.STEP)
    lost = [sum(math.comb(int(k), m) * 0.8**m * 0.2 ** (int(k) - m) for m in range(f)) for k, f in zip(n, fewest, strict=True)]
    assert sum(lost) < 2e-5 and (np.diff(fewest) > 0).all()
    assert (1 - 0.8**near_dup.ROWS) ** near_dup.BANDS < 1e-5
