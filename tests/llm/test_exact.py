"""Operators that compare texts are exact on texts made to collide in polynomial hashes."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from graphloom.llm import bytetext as bt
from graphloom.llm import line_dedup, near_dup

from .test_operators import brute_lines, brute_near, sha


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def pairs(n: int) -> list[tuple[str, str]]:
    """Two different texts each that collide modulo 2^64 for every odd base (and some plain ones)."""
    return [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")), (thue_morse(n, "ab", "ba"), thue_morse(n, "ba", "ab")), ("a" * n, "a" * (n + 8)), ("x" * n + "a" * 8, "x" * (n - 8) + "a" * 16)]


def hashes(texts: list[str], seed: int = 0) -> np.ndarray:
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    return bt.span_hashes(np.frombuffer(b"".join(raw), np.uint8), offs[:-1], offs[1:], seed)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_structured_texts_have_different_hashes(n):
    for t, u in pairs(n):
        for seed in (0, near_dup.SECOND):
            assert len(set(hashes([t, u], seed).tolist())) == 2
    many = [t[k:] + t[:k] for t, _ in pairs(n)[:2] for k in range(64)] + ["a" * k for k in range(1, 200)] + [""]
    assert len(set(hashes(many).tolist())) == len(set(many))
    words = hashes(list(thue_morse(2048, "a", "b")))
    assert len(set(bt.window_hashes(words, 16).tolist())) == len({thue_morse(2048, "a", "b")[k : k + 16] for k in range(2033)})


def test_numbers_are_those_of_the_bytes(monkeypatch):
    data = np.frombuffer(b"abc abd abc ab", np.uint8)
    starts, ends = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 14])
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(bt, "span_hashes", lambda d, a, b, seed=0: np.zeros(len(a), np.uint64))
        n = bt.span_numbers(data, starts, ends).tolist()
        assert n[0] == n[2] and len(set(n)) == 3


@pytest.mark.parametrize("n", [1024, 4096])
def test_lines_that_collide_stay(spark, n):
    rows = []
    for k, (t, u) in enumerate(pairs(n)):
        rows += [(100 * k + i, f"{t}\nown {k} {i}") for i in range(5)] + [(100 * k + 10, f"{u}\n{t}\nend"), (100 * k + 3, t)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.text or "")) for r in out.collect()) == brute_lines(rows)


def test_colliding_words_are_no_copies(spark):
    rows = []
    for k, (t, u) in enumerate(pairs(4096)):
        common = " ".join(f"k{k}w{i}" for i in range(60))
        rows += [(10 * k, f"{common} {t}"), (10 * k + 1, f"{common} {u}"), (10 * k + 2, t), (10 * k + 3, u), (10 * k + 4, t)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in got} == brute_near(rows)
    copies = {r.doc_id: r.copy_id for r in got}
    assert all(copies[10 * k] != copies[10 * k + 1] and copies[10 * k + 2] != copies[10 * k + 3] and copies[10 * k + 2] == copies[10 * k + 4] for k in range(4))


def test_verification_spells_the_shingles(monkeypatch):
    # with words that all hash alike the numbers still tell them apart
    texts = [b"one two three four five six", b"one two three four five seven", b"One, two", b"one two", b"", b"two one"]
    want = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().replace(b",", b"").split() for t in texts)]
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(bt, "span_hashes", lambda d, a, b, seed=0: np.zeros(len(a), np.uint64))
        got = [set(x.tolist()) for x in near_dup.spelled_sets(texts)]
        assert [[len(a & b) for b in got] for a in got] == [[len(a & b) for b in want] for a in want]
