"""Vectorised text primitives that work on Arrow string buffers.

Whole batches of texts are tokenised and hashed with numpy on their UTF-8
bytes; no Python string is made per word.  Every helper takes ``data`` (the
bytes of many texts, one after the other, uint8) and ``offs`` (n + 1 offsets,
text ``i`` is ``data[offs[i]:offs[i + 1]]``).  Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are handled in slices of about so many bytes, so that the 8-byte work
#: arrays stay small; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: After lower-casing: 0-9, a-z and every byte of a non-ASCII code point.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = True
WORD[0x61:0x7B] = True
WORD[0x80:] = True

#: The white space that lines are stripped of: 0x20 and 0x09 to 0x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offs, raw = column.buffers()
    offs = np.frombuffer(raw_offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes each, or of one text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j
        i = j


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text offsets of the runs of true bytes; no run crosses a text's end."""
    n = len(inside)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    cut = offs[:-1]
    before[cut[cut < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Masks for the last 0 to 8 bytes of a span.
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def span_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans' bytes as 8-byte numbers (the last one padded with zeros), each one's place in its span, and the spans' offsets."""
    counts = (ends - starts + 7) >> 3
    to = np.concatenate(([0], np.cumsum(counts)))
    place = np.arange(to[-1]) - np.repeat(to[:-1], counts)
    at = np.repeat(starts, counts) + 8 * place
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    chunks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    chunks &= _TAIL[np.minimum(np.repeat(ends, counts) - at, 8)]
    return chunks, place, to


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes have equal hashes wherever they are.

    Every 8 bytes are mixed together with their place before they are added up,
    so no structure of the bytes carries over to the sums.
    """
    if not len(starts):
        return np.zeros(0, dtype=U64)
    chunks, place, to = span_chunks(data, starts, ends)
    out = np.zeros(len(starts), dtype=U64)
    full = np.flatnonzero(np.diff(to))
    if len(full):
        later = place > 0
        chunks[later] ^= mix64(place[later].astype(U64), seed + 1)
        out[full] = np.add.reduceat(mix64(chunks, seed + 2), to[:-1][full])
    return mix64(out + (ends - starts).astype(U64), seed + 3)


def span_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span: equal ones are equal bytes, which are compared, and not only their hashes."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    _, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    like = first[number]
    same = bool((ends - starts == ends[like] - starts[like]).all())
    if same:
        chunks, place, to = span_chunks(data, starts, ends)
        same = bool((chunks == chunks[np.repeat(to[:-1][like], np.diff(to)) + place]).all())
    if same:
        return number
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)


def words(data: np.ndarray, offs: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words: their hashes, starts and ends in ``data``, and per-text word offsets."""
    low = LOWER[data]
    starts, ends, at = runs(WORD[low], offs)
    return span_hashes(low, starts, ends, seed), starts, ends, at


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive hashes (of the whole array; the caller drops those that cross texts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, size, dtype=U64)
    for t in range(size):
        # each step is a bijection of what went before
        out ^= hashes[t : t + n]
        out *= U64(0xD6E8FEB86659FD93)
        out ^= out >> U64(32)
    return mix64(out, size)


def text_windows(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes within texts, and the offsets of each text's windows.

    A text of fewer than ``size`` words, but not none, has one window: all its words.
    """
    counts = np.diff(at)
    whole = np.maximum(counts - size + 1, 0)
    out_counts = np.where(counts == 0, 0, np.maximum(whole, 1))
    to = np.concatenate(([0], np.cumsum(out_counts)))
    out = np.zeros(to[-1], dtype=U64)
    full = window_hashes(hashes, size)
    long = np.repeat(counts >= size, out_counts)
    first = np.repeat(at[:-1], out_counts) + np.arange(to[-1]) - np.repeat(to[:-1], out_counts)
    out[long] = full[first[long]]
    for length in range(1, size):
        short = np.flatnonzero(counts == length)
        if len(short):
            out[to[short]] = window_hashes(hashes, length)[at[short]]
    return out, to
