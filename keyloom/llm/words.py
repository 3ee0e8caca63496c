"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes of one class; every class used here is closed under UTF-8
(bytes from 0x80 always belong to a word), so byte runs and code point runs agree.
A word is known by a 64-bit hash: a polynomial over random byte values, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single text is worked on alone.
SLICE_BYTES = 2_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_BYTE_VALUE = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _class(separators: list[tuple[int, int]], fold: bool) -> np.ndarray:
    """0 for a byte that separates words, else the byte after A-Z are lowered."""
    table = _lower() if fold else np.arange(256, dtype=np.uint8)
    table[0] = 1  # 0 stands for "separator"; a NUL byte inside a word keeps a value of its own
    for low, high in separators:
        table[low : high + 1] = 0
    return table


#: Words are what white space separates; A-Z lowered.
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)], True)
#: Words are what white space separates, case kept.
SPACED_CASED = _class([(0x20, 0x20), (0x09, 0x0D)], False)
#: Words are runs of a-z, 0-9 and anything beyond ASCII; A-Z lowered first.
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], True)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        full[0] = 1
        _powers[name] = have = np.multiply.accumulate(full)
    return have[:n]


@dataclass
class Words:
    """Words of a slice of texts: byte spans, the text of each, and the hash of each."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i] .. bounds[i+1]-1
    hashes: np.ndarray | None


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_BYTES."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]]."""
    first = int(offsets[0])
    data, offsets = data[first : int(offsets[-1])], offsets - first
    folded = table[data]
    inside = folded != 0
    before = np.empty(len(data) + 1, bool)
    before[0] = before[-1] = False
    before[1:] = inside
    after = before[1:].copy()
    before = before[:-1].copy()
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[:-1] = inside[1:]
    after[-1:] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    hashes = None
    if hashed:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[folded] * _power(_BASE, len(data), "up"), out=total[1:])
        back = _power(_BASE_INVERSE, len(data) + 1, "down")
        hashes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
        hashes[hashes == 0] = 1
    return Words(starts, ends, text, bounds, hashes)


def count_words(column: pa.Array | pa.ChunkedArray, table: np.ndarray = SPACED) -> np.ndarray:
    """Number of words of each text."""
    offsets, data = text_buffers(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in slices(offsets):
        out[a:b] = np.diff(split(data, offsets[a : b + 1], table, hashed=False).bounds)
    return out


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``size`` words; a text with fewer words, but not none, is one run."""
    h, counts = words.hashes, np.diff(words.bounds)
    n = len(h) - size + 1
    if n > 0:
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = (out + h[k : k + n]) * _U(0xD6E8FEB86659FD93)
            out ^= out >> _U(32)
        whole = words.text[:n] == words.text[size - 1 :]
        out, text = mix(out[whole]), words.text[:n][whole]
    else:
        out, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for at, i in enumerate(short):
            acc = counts[i].astype(np.uint64)
            with np.errstate(over="ignore"):
                for x in h[words.bounds[i] : words.bounds[i + 1]]:
                    acc = (acc + x) * _U(0xA0761D6478BD642F)
                    acc ^= acc >> _U(29)
            extra[at] = acc
        out, text = np.concatenate([out, mix(extra)]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        out, text = out[order], text[order]
    return out, text
