"""Vectorised text primitives shared by the corpus operators.

Everything here works on flat arrays of code points with document offsets, so a
batch of documents is processed by a fixed number of numpy calls whatever its
number of words.  Long documents are never cut: a batch holds at least one
whole document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled at once; bounds the working memory of a Python worker.
SLICE = 1 << 19

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_TABLES: dict = {}


def release() -> None:
    """Give freed memory back to the system: Python workers live on beside those of other stages, with all they once took."""
    pa.default_memory_pool().release_unused()
    if "trim" not in _TABLES:
        try:
            _TABLES["trim"] = ctypes.CDLL(None).malloc_trim
        except (AttributeError, OSError):  # another C library
            _TABLES["trim"] = None
    if _TABLES["trim"]:
        _TABLES["trim"](0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit arrays."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def class_tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, fold) by code point. Class bits: 1 letter, 2 number, 4 white space.

    ``fold`` lower-cases where the lower case is a single code point.
    """
    if "class" not in _TABLES:
        import regex

        whole = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        kind = np.zeros(0x110000, dtype=np.uint8)
        for bit, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+")):
            for m in regex.finditer(pattern, whole):
                lo, hi = (p if p < 0xD800 else p + 0x800 for p in (m.start(), m.end() - 1))
                kind[lo : hi + 1] = bit
        kind[0xD800:0xE000] = 0
        for lo, hi in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
            kind[lo : hi + 1] = 4
        fold = np.arange(0x110000, dtype=np.uint32)
        for m in regex.finditer(r"\p{Lu}|\p{Lt}", whole):
            low = m.group().lower()
            if len(low) == 1:
                fold[ord(m.group())] = ord(low)
        _TABLES["class"] = kind, fold
    return _TABLES["class"]


def powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _TABLES.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 1 << 22:
            _TABLES[int(base)] = have
    return have[0][:n], have[1][:n]


def segment_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each segment, independent of where it lies."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def unique(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting (numpy's own way by a hash table is many times slower on some integers)."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the len(texts)+1 offsets."""
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return cps, offsets


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of an Arrow column; null becomes the empty text."""
    return pc.fill_null(column, "").to_pylist()


def slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges that hold about ``most`` characters, and always a whole text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def words(cps: np.ndarray, offsets: np.ndarray, numbers: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of each maximal run of letters (and numbers)."""
    inside = (class_tables()[0][cps] & (3 if numbers else 1)) != 0
    edge = np.zeros(len(cps) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(cps), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(cps), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def by_document(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets into items sorted by document, for n documents."""
    return np.searchsorted(doc, np.arange(n + 1))


def pretokens(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start offsets of the pre-tokens of byte-level BPE's usual pattern.

    The pattern: contractions; an optional space and letters, numbers or other
    signs; white space up to its last sign before a word; other white space.
    Pre-tokens cover every code point and never cross a document's edge.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_tables()[0][cps]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    space = kind == 4
    prev = np.empty(n, np.uint8)
    prev[1:], prev[0] = kind[:-1], 255
    change = (kind != prev) | first
    # A run of white space before a word gives its last sign away: a blank joins the word, another sign stands alone.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    blank = cps == 32
    joins = last & blank
    start = change | last
    start[1:] &= ~joins[:-1] | first[1:]
    # Contractions are taken where a sign run starts with an apostrophe that no blank precedes.
    quote = np.flatnonzero((cps == 39) & start)
    if len(quote):
        end_of_doc = offsets[np.searchsorted(offsets, quote, side="right")]
        for i, stop in zip(quote.tolist(), end_of_doc.tolist(), strict=True):
            two = "".join(map(chr, cps[i + 1 : min(i + 3, stop)]))
            size = 2 if two[:1] in ("s", "t", "m", "d") and two else 3 if two in ("re", "ve", "ll") else 0
            if size:
                start[i + 1 : i + size] = False
                if i + size < stop:
                    if not start[i + size]:  # the rest of the same word begins a new pre-token
                        start[i + size] = True
    return np.flatnonzero(start)


class Chunk:
    """Texts as a list of distinct pre-tokens and, for each document, their numbers in order."""

    def __init__(self, texts: list[str]):
        first: list[np.ndarray] = []
        second: list[np.ndarray] = []
        self.counts = np.zeros(len(texts), np.int64)
        bounds: list[np.ndarray] = []
        places: list[tuple[int, int]] = []
        for lo, hi in slices(texts):
            cps, offsets = code_points(texts[lo:hi])
            start = pretokens(cps, offsets)
            end = np.append(start[1:], len(cps))[: len(start)]
            first.append(segment_hash(cps, start, end))
            second.append(segment_hash(cps, start, end, BASE2))
            self.counts[lo:hi] = np.diff(np.searchsorted(start, offsets))
            bounds.append(np.stack([start, end]))
            places.append((lo, hi))
        h = np.concatenate(first) if first else np.zeros(0, np.uint64)
        g = np.concatenate(second) if second else np.zeros(0, np.uint64)
        distinct, at, self.sequence = np.unique(h, return_index=True, return_inverse=True)
        if not np.array_equal(g[at][self.sequence], g):  # two words share a hash: number the pairs of hashes
            distinct, at, self.sequence = np.unique(np.stack([h, g], 1), axis=0, return_index=True, return_inverse=True)
        self.sequence = self.sequence.reshape(-1)
        self.words = [""] * len(at)
        edges = np.cumsum([0, *map(len, first)])
        order = np.argsort(at)
        for k, (lo, hi) in enumerate(places):
            mine = order[np.searchsorted(at[order], edges[k]) : np.searchsorted(at[order], edges[k + 1])]
            joined = "".join(texts[lo:hi])
            start, end = bounds[k][:, at[mine] - edges[k]]
            for i, s, e in zip(mine.tolist(), start.tolist(), end.tolist(), strict=True):
                self.words[i] = joined[s:e]

    def __len__(self) -> int:
        return len(self.words)


def expand(sequence: np.ndarray, sizes: np.ndarray, flat: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """flat's runs (of the given sizes; one after the other unless begin is given) in the order of sequence, and the size of each."""
    if begin is None:
        begin = np.cumsum(sizes) - sizes
    size = sizes[sequence]
    total = np.cumsum(size)
    n = int(total[-1]) if len(total) else 0
    shift = np.repeat(begin[sequence] - (total - size), size)
    return flat[shift + np.arange(n)], size
