"""Near deduplication: 256-bit SimHash fingerprints and the May-Ozerov nearest-neighbour recursion.

A document's features are its distinct pairs of neighbouring words (letters and
digits, lower case); a document of one word has that word.  Two fingerprints
are near at a Hamming distance of at most ``radius``; documents that a chain of
near fingerprints connects form a group, and the one with the least doc_id
stays.

Search over the distinct fingerprints, as May and Ozerov do it:

1. ``REPEATS`` times the coordinates are permuted.  On the first strip, a list
   is opened for each of many random centres and takes the fingerprints whose
   partial weight there (their distance from the centre on the strip) is low.
   Near fingerprints fall into the same list far more often than others.
2. Each list is split once more, by partial weights from random centres on the
   next strip.  All lists of a repeat share these centres, so a fingerprint's
   second-level centres are found once, where its lists are, and travel with it.
3. Small lists are compared by brute force, with no cap on partners; a list
   passes on a spanning star of each of its components only, so a group of n
   copies costs n edges and not n * n pairs.  A group that fills a small list is
   taken out of it by a pivot first (see ``compare``), which loses no pair.

A large group of near copies with fingerprints of their own would make some lists
as large as itself.  So the fingerprints within the radius of a hot pivot (one that
a HOT share of a bounded sample is near to) are joined to it at once, and in lists
only meet those of other groups or none, and only where the triangle inequality
lets them be near: a list of such a group is cut into blocks of at most LIST, each
with all it has to meet.  The sample chooses pivots and nothing else: any choice
gives the same groups.

``plan`` chooses limits and numbers of centres by the exact law of the whole
search: the places where a pair differs are split over a repeat's strips
hypergeometrically, all centres of a strip see the same split, and repeats are
independent.  A pair at the very radius is found with probability ``recall`` at
any number of fingerprints, and one at half of it five times as surely (0.99);
up to LEAF fingerprints are one list, compared whole.  Fixed seeds make a run repeatable.

Defined results: a null or empty text, or one without any word, has no
fingerprint and stays; a very long text counts whole.  Equal doc_ids are told apart
by their text; of identical rows one stays; null doc_ids come last in the order;
nulls in other columns change nothing.  Of equal counts of a bit the least
feature decides.  An empty table stays empty.  All columns of df are kept, and
may be named as those used inside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _shared, _text

BITS = 256
RADIUS = 56
RECALL = 0.95
REPEATS = 8
#: Coordinates of the two levels of a repeat.
STRIPS = (96, 96)
#: As many fingerprints are one list, compared whole.
LEAF = 256
#: First-level lists are planned to be smaller than this.
LIST = 4 << 20

#: Share of about SAMPLE fingerprints, those of least hash, that must be near a hot pivot; at most PIVOTS.
HOT, SAMPLE, PIVOTS = 1 / 64, 4096, 63

#: A byte's eight bits as the eight bytes of an integer.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


# --- fingerprints
def features(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct features, sorted by document."""
    start, end, doc = _text.words(cps, offsets)
    h = _text.segment_hash(_text.class_tables()[1][cps], start, end)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    alone = np.flatnonzero(count[doc] == 1)
    d = np.concatenate([doc[pair], doc[alone]])
    f = np.concatenate([_text.mix64(h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1]), h[alone]])
    order = np.lexsort((f, d))
    d, f = d[order], f[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
    return d[new], f[new]


def simhash(texts: list[str]) -> list[bytes | None]:
    """The fingerprint of each text; None where it has no word. Ties of a bit go by the least feature."""
    out: list[bytes | None] = [None] * len(texts)
    for lo, hi in _text.slices(texts):
        cps, offsets = _text.code_points(texts[lo:hi])
        doc, f = features(cps, offsets)
        if not len(f):
            continue
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        size = np.diff(np.append(first, len(doc)))
        cuts = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(first.tolist(), size.tolist(), strict=True)])
        bits = np.stack([_text.mix64(f + np.uint64((i + 1) * 0xD1342543DE82EF95 % (1 << 64))) for i in range(BITS // 64)], axis=1)
        packed = np.add.reduceat(_SPREAD[bits.view(np.uint8).reshape(len(f), BITS // 8)], cuts, axis=0)  # eight counts, of up to 255 each, in an integer
        ones = np.add.reduceat(packed.view(np.uint8).astype(np.int32), np.searchsorted(cuts, first), axis=0)
        tie = np.unpackbits(bits[first].view(np.uint8).reshape(len(first), BITS // 8), axis=1, bitorder="little")  # features are sorted: the first is the least
        final = np.packbits(2 * ones + tie > size[:, None], axis=1, bitorder="little")
        for d, row in zip(doc[first].tolist(), final, strict=True):
            out[lo + d] = row.tobytes()
    return out


def signatures(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, key, fp) for each row; key tells texts of one id apart."""
    kept = df.select(F.col(doc_id).alias("id"), F.xxhash64(df[text]).alias("key"), df[text].alias("text"))
    schema = T.StructType([kept.schema["id"], T.StructField("key", T.LongType()), T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array(simhash(_text.strings(b.column(2))), pa.binary())
            _text.release()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], names=schema.names)

    return kept.mapInArrow(run, schema)


# --- the plan of a search
@lru_cache(maxsize=1024)
def meeting(strip: int, limit: int) -> np.ndarray:
    """Probability that two vectors which differ in d places, d = 0 ... strip, both lie within ``limit`` of a random centre."""
    binom = lambda n: np.array([math.comb(n, k) for k in range(n + 1)], float) / 2.0**n
    out = np.zeros(strip + 1)
    for d in range(strip + 1):
        same = np.cumsum(binom(strip - d))
        left = limit - np.maximum(np.arange(d + 1), d - np.arange(d + 1))
        out[d] = (binom(d) * np.where(left >= 0, same[np.clip(left, 0, strip - d)], 0)).sum()
    return np.minimum(out, 1.0)


@lru_cache(maxsize=64)
def split_law(total: int, strip: int, most: int) -> np.ndarray:
    """(r, d): probability that d of r differing places out of ``total`` lie on the strip."""
    ways = lambda n, k: math.comb(n, k) if 0 <= k <= n else 0
    return np.array([[ways(r, d) * ways(total - r, strip - d) / math.comb(total, strip) for d in range(most + 1)] for r in range(most + 1)])


@dataclass(frozen=True)
class Plan:
    repeats: int
    limits: tuple[int, ...]
    centres: tuple[int, ...]

    def found(self, distance: int) -> float:
        """Exact probability that a pair at this distance shares a small list."""
        state, left = np.zeros(distance + 1), BITS
        state[distance] = 1.0
        for strip, limit, centres in zip(STRIPS, self.limits, self.centres, strict=True):
            p = np.zeros(distance + 1)
            known = meeting(strip, limit)[: distance + 1]
            p[: len(known)] = known
            with np.errstate(divide="ignore"):
                shares = -np.expm1(centres * np.log1p(-p))
            both = state[:, None] * split_law(left, strip, distance) * shares
            state = np.array([sum(both[r + d, d] for d in range(distance + 1 - r)) for r in range(distance + 1)])
            left -= strip
        return float(-np.expm1(self.repeats * np.log1p(-min(float(state.sum()), 1 - 1e-16))))

    def sizes(self, n: int) -> tuple[float, float, float, float]:
        """Expected, for n spread fingerprints: size of a list and of a small list, lists and small lists that a fingerprint is in."""
        q = [float(meeting(s, w)[0]) for s, w in zip(STRIPS, self.limits, strict=True)]
        rows = self.repeats * self.centres[0] * q[0]
        return n * q[0], n * q[0] * q[1], rows, rows * self.centres[1] * q[1]

    def cost(self, n: int) -> float:
        """Nanoseconds a fingerprint, about: tests of centres, rows shuffled, small lists opened, pairs compared."""
        _, leaf, rows, places = self.sizes(n)
        return self.repeats * sum(c * (0.06 * s + 1.5) for c, s in zip(self.centres, STRIPS, strict=True)) + 4000 * rows + places * (100 + 1e5 / leaf + 3 * leaf)


def _centres(limits: tuple[int, int], radius: int, recall: float) -> Plan:
    """The fewest centres, in proportion to how seldom a pair at the radius shares one, that give the recall there and a fifth of its misses at half the radius."""
    rare = [float((meeting(s, w)[: radius + 1] * split_law(BITS, s, radius)[radius, : s + 1]).sum()) for s, w in zip(STRIPS, limits, strict=True)]
    make = lambda k: Plan(REPEATS, limits, tuple(max(1, math.ceil(k / p)) for p in rare))
    enough = lambda one: one.found(radius) >= recall and one.found(radius // 2) >= 1 - (1 - recall) / 5
    low, high = 0.01, 4.0
    while not enough(make(high)):
        high *= 2
    for _ in range(8):
        middle = math.sqrt(low * high)
        low, high = (low, middle) if enough(make(middle)) else (middle, high)
    return make(high)


@lru_cache(maxsize=256)
def plan(n: int, radius: int = RADIUS, recall: float = RECALL) -> Plan:
    """The cheapest plan for n fingerprints of those that find a pair at the radius with probability ``recall``."""
    if n <= LEAF:
        return Plan(1, STRIPS, (1, 1))
    share = lambda strip, limit: float(meeting(strip, limit)[0])
    best = None
    for first in range(STRIPS[0] // 2, 0, -1):
        size = n * share(STRIPS[0], first)
        if size >= LIST:
            continue
        if size < LEAF / 4:
            break
        for goal in (150, 400):
            second = next((w for w in range(STRIPS[1] // 2, 0, -1) if size * share(STRIPS[1], w) <= goal), 1)
            one = _centres((first, second), radius, recall)
            if best is None or one.cost(n) < best.cost(n):
                best = one
        if best.cost(n) < STRIPS[0] * 0.06 * REPEATS * one.centres[0]:  # still tighter lists have too many centres
            break
    return best


def centres(repeat: int, level: int, count: int) -> np.ndarray:
    """The packed random centres of a repeat's strip."""
    width = STRIPS[level] // 8
    return np.frombuffer(np.random.default_rng((104729, repeat, level)).bytes(count * width), np.uint8).reshape(count, width)


def signs(packed: np.ndarray) -> np.ndarray:
    """Packed bits as -1 and 1."""
    return np.unpackbits(packed, axis=1, bitorder="little").astype(np.float32) * 2 - 1


def on_strip(fp: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    """The chosen bits of fingerprints as -1 and 1."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(len(fp), BITS // 8), axis=1, bitorder="little")
    return bits[:, coordinates].astype(np.float32) * 2 - 1


def within(x: np.ndarray, packed: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, centre) of all rows within the limit of a centre, by row; blocks of centres bound the memory."""
    least, rows, found = x.shape[1] - 2 * limit, [], []
    for a in range(0, len(packed), 2048):
        z = signs(packed[a : a + 2048])
        row, centre = np.divmod(np.flatnonzero(x @ z.T >= least), len(z))
        rows.append(row)
        found.append(centre + a)
    row, centre = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(row, kind="stable") if len(rows) > 1 else slice(None)
    return row[order], centre[order]


# --- inside a list
def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components (each labelled by its least member) of i and j, in place."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def join_near(x: np.ndarray, rows: np.ndarray, y: np.ndarray, others: np.ndarray | None, label: np.ndarray, radius: int) -> None:
    """Join all pairs of rows within the radius of others; without others, all pairs of rows."""
    same = others is None
    y, others = (x, rows) if same else (y, others)
    step = max(1, (1 << 19) // max(1, len(y)))
    for a in range(0, len(x), step):
        block, rest = x[a : a + step], y[a:] if same else y
        half = np.bitwise_count(block[:, None, 0] ^ rest[None, :, 0]) + np.bitwise_count(block[:, None, 1] ^ rest[None, :, 1])
        i, j = np.divmod(np.flatnonzero(half.ravel() <= radius), len(rest))  # half of the bits decide most pairs, and lose none
        if same:
            ahead = j > i
            i, j = i[ahead], j[ahead]
        if len(i):
            d = half[i, j].astype(np.int64) + np.bitwise_count(block[i, 2:] ^ rest[j, 2:]).sum(axis=1)
            near = d <= radius
            join_labels(label, rows[a + i[near]], others[(a if same else 0) + j[near]])


def compare(fp: np.ndarray, rows: np.ndarray, label: np.ndarray, radius: int, most: int = 2048) -> None:
    """Join all pairs of rows within the radius.

    A list above ``most`` may hold a large group of near copies, of which all
    pairs would be too many.  So while a pivot has a sixteenth of the rows within
    the radius, these are joined to it and taken out: pairs among them say nothing
    new, and of pairs with other rows only those are compared that the triangle
    inequality leaves.  What no pivot takes is compared whole.
    """
    while len(rows) > most:
        sample = fp[rows[:: len(rows) // 512]]
        trial = sample[:: len(sample) // 32]
        close = (np.bitwise_count(trial[:, None] ^ sample[None]).sum(axis=2, dtype=np.int64) <= radius).sum(axis=1)
        if close.max() * 16 < len(sample):
            break
        d = distances(fp[rows], trial[close.argmax()])
        taken = d <= radius
        mine, rest = rows[taken], rows[~taken]
        join_labels(label, mine, np.full(len(mine), mine[0]))
        reach = d[~taken] <= radius + d[taken].max()
        if reach.any():
            hit = d[taken] >= d[~taken][reach].min() - radius
            join_near(fp[mine[hit]], mine[hit], fp[rest[reach]], rest[reach], label, radius)
        rows = rest
    join_near(fp[rows], rows, fp[rows], None, label, radius)


def gather(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """(len(at), width) bytes of data from the given places on."""
    out = np.empty((len(at), width), np.uint8)
    for a in range(0, len(at), 1 << 16):
        out[a : a + (1 << 16)] = data[at[a : a + (1 << 16), None] + np.arange(width)]
    return out


def list_edges(x: np.ndarray, row: np.ndarray, centre: np.ndarray, radius: int, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) of the near components that the small lists of a list show; row ``row`` of x lies at second-level centre ``centre``.

    With ``right``, only pairs of a row of x that is marked there and one that is not.
    """
    label = np.arange(len(x))
    order = np.argsort(centre, kind="stable")
    row, centre = row[order], centre[order]
    cuts = np.flatnonzero(np.append(True, centre[1:] != centre[:-1])) if len(centre) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)], strict=bool(len(cuts))):
        if b - a > 1 and right is None:
            compare(x, row[a:b], label, radius)
        elif b - a > 1:
            side = right[row[a:b]]
            one, two = row[a:b][~side], row[a:b][side]
            if len(one) and len(two):
                join_near(x[one], one, x[two], two, label, radius)
    joined = np.flatnonzero(label != np.arange(len(x)))
    return joined, label[joined]


# --- over Spark
def permutation(repeat: int) -> np.ndarray:
    return np.random.default_rng(7919 + repeat).permutation(BITS)


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) distances."""
    return np.stack([distances(x, p) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0), np.int64)


def choose_pivots(x: np.ndarray, radius: int, share: float = HOT, most: int = PIVOTS) -> np.ndarray:
    """Fingerprints of the sample x that at least a share of it is near to and no chosen one before."""
    near = np.concatenate([np.bitwise_count(x[a : a + 64, None] ^ x[None]).sum(axis=2, dtype=np.int64) <= radius for a in range(0, len(x), 64)]) if len(x) else np.zeros((0, 0), bool)
    free, out = np.ones(len(x), bool), []
    while free.any() and len(out) < most:
        count = near[:, free].sum(axis=1)
        best = int(count.argmax())
        if count[best] < max(8, share * len(x)):
            break
        out.append(best)
        free &= ~near[best]
    return x[out]


@dataclass(frozen=True)
class Hot:
    """Hot pivots, with the number of fingerprints nearest to each within the radius, and the greatest distance of these."""

    pivots: np.ndarray
    counts: np.ndarray
    reach: np.ndarray
    blocks: np.ndarray

    def labels(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest pivot within the radius or -1, distances to all) of each row."""
        d = to_pivots(x, self.pivots)
        if not len(self.pivots):
            return np.full(len(x), -1), d
        best = d.argmin(axis=1)
        return np.where(d[np.arange(len(x)), best] <= radius, best, -1), d


def cell(group: int, block: np.ndarray | int, other: int, other_block: np.ndarray | int) -> np.ndarray | int:
    """The part of a list where a block of a hot group meets a block of another one, or (other -1) all that is in none; 0 is that by itself."""
    return (group + 1) << 46 | (other + 1) << 40 | block << 20 | other_block


def find_hot(distinct: DataFrame, n: int, radius: int, block: int = LIST) -> Hot:
    spark = distinct.sparkSession
    # Hashes are uniform: about SAMPLE rows of any n are below this one.
    below = (1 << 64) * min(n, SAMPLE) // max(n, 1) - (1 << 63)
    sample = distinct.select("fp").where(F.xxhash64("fp") <= F.lit(min(below, (1 << 63) - 1))).orderBy("fp").collect()
    pivots = choose_pivots(np.frombuffer(b"".join(bytes(r["fp"]) for r in sample), np.uint64).reshape(-1, BITS // 64), radius)
    k = len(pivots)
    none = Hot(pivots, np.zeros(k, np.int64), np.zeros(k, np.int64), np.ones(k, np.int64))
    if not k:
        return none
    shared = spark.sparkContext.broadcast(none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, d = shared.value.labels(unpacked(batch.column(0)), radius)
            mine = [d[label == h, h] for h in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array([len(v) for v in mine]), pa.array([int(v.max(initial=0)) for v in mine])], names=["h", "n", "far"])

    rows = distinct.select("fp").mapInArrow(run, "h long, n long, far long").groupBy("h").agg(F.sum("n").alias("n"), F.max("far").alias("far")).orderBy("h").collect()  # a row for each pivot
    counts = np.array([r["n"] for r in rows])
    return Hot(pivots, counts, np.array([r["far"] for r in rows]), np.maximum(1, -(-counts // block)))


def cells_of(label: np.ndarray, d: np.ndarray, lot: np.ndarray, hot: Hot, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray | int, bool]]:
    """(rows, their cells, whether on the right side) of all that rows with these labels and distances go to; lot is a random number of each row."""
    yield np.flatnonzero(label < 0), 0, False
    between = to_pivots(hot.pivots, hot.pivots)
    for h in range(len(hot.pivots)):
        mine = np.flatnonzero(label == h)
        block = lot[mine] % hot.blocks[h]
        within_reach = d[:, h] <= radius + hot.reach[h]
        for other in range(-1, h):
            if other >= 0 and between[h, other] > hot.reach[h] + hot.reach[other] + radius:
                continue
            theirs = np.flatnonzero((label == other) & within_reach)
            blocks = int(hot.blocks[other]) if other >= 0 else 1
            for b in range(blocks):
                yield mine, cell(h, block, other, b), False
            for b in range(int(hot.blocks[h])):
                yield theirs, cell(h, b, other, lot[theirs] % blocks), True


def near_edges(distinct: DataFrame, n: int, radius: int = RADIUS, recall: float = RECALL, hot_block: int = LIST) -> DataFrame:
    """(a, b) edges whose components are the groups of near fingerprints; distinct has a column fp, n rows."""
    chosen = plan(n, radius, recall)
    found = find_hot(distinct, n, radius, hot_block)
    shared = distinct.sparkSession.sparkContext.broadcast(found)
    kind = np.dtype("<u2" if chosen.centres[1] <= 1 << 16 else "<u4")
    width = BITS // 8

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        packed = [[centres(r, level, chosen.centres[level]) for level in range(2)] for r in range(chosen.repeats)]
        for batch in batches:
            x = unpacked(batch.column(0))
            for a in range(0, len(x), 2048):
                block = x[a : a + 2048]
                label, d = hot.labels(block, radius)
                lot = (_text.mix64(block[:, 0] ^ block[:, 3]) >> np.uint64(8)).astype(np.int64)
                for r in range(chosen.repeats):
                    at = permutation(r)
                    row, second = within(on_strip(block, at[STRIPS[0] : sum(STRIPS)]), packed[r][1], chosen.limits[1])
                    # The fingerprint, and its second-level centres behind it.
                    count = np.bincount(row, minlength=len(block))
                    ends = np.cumsum(width + kind.itemsize * count)
                    begin = ends - width - kind.itemsize * count
                    data = np.empty(int(ends[-1]), np.uint8)
                    data[begin[:, None] + np.arange(width)] = block.view(np.uint8).reshape(len(block), width)
                    place = np.repeat(begin + width - kind.itemsize * (np.cumsum(count) - count), count) + kind.itemsize * np.arange(len(row))
                    data[place[:, None] + np.arange(kind.itemsize)] = second.astype(kind).view(np.uint8).reshape(-1, kind.itemsize)
                    row, first = within(on_strip(block, at[: STRIPS[0]]), packed[r][0], chosen.limits[0])
                    some = count[row] > 0
                    row, first = row[some], first[some]
                    whole = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])
                    for rows, at_cell, right in cells_of(label[row], d[row], lot[row], hot, radius):
                        if len(rows):
                            cells = np.broadcast_to(at_cell, len(rows)).astype(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(first[rows] + r * chosen.centres[0], pa.int64()), pa.array(cells), pa.array(np.full(len(rows), right)), whole.take(pa.array(row[rows]))], names=["list", "cell", "right", "data"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [p.tobytes() for p in shared.value.pivots]
        for batch in batches:
            label, _ = shared.value.labels(unpacked(batch.column(0)), radius)
            at = np.flatnonzero(label >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([ends[h] for h in label[at].tolist()], pa.binary())], names=["a", "b"])

    def edges(key, table):
        column = table.column("data").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        x = gather(data, ends[:-1], width).view(np.uint64)
        order = np.lexsort(x.T)  # whatever the order of the rows, the same edges
        count = (np.diff(ends) - width) // kind.itemsize
        row = np.repeat(np.arange(len(x)), count)
        place = np.repeat(ends[:-1] + width - kind.itemsize * (np.cumsum(count) - count), count) + kind.itemsize * np.arange(len(row))
        second = gather(data, place, kind.itemsize).view(kind).reshape(-1)
        new = np.empty(len(x), np.int64)
        new[order] = np.arange(len(x))
        x = np.ascontiguousarray(x[order])
        right = table.column("right").to_numpy()[order] if key[1].as_py() else None
        i, j = list_edges(x, new[row], second, radius, right)
        out = pa.table({n: pa.array([x[k].tobytes() for k in at.tolist()], pa.binary()) for n, at in (("a", i), ("b", j))})
        _text.release()
        return out

    listed = distinct.select("fp").mapInArrow(lists, "list long, cell long, right boolean, data binary")
    out = listed.groupBy("list", "cell").applyInArrow(edges, "a binary, b binary").distinct()
    return out.unionByName(distinct.select("fp").mapInArrow(stars, "a binary, b binary").where("a <> b")) if len(found.pivots) else out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes but the roots: large-star and small-star steps until nothing changes."""
    spark = edges.sparkSession
    now, path = _shared.write_table(edges.select("a", "b").where("a <> b"), "edges")
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least2, "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least2.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old = path
        now, path = _shared.write_table(new, "edges")
        _shared.remove(spark, old)


def near_groups(signed: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """(id, key, group) of the rows with a fingerprint; signed must be a written table."""
    known = signed.where("fp IS NOT NULL")
    distinct, path = _shared.write_table(known.select("fp").distinct(), "fps")
    roots = components(near_edges(distinct, distinct.count(), radius, recall))
    _shared.remove(signed.sparkSession, path)
    return known.join(roots, known.fp == roots.node, "left").select("id", "key", F.coalesce("root", "fp").alias("group"))


def near_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """The rows of df that stay: of each group of near documents the one with the least doc_id."""
    signed, _ = _shared.write_table(signatures(df, text, doc_id), "signatures")
    order = Window.partitionBy("group").orderBy(F.col("id").asc_nulls_last(), "key")
    ranked = near_groups(signed, radius, recall).withColumn("place", F.dense_rank().over(order))
    removed, _ = _shared.write_table(ranked.where("place > 1").select("id", "key").distinct(), "removed")
    repeated, _ = _shared.write_table(ranked.where("place = 1").groupBy("id", "key").count().where("count > 1").select("id", "key"), "repeated")
    k, number = _shared.fresh(df.columns, "__key", "__n")
    keyed = df.withColumn(k, F.xxhash64(df[text]))
    same = lambda r: keyed[doc_id].eqNullSafe(r["id"]) & (keyed[k] == r["key"])
    # The removed rows grow with the input: both sides are shuffled, and only the narrow one is held in memory.
    kept = keyed.join(removed.hint("shuffle_hash"), same(removed), "left_anti")
    if not repeated.isEmpty():
        is_one = kept[doc_id].eqNullSafe(repeated["id"]) & (kept[k] == repeated["key"])
        rest = kept.join(repeated, is_one, "left_anti")
        one = kept.join(repeated, is_one, "left_semi")
        one = one.withColumn(number, F.row_number().over(Window.partitionBy(doc_id, k).orderBy(F.lit(1)))).where(F.col(number) == 1).drop(number)
        kept = rest.unionByName(one)
    return kept.select(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
