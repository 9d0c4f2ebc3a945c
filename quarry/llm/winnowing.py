"""Document fingerprints by winnowing.

A document is reduced to its letters and digits in lower case.  Every k-gram of
these gets a 63-bit rolling hash; of every window of w consecutive hashes the
least is chosen, the rightmost of equals, and each chosen k-gram is kept once
with its position.  Hence (Schleimer, Wilkerson and Aiken) two documents that
share w + k - 1 letters and digits in a row share a fingerprint, and none is
shared by less than k, but for whole texts: one of fewer than k letters and
digits is a single gram (the hash of its letters with zeros up to k, which no
other text has), so that copies of short texts share it too.  With the default
K and W a shared passage of 79 letters and digits is always found.

Defined results, by row: a null or empty text, and one without letters or digits,
has no fingerprints; one of fewer than w k-grams forms a single window.  A very
long text is processed whole.  Of equal hashes in a window the rightmost is
chosen.  A repeated row is fingerprinted each time, and a null in any other
column changes nothing.  An empty table gives no rows.  Other columns are passed
by unless ``carry`` names them; their names may be any, also those used inside,
but a carried column must not be called pos or fp.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm import _shared, _text

K, W = 30, 50
#: Multiplier of the rolling hash, modulo 2**64.
B = 6364136223846793005


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """sum(values[i + j] * B**(k - 1 - j)) modulo 2**64, for each i; built by doubling."""
    power, size = values.astype(np.uint64), 1
    done, length = None, 0
    rest = k
    while True:
        if rest & 1:
            if done is None:
                done, length = power, size
            else:  # the part already built goes to the right of the new one
                n = len(values) - size - length + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                done = power[:n] * np.uint64(pow(B, length, 1 << 64)) + done[size : size + n]
                length += size
        rest >>= 1
        if not rest:
            return done
        n = len(values) - 2 * size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        power = power[:n] * np.uint64(pow(B, size, 1 << 64)) + power[size : size + n]
        size *= 2


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each i, the index of the rightmost least of h[i : i + w]."""
    at, size = np.arange(len(h)), 1
    while size * 2 <= w:
        a, b = at[:-size], at[size:]
        at = np.where(h[b] <= h[a], b, a)
        size *= 2
    if size < w:
        a, b = at[: len(h) - w + 1], at[w - size :]
        at = np.where(h[b] <= h[a], b, a)
    return at


def fingerprints(texts: list[str], k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position in it, hash) of all fingerprints, in this order."""
    cps, offsets = _text.code_points(texts)
    kind, fold = _text.class_tables()
    place = np.flatnonzero(kind[cps] & 3)
    edges = np.searchsorted(place, offsets)
    h = _text.mix64(rolling(fold[cps[place]], k)) >> np.uint64(1)
    chosen = np.zeros(len(h), bool)
    grams = np.diff(edges) - k + 1
    full = grams >= w
    if full.any():
        best = window_minima(h, w)
        inside = np.zeros(len(best) + 1, np.int64)  # windows that lie in one document
        np.add.at(inside, edges[:-1][full], 1)
        np.add.at(inside, edges[:-1][full] + grams[full] - w + 1, -1)
        chosen[best[np.cumsum(inside[:-1]) > 0]] = True
    for i in np.flatnonzero((grams > 0) & ~full):
        part = h[edges[i] : edges[i] + grams[i]]
        chosen[edges[i] + grams[i] - 1 - np.argmin(part[::-1])] = True
    at = np.flatnonzero(chosen)
    doc = np.searchsorted(edges, at, side="right") - 1
    found = h[at]
    short = np.flatnonzero((grams <= 0) & (np.diff(edges) > 0))
    if len(short):  # each whole text is one gram
        steps = np.array([pow(B, k - 1 - j, 1 << 64) for j in range(k - 1)], np.uint64)
        whole = [(fold[cps[place[a:b]]].astype(np.uint64) * steps[: b - a]).sum(dtype=np.uint64) for a, b in zip(edges[short].tolist(), edges[short + 1].tolist(), strict=True)]
        at, doc = np.concatenate([at, edges[short]]), np.concatenate([doc, short])
        found = np.concatenate([found, _text.mix64(np.array(whole, np.uint64)) >> np.uint64(1)])
        order = np.argsort(doc, kind="stable")
        at, doc, found = at[order], doc[order], found[order]
    return doc, place[at] - offsets[doc], found.astype(np.int64)


def winnow(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), k: int = K, w: int = W) -> DataFrame:
    """One row (carried columns, pos, fp) for each fingerprint; pos counts characters of the original text."""
    if k < 1 or w < 1:
        raise ValueError("k and w must be positive")
    kept = df.select(*carry, df[text].alias(_shared.fresh(list(carry), "__text")[0]))
    schema = T.StructType([kept.schema[c] for c in carry] + [T.StructField("pos", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text.strings(batch.column(len(carry)))
            for lo, hi in _text.slices(texts):
                doc, pos, fp = fingerprints(texts[lo:hi], k, w)
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(carry))), pa.array(pos), pa.array(fp)], names=schema.names)

    return kept.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return winnow(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """One running sum of terms value * B**-i gives all k-grams: that of a frame of K rows, times B**(i + K - 1)."""
    low = f"{(1 << 64) - 1}::UHUGEINT"
    power = lambda n: f"{pow(B, n, 1 << 64)}::UHUGEINT"
    table = lambda name, i, end, step: f"{name} AS (SELECT 0 AS {i}, 1::UHUGEINT AS {i}_up, 1::UHUGEINT AS {i}_down UNION ALL SELECT {i} + 1, ({i}_up * {power(step)}) & {low}, ({i}_down * {power(-step)}) & {low} FROM {name} WHERE {i} < {end})"
    return f"""WITH RECURSIVE chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents WHERE text <> ''),
kept AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, unicode(lower(c)) AS v FROM chars WHERE regexp_matches(c, '[\\p{{L}}\\p{{N}}]')),
{table("small", "a", 1023, 1)}, {table("large", "b", "(SELECT max(n) // 1024 FROM kept)", 1024)},
powers AS (SELECT b * 1024 + a AS i, (a_up * b_up) & {low} AS up, (a_down * b_down) & {low} AS down FROM small, large),
terms AS (SELECT doc_id, pos, i, n, up, ((v::UHUGEINT * down) & {low})::HUGEINT AS t FROM kept JOIN powers USING (i)),
sums AS (SELECT doc_id, pos, i, n, up, (sum(t) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING))::UHUGEINT & {low} AS s FROM terms),
grams AS (SELECT doc_id, pos, i, n, (((s * up) & {low}) * {power(K - 1)}) & {low} AS h FROM sums WHERE i <= greatest(n - {K}, 0)),
m1 AS (SELECT doc_id, pos, i, n, (xor(h, h >> 30) * {0xBF58476D1CE4E5B9}::UHUGEINT) & {low} AS h FROM grams),
m2 AS (SELECT doc_id, pos, i, n, (xor(h, h >> 27) * {0x94D049BB133111EB}::UHUGEINT) & {low} AS h FROM m1),
f AS (SELECT doc_id, pos::BIGINT AS pos, i, n, (xor(h, h >> 31) >> 1)::BIGINT AS fp FROM m2),
v AS (SELECT doc_id, i, n, min(fp::HUGEINT * 4294967296 + 4294967295 - i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS best FROM f),
b AS (SELECT DISTINCT doc_id, 4294967295 - (best % 4294967296)::BIGINT AS i FROM v WHERE i <= greatest(n - {K + W - 1}, 0))
SELECT doc_id, pos, fp FROM f SEMI JOIN b USING (doc_id, i)"""


SQL = _sql()
