"""64-bit token hashes and unsigned arithmetic on them.

Hashes are stored as BIGINT bit patterns; ``unsigned`` shows them and
``unsigned_mod`` routes by them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import url as ur

SEED = 0xC70F6907
_M = np.uint64(0xC6A4A7935BD1E995)
_R = np.uint64(47)


def murmur64a(column: pa.Array, seed: int = SEED) -> np.ndarray:
    """MurmurHash64A of each string's bytes, all strings at once: the i-th step takes the i-th eight bytes of those that have them."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    start, size = ends[:-1], np.diff(ends)
    h = np.uint64(seed) ^ (size.astype(np.uint64) * _M)
    byte = np.arange(8)
    blocks = size // 8
    for i in range(int(blocks.max(initial=0))):
        rows = np.flatnonzero(blocks > i)
        k = data[(start[rows] + 8 * i)[:, None] + byte].view("<u8").reshape(-1) * _M
        k = (k ^ (k >> _R)) * _M
        h[rows] = (h[rows] ^ k) * _M
    rest = size % 8
    rows = np.flatnonzero(rest)
    if len(rows):
        tail = data[(start[rows] + 8 * blocks[rows])[:, None] + byte]
        tail[byte[None, :] >= rest[rows][:, None]] = 0
        h[rows] = (h[rows] ^ tail.view("<u8").reshape(-1)) * _M
    h = (h ^ (h >> _R)) * _M
    return h ^ (h >> _R)


def token_hash(c: Column, seed: int = SEED) -> Column:
    """The hash as a BIGINT bit pattern; null for null."""

    @F.arrow_udf(T.LongType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array(murmur64a(column.fill_null(b""), seed).view(np.int64), mask=column.is_null().to_numpy(zero_copy_only=False))

    return run(c.cast("binary"))


def token_hashes(c: Column, seed: int = SEED) -> Column:
    """The hash of each string of an array."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        h = pa.array(murmur64a(flat.fill_null(""), seed).view(np.int64), mask=flat.is_null().to_numpy(zero_copy_only=False))
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), h, mask=column.is_null())

    return run(c)


def url_hash(url: Column) -> Column:
    """The key of a page: the hash of host, path and query."""
    return token_hash(ur.hash_input(url))


def host_hash(url: Column) -> Column:
    return token_hash(ur.host(url))


def link_hash(source_url: Column, target_url: Column) -> Column:
    """The key of a link from a host to a page; the link's text is no part of it."""
    return token_hash(ur.link_hash_input(ur.host(source_url), target_url))


def domain_link_hash(source_url: Column, target_url: Column) -> Column:
    """The key of a link from a host to a host."""
    return token_hash(ur.domain_link_hash_input(ur.host(source_url), ur.host(target_url)))


def unsigned(h: Column) -> Column:
    """The bit pattern as an unsigned number."""
    return F.conv(F.hex(h), 16, 10).cast("decimal(20,0)")


def unsigned_mod(h: Column, n: int) -> Column:
    """h modulo n with h taken as unsigned, in integers of 64 bits: (high half * 2**32 + low half) mod n."""
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    return (high % n * F.lit((1 << 32) % n) + low) % n


def unsigned_order(h: Column) -> Column:
    """A column whose signed order is the unsigned order of h."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))
