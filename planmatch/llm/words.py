"""Words of texts as 64-bit hashes, over whole Arrow batches at once, and small helpers for routing rows and blobs.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash adds a random number for each byte times an odd random
number for its place, then mixes: equal words have equal hashes, and different ones differ but for odds of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 4096
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_BYTES[~WORD_BYTE] = 0
_LOWER = _BYTES.copy()
_LOWER[0x41:0x5B] = _BYTES[0x61:0x7B]
#: Hash that stands for the end of a text; no word is given it on purpose.
END = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array, nulls as empty, and the offset of each text and of the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def word_spans(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each word, whether each byte begins one, and for each text the number of its first word."""
    inside = WORD_BYTE[body]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(body)]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    return starts, begins, np.searchsorted(starts, at)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and for each text the number of its first word (and the total)."""
    body, at = raw(texts)
    starts, begins, first = word_spans(body, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    place = np.arange(starts[0], len(body))
    place -= np.repeat(starts, np.diff(starts, append=len(body)))
    values = np.take(_LOWER if lower else _BYTES, body[starts[0] :])
    if (longest := int(place.max())) >= PLACES:
        values *= (2 * (place // PLACES) + 1).astype(np.uint64)
    values *= np.take(_PLACE, place, mode="wrap") if longest >= PLACES else np.take(_PLACE, place, mode="clip")
    return mix(np.add.reduceat(values, starts - starts[0])), first


def windows(hashes: np.ndarray, size: int, base: int = 0x100000001B3) -> np.ndarray:
    """Rabin-Karp hashes of every window of ``size`` consecutive items: a polynomial in an odd base modulo 2**64, then mixed."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(base)
        out += hashes[k : k + n]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batches' rows in parts of at most ``most`` bytes of ``column``, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def runs(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal neighbours, and the length of the array."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def prime(n: int) -> int:
    """Smallest prime that is at least n."""
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def route(key: Column, groups: int) -> Column:
    """Group of a long key, as route_np has it; groups: a prime."""
    return F.pmod(key.bitwiseXOR(F.shiftrightunsigned(key, 16)).bitwiseXOR(F.shiftrightunsigned(key, 33)), F.lit(groups)).cast("int")


def route_np(key: np.ndarray, groups: int) -> np.ndarray:
    u = key.astype(np.int64).view(np.uint64)
    return (u ^ (u >> np.uint64(16)) ^ (u >> np.uint64(33))).view(np.int64) % groups


def ordered(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by row, then value, of rows that are few: a sort by value, then a stable one by row, which for 16 bits is by radix."""
    first = np.argsort(value)
    return first[np.argsort(row[first].astype(np.uint16 if not len(row) or row.max() < 1 << 16 else np.int64), kind="stable")]


def blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
