"""Removal of word windows that an earlier document has: Rabin-Karp hashes of every window of 13 words, counted over all documents.

Map side: each chunk of documents sorts its windows' hashes; where several of its documents have a window, all but the
smallest are decided there and then, so that a window in every document is sent once a chunk, not once a document.
What is sent goes by hash range to buckets, as packed arrays: documents by their distances, so that ids near to each other take little however few windows
a document has in a bucket. There are at most ``MOST_BUCKETS``, so that records don't become many and small as the input grows; a bucket with more than
``HELD`` windows is split by hash on the task's own disk. A bucket finds the smallest document of each
hash and tells every larger document that has it. The last step brings those hashes to the documents, merges
the repeated windows of each text into maximal intervals and removes the words inside.

Defined results: null text counts as empty; texts of fewer than 13 words lose nothing; rows with the same doc_id are one document for
"smaller", each judged on its own text; a null doc_id counts as larger than all others; an empty table gives an empty table.
No columns but the two named are read. Windows are compared by 64-bit hashes: among n windows about n * n / 2**65 pairs are taken as equal that are not.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.words import blob, mix, prime, raw, route, route_np, runs, slices, windows, word_hashes, word_spans

NO_ID = np.iinfo(np.int64).max
WINDOW = 13
#: Windows sorted at once by a task.
CHUNK = 1 << 21
#: Buckets at most: a chunk sends 64 windows to each.
MOST_BUCKETS = 1 << 15
#: Windows of a bucket that a task judges at once, and the parts that a larger one is split into.
HELD, SPLIT = 1 << 22, 64


def window_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of each window inside a text."""
    words, first = word_hashes(texts)
    h = windows(words, size)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)[: len(h)]
    fits = np.arange(len(h)) + size <= first[1:][row] if len(h) else np.zeros(0, bool)
    return h[fits], row[fits], np.flatnonzero(fits)


def packed(bucket: int, docs: np.ndarray, hashes: np.ndarray) -> tuple:
    """Hashes in order of document, and the documents and how many each has: distances and counts, compressed."""
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    at = runs(docs)
    own = docs[at[:-1]]
    return bucket, zlib.compress(blob(np.diff(own, prepend=np.int64(0))), 1), zlib.compress(blob(np.diff(at).astype(np.uint32)), 1), blob(hashes[order])


def unpacked(docs: bytes, counts: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.cumsum(np.frombuffer(zlib.decompress(docs), np.int64))
    return np.repeat(own, np.frombuffer(zlib.decompress(counts), np.uint32)), np.frombuffer(hashes, np.uint64)


def cropped(row: tuple) -> tuple:
    """A packed row of a bucket without the hashes' highest byte, which the bucket's number holds: at least 8 bits of it are theirs."""
    bucket, docs, counts, hashes = row
    return bucket, docs, counts, np.frombuffer(hashes, np.uint8).reshape(-1, 8)[:, :7].tobytes()


def restored(bucket: int, hashes: bytes, bits: int) -> bytes:
    low = np.frombuffer(hashes, np.uint8).reshape(-1, 7)
    out = np.full((len(low), 8), bucket >> (bits - 8), np.uint8)
    out[:, :7] = low
    return out.tobytes()


class Bucket:
    """The (document, hash) pairs of a bucket: in memory, or split by hash into files of this task where they are more than ``held``."""

    def __init__(self, bits: int, held: int):
        self.shift, self.most, self.parts, self.count, self.files = np.uint64(64 - bits), held, [], 0, []

    def add(self, docs: np.ndarray, hashes: np.ndarray) -> None:
        self.parts.append((docs, hashes))
        self.count += len(docs)
        if self.count > self.most:
            self.spill()

    def spill(self) -> None:
        self.files = self.files or [tempfile.TemporaryFile() for _ in range(SPLIT)]
        d, h = (np.concatenate(x) for x in zip(*self.parts))
        # bits behind the bucket's own
        part = ((h << (np.uint64(64) - self.shift)) >> np.uint64(64 - SPLIT.bit_length() + 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at = np.searchsorted(part[order], np.arange(SPLIT + 1))
        for k, file in enumerate(self.files):
            own = order[at[k] : at[k + 1]]
            file.write(np.stack([d[own].view(np.uint64), h[own]], 1).tobytes())
        self.parts, self.count = [], 0

    def __iter__(self):
        if not self.files:
            if self.parts:
                yield tuple(np.concatenate(x) for x in zip(*self.parts))
            return
        if self.parts:
            self.spill()
        for file in self.files:
            file.seek(0)
            pairs = np.frombuffer(file.read(), np.uint64).reshape(-1, 2)
            file.close()
            if len(pairs):
                yield np.ascontiguousarray(pairs[:, 0]).view(np.int64), np.ascontiguousarray(pairs[:, 1])


SENT = "bucket int, docs binary, counts binary, hashes binary"
_SENT = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def flush(rows: list[tuple], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), most):
        yield table(rows[k : k + most], schema)


def ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def repeated(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash and document; in that order, whether a smaller document has the hash, and whether the item repeats the one before."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    at = runs(h)
    least = np.repeat(d[at[:-1]], np.diff(at))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    return order, d > least, again


def removals(docs: DataFrame, window: int, buckets: int, groups: int, held: int = HELD) -> DataFrame:
    """Rows (g, docs, counts, hashes): the windows of each document that a smaller document has too, by the documents' group."""
    bits = buckets.bit_length() - 1
    shift = np.uint64(64 - bits)

    def told(d: np.ndarray, h: np.ndarray, kind: int) -> list[tuple]:
        """By group of the documents; bucket -1 - g marks what is decided already."""
        g = route_np(d, groups)
        order = np.argsort(g, kind="stable")
        at = runs(g[order])
        return [packed(int(g[order[i]]) if kind else -1 - int(g[order[i]]), d[order[i:j]], h[order[i:j]]) for i, j in zip(at[:-1], at[1:])]

    def send(batches):
        hs, ds, count = [], [], 0

        def chunk():
            h, d = np.concatenate(hs), np.concatenate(ds)
            order, later, again = repeated(h, d)
            h, d = h[order], d[order]
            gone, first = later & ~again, ~later & ~again
            rows = told(d[gone], h[gone], 0)
            h, d = h[first], d[first]
            key = (h >> shift).astype(np.int64)
            at = runs(key)
            rows += [cropped(packed(int(key[i]), d[i:j], h[i:j])) for i, j in zip(at[:-1], at[1:]) if j > i]
            return rows

        for batch in slices(batches, "text"):
            h, row, _ = window_hashes(batch.column("text"), window)
            hs.append(h)
            ds.append(ids(batch.column("doc_id"))[row])
            count += len(h)
            if count >= CHUNK:
                yield from flush(chunk(), _SENT)
                hs, ds, count = [], [], 0
        if count:
            yield from flush(chunk(), _SENT)

    def judge(batches):
        key, own = None, Bucket(bits, held)

        def end():
            for d, h in own:
                order, later, again = repeated(h, d)
                keep = order[later & ~again]
                yield from flush(told(d[keep], h[keep], 1), _SENT)

        for batch in batches:
            for bucket, d, c, h in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if bucket < 0:
                    yield table([(-1 - bucket, d, c, h)], _SENT)
                    continue
                if bucket != key:
                    yield from end()
                    key, own = bucket, Bucket(bits, held)
                own.add(*unpacked(d, c, restored(bucket, h, bits)))
        yield from end()

    sent = docs.mapInArrow(send, SENT)
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(judge, SENT)


def kept_words(body: np.ndarray, starts: np.ndarray, at: np.ndarray, keep: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each text its kept words, joined by one space."""
    data, out = body.tobytes(), []
    for i in range(len(first) - 1):
        a, b, end = first[i], first[i + 1], at[i + 1]
        cut = runs(keep[a:b]) + a
        # bytes.split() takes the same six bytes as white space
        parts = [data[starts[s] : starts[e] if e < b else end] for s, e in zip(cut[:-1], cut[1:]) if keep[s]]
        out.append(b" ".join(b" ".join(parts).split()))
    return out


#: Groups of documents, which are told apart by their numbers, at most; texts of a task, in which groups follow each other, and tasks at most.
MOST_GROUPS, TASK_BYTES, MOST_TASKS = 1 << 18, 128 << 20, 100_000


def remove_repeats(docs: DataFrame, window: int = WINDOW, bucket_windows: int = 1 << 20, held: int = HELD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of every row."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, 1 << max(8, int(size / 6 / bucket_windows).bit_length()))
    groups = prime(min(MOST_GROUPS, max(1, int(size / (4 << 20)))))
    tasks = max(1, min(groups, MOST_TASKS, max(-(-size // TASK_BYTES), 4 * docs.sparkSession.sparkContext.defaultParallelism)))
    gone = removals(docs, window, buckets, groups, held)
    none = F.lit(None).cast("binary")
    both = docs.select(
        route(F.coalesce("doc_id", F.lit(int(NO_ID))), groups).alias("g"), F.lit(1).alias("kind"), "doc_id", "text", none.alias("docs"), none.alias("counts"), none.alias("hashes")
    ).unionByName(gone.select(F.col("bucket").alias("g"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "docs", "counts", "hashes"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary())])

    def apply(batches):
        key, parts, marks = None, [], None
        for batch in slices(batches, "text"):
            kind, group = batch.column("kind").to_numpy(), batch.column("g").to_numpy()
            at = runs(group * 2 + kind)
            for i, j in zip(at[:-1], at[1:]):
                if group[i] != key:
                    key, parts, marks = group[i], [], None
                part = batch.slice(i, j - i)
                if kind[i] == 0:
                    for d, c, h in zip(*(part.column(k).to_pylist() for k in ("docs", "counts", "hashes"))):
                        d, h = unpacked(d, c, h)
                        parts.append(mix(d.view(np.uint64)) ^ h)
                    continue
                if marks is None:
                    marks = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                    parts = []
                texts, docs_ = part.column("text"), ids(part.column("doc_id"))
                h, row, first_word = window_hashes(texts, window)
                body, at_ = raw(texts)
                starts, _, first = word_spans(body, at_)
                keep = np.ones(len(starts), bool)
                if len(h) and len(marks):
                    own = mix(docs_[row].view(np.uint64)) ^ h
                    spot = np.searchsorted(marks, own)
                    hit = first_word[marks[np.minimum(spot, len(marks) - 1)] == own]
                    cover = np.bincount(hit, minlength=len(starts) + 1) - np.bincount(hit + window, minlength=len(starts) + 1)[: len(starts) + 1]
                    keep = np.cumsum(cover)[: len(starts)] == 0
                n = np.diff(first)
                kept = np.add.reduceat(np.append(keep, False).astype(np.int64), first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)
                kept[n == 0] = 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - kept, pa.int64()), pa.array(kept_words(body, starts, at_, keep, first), pa.binary())], schema=schema
                )

    return both.repartition(tasks, "g").sortWithinPartitions("g", "kind").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_text binary")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same by plain words and a dictionary, for small tables."""
    split = [(d, (t or "").encode().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ")) for d, t in rows]
    split = [(d, [w for w in ws if w]) for d, ws in split]
    least: dict = {}
    rank = lambda d: NO_ID if d is None else d
    for d, ws in split:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            least[k] = min(least.get(k, NO_ID), rank(d))
    out = []
    for d, ws in split:
        gone = {j for i in range(len(ws) - window + 1) if least[tuple(ws[i : i + window])] < rank(d) for j in range(i, i + window)}
        out.append((d, len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()))
    return out


SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, array_to_string(w[i + 1:i + 13], ' ') as s from (select doc_id, w, unnest(range(len(w) - 12)) as i from w where len(w) >= 13)),
least as (select s, min(doc_id) as first from win group by s having count(distinct doc_id) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from win join least using (s) where doc_id > first),
word as (select doc_id, i - 1 as i, w[i] as x from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w)),
kept as (select word.doc_id, string_agg(x, ' ' order by word.i) as t, count(*) as n from word left join gone on word.doc_id = gone.doc_id and word.i = gone.i
    where gone.i is null group by word.doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
"""
