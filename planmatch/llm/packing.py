"""Best-fit packing of tokenised documents into sequences, with certified partitions.

Documents are tokenised once and cut into pieces of at most the sequence length. Pieces are dealt evenly to partitions of bounded size, equal rows among them; each
packs its own by best-fit decreasing and compares its number of bins with the lower bound of dual feasible
functions. A partition that meets the bound is certified and done. The others keep their full bins and give the
pieces of all bins with room to the next round, where fewer partitions exchange and repack them, until one is left or the rounds are used up.

Defined results: null text counts as empty and is the end token alone; every row is a document, repeated ids included, and a null doc_id stays null; an empty
table gives an empty table; the file's added tokens (``<|endoftext|>``) are found in texts and have their own ids, as tokenizers does by default.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.storage import cut
from planmatch.llm.words import slices

LENGTH = 2048
END = 0


@functools.cache
def encoder(path: str):
    """Encoding, in tiktoken, of a byte-level BPE vocabulary in a tokenizers file: its ids are the ranks of its merges, and added tokens are cut out of texts before."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, added = whole["model"], {t["content"]: t["id"] for t in whole["added_tokens"]}
    if any(t[x] for t in whole["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token isn't taken literally")
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(printable)))}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token) and token not in added}
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(ranks[bytes(byte[c] for c in m.replace(" ", ""))] != 256 + i for i, m in enumerate(merged)):
        raise ValueError("ids aren't in the order of merges")
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str, length: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def go(batches):
        encode = functools.partial(encoder(tokenizer).encode, allowed_special="all")
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "")
                ids.append(END)
                data, n = np.array(ids, "<u4").tobytes(), len(ids)
                first = (n - 1) % length + 1 if n > length else n
                at = [0, *range(first, n + 1, length)]
                for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    rows.append((doc, i, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(go, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the room left in each bin. Bins are kept by room, with a bit set for each room in use."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, used = [], 0
    for i, n in zip((order := np.argsort(-lengths, kind="stable")).tolist(), lengths[order].tolist()):
        if fits := used >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                used &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            by_room[r - n].append(b)
            used |= 1 << (r - n)
    return bins, offsets, np.array(room, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins needed at least: the best of the dual feasible functions that, for a threshold up to half the capacity, drop
    lengths below it and round those above its complement up to a whole bin."""
    count = np.bincount(lengths, minlength=capacity + 1)
    tokens, many = np.cumsum(count * np.arange(capacity + 1)), np.cumsum(count)
    t = np.arange(capacity // 2 + 1)
    below = np.where(t > 0, tokens[np.maximum(t - 1, 0)], 0)
    large = many[capacity] - many[capacity - t]
    middle = tokens[capacity - t] - below
    return int((-(-middle // capacity) + large).max())


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def packer(length: int, turn: int, last: bool):
    """Packs one partition; ``done`` marks the bins that take no part in the next round."""

    def packed(key: tuple, part: pa.Table) -> pa.Table:
        part = part.select(COLUMNS).sort_by([(c, "ascending") for c in COLUMNS])
        sizes = part.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(sizes, length)
        certified = len(room) == lower_bound(sizes, length)
        done = np.ones(len(room), bool) if certified or last else room == 0
        own = {
            "sequence_id": pa.array((turn << 58) + (key[0].as_py() << 24) + bins), "offset": pa.array(offsets),
            "certified": pa.array(np.full(len(bins), certified)), "done": pa.array(done[bins]),
        }
        return pa.table({**{c: part.column(c) for c in COLUMNS}, **own})

    return packed


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, part: int = 1 << 15, rounds: int = 6) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified."""
    left = cut(pieces(docs, tokenizer or default_tokenizer(), length))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, certified boolean, done boolean"
    finished = []
    n = left.count()
    for turn in range(rounds):
        parts = max(1, -(-n // part))
        last = parts == 1 or turn == rounds - 1

        packed = packer(length, turn, last)
        # by place in the checkpoint, which a lost task reads again as it was: equal rows are dealt apart too
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), F.monotonically_increasing_id()), F.lit(parts)))
        result = dealt.groupBy("part").applyInArrow(packed, out)
        if last:
            finished.append(result)
            break
        result = cut(result)
        finished.append(result.filter("done"))
        left = result.filter("not done").select(*COLUMNS)
        n = left.count()
    whole = finished[0]
    for more in finished[1:]:
        whole = whole.unionByName(more)
    return whole.drop("done")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
