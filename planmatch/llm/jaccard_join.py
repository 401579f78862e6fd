"""Exact Jaccard join of documents on word shingles, with skipping by set relations.

1. Equal sets form a class by digest; only one set of a class goes on.
2. Shingles are ordered by how often their hash cell occurs in all documents (a sketch of bounded size, rarest first), then by hash. Two
   sets that link share a shingle among the first |x| - ceil(t |x|) + 1 of each. Those go to index lists, packed by hash range. A list goes by the first
   48 bits of the hash: shingles that have these in common share a list, which adds candidates and loses none, as a set keeps its earliest place there.
3. A list is sorted by set size and cut into blocks, each ending where sets grow too large to link with its first. The pivot of a block is the set
   in which the shingle stands earliest: it has the fewest rare shingles of its own. Every set is compared with its blocks' pivots only, unless size or
   position in the order already rule the pair out. A list that the sketch says is long is split over tasks by set; each part has its own pivots, and these
   make a list in turn.
4. Links join sets to components. Then only pairs across components are left: lists within one component are skipped
   whole, and of the other pairs those are skipped whose overlap with a common pivot, known by now, decides them either way:
   |x & p| + |y & p| - |p| <= |x & y| <= min(|x & p|, |y & p|) + min(|x| - |x & p|, |y| - |y & p|). The rest is compared: a few pairs of any
   two components first, then all that these haven't joined. Long lists are compared in pairs of parts, a task each.

Every pair of different sets that links is compared, decided by a bound, or inside a component already: the classes and components are
exact, but for 64-bit hashes, which stand for shingles and sets. What a task gets is bounded by ``bucket_entries`` and ``list_part``, not by how often
a shingle, set or component occurs.

Defined results: null text counts as empty; a text without words has an empty set and links with nothing; rows are told apart by their texts, so
that equal rows, or texts with equal sets, are one class; a null doc_id takes part and is the largest; ``similar`` reads no columns but the two named, and
``one_of_each`` passes all on, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planmatch.llm.components import connected
from planmatch.llm.names import unused
from planmatch.llm.skew import MOST_KEYS, spread_join
from planmatch.llm.storage import cut_for_joins as cut
from planmatch.llm.substring_dedup import NO_ID, ids
from planmatch.llm.words import mix, ordered, runs, slices, windows, word_hashes

SHINGLE = 5
PERCENT = 75


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    words, first = word_hashes(texts, lower=True)
    n = np.diff(first)
    h = windows(words, size)
    row = np.repeat(np.arange(len(n)), n)[: len(h)]
    fits = np.arange(len(h)) + size <= first[1:][row] if len(h) else np.zeros(0, bool)
    few = np.flatnonzero((n > 0) & (n < size))
    short = np.zeros(len(few), np.uint64)
    for i, r in enumerate(few):  # fewer words than a shingle has
        for w in words[first[r] : first[r + 1]]:
            short[i : i + 1] = mix(short[i : i + 1] * np.uint64(31) + w + np.uint64(n[r]))
    h, row = np.concatenate([h[fits], short]), np.concatenate([row[fits], few])
    order = ordered(row, h)
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def digests(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set; 0 for empty ones."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
    n = np.diff(at)
    out = mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return np.where(n > 0, out | np.uint64(1), np.uint64(0)).view(np.int64)


def needed(n, m, percent: int):
    """Smallest overlap at which sets of n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n, percent: int):
    return n - -(-percent * n // 100) + 1


SCAN = "cells int, salt int, data binary, docs binary, keys binary, sizes binary, nodes binary"
ENTRY = "token long, node long, size int, pos int"
#: Tasks' tables are added up in so many parts first, at most.
ADDERS = 64


def added(parts: DataFrame, add: Callable, last: Callable | None = None) -> list:
    """cells, data of each part of a table of bounded size, added up over all tasks in two steps, the second by ``last``."""
    once = lambda rows, join, *keys: rows.groupBy(*keys).applyInArrow(lambda t: pa.table({"cells": t.column("cells").slice(0, 1), "data": pa.array([join(t.column("data").to_pylist())], pa.binary())}), "cells int, data binary")
    return once(once(parts, add, "cells", "salt"), last or add, "cells").collect()


def adder(adders: int = ADDERS) -> int:
    return TaskContext.get().partitionId() % adders


def planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: those that are zero nearly everywhere cost next to nothing once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def numbers(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def packed(counts: np.ndarray) -> bytes:
    """Counts of few bits each in about as many: planes up to the highest one in use, by runs and frequency."""
    used = max(1, -(-int(counts.max()).bit_length() // 8))
    code = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, 9, zlib.Z_RLE)
    return code.compress(planes(counts)[: used * len(counts)]) + code.flush()


def total(parts: list[bytes], cells: int) -> np.ndarray:
    """The sum of packed counts of ``cells`` cells."""
    out = np.zeros(cells, np.uint64)
    for x in parts:
        out += numbers(zlib.decompress(x).ljust(8 * cells, b"\0"), np.uint64)
    return out


def scan(docs: DataFrame, size: int, bits: int, adders: int = ADDERS) -> DataFrame:
    """Of each task: ids, set sizes and digests of its documents in parts, and how often each cell of hashes occurs."""
    schema = pa.schema([("cells", pa.int32()), ("salt", pa.int32()), ("data", pa.binary()), ("docs", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("nodes", pa.binary())])

    def go(batches):
        cells = np.zeros(1 << bits, np.uint64)
        for batch in slices(batches, "text"):
            h, at = shingle_sets(batch.column("text"), size)
            np.add.at(cells, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.int32()), pa.array([None], pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids(batch.column("doc_id")), batch.column("key").to_numpy(), np.diff(at).astype(np.int64), digests(h, at)))], schema=schema)
        parts = np.split(cells, max(1, 1 << (bits - 16)))
        for k, part in enumerate(parts):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([adder(adders)], pa.int32()), pa.array([packed(part)], pa.binary()), *(pa.array([None], pa.binary()) for _ in range(4))], schema=schema)

    return docs.mapInArrow(go, SCAN)


def sketch(scanned: DataFrame, bits: int) -> np.ndarray:
    """A byte for each cell: about four times the logarithm of how often it occurs. 2**bits bytes, whatever the data."""
    part = min(1 << bits, 1 << 16)
    level = lambda x: zlib.compress(np.minimum(4 * np.log2(total(x, part) + 1.0), 255).astype(np.uint8).tobytes(), 1)
    out = np.zeros((max(1, 1 << (bits - 16)), part), np.uint8)
    for r in added(scanned.filter("cells is not null").select("cells", "salt", "data"), lambda x: packed(total(x, part)), level):
        out[r["cells"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return out.reshape(-1)


def unpacked(scanned: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, node of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])

    def go(batches):
        for batch in batches:
            for d, k, s, n in zip(*(batch.column(c).to_pylist() for c in ("docs", "keys", "sizes", "nodes"))):
                doc, node = np.frombuffer(d, np.int64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_ID), pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(s, np.int64)), pa.array(node, mask=node == 0)], schema=schema)

    return scanned.filter("cells is null").select("docs", "keys", "sizes", "nodes").mapInArrow(go, "doc_id long, key long, n_shingles long, node long")


def index_lists(docs: DataFrame, size: int, percent: int, levels, bits: int, bucket_bits: int, bucket_entries: int) -> DataFrame:
    """(bucket, part, tokens, nodes, sizes, places): the prefix entries of each set, once a task. ``part`` is -1 but in cells of the sketch that hold
    more than ``bucket_entries``: their sets are dealt over as many parts as they fill. Tokens lose their last 16 bits."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("tokens", "nodes", "sizes", "places"))])

    def go(batches):
        seen: set[int] = set()
        held, count = [], 0

        def out():
            token, node, n, pos = (np.concatenate(x) for x in zip(*held))
            bucket = (token >> np.uint64(64 - bucket_bits)).astype(np.int64)
            parts = np.ceil(2 ** (levels.value[(token >> np.uint64(64 - bits)).astype(np.int64)] / 4) / bucket_entries).astype(np.int64)
            own = np.where(parts > 1, (mix(node.view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), -1)
            order = np.lexsort((own, bucket))
            at = runs((bucket[order] << 32) + own[order])
            for i, j in zip(at[:-1], at[1:]):
                o = order[i:j]
                yield pa.RecordBatch.from_arrays([pa.array([bucket[o[0]]], pa.int32()), pa.array([own[o[0]]], pa.int32()), pa.array([planes(token[o])[2 * len(o) :]], pa.binary()), pa.array([node[o].tobytes()], pa.binary()), *(pa.array([planes(x[o])], pa.binary()) for x in (n, pos))], schema=schema)

        for batch in slices(batches, "text"):
            h, at = shingle_sets(batch.column("text"), size)
            node, n = digests(h, at), np.diff(at)
            fresh = np.zeros(len(n), bool)
            for i, x in enumerate(node.tolist()):
                if x and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            row = np.repeat(np.arange(len(n)), n)
            # sorted by text and hash already: stable sorts by level, then text, keep the hashes in order
            order = np.argsort(levels.value[(h >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
            order = order[np.argsort(row[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
            pos = np.arange(len(h)) - at[row]
            keep = (pos < prefix(n, percent)[row]) & fresh[row]
            held.append((h[order][keep], node[row][keep], n[row][keep].astype(np.int32), pos[keep].astype(np.int32)))
            count += int(keep.sum())
            if count > 1 << 20:
                yield from out()
                held, count = [], 0
        if held:
            yield from out()

    return docs.mapInArrow(go, "bucket int, part int, tokens binary, nodes binary, sizes binary, places binary")


def possible(n, i, m, j, percent: int):
    """Whether sets of n and m whose first common shingle is at places i and j can still link."""
    return (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & (1 + np.minimum(n - i - 1, m - j - 1) >= needed(n, m, percent))


def pivoted(token: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int, split: bool) -> pa.Table:
    """The entries of lists that more than one set is in, each with its block's pivot, null where the pair is ruled out or the entry is the pivot.
    Of parts of lists, entries that are alone are kept, as their list has others."""
    order = np.lexsort((pos, node, n, token))
    token, node, n, pos = token[order], node[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, n, pos = token[new], node[new], n[new], pos[new]
    at = runs(token)
    many = np.repeat(np.diff(at) > 1, np.diff(at)) | split
    token, node, n, pos = token[many], node[many], n[many], pos[many]
    at = runs(token)
    first = np.repeat(at[:-1], np.diff(at))
    pivot = first.copy()
    while len(over := np.flatnonzero(n * percent > 100 * n[pivot])):
        # the first entry of each list that its block can't hold begins the next block
        begin = np.full(len(token), len(token))
        np.minimum.at(begin, pivot[over], over)
        pivot[over] = begin[pivot[over]]
    # any two of a block may link; the one with the fewest rarer shingles of its own is the likeliest centre of the others
    block = pivot
    best = np.lexsort((node, n, pos, block))
    pivot = best[np.searchsorted(block[best], block)]
    ok = possible(n, pos, n[pivot], pos[pivot], percent) & (pivot != np.arange(len(n)))
    return pa.table(
        {
            "token": pa.array(token.view(np.int64)), "node": pa.array(node), "size": pa.array(n.astype(np.int32)), "pos": pa.array(pos.astype(np.int32)),
            "pivot": pa.array(node[pivot], mask=~ok), "pivot_size": pa.array(n[pivot].astype(np.int32)), "leads": pa.array((pivot == np.arange(len(n))) & split),
        }
    )


PIVOTED = ENTRY + ", pivot long, pivot_size int, leads boolean"


def live(lists: DataFrame, percent: int) -> DataFrame:
    """Entries with their pivots; ``leads`` marks the pivots of parts of lists."""

    def go(key: tuple, part: pa.Table) -> pa.Table:
        column = lambda c, read: np.concatenate([read(x) for x in part.column(c).to_pylist()])
        token = column("tokens", lambda x: numbers(bytes(len(x) // 3) + x, np.uint64))
        node = column("nodes", lambda x: np.frombuffer(x, np.int64))
        n, pos = (column(c, lambda x: numbers(x, np.int32)) for c in ("sizes", "places"))
        split = key[1].as_py() >= 0
        if not split:  # nearly all shingles have one set: leave these out before the long sort
            rank = np.argsort(token, kind="stable")
            t = token[rank]
            several = np.zeros(len(t), bool)
            several[1:] = t[1:] == t[:-1]
            several[:-1] |= several[1:]
            rank = rank[several]
            token, node, n, pos = token[rank], node[rank], n[rank], pos[rank]
        return pivoted(token, node, n, pos, percent, split)

    return lists.groupBy("bucket", "part").applyInArrow(go, PIVOTED)


def among_pivots(entries: DataFrame, percent: int, tasks: int) -> DataFrame:
    """The pivots of parts of lists as lists of their own, with pivots in turn."""

    def go(part: pa.Table) -> pa.Table:
        return pivoted(part.column("token").to_numpy().view(np.uint64), *(part.column(c).to_numpy() for c in ("node", "size", "pos")), percent, False)

    group = F.pmod(F.xxhash64("token"), F.lit(tasks)).alias("group")
    return entries.filter("leads").select("token", "node", "size", "pos", group).groupBy("group").applyInArrow(go, PIVOTED)


def across(entries: DataFrame, percent: int, tasks: int, list_part: int) -> DataFrame:
    """a, a_size, b, b_size: pairs of sets of different components in a list that are not ruled out. ``entries`` have root, and count, the length of their
    list. Lists longer than ``list_part`` are cut into parts by set; each pair of parts is a group of its own."""

    def go(key: tuple, part: pa.Table) -> pa.Table:
        token, node, n, pos, root, own = (part.column(c).to_numpy().astype(np.int64) for c in ("token", "node", "size", "pos", "root", "own"))
        order = np.lexsort((node, n, token))
        token, node, n, pos, root, own = token[order], node[order], n[order], pos[order], root[order], own[order]
        found = [np.zeros((0, 4), np.int64)]
        apart = key[1].as_py() != key[2].as_py()
        i, k, held = np.arange(len(token)), 1, 0
        while len(i):
            i = i[i + k < len(token)]
            j = i + k
            on = (token[i] == token[j]) & (n[i] * 100 >= percent * n[j])
            i, j = i[on], j[on]  # sizes only grow: an entry that is out stays out
            hit = (root[i] != root[j]) & possible(n[i], pos[i], n[j], pos[j], percent)
            if apart:
                hit &= own[i] != own[j]
            a, b = i[hit], j[hit]
            swap = node[a] > node[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            found.append(np.stack([node[a], n[a], node[b], n[b]], 1))
            held += len(a)
            if held > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = 0
            k += 1
        rows = np.unique(np.concatenate(found), axis=0)
        return pa.table({c: pa.array(rows[:, x]) for x, c in enumerate(("a", "a_size", "b", "b_size"))})

    parts = F.ceil(F.col("count") / list_part).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    # a list of one part shares its group with others; a pair of parts of a long one has a group to itself
    group = F.when(F.col("count") > list_part, F.col("token")).otherwise(F.pmod(F.xxhash64("token"), F.lit(tasks)))
    dealt = entries.select("token", "node", "size", "pos", "root", group.alias("group"), own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    cells = dealt.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return cells.groupBy("group", "low", "high").applyInArrow(go, "a long, a_size long, b long, b_size long").distinct()


def cell_of(nodes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(nodes.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def bloom(nodes: DataFrame, bits: int) -> np.ndarray:
    """Which cells of 2**bits the nodes fall in, a bit each."""
    part = min(1 << (bits - 3), 1 << 16)

    def go(batches):
        cells = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = cell_of(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(cells, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k, own in enumerate(cells.reshape(-1, part)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([adder()], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["cells", "salt", "data"])

    def join(parts: list[bytes]) -> bytes:
        return zlib.compress(np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in parts]).tobytes(), 1)

    out = np.zeros((1 << (bits - 3)) // part * part, np.uint8).reshape(-1, part)
    for r in added(nodes.mapInArrow(go, "cells int, salt int, data binary"), join):
        out[r["cells"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return out.reshape(-1)


#: A filter has at most 2**29 cells, 64 MB, and at least 64 for each node up to there; beyond, it lets more sets through, and none less.
FILTER_BITS = 29


def sets_of(docs: DataFrame, size: int, nodes: DataFrame, count: int) -> DataFrame:
    """node, set of each of ``nodes``, of which there are ``count`` at most; a filter of bounded size keeps nearly all other texts' sets from being sent."""
    bits = min(FILTER_BITS, max(16, (64 * count).bit_length()))
    cells = docs.sparkSession.sparkContext.broadcast(bloom(nodes, bits))
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def go(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            h, at = shingle_sets(batch.column("text"), size)
            node = digests(h, at)
            at_cell = cell_of(node, bits)
            hit = np.flatnonzero((cells.value[at_cell >> 3] >> (at_cell & 7).astype(np.uint8) & 1).astype(bool) & (node != 0))
            rows = []
            for i in hit.tolist():
                if (x := int(node[i])) not in seen:
                    seen.add(x)
                    rows.append((x, h[at[i] : at[i + 1]].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.mapInArrow(go, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


#: Pairs of a set from which it is sent to several tasks.
HUB = 256


def overlaps(pairs: DataFrame, sets: DataFrame, hub_sets: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``pairs`` (a, a_size, b, b_size), a table that has been written, with the size of their sets' intersection.

    A set lies where its node is dealt; pairs go there, take it along to their other end, and are compared. A set of many pairs, a pivot's, is sent to the salts of its
    pairs instead, and only such sets, which ``hub_sets`` gives (for nodes, and how many they are at most), are sent again. It is the pair's other end, so that the pair takes along the other set.
    """
    each = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("pairs"))
    n = pairs.count()
    limit = max(HUB, -(-2 * n // MOST_KEYS))
    hubs = cut(each.filter(F.col("pairs") > limit))
    many = hubs.count()
    own = lambda table, end: table.select(F.col("node").alias(end), F.col("set").alias(f"{end}_set"))
    if not many:
        with_sets = pairs.join(own(sets, "a"), "a").join(own(sets, "b"), "b")
    else:
        held = cut(hub_sets(hubs.select("node"), many))
        # at most MOST_KEYS rows
        hub = lambda end: F.broadcast(hubs.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_hub")))
        marked = pairs.join(hub("a"), "a", "left").join(hub("b"), "b", "left")
        swap = F.col("a_hub").isNotNull() & F.col("b_hub").isNull()
        turned = marked.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("a_size", "b_size"), ("b", "a"), ("b_size", "a_size"), ("a_hub", "b_hub"), ("b_hub", "a_hub"))])
        hot = lambda rows, end: spread_join(rows, own(held, end), end, rows=2 * n, least=HUB)
        far = turned.filter("a_hub is null").join(own(sets, "a"), "a")
        both = hot(turned.filter("a_hub is not null"), "a")
        to_hub = far.filter("b_hub is not null").unionByName(both)
        # the pairs themselves tell how often a hub is met: they are small, and the sets on their way aren't made twice to be counted
        to_hub = spread_join(to_hub, own(held, "b"), "b", rows=2 * n, least=HUB, counted=turned.filter("b_hub is not null"))
        with_sets = far.filter("b_hub is null").join(own(sets, "b"), "b").unionByName(to_hub)
    names = ["a", "a_size", "b", "b_size"]

    def go(batches):
        for batch in batches:
            count = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(pa.int64()) for c in names), pa.array(count, pa.int64())], names=[*names, "overlap"])

    found = with_sets.select(*names, "a_set", "b_set").mapInArrow(go, "a long, a_size long, b long, b_size long, overlap long")
    turn = F.col("a") > F.col("b")
    return found.select(*[F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("a_size", "b_size"), ("b", "a"), ("b_size", "a_size"))], "overlap")


def undecided(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``pairs`` without those that a common pivot rules out; ``sure`` marks those it links. Of its pivots a set takes the one it shares most with."""
    both = known.select("a", "b", "overlap", F.col("b_size").alias("p_size")).unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap", F.col("a_size").alias("p_size")))
    own = both.groupBy("a").agg(F.max_by(F.struct("b", "overlap", "p_size"), F.struct("overlap", "b")).alias("p")).select("a", F.col("p.b").alias("pivot"), F.col("p.overlap").alias("ap"), F.col("p.p_size").alias("p_size"))
    bounded = pairs.join(own, "a", "left").join(both.select(F.col("a").alias("b"), F.col("b").alias("pivot"), F.col("overlap").alias("bp")), ["b", "pivot"], "left")
    need = F.ceil(percent * (F.col("a_size") + F.col("b_size")) / (100 + percent))
    most = F.least("ap", "bp") + F.least(F.col("a_size") - F.col("ap"), F.col("b_size") - F.col("bp"))
    known_all = F.col("ap").isNotNull() & F.col("bp").isNotNull()
    bounded = bounded.filter(~known_all | (most >= need))
    return bounded.select("a", "a_size", "b", "b_size", F.coalesce(F.col("ap") + F.col("bp") - F.col("p_size") >= need, F.lit(False)).alias("sure"))


def separate(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` whose ends are in different components so far, with these as ra < rb."""
    found = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    found = found.withColumn("x", F.coalesce("x", "a")).withColumn("y", F.coalesce("y", "b")).filter("x <> y")
    return found.select(*pairs.columns, F.least("x", "y").alias("ra"), F.greatest("x", "y").alias("rb"))


def similar(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, cell_bits: int = 24, bucket_entries: int = 1 << 19, list_part: int = 1 << 14, tries: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, class_id (smallest doc_id with an equal set), component_id, first of every row.

    ``key`` tells rows of one doc_id apart by their text; ``first`` marks the smallest (doc_id, key) of each component.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    spark = docs.sparkSession
    bytes_ = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shingles = max(1, int(bytes_ / 6))
    bits = int(min(cell_bits, max(16, (shingles // 32).bit_length())))
    # as many as each then adds up, if a task reads 16 MB of text
    adders = min(ADDERS, max(1, math.isqrt(bytes_ >> 24)))
    scanned = cut(scan(docs, size, bits, adders))
    rows = unpacked(scanned)
    levels = spark.sparkContext.broadcast(sketch(scanned, bits))
    buckets = max(1, (shingles // 4 // bucket_entries)).bit_length()
    tasks = 1 << buckets
    entries = cut(live(index_lists(docs, size, percent, levels, bits, buckets, bucket_entries), percent))

    pivots = entries.unionByName(among_pivots(entries, percent, tasks)).filter("pivot is not null")
    swap = F.col("node") < F.col("pivot")
    ordered_pair = [F.least("node", "pivot").alias("a"), F.when(swap, F.col("size")).otherwise(F.col("pivot_size")).cast("long").alias("a_size"), F.greatest("node", "pivot").alias("b"), F.when(swap, F.col("pivot_size")).otherwise(F.col("size")).cast("long").alias("b_size")]
    first = cut(pivots.select(*ordered_pair).distinct())
    n_first = first.count()
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    known = cut(overlaps(first, sets_of(docs, size, ends(first), 2 * n_first), lambda nodes, n: sets_of(docs, size, nodes, n)))
    links = F.col("overlap") * (100 + percent) >= percent * (F.col("a_size") + F.col("b_size"))
    roots = connected(known.filter(links).select("a", "b"))

    marked = entries.select("token", "node", "size", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = marked.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("count")).filter("x <> y").select("token", "count")
    if entries.groupBy("token").count().filter(F.col("count") > list_part).limit(1).count():
        listed = spread_join(marked, mixed, "token")
    else:
        listed = marked.join(mixed, "token", "left_semi").withColumn("count", F.lit(1))
    left = across(listed, percent, tasks, list_part).join(known.select("a", "b"), ["a", "b"], "left_anti")
    left = cut(undecided(left, known, percent))
    n_left = left.count()
    if n_left:
        sets = cut(sets_of(docs, size, ends(left.filter("not sure")), 2 * n_left))
        # first, of any two components, the pairs of the most equal sizes; what these join needs no further comparison
        apart = separate(left, roots)
        order = Window.partitionBy("ra", "rb").orderBy(F.desc("sure"), F.abs(F.col("a_size") - F.col("b_size")), "a", "b")
        tried = cut(apart.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= tries).select("a", "a_size", "b", "b_size", "sure"))
        for pairs in (tried, left.join(tried.select("a", "b"), ["a", "b"], "left_anti")):
            pairs = separate(pairs, roots)
            compared = cut(pairs.filter("not sure").select("a", "a_size", "b", "b_size"))
            more = overlaps(compared, sets, lambda nodes, n: sets.join(F.broadcast(nodes), "node", "left_semi")).filter(links).select("a", "b").unionByName(pairs.filter("sure").select("a", "b"))
            roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    rank = F.struct(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), F.col("key"))
    classes = rows.filter("node is not null").groupBy("node").agg(F.min(rank).alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = cut(classes)
    top = classes.groupBy("root").agg(F.min("least").alias("top"))
    classes = spread_join(classes, top, "root").select("node", F.col("least.doc_id").alias("class_id"), "top")
    out = rows.join(classes, "node", "left")
    back = lambda c, own: F.when(F.col("top").isNull(), F.col(own)).otherwise(F.nullif(c, F.lit(int(NO_ID))))
    return out.select(
        "doc_id", "key", "n_shingles", back(F.col("class_id"), "doc_id").alias("class_id"), back(F.col("top.doc_id"), "doc_id").alias("component_id"), F.coalesce(F.col("top") == rank, F.lit(True)).alias("first")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that come first in their component, once each."""
    names = docs.columns
    own_id, own_key, first_id, first_key = unused(names, "own_id", "own_key", "first_id", "first_key")
    rank = lambda c: F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(int(NO_ID)))
    first = similar(docs, doc_id=doc_id, text=text, **options).filter("first").select(rank("doc_id").alias(first_id), F.col("key").alias(first_key)).distinct()
    keyed = docs.withColumns({own_key: F.xxhash64(F.col(f"`{text}`").cast("string")), own_id: rank(doc_id)})
    kept = keyed.join(first, (F.col(own_id) == F.col(first_id)) & (F.col(own_key) == F.col(first_key)), "left_semi")
    return kept.dropDuplicates([own_id, own_key]).select(*[F.col(f"`{c}`") for c in names])


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "class_id")


def brute_force(rows: list[tuple[int, str | None]], size: int = SHINGLE, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """n_shingles and component_id by comparing all pairs, for small tables with distinct ids."""
    low = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
    sets = {}
    for d, t in rows:
        w = (t or "").encode().translate(low).split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(sets, key=lambda d: len(sets[d]))
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if len(sets[a]) * 100 < percent * len(sets[b]):
                break
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}
