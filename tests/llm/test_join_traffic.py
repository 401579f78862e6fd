"""What the Jaccard join sends grows with the input: the sketch in a byte or two a shingle, entries of index lists in a few bytes, and nothing is lost by it."""

import numpy as np
import pyarrow as pa
import pytest

from planmatch.llm import jaccard_join


def test_counts_are_packed():
    for counts in ([1, 0, 0], [255, 256, 65_536, 0], [2**63, 1], [0, 7] * 500):
        x = np.array(counts, np.uint64)
        assert (jaccard_join.total([jaccard_join.packed(x)] * 2, len(x)) == x * np.uint64(2)).all()
    rare = np.random.default_rng(1).poisson(0.5, 1 << 16).astype(np.uint64)
    assert len(jaccard_join.packed(rare)) < 0.25 * len(rare)  # 0.61 when eight bytes of each were compressed


@pytest.mark.parametrize("adders", [1, 3, 64])
def test_sketch(spark, adders):
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 400))) for _ in range(160)] + ["a b c d e"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "xxhash64(text) as key").repartition(4, "doc_id")
    scanned = jaccard_join.scan(docs, 5, 17, adders).cache()
    h, _ = jaccard_join.shingle_sets(pa.array(texts), 5)
    cells = np.bincount((h >> np.uint64(64 - 17)).astype(np.int64), minlength=1 << 17)
    assert (jaccard_join.sketch(scanned, 17) == np.minimum(4 * np.log2(cells + 1.0), 255).astype(np.uint8)).all()
    sent = scanned.filter("cells is not null").selectExpr("sum(octet_length(data))", "count(distinct salt)").first()
    assert sent[0] < 1.2 * len(h) and sent[1] <= adders
    scanned.unpersist()


def test_entries_are_short(spark):
    texts = [" ".join(f"w{d}x{i}" for i in range(200)) for d in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    levels = spark.sparkContext.broadcast(np.zeros(1 << 16, np.uint8))
    rows = jaccard_join.index_lists(docs, 5, 75, levels, 16, 4, 1 << 19).collect()
    n = sum(len(r["nodes"]) for r in rows) // 8
    assert n == 50 * jaccard_join.prefix(196, 75)
    compressed = sum(len(pa.compress(r[c], codec="lz4_raw", asbytes=True)) for r in rows for c in ("tokens", "nodes", "sizes", "places"))
    assert compressed < 8.5 * n  # 9.9 before
    # read again, they are what was sent, but for the last bits of tokens
    h, at = jaccard_join.shingle_sets(pa.array(texts), 5)
    token = np.concatenate([jaccard_join.numbers(bytes(len(r["tokens"]) // 3) + r["tokens"], np.uint64) for r in rows])
    place = np.concatenate([jaccard_join.numbers(r["places"], np.int32) for r in rows])
    pos = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    assert sorted(zip(token.tolist(), place.tolist())) == sorted((int(t) >> 16 << 16, int(p)) for t, p in zip(h, pos) if p < jaccard_join.prefix(196, 75))


def test_a_shared_token_keeps_the_earliest_place():
    """Two shingles of one set may share a token: the set stands in the list with the earlier one, so that no pair is ruled out by the later."""
    token, node = np.array([5, 5, 5], np.uint64) << np.uint64(16), np.array([1, 1, 2])
    rows = jaccard_join.pivoted(token, node, np.array([20, 20, 20]), np.array([9, 0, 0]), 75, False).to_pylist()
    assert [(r["node"], r["pos"], r["pivot"]) for r in rows] == [(1, 0, None), (2, 0, 1)]
