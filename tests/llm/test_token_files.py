"""Compressed files of token ids: exact round trips, ranges from checkpoints, damage, and documents against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest

from planmatch.llm import token_files as tf

SCHEMA = "doc_id long, text string, part int, n_tokens string"


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 70_001, tf.BLOCK, tf.BLOCK + 1, 2 * tf.BLOCK + 40_000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (np.minimum(rng.zipf(1.4, n), 50_256), rng.integers(0, 50_257, n), np.zeros(n, int)):
        file = tf.File(tf.encode_file(ids.astype(np.uint32), b"index"))
        assert (file.ids() == ids).all() and file.index == b"index" and file.count == n
        for _ in range(4):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (file.range(a, b) == ids[a:b]).all()


def test_size_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 1 << 20), 50_256).astype(np.uint32)
    p = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * len(tf.encode_file(ids)) / len(ids) < 1.08 * -(p * np.log2(p)).sum()


def test_frequencies_sum_up():
    rng = np.random.default_rng(2)
    for ids in (np.arange(50_257), np.zeros(3, int), np.r_[np.zeros(10**6, int), np.arange(60_000)], rng.integers(0, 9, 100)):
        symbols, f, bits = tf.frequencies(ids)
        assert f.sum() == 1 << bits and f.min() >= 1 and (symbols == np.unique(ids)).all()


def test_damage_is_found():
    ids = np.random.default_rng(3).integers(0, 300, 5000).astype(np.uint32)
    good = tf.encode_file(ids)
    for at in range(0, len(good), 97):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises(tf.Damaged):
            tf.File(bytes(bad)).ids()
    for cut in (good[:5], good[:-1], b""):
        with pytest.raises(tf.Damaged):
            tf.File(cut).ids()


def test_joined_checksums():
    rng = random.Random(4)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 400))
        assert tf.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected(rows):
    """By the library itself, with its default settings."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def documents(spark, rows):
    return spark.createDataFrame([(d, t, 7, "x") for d, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("file_ids", [50, 1000, tf.FILE_IDS])
def test_documents(spark, tmp_path, file_ids):
    rng = random.Random(5)
    words = ["an", "ção", "über", "\n", "<|endoftext|>", "7", "the", "ß", "  ", "日本"]
    rows = [(None, None), (None, ""), (3, "long " * 3000), *((d, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for d in rng.sample(range(-500, 10_000), 150)), (20_000, "same"), (20_000, "same")]
    tf.write(documents(spark, rows), f"{tmp_path}/t", file_ids=file_ids)
    files = spark.read.parquet(f"{tmp_path}/t")
    key = lambda r: r[1]
    got = sorted((tuple(r) for r in tf.read(files).collect()), key=key)
    want = expected(rows)
    # the two without an id are in the order of their hashes
    assert got[2:] == want[2:] and sorted(x[2:] for x in got[:2]) == sorted(x[2:] for x in want[:2])
    sent = tf.export(files, f"{tmp_path}/files").collect()
    assert len(sent) == files.count() and len(list((tmp_path / "files").glob("*.rans"))) == len(sent)
    assert sorted((tuple(r) for r in tf.read(tf.imported(spark, f"{tmp_path}/files")).collect()), key=key) == got


def test_equal_ids_over_several_ranges(spark, tmp_path, monkeypatch):
    """One doc_id for two thirds of the rows: it is split over ranges, and no id is lost or counted twice."""
    monkeypatch.setattr(tf, "RANGE_BYTES", 2000)
    rows = [(5 if i % 3 else i, f"text {i} " * (i % 7)) for i in range(400)]
    tf.write(documents(spark, rows), f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    assert files.select("part").distinct().count() > 4
    got, want = sorted(tuple(r) for r in tf.read(files).collect()), expected(rows)
    assert sorted((d, n, c) for d, _, n, c in got) == sorted((d, n, c) for d, _, n, c in want)
    ends = sorted((s, s + n) for _, s, n, _ in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and all(x in got for x in want if x[0] != 5)


def test_empty_table(spark, tmp_path):
    tf.write(documents(spark, []), f"{tmp_path}/t")
    assert tf.read(spark.read.schema(tf.FILES).parquet(f"{tmp_path}/t")).count() == 0
