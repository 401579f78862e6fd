"""Running sums over ranges against plain ones: hot keys, nulls, ties and one or no key."""

import random

import pytest
from pyspark.sql import functions as F

from planmatch.operators.running import SUM, XOR, running


def plain(rows, keys, kind):
    out, sums = [], {}
    for r in sorted(rows, key=lambda r: r[2]):
        k = keys(r)
        sums[k] = sums.get(k, 0) ^ (r[3] or 0) if kind is XOR else sums.get(k, 0) + (r[3] or 0)
        out.append((*r, sums[k]))
    return out


@pytest.mark.parametrize("kind", ["sum", "xor"])
@pytest.mark.parametrize("keys", [[], ["a"], ["a", "b"]])
def test_running(spark, kind, keys):
    rng = random.Random(len(keys))
    # one key has two thirds of all rows; the place tells all rows apart
    rows = [(None if i % 11 == 0 else 1 if i % 3 else rng.randint(0, 40), rng.choice([None, "x", "y"]), i, rng.choice([None, i, -7])) for i in rng.sample(range(900), 600)]
    df = spark.createDataFrame(rows, "a long, b string, i long, v long").repartition(5)
    got = running(df, keys, ["i"], {"s": F.col("v"), "n": F.lit(1)} if kind == "sum" else {"s": F.col("v")}, XOR if kind == "xor" else SUM, partitions=7).collect()
    take = {0: lambda r: (), 1: lambda r: (r[0],), 2: lambda r: (r[0], r[1])}[len(keys)]
    want = plain(rows, take, XOR if kind == "xor" else None)
    assert sorted((r["i"], r["s"]) for r in got) == sorted((r[2], r[4]) for r in want)
    if kind == "sum" and len(keys) == 1:
        assert max(r["n"] for r in got if r["a"] == 1) == sum(r[0] == 1 for r in rows)


def test_no_window_over_all_rows(spark):
    """Only rows of ranges go through a window without keys."""
    df = spark.range(2000).select(F.col("id").alias("i"), F.lit(1).alias("v"))
    out = running(df, [], ["i"], {"s": F.col("v")}, partitions=4)
    assert out.filter("s <> i + 1").count() == 0 and out.count() == 2000
    assert running(df.limit(0), [], ["i"], {"s": F.col("v")}).count() == 0
