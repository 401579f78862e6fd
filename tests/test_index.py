"""The kept catalog index: equal to one made anew, found again, renewed for changed ids, and joined without moving it."""

import random

import pytest
from pyspark.sql import functions as F

from planmatch.operators import catalog as cat
from planmatch.operators import index, resolver


def records(seed, n=200):
    rng = random.Random(seed)
    ids = [f"{rng.choice('ODLGN')}{rng.randint(0, 140):03d}{rng.choice(['', 'F'])}" for _ in range(n)] + ["O", "F", "FF", "XFF", "Ä12", "N143A", "0131"]
    return [(f"S{i}", x, str(float(i % 7)), "1.0") for i, x in enumerate(ids)]


def catalog(spark, rows):
    return cat.load(spark.createDataFrame(rows, "source_id string, pole_id_raw string, x string, y string").repartition(3))


def content(found):
    plain = lambda df, *drop: sorted(str(tuple(r)) for r in df.drop(*drop).collect())
    columns = ["pole_id", "match_count", "source_ids", "neighbours"]
    forms = ["form", "pole_id", "phase", "ord", "cost", "made", "match_count", "source_ids", "neighbours"]
    return plain(found.ids.select(*columns)), plain(found.spellings.select(*forms)), plain(found.shapes.select("shape", "id_count"))


def test_kept_equals_plain(spark, tmp_path):
    one = catalog(spark, records(1))
    first = index.kept(one, f"{tmp_path}/i")
    assert content(first) == content(index.plain(one))
    made = spark.read.parquet(f"{tmp_path}/i/made")
    # the same records in another order and number of parts
    again = index.kept(catalog(spark, records(1)[::-1]).coalesce(1), f"{tmp_path}/i")
    assert again.version == first.version and made.count() == spark.read.parquet(f"{tmp_path}/i/made").count() == 1


def test_renewed_equals_plain(spark, tmp_path):
    rows = records(2)
    index.kept(catalog(spark, rows), f"{tmp_path}/i")
    # an id goes, one comes, one moves, one is there twice, one is renamed by its source
    rows = [r for r in rows if r[1] != rows[0][1]] + [("N1", "O077", "1", "1"), ("N2", "O141F", "1", "1"), (rows[5][0], rows[5][1], "99.0", "1.0"), rows[9]]
    rows[20] = ("other", *rows[20][1:])
    two = catalog(spark, rows)
    assert content(index.kept(two, f"{tmp_path}/i")) == content(index.plain(two))
    assert spark.read.parquet(f"{tmp_path}/i/made").count() == 2


def test_readings_by_either(spark, tmp_path):
    one = catalog(spark, records(3))
    texts = [f"{m}{x}" for m in ("", "P#", "PP-", "XY:", "P") for x in ("O12", "0012F", "1044", "6100", "XFF", "FF", "XF", "F", "0", "O-012", "")] + [r[1] for r in records(3)[:40]]
    rows = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "i int, raw_text string, explicit_pole_context boolean")
    by = lambda c: sorted(str(tuple(r)) for r in resolver.resolve(rows, c).collect())
    assert by(one) == by(index.kept(one, f"{tmp_path}/i"))


def test_second_run_moves_no_catalog(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 500)
    one = catalog(spark, records(4))
    index.kept(one, f"{tmp_path}/i")
    found = index.kept(one, f"{tmp_path}/i")
    rows = spark.createDataFrame([("O012", False)], "raw_text string, explicit_pole_context boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = resolver.resolve(rows, found)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (scan,) = [i for i, line in enumerate(plan) if "FileScan parquet" in line and "_forms" in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, at = [], depth(plan[scan])
    for line in reversed(plan[:scan]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    join = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[:join]) and any("Bucketed: true" in line for line in plan)


@pytest.mark.parametrize("rows", [[], [("S", "O1", "1", "1")]])
def test_small(spark, tmp_path, rows):
    one = catalog(spark, rows)
    found = index.kept(one, f"{tmp_path}/i")
    assert found.ids.count() == len(rows)
    asked = spark.createDataFrame([("O1", False), ("xx", False)], "raw_text string, explicit_pole_context boolean")
    assert resolver.resolve(asked, found).filter(F.col("status") == "reference_exact").count() == len(rows)
