"""What lets queries grow with their tables: no step that gathers many rows in a few tasks, no pattern where a set of characters does."""

import re

from pyspark.sql import functions as F

from planmatch.functions import text
from planmatch.operators import catalog, evidence, index, pages, resolver
from planmatch.plans import queries


def plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_of_equal_pages_need_no_join(spark):
    """Pages have few sizes: a join on them would put half of all tiles in one task."""
    sizes = spark.range(6).select("id", F.when(F.col("id") % 2 == 0, 2592.0).otherwise(1224.0).alias("width_points"), F.lit(1728.0).alias("height_points"))
    found = pages.tiles(sizes, keys=["id"])
    assert "Join" not in plan(found)
    assert found.groupBy("id").count().filter("id < 2").orderBy("id").collect() == [(0, 24), (1, 12)]


def test_characters_of_blanks_are_those_of_the_pattern(spark):
    rows = spark.createDataFrame([(chr(i),) for i in range(0x3100)], "c string").withColumn("t", F.concat("c", F.lit("a"), "c", F.lit("b"), "c"))
    trimmed, deleted = F.regexp_replace("t", rf"^{text.WS}+|{text.WS}+$", ""), F.regexp_replace(F.upper("t"), text.WS, "")
    assert rows.filter((text.trimmed("t") != trimmed) | (text.normalized("t") != deleted)).count() == 0


def test_texts_are_normalised_once_not_for_each_reading(spark):
    """A reading has one join with what is known of its text: what normalises stands below the distinct texts."""
    records = catalog.load(spark.createDataFrame([("S1", "O123", 1.0, 2.0), ("S2", "O123", 1.0, 2.0)], "source_id string, pole_id_raw string, x double, y double"))
    rows = spark.createDataFrame([(i, t, label) for i, (t, label) in enumerate([(" o123", ""), ("P#0123", None), ("0123", "POLE#: 0123"), (None, None)])], "i int, raw_text string, label_text string")
    found = resolver.resolve(rows, records, lists=False)
    assert "matched_source_ids" not in found.columns
    assert not [x for x in plan(found).split("\n") if re.search(r"\bi#\d", x) and re.search(r"upper\(|regexp|trim\(", x)]
    got = {r["i"]: r for r in found.collect()}
    assert [got[i]["raw_text"] for i in range(4)] == ["o123", "P#0123", "0123", ""]
    assert [got[i]["explicit_pole_context"] for i in range(4)] == [False, True, True, False]
    assert [got[i]["resolved_pole_id"] for i in range(4)] == ["O123", "O123", "O123", None]
    assert [got[i]["status"] for i in range(4)] == ["reference_exact", "reference_resolved", "reference_resolved", "ignored"]


def test_accepted_ids_take_their_sources_from_the_catalog(spark):
    seen = [(1, "O1", "reference_exact", "accepted", 0.9, 2), (1, "O1", "reference_exact", "accepted", 0.8, 2), (2, "O1", "reference_exact", "accepted", 0.7, 2), (2, "O2", "reference_exact", "review", 0.7, 1)]
    found = spark.createDataFrame(seen, "page_number int, normalized_text string, catalog_match_status string, acceptance_status string, model_confidence double, catalog_match_count long")
    sources = spark.createDataFrame([("O1", ["S1", "S2"]), ("O2", ["S3"])], "pole_id string, source_ids array<string>")
    assert [tuple(r) for r in evidence.by_pole(found, sources=sources).collect()] == [("O1", [1, 2], 3, 0.9, 2, ["S1", "S2"])]


def test_places_of_ids_need_no_set_of_places(spark):
    rows = [("A", 1.0, 2.0), ("A", 1.0, 2.0), ("B", 1.0, 2.0), ("B", 1.0, 3.0), ("C", None, None), ("C", None, None), ("D", 1.0, 2.0), ("D", None, 2.0), ("E", float("nan"), 2.0), ("E", float("nan"), 2.0), ("F", None, 4.0), ("F", None, 4.0)]
    found = catalog.coordinates(spark.createDataFrame(rows, "pole_id_normalized string, x double, y double"))
    assert "distinct" not in plan(found)
    assert {r["pole_id"]: str((r["x"], r["y"])) for r in found.collect()} == {"A": "(1.0, 2.0)", "B": "(None, None)", "C": "(None, None)", "D": "(None, None)", "E": "(nan, 2.0)", "F": "(None, 4.0)"}


def test_first_reads_hold_all_that_candidates_take(spark):
    """One reading for each text and label of a tile is moved and sorted, not every reading; the candidates are the same."""
    texts = [("O123", "O123"), ("O-123", "O-123"), ("P#O123", "P#O123"), ("0123", "POLE#: 0123"), ("0123", "0123"), ("N9", "N9"), ("", "")]
    seen = [(t % 3, 50 - t, *texts[t * t % 7], t / 100, t % 2 == 0) for t in range(50)]
    rows = spark.createDataFrame(seen, "tile_index int, pos int, raw_text string, label_text string, model_confidence double, model_reports_complete boolean")
    records = catalog.load(spark.createDataFrame([("S1", "O123", 1.0, 2.0), ("S2", "I456", 1.0, 2.0)], "source_id string, pole_id_raw string, x double, y double"))
    first = evidence.first_read(rows, ["tile_index"], ["raw_text", "label_text"])
    assert first.columns == rows.columns and first.count() == rows.select("tile_index", "raw_text", "label_text").distinct().count() < 50
    taken = [sorted(map(str, evidence.candidates(resolver.resolve(x, records), ["tile_index"]).collect())) for x in (rows, first)]
    assert taken[0] == taken[1] and taken[0]


def test_candidates_are_sorted_after_readings_are_gathered(spark, sf_dir):
    """A window over readings as they are made numbers them; none sorts them all again by text."""
    assert "min(pos" in plan(queries.QUERIES["tile_dedupe"](spark, sf_dir))


def test_hits_without_lists_leave_source_ids_unread(spark, tmp_path):
    records = catalog.load(spark.createDataFrame([("S1", "O123", 1.0, 2.0)], "source_id string, pole_id_raw string, x double, y double"))
    rows = spark.createDataFrame([("O123", "")], "raw_text string, label_text string")
    kept = index.kept(records, f"{tmp_path}/i")
    assert not [x for x in plan(resolver.resolve(rows, kept, lists=False)).split("\n") if "source_ids" in x and "Relation" not in x]


def test_an_index_reads_its_records_once_beside_their_digest(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    raw = spark.range(300).selectExpr("concat('S', id) source_id", "concat('O', id % 100) pole_id_raw", "1.0D x", "2.0D y")
    index.kept(catalog.load(raw.mapInArrow(counted, raw.schema)), f"{tmp_path}/i")
    assert seen.value == 600


def test_doubles_need_no_text(spark):
    values = [1.5, -0.0, 1e-300, 5e-324, 1.7976931348623157e308, 123456789.125, float("nan"), float("inf"), float("-inf"), None]
    raw = spark.createDataFrame([(f"S{i}", f"O{i}", v, v) for i, v in enumerate(values)], "source_id string, pole_id_raw string, x double, y double")
    found = catalog.load(raw)
    assert "cast(x" not in plan(found)
    by_text = catalog.load(raw.withColumns({c: F.col(c).cast("string") for c in "xy"}))
    assert str(found.orderBy("source_id").collect()) == str(by_text.orderBy("source_id").collect())


def test_texts_of_pages_are_normalised_once_distinct(spark, sf_dir):
    """The join on the normal form infers a filter, which mustn't be pushed to all readings."""
    ids = spark.createDataFrame([("O123",)], "pole_id string")
    assert "l_orderkey" not in plan(queries._pages_of_text(spark, sf_dir, ids))


def test_poles_of_permits_meet_places_by_id(spark, sf_dir):
    """The join on ids infers a filter, which mustn't be pushed to all records of the catalog."""
    assert "p_partkey" not in plan(queries._permit_poles(spark, sf_dir))
