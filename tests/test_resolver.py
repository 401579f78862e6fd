"""Resolver, evidence and label grammar on hand-made catalogs."""

import pytest
from pyspark.sql import functions as F

from planmatch.functions.text import normalized, shape, unknown_body
from planmatch.operators import catalog as cat
from planmatch.operators import evidence, resolver

IDS = ["O131F", "O132F", "O200", "D044", "Q044", "L310", "J310", "G500F", "N143", "N143A"]
GOLD = [
    ("O131F", False, "reference_exact", "O131F", 1.0), (" o131f ", False, "reference_exact", "O131F", 1.0), ("O 131F", False, "reference_exact", "O131F", 1.0), ("O-131F", False, "reference_resolved", "O131F", 1.0),
    ("P#O131F", False, "reference_resolved", "O131F", 0.98), ("PP-O200", False, "reference_resolved", "O200", 0.98), ("POLE NO: G500F", False, "reference_resolved", "G500F", 0.98), ("P#0131F", False, "reference_resolved", "O131F", 0.95),
    ("P#0131", False, "reference_resolved", "O131F", 0.80), ("P#0044", False, "reference_ambiguous", None, 0.80), ("P-1310", False, "reference_ambiguous", None, 0.82), ("XY:O200", False, "reference_resolved", "O200", 0.96),
    ("P0131F", False, "reference_resolved", "O131F", 0.91), ("O0131F", False, "ignored", None, 0.0), ("O999F", False, "not_found", None, 0.0), ("0200", True, "reference_resolved", "O200", 0.92), ("01135", True, "not_found", None, 0.0),
    ("304 ELM", False, "ignored", None, 0.0), ("UNK", False, "unknown_by_design", None, 0.0), ("N/A", False, "unknown_by_design", None, 0.0), ("P#TBD", False, "unknown_by_design", None, 0.0), ("PP-?", False, "unknown_by_design", None, 0.0),
    ("POLE#", False, "not_found", None, 0.0), ("PP-", False, "not_found", None, 0.0), ("", False, "ignored", None, 0.0),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return cat.load(spark.createDataFrame([(f"s{i}", x, str(float(i)), "2.0") for i, x in enumerate(IDS)], "source_id string, pole_id_raw string, x string, y string"))


def test_golden_readings(spark, catalog):
    rows = spark.createDataFrame([(i, r, e) for i, (r, e, *_) in enumerate(GOLD)], "i int, raw_text string, explicit_pole_context boolean")
    got = {r["i"]: r for r in resolver.resolve(rows, catalog).collect()}
    for i, (raw, _, status, pole, confidence) in enumerate(GOLD):
        r = got[i]
        assert (r["status"], r["resolved_pole_id"], r["resolution_confidence"]) == (status, pole, confidence), raw
    assert got[8]["transformations"][-1] == "added_terminal_f" and got[8]["f_suffix_agrees"] is False
    assert got[9]["match_count"] == 2 and got[9]["requires_spatial_confirmation"]
    assert got[0]["id_neighborhood_ids"] == ["O132F"] and got[0]["requires_spatial_confirmation"]
    assert got[23]["candidate_variants"] == []


def test_prefix_of_a_longer_id_waits(spark):
    rows = spark.createDataFrame([(1, 1, 1, "N143"), (1, 1, 2, "N143A"), (2, 1, 1, "N143")], "page_number int, tile_index int, pos int, normalized_text string")
    rows = rows.withColumns({"catalog_match_status": F.lit("reference_exact"), "model_reports_complete": F.lit(True), "model_reports_edge_clipped": F.lit(False), "model_confidence": F.lit(0.9)})
    got = {(r["page_number"], r["normalized_text"]): r["review_reasons"] for r in evidence.judged(rows, ["page_number"]).collect()}
    assert got == {(1, "N143"): ["prefix_of_longer_id_on_page"], (1, "N143A"): [], (2, "N143"): []}


def test_nan_confidence_is_not_low(spark):
    rows = spark.createDataFrame([(1, "A1", float("nan")), (1, "A2", 0.5)], "page_number int, normalized_text string, model_confidence double")
    rows = rows.withColumns({"catalog_match_status": F.lit("reference_exact"), "model_reports_complete": F.lit(True), "model_reports_edge_clipped": F.lit(False)})
    assert {r["normalized_text"]: r["acceptance_status"] for r in evidence.judged(rows, ["page_number"]).collect()} == {"A1": "accepted", "A2": "review"}


def test_text_functions(spark):
    texts = [" o 131f ", "a b　c", "", "é²x", "P-unk"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(normalized("t"), shape("t"), unknown_body(normalized("t"))).collect()]
    assert [g[0] for g in got] == ["O131F", "ABC", "", "É²X", "P-UNK"]
    assert got[3][1] == "A9A" and got[4][2] == "UNK"


def test_coordinates(spark):
    rows = [("a", "P1", "1", "2"), ("b", "P1", "1", "2"), ("c", "P2", "1", "2"), ("d", "P2", None, None), ("e", "P3", None, "x")]
    c = cat.load(spark.createDataFrame(rows, "source_id string, pole_id_raw string, x string, y string"))
    assert {r["pole_id"]: (r["x"], r["y"]) for r in cat.coordinates(c).collect()} == {"P1": (1.0, 2.0), "P2": (None, None), "P3": (None, None)}
