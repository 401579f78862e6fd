"""Evidence rules over resolved readings: what is accepted, what waits for review, and summaries of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planmatch.functions.text import readable
from planmatch.operators.pages import check_threshold


def candidates(resolved: DataFrame, tile_keys: list[str]) -> DataFrame:
    """Readings that can be ids and aren't ignored, the first of each text in a tile; ``pos`` orders a tile's readings."""
    kept = resolved.filter(readable("raw_normalized_text") & (F.col("status") != "ignored"))
    kept = kept.withColumn("normalized_text", F.coalesce("resolved_pole_id", "raw_normalized_text"))
    kept = kept.withColumn("catalog_match_status", F.when(F.col("status").isin("reference_exact", "reference_resolved"), "reference_exact").otherwise(F.col("status")))
    first = Window.partitionBy(*tile_keys, "normalized_text").orderBy("pos")
    return kept.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n").withColumnRenamed("match_count", "catalog_match_count")


def first_read(readings: DataFrame, tile_keys: list[str], text: list[str]) -> DataFrame:
    """The first reading of each of ``text`` (what a reading's resolution hangs on) in a tile, by ``pos``, which is never null; what ``candidates`` takes of all readings is among these.

    Gathered where readings are made, before any are joined or moved: no sort of all readings by tile and text.
    """
    keys = [*tile_keys, *text]
    rest = [c for c in readings.columns if c not in (*keys, "pos")]
    out = readings.groupBy(*keys).agg(F.min("pos").alias("pos"), *(F.min_by(c, "pos").alias(c) for c in rest))
    return out.select(*readings.columns)


def ignored(resolved: DataFrame) -> DataFrame:
    return resolved.filter(readable("raw_normalized_text") & (F.col("status") == "ignored"))


def longer_ids(found: DataFrame, page_keys: list[str]) -> DataFrame:
    """page_keys, normalized_text, longer: how many other exact ids of the page begin with an exact id.

    Ids meet their own beginnings on an equi-join, so that a page's ids are never compared all with all.
    """
    ids = found.filter("catalog_match_status = 'reference_exact'").select(*page_keys, "normalized_text").distinct()
    begun = ids.filter(F.length("normalized_text") > 1).select(*page_keys, F.expr("explode(transform(sequence(1, length(normalized_text) - 1), n -> left(normalized_text, n)))").alias("normalized_text"))
    begun = begun.groupBy(*page_keys, "normalized_text").agg(F.count("*").alias("longer"))
    return ids.join(begun, [*page_keys, "normalized_text"])


def judged(found: DataFrame, page_keys: list[str], threshold: float = 0.80) -> DataFrame:
    """``found`` with review_reasons, in order, and acceptance_status."""
    check_threshold(threshold)
    status, exact = F.col("catalog_match_status"), F.col("catalog_match_status") == "reference_exact"
    out = found.join(longer_ids(found, page_keys), [*page_keys, "normalized_text"], "left")
    low = (F.col("model_confidence") < threshold) & ~F.isnan("model_confidence")
    reasons = F.array_compact(
        F.array(
            F.when(status == "reference_ambiguous", "catalog_ambiguous").when(status == "unknown_by_design", "drafter_marked_pole_unknown").when(~exact, "catalog_not_found"),
            F.when(~F.col("model_reports_complete"), "model_did_not_confirm_complete_id"), F.when(F.col("model_reports_edge_clipped"), "model_reported_tile_edge_clipping"), F.when(low, "below_minimum_confidence"),
            F.when(exact & (F.col("longer") >= 2), "prefix_of_multiple_longer_ids_on_page").when(exact & (F.col("longer") == 1), "prefix_of_longer_id_on_page"),
        )
    )
    out = out.withColumn("review_reasons", reasons).drop("longer")
    return out.withColumn("acceptance_status", F.when(F.size("review_reasons") == 0, "accepted").otherwise("review"))


def accepted(found: DataFrame) -> DataFrame:
    return found.filter("catalog_match_status = 'reference_exact' and acceptance_status = 'accepted'")


def by_pole(found: DataFrame, keys: list[str] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """One row for each accepted id: its pages, how often it was read, best confidence, records and source ids.

    Source ids come from ``sources`` (pole_id, source_ids) where it is given, so that readings needn't carry them, or from ``found``, where that has them.
    """
    keys = [*(keys or []), "pole_id"]
    own = sources is None and "matched_source_ids" in found.columns
    named = accepted(found).withColumn("pole_id", F.col("normalized_text"))
    # by page first, which needs no more than numbers: few rows are left to gather lists of
    paged = named.groupBy(*keys, "page_number").agg(
        F.count("*").alias("n"), F.max("model_confidence").alias("c"), F.max("catalog_match_count").alias("m"), *([F.collect_set("matched_source_ids").alias("s")] if own else [])
    )
    out = paged.groupBy(*keys).agg(
        F.array_sort(F.collect_list("page_number")).alias("pages"), F.sum("n").alias("tile_observation_count"), F.round(F.max("c"), 4).alias("maximum_model_confidence"), F.max("m").alias("catalog_match_count"),
        *([F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("s"))))).alias("matched_source_ids")] if own else []),
    )
    return out if sources is None else out.join(sources.select("pole_id", F.col("source_ids").alias("matched_source_ids")), "pole_id", "left")


def totals(found: DataFrame, skipped: DataFrame, assessments: DataFrame | None = None, tile_replies: DataFrame | None = None) -> DataFrame:
    """One row of counts; with ``assessments`` and ``tile_replies`` (error), also how many pages and tiles were read and how many failed."""
    exact, review = F.col("catalog_match_status") == "reference_exact", F.col("acceptance_status") == "review"
    counts = found.agg(
        F.count("*").alias("candidate_observation_count"), F.count_if(exact).alias("exact_candidate_observation_count"), F.count_if(exact & ~review).alias("accepted_candidate_observation_count"),
        F.count_if(review).alias("review_candidate_observation_count"), F.count_distinct(F.when(exact & ~review, F.col("normalized_text"))).alias("exact_unique_id_count"),
    )
    more = [skipped.agg(F.count("*")).scalar().alias("ignored_candidate_observation_count")]
    for rows, read, failed in ((assessments, "preview_assessment_count", "preview_error_count"), (tile_replies, "tile_count", "tile_error_count")):
        if rows is not None:
            more += [rows.agg(F.count("*")).scalar().alias(read), rows.agg(F.count_if(F.col("error").isNotNull())).scalar().alias(failed)]
    return counts.select("*", *more)


def unmatched(found: DataFrame) -> DataFrame:
    return found.filter("catalog_match_status <> 'reference_exact' and normalized_text <> ''").select("normalized_text").distinct()


def review_queue(found: DataFrame) -> DataFrame:
    """What waits for a person: an output beside the accepted poles."""
    return found.filter("acceptance_status = 'review'")
