"""Merges findings in text and in images into one list of poles with catalog coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmatch.operators import catalog as cat


def observations(native: DataFrame, visual: DataFrame, keys: list[str]) -> DataFrame:
    """Exact native candidates and accepted visual ones as (keys, pole_id, page_number, visual, confidence)."""
    n = native.filter("match_status = 'reference_exact'").select(*keys, F.col("normalized_text").alias("pole_id"), F.col("page_number").cast("long"), F.lit(False).alias("visual"), F.lit(1.0).alias("confidence"))
    v = visual.filter("acceptance_status = 'accepted'").select(*keys, F.col("normalized_text").alias("pole_id"), F.col("page_number").cast("long"), F.lit(True).alias("visual"), F.col("resolution_confidence").alias("confidence"))
    return n.unionByName(v)


def accepted(native: DataFrame, visual: DataFrame, catalog: DataFrame | None = None, keys: list[str] | None = None, *, places: DataFrame | None = None) -> DataFrame:
    """One row for each pole: discovery_sources, pages, confidence, and its coordinates if the catalog's records agree; ``places`` are the catalog's coordinates where they are made already."""
    keys = keys or []
    # by page first, which needs no more than numbers: few rows are left to gather lists of
    paged = observations(native, visual, keys).groupBy(*keys, "pole_id", "page_number", "visual").agg(F.max("confidence").alias("confidence"))
    merged = paged.groupBy(*keys, "pole_id").agg(
        F.array_compact(F.array(F.when(F.max(~F.col("visual")), "native_text"), F.when(F.max("visual"), "visual"))).alias("discovery_sources"), F.array_sort(F.collect_set("page_number")).alias("pages"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"),
    )
    return merged.join(cat.coordinates(catalog) if places is None else places, "pole_id", "left").select(*keys, "pole_id", "x", "y", "discovery_sources", "pages", "confidence")


def status(poles: DataFrame, judged: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """status, accepted_pole_count, review_candidate_count: one row, or one for each of ``documents`` (its columns are the keys)."""
    review = F.count_if(F.col("acceptance_status") == "review").alias("review_candidate_count")
    accepted_ = F.count("*").alias("accepted_pole_count")
    if documents is None:
        out = poles.agg(accepted_).select("*", judged.agg(review).scalar().alias("review_candidate_count"))
    else:
        keys = documents.columns
        out = documents.distinct().join(poles.groupBy(*keys).agg(accepted_), keys, "left").join(judged.groupBy(*keys).agg(review), keys, "left").fillna(0, ["accepted_pole_count", "review_candidate_count"])
    verdict = F.when(F.col("review_candidate_count") > 0, "needs_review").when(F.col("accepted_pole_count") > 0, "completed").otherwise("no_poles_found")
    return out.select(*(documents.columns if documents is not None else []), verdict.alias("status"), "accepted_pole_count", "review_candidate_count")
