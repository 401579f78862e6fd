"""Pages: classes of content, which go on to visual reading, and their tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmatch.errors import EngineError
from planmatch.functions.text import trimmed
from planmatch.functions.values import axis_starts, content_type

VISUAL = ["mixed", "likely_scanned", "image_only", "vector_or_empty"]


def inspect(raw: DataFrame) -> DataFrame:
    """Sizes to two places, flags and content type of page rows (width_points, height_points, embedded_word_count, image_count, largest_image_coverage)."""
    words, images, share = F.col("embedded_word_count"), F.col("image_count"), F.round("largest_image_coverage", 4)
    own = {
        "width_points": F.round("width_points", 2), "height_points": F.round("height_points", 2), "largest_image_coverage": share, "has_embedded_text": words > 0, "has_images": images > 0,
        "likely_scanned_page": (words == 0) & (share >= 0.75), "content_type": content_type(words, images, share),
    }
    return raw.withColumns(own)


def select(inspections: DataFrame, summaries: DataFrame, *, keys: list[str], with_unmatched_text: bool = False) -> DataFrame:
    """Pages with a reason for visual reading, and the reasons in order. ``summaries``: keys, native_word_count, exact_match_count, pattern_match_count."""
    kind = F.lower(trimmed(F.coalesce(F.nullif("content_type", F.lit("")), F.lit("unknown"))))
    joined = inspections.withColumn("content_type", kind).join(summaries.select(*keys, "native_word_count", "exact_match_count", "pattern_match_count"), keys, "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("native_word_count") == 0, "no_native_text"), F.when(F.col("likely_scanned_page"), "likely_scanned_page"), F.when(F.col("content_type").isin(VISUAL), F.concat(F.lit("content_type:"), "content_type")),
            F.when(F.col("pattern_match_count") > 0, "native_pattern_candidate"),
            F.when(F.lit(with_unmatched_text) & (F.col("content_type") == "embedded_text") & (F.coalesce("exact_match_count", F.lit(0)) == 0), "embedded_text_without_exact_match"),
        )
    )
    return joined.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(*keys, "content_type", "reasons")


FLAGS = ["contains_pole_drawing", "contains_facility_ids", "contains_utility_plan_sheet", "contains_highlighted_pole_labels"]


def route(assessments: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``relevant_for_tiles`` of page assessments (the flags, confidence, error). A failed reading keeps its page, without flags."""
    check_threshold(threshold)
    failed = F.col("error").isNotNull()
    out = assessments.withColumns({c: F.when(failed, False).otherwise(F.coalesce(c, F.lit(False))) for c in FLAGS} | {"confidence": F.when(failed, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))})
    any_flag = F.greatest(*FLAGS)
    return out.withColumn("relevant_for_tiles", failed | any_flag | (F.col("confidence") < threshold) & ~F.isnan("confidence"))


def check_threshold(value: float) -> float:
    """NaN passes, as it compares false both ways."""
    try:
        value = float(value)
    except (TypeError, ValueError) as e:
        raise EngineError("a confidence threshold must be numeric") from e
    if value < 0.0 or value > 1.0:
        raise EngineError("a confidence threshold must be from 0 through 1")
    return value


def skipped(routed: DataFrame, keys: list[str]) -> DataFrame:
    """Assessed pages none of whose assessments is relevant."""
    return routed.select(*keys).distinct().join(routed.filter("relevant_for_tiles").select(*keys).distinct(), keys, "left_anti")


def relevant(routed: DataFrame, selections: DataFrame, keys: list[str]) -> DataFrame:
    """Selections of the relevant pages; a relevant page without a selection stops the plan."""
    pages = routed.filter("relevant_for_tiles").select(*keys).distinct()
    out = pages.join(selections.withColumn("__there", F.lit(True)), keys, "left")
    missing = F.raise_error(F.lit("a page has a preview but no selection"))
    return out.withColumn("content_type", F.when(F.col("__there").isNull(), missing).otherwise(F.col("content_type"))).drop("__there")


def tiles(pages: DataFrame, *, keys: list[str], dpi: int = 225, tile_pixels: int = 1800, overlap: float = 0.15) -> DataFrame:
    """Tiles of each page (width_points, height_points), row by row from 1, with boxes to three places."""
    size = tile_pixels * 72.0 / dpi
    step = size * (1.0 - overlap)
    # each page has its own starts: a join on sizes would put all pages of a size, and all of their tiles, in one task
    starts = {"xs": axis_starts(F.col("width_points"), size, step), "ys": axis_starts(F.col("height_points"), size, step)}
    placed = pages.select(*keys, "width_points", "height_points").withColumns(starts)
    rows = placed.select("*", F.size("xs").alias("across"), F.posexplode("ys").alias("r", "y0"))
    cells = rows.select("*", F.posexplode("xs").alias("c", "x0"))
    box = [F.col("x0"), F.col("y0"), F.least(F.col("x0") + size, "width_points"), F.least(F.col("y0") + size, "height_points")]
    return cells.select(
        *keys, (F.col("r") * F.col("across") + F.col("c") + 1).alias("tile_index"), (F.col("r") + 1).alias("tile_row"), (F.col("c") + 1).alias("tile_column"), F.array(*[F.round(x, 3) for x in box]).alias("pdf_bbox")
    )
