"""Resolves readings of labels to catalog ids: the catalog is spelled once, in all forms that reach an id, and a distinct text meets them in one equi-join.

Hits come in phases: the text itself (0), without separators (1), the body behind a marker with look-alike letters for
its leading digit (2), and those with a last F added or taken off (3). A reading's first phase with a hit counts; within it penalties
rank the ids, and a runner-up nearer than the margin makes the reading ambiguous. Penalties are integers, so that margins are exact.

What a reading could mean needs no variants of the reading: those of phases 2 and 3 are undone on the ids instead (``spelling.forms``), so that a text is looked up under three
spellings at most, whatever the look-alikes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmatch.functions.text import explicit_label, normalized, trimmed
from planmatch.operators.index import CatalogIndex, plain
from planmatch.operators.spelling import grammar, tried_bodies

MARGIN = 500
NEIGHBOURS = 12


def resolve(readings: DataFrame, catalog: DataFrame | CatalogIndex, *, keep: bool | Callable[[DataFrame], DataFrame] = False, lists: bool = True) -> DataFrame:
    """``readings`` (raw_text, explicit_pole_context and whatever else; without that column it comes from label_text and raw_text) with their resolution.

    It depends on the normalised text and the context alone, and these on the text as read and the context or label: each distinct pair of those is trimmed, normalised and searched for
    a label once, each distinct pair of these is resolved once, and a reading has one join with what is known of its own pair. ``keep`` holds that in memory, and on disk
    beyond it, for plans that use the result more than once, until ``spark.catalog.clearCache()``; or it is what keeps it. ``lists=False`` leaves out matched_source_ids, which are
    as long as an id has records, so that neither a reading nor a hit carries them.
    """
    empty, given = F.lit(""), "explicit_pole_context" in readings.columns
    said = F.coalesce(F.col("explicit_pole_context"), F.lit(False)) if given else F.coalesce(F.col("label_text").cast("string"), empty)
    rows = readings.withColumns({"__text": F.coalesce(F.col("raw_text").cast("string"), empty), "__said": said})
    pair, keys = ["__text", "__said"], ["__norm", "__context"]
    context = F.col("__said") if given else explicit_label("__said") | explicit_label("__text")
    pairs = rows.select(*pair).distinct().withColumn("__trimmed", trimmed("__text")).withColumns({"__norm": normalized("__trimmed"), "__context": context})
    # few bytes a row but much work: as many tasks as shuffles have, which a count given keeps from being merged
    tasks = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = pairs.select(*keys).distinct().repartition(tasks, *keys).withColumn("raw_text", F.col("__norm")).withColumn("explicit_pole_context", F.col("__context"))
    found = resolve_texts(texts, catalog, keys, lists).drop("raw_text", "explicit_pole_context", "raw_normalized_text")
    known = pairs.join(found, keys).withColumnsRenamed({"__trimmed": "raw_text", "__norm": "raw_normalized_text"})
    known = known.drop("__context") if given else known.withColumnRenamed("__context", "explicit_pole_context")
    if keep:
        known = keep(known) if callable(keep) else known.persist()
    own = [c for c in rows.columns if c in pair or c not in known.columns]
    return rows.select(*own).join(known, pair).drop(*pair)


def resolve_texts(readings: DataFrame, catalog: DataFrame | CatalogIndex, keys: list[str], lists: bool = True) -> DataFrame:
    """One row for each of ``readings``, which ``keys`` tell apart; without matched_source_ids where ``lists`` is false."""
    index = catalog if isinstance(catalog, CatalogIndex) else plain(catalog)
    r = grammar(readings, index.letters)
    readable = (F.col("norm") != "") & F.col("unknown").isNull()
    asked = lambda text, how: F.struct(text.alias("text"), F.lit(how).alias("how"))
    bare = F.when(readable, asked(F.col("norm"), 0)), F.when(readable & (F.col("joined") != F.col("norm")) & (F.col("joined") != ""), asked(F.col("joined"), 1))
    behind = F.when(readable & F.col("body_unknown").isNull() & (F.col("body") != ""), asked(F.col("body"), 2))
    # the outer form, as the plain one infers a filter that would be pushed below the distinct texts and read every label's parts
    asks = r.select(*keys, "context", "name", "penalty", F.explode_outer(F.array_compact(F.array(*bare, behind))).alias("v"))
    met = asks.select("*", F.col("v.text").alias("form")).join(index.spellings, "form").filter("case when v.how < 2 then phase = 2 and ord = 0 else phase = 2 or not context end")
    behind = F.col("v.how") == 2
    hit = F.struct(
        F.when(behind, F.col("phase")).otherwise(F.col("v.how")).alias("phase"), F.when(behind, F.col("penalty") + F.col("cost")).otherwise(0).alias("penalty"), F.col("pole_id"),
        F.when(behind, F.concat(F.array("name"), "made")).when(F.col("v.how") == 1, F.array(F.lit("removed_identifier_separators"))).otherwise(F.array().cast("array<string>")).alias("steps"), "match_count", *(["source_ids"] if lists else []), "neighbours",
    )
    hits = met.select(*keys, hit.alias("hit")).groupBy(*keys).agg(F.min("hit.phase").alias("phase"), F.array_sort(F.collect_list("hit")).alias("hits"))
    # sorted by phase first: the first phase's hits lead
    hits = hits.withColumn("hits", F.filter("hits", lambda h: h["phase"] == F.col("phase")))
    r = r.join(hits, keys, "left").join(
        index.shapes.select(F.col("shape").alias("__shape")), F.col("norm_shape") == F.col("__shape"), "left"
    )  # one row at most for each shape
    best, second = F.get("hits", 0), F.get("hits", 1)
    alone = second.isNull() | (second["penalty"] - best["penalty"] >= MARGIN)
    ambiguous = (F.col("phase") >= 2) & ~alone
    known = F.col("__shape").isNotNull()
    status = (
        F.when(F.col("norm") == "", "ignored").when(F.col("unknown").isNotNull(), "unknown_by_design").when(F.col("phase") == 0, "reference_exact").when(F.col("phase") == 1, "reference_resolved")
        .when(F.col("body_unknown").isNotNull(), "unknown_by_design").when(F.col("body").isNull() & ~known, "ignored").when(ambiguous, "reference_ambiguous").when(F.col("phase") >= 2, "reference_resolved").otherwise("not_found")
    )
    method = (
        F.when(F.col("norm") == "", "ignored_empty_text").when(F.col("unknown").isNotNull(), "drafter_marked_pole_unknown").when(F.col("phase") == 0, "catalog_exact")
        .when(F.col("phase") == 1, "catalog_exact_after_separator_removal").when(F.col("body_unknown").isNotNull(), "drafter_marked_pole_unknown").when(F.col("body").isNull() & ~known, "ignored_non_pole_text")
        .when(F.col("body").isNull(), "catalog_exact_not_found").when(ambiguous, "catalog_constrained_ambiguous").when(F.col("phase") >= 2, "catalog_constrained_normalization").otherwise("catalog_constrained_not_found")
    )
    r = r.withColumn("status", status).withColumn("resolution_method", method)
    found, single = F.col("status").isin("reference_exact", "reference_resolved", "reference_ambiguous"), F.col("status").isin("reference_exact", "reference_resolved")
    union = lambda field: F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h[field]))))
    empty = F.array().cast("array<string>")
    near = F.when(single, best["neighbours"]).when(ambiguous & found, union("neighbours")).otherwise(empty)
    r = r.withColumn("base", F.when(F.col("body").isNotNull() & F.col("body_unknown").isNull() & readable, tried_bodies(F.col("body"), F.col("__letters"))).otherwise(empty))
    toggle = lambda t: F.when(t.endswith("F"), F.left(t, F.length(t) - 1)).otherwise(F.concat(t, F.lit("F")))
    more = F.when(F.col("context"), empty).otherwise(F.filter(F.transform("base", toggle), lambda t: t != ""))
    tried = (
        F.when(F.col("norm") == "", empty).when(F.col("unknown").isNotNull(), F.array("unknown")).when(F.col("phase") == 0, F.array("norm")).when(F.col("phase") == 1, F.array("norm", "joined"))
        .when(F.col("body_unknown").isNotNull(), F.array("body")).when(F.col("body").isNull(), F.array("norm")).when(F.col("phase") == 2, F.col("base")).otherwise(F.concat("base", more))
    )
    own = F.when(F.col("phase") == 0, F.col("norm")).when(F.col("phase") == 1, F.col("joined")).otherwise(F.col("body"))
    toggles = F.arrays_overlap(best["steps"], F.array(F.lit("added_terminal_f"), F.lit("removed_terminal_f")))
    r = r.withColumn("__near", near)
    scored = F.transform("hits", lambda h: F.struct(h["pole_id"].alias("pole_id"), ((10000 - h["penalty"]) / 10000.0).alias("confidence"), h["steps"].alias("transformations"), (own.endswith("F") == h["pole_id"].endswith("F")).alias("f_suffix_agrees")))
    out = {
        "raw_text": F.col("raw"), "raw_normalized_text": F.col("norm"), "status": F.col("status"), "resolution_method": F.col("resolution_method"), "resolved_pole_id": F.when(single, best["pole_id"]),
        "transformations": F.when(single, best["steps"]).otherwise(empty), "candidate_variants": tried,
        "match_count": F.when(single, best["match_count"]).when(F.col("status") == "reference_ambiguous", F.size("hits").cast("long")).otherwise(F.lit(0).cast("long")),
        **({"matched_source_ids": F.when(single, best["source_ids"]).when(F.col("status") == "reference_ambiguous", union("source_ids")).otherwise(empty)} if lists else {}),
        "resolution_confidence": F.when(found, (10000 - best["penalty"]) / 10000.0).otherwise(0.0), "scored_candidates": F.when(found, scored),
        "f_suffix_agrees": F.when(single, own.endswith("F") == best["pole_id"].endswith("F")), "id_neighborhood_count": F.size("__near").cast("long"), "id_neighborhood_ids": F.slice("__near", 1, NEIGHBOURS),
        "requires_spatial_confirmation": F.when(single, (F.size("__near") > 0) | toggles).otherwise(F.col("status") == "reference_ambiguous"),
    }
    given = [c for c in readings.columns if c not in out]
    return r.select(*given, *(v.alias(k) for k, v in out.items()))
