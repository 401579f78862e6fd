"""Registered queries: each operator over its whole input view. Arrays are joined to text, so that both engines print them alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.functions.text import explicit_label, normalized, plan_prefix, shape, unknown_body, unwrapped, without_separators
from planmatch.functions.values import coverage
from planmatch.operators import catalog as cat
from planmatch.operators import evidence, geometry, index, merge, native, pages, permits, replies, resolver, spelling
from planmatch.plans import fixtures as fx
from planmatch.sources import pdf
from planmatch.sources.shared import cut
from planmatch.streaming import jobs

TILE, PAGE = ["page_number", "tile_index"], ["page_number"]
REPLY = [*TILE, "reply"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(c: str | Column, name: str | None = None) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(name or c)


# ---------------------------------------------------------------- catalog


@query
def catalog_load(spark, d):
    return fx.catalog(spark, d).select("source_id", "pole_id_raw", "pole_id_normalized", "x", "y")


@query
def catalog_summary(spark, d):
    return cat.summary(fx.catalog(spark, d))


@query
def catalog_shapes_top20(spark, d):
    return cat.top_shapes(fx.catalog(spark, d))


@query
def catalog_leading_letters(spark, d):
    return cat.leading_letters(fx.catalog(spark, d))


@query
def catalog_coordinates(spark, d):
    return cat.coordinates(fx.catalog(spark, d))


@query
def catalog_neighbourhood(spark, d):
    return cat.neighbourhood(fx.catalog(spark, d)).select("pole_id", F.size("neighbours").alias("neighbour_count"), joined(F.slice("neighbours", 1, 12), "first_neighbours"))


@query
def catalog_duplicates(spark, d):
    return cat.duplicates(fx.catalog(spark, d))


@query
def catalog_records(spark, d):
    """Each id's records, those of one place in systems S and D told once."""
    merged = fx.catalog(spark, d).withColumn("source_id", F.when(F.col("source_id").startswith("T"), "T").otherwise("S"))
    found = cat.by_id(merged, records=True)
    return found.select("pole_id", "match_count", F.posexplode("records").alias("place", "r")).select("pole_id", "match_count", "place", "r.source_id", "r.pole_id_raw", "r.x", "r.y")


@query
def catalog_by_source(spark, d):
    """Records of one asset number in all systems, repeated ones kept."""
    assets = fx.catalog(spark, d).withColumn("source_id", F.substring("source_id", 2, 20))
    return cat.by_source(assets).select("source_id", F.posexplode("records").alias("place", "r")).select("source_id", "place", "r.pole_id_normalized", "r.pole_id_raw", "r.x", "r.y")


# ---------------------------------------------------------------- lookups


@query
def exact_match(spark, d):
    found = cat.exact_match(fx.readings(spark, d).withColumn("norm", normalized("raw_text")), "norm", fx.catalog(spark, d))
    return found.select(*TILE, "pos", "raw_text", "source_id", "x", "y")


@query
def exact_match_outer(spark, d):
    found = cat.match_exact(fx.readings(spark, d), "raw_text", fx.catalog(spark, d))
    return found.select(*TILE, "pos", "candidate_normalized", "match_status", "match_count", joined("source_ids"))


# ---------------------------------------------------------------- text


@query
def native_words(spark, d):
    return fx.words(spark, d).select("page_number", "line_number", "word_number", "normalized_text", *(F.get("bbox", i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query
def native_single_tokens(spark, d):
    w = fx.words(spark, d).withColumn("raw_text", F.col("text"))
    found = native.evaluate(w.drop("normalized_text"), fx.text_catalog(spark, d))
    return found.select("page_number", "line_number", "word_number", "normalized_text", "match_status", "match_count")


@query
def native_adjacent_pairs(spark, d):
    return native.pairs(fx.lines(spark, d)).select("page_number", "line_number", "word_number", "raw_text", *(F.get("bbox", i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def _native(spark, d):
    return native.candidates(fx.lines(spark, d), fx.text_catalog(spark, d))


@query
def native_candidates(spark, d):
    return native.in_reading_order(_native(spark, d)).select("page_number", "raw_text", "normalized_text", "match_status", "match_count", joined("matched_source_ids"), *(F.get("bbox", i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def _summaries(spark, d):
    all_pages = fx.table(spark, d, "documents").select((F.col("doc_id") + 1).alias("page_number"))
    return native.page_summary(all_pages, fx.lines(spark, d), _native(spark, d))


@query
def native_page_summary(spark, d):
    return _summaries(spark, d)


@query
def native_totals(spark, d):
    out = native.totals(_summaries(spark, d), _native(spark, d))
    return out.select("page_count", "native_word_count", "exact_match_occurrence_count", "pattern_candidate_count", joined("exact_unique_pole_ids"), joined("pages_without_native_text"))


# ---------------------------------------------------------------- pages


@query
def page_classify(spark, d):
    return pages.inspect(fx.pages(spark, d)).select("doc_id", "page_number", "has_embedded_text", "has_images", "likely_scanned_page", "content_type")


@query
def image_coverage(spark, d):
    p = fx.pages(spark, d)
    # one box for each image: the k-th covers the k-th part of the page's height, the last reaches over its edge
    boxes = F.expr("transform(sequence(1, greatest(image_count, 1)), k -> case when image_count = 0 or k = 3 then null else array(0.0D, 0.0D, width_points * k * largest_image_coverage, height_points) end)")
    return p.select("doc_id", "page_number", coverage(boxes, F.col("width_points") * F.col("height_points")).alias("coverage"))


def _page_counts(p: DataFrame) -> DataFrame:
    """Summaries of six pages in seven: a page without one is part of what is tested, as its reasons then come from its inspection alone."""
    n = F.col("page_number")
    return p.filter(n % 7 != 0).select("doc_id", "page_number", F.col("embedded_word_count").alias("native_word_count"), (n % 3).alias("exact_match_count"), (n % 2).alias("pattern_match_count"))


@query
def page_select(spark, d):
    p = fx.pages(spark, d)
    return pages.select(pages.inspect(p), _page_counts(p), keys=["doc_id", "page_number"], with_unmatched_text=True).select("doc_id", "page_number", "content_type", joined("reasons"))


PREVIEW = (
    "case when page_number % 11 = 0 then 'not readable' else concat('{{\"contains_pole_drawing\": ', case when page_number % 5 = 0 then 'true' else '\"no\"' end, ', \"contains_facility_ids\": ', case when page_number % 13 = 0 then '1' else '0' end, "
    "', \"confidence\": ', case when page_number % 3 = 0 then '\"0.95\"' else '0.5' end, ', \"reason\": \" page ', cast(page_number as {text}), ' \"}}') end"
)


def _routed(spark, d):
    previews = fx.pages(spark, d).withColumn("raw_response", F.expr(PREVIEW.format(text="string")))
    return pages.route(replies.assessments(previews.select("doc_id", "page_number", "raw_response")), 0.90)


@query
def preview_route(spark, d):
    return _routed(spark, d).select("doc_id", "page_number", *pages.FLAGS[:2], "confidence", "reason", F.col("error").isNotNull().alias("failed"), "relevant_for_tiles")


@query
def skipped_pages(spark, d):
    return pages.skipped(_routed(spark, d), ["doc_id", "page_number"])


@query
def tile_grid(spark, d):
    grid = pages.tiles(fx.pages(spark, d), keys=["doc_id", "page_number"])
    return grid.select("doc_id", "page_number", "tile_index", "tile_row", "tile_column", *(F.get("pdf_bbox", i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


# ---------------------------------------------------------------- replies and labels


@query
def reply_parse(spark, d):
    return replies.readings(fx.replies(spark, d), REPLY)


@query
def reply_salvage(spark, d):
    """Replies inside prose: the first JSON value is taken out of them."""
    wrapped = fx.replies(spark, d).withColumn("raw_response", F.concat(F.lit("Here is {what} I found: "), F.regexp_replace("raw_response", "```(json)?", ""), F.lit(" -- done")))
    return replies.readings(wrapped, REPLY)


def _labelled(spark, d):
    return fx.readings(spark, d).withColumn("explicit_pole_context", explicit_label("label_text") | explicit_label("raw_text"))


@query
def explicit_pole_label(spark, d):
    return _labelled(spark, d).select(*TILE, "pos", "raw_text", "label_text", "explicit_pole_context")


@query
def prefix_removal(spark, d):
    r = fx.readings(spark, d).withColumn("norm", normalized(unwrapped("raw_text"))).withColumn("letters", cat.letters_array(fx.catalog(spark, d)))
    r = r.withColumn("p", plan_prefix("norm", F.col("letters")))
    return r.select(*TILE, "pos", "norm", shape("norm").alias("shape"), unknown_body("norm").alias("unknown_body"), without_separators("norm").alias("joined"), F.col("p.body").alias("body"), F.col("p.name").alias("transformation"))


@query
def variants(spark, d):
    """Spelled once for each distinct text and label, and written out where readings meet them."""
    pairs = fx.readings(spark, d).select("raw_text", "label_text").distinct()
    pairs = pairs.withColumns({"__norm": normalized("raw_text"), "explicit_pole_context": explicit_label("label_text") | explicit_label("raw_text")})
    keys = ["__norm", "explicit_pole_context"]
    texts = pairs.select(*keys).distinct().withColumn("raw_text", F.col("__norm"))
    each = F.transform("variants", lambda v: F.struct(v["phase"].alias("phase"), v["text"].alias("text"), v["penalty"].alias("penalty"), F.array_join(v["steps"], ",").alias("steps")))
    spelt = spelling.spelled(texts, fx.catalog(spark, d)).select(*keys, each.alias("variants"))
    known = _texts(pairs.join(spelt, keys).select("raw_text", "label_text", "variants"))
    return fx.readings(spark, d).join(known, ["raw_text", "label_text"]).select(*TILE, "pos", F.inline("variants"))


def _texts(known: DataFrame) -> DataFrame:
    """What is known of distinct texts, resolved once for all uses; broadcast where they are counted to be few and have no lists as long as an id has records."""
    known = cut(known)
    return F.broadcast(known) if "matched_source_ids" not in known.columns and cat.few(known) else known


def _resolved(spark, d, lists: bool = False, firsts: bool = False):
    """All readings resolved, or with ``firsts`` the first of each text and label in a tile: all that candidates are taken from."""
    readings = fx.readings(spark, d)
    readings = evidence.first_read(readings, TILE, ["raw_text", "label_text"]) if firsts else readings
    return resolver.resolve(readings, index.kept(fx.catalog(spark, d)), keep=_texts, lists=lists)


@query
def resolve(spark, d):
    return _resolved(spark, d, lists=True).select(
        *TILE, "pos", "raw_normalized_text", "status", "resolution_method", "resolved_pole_id", joined("transformations"), joined("candidate_variants"), "match_count", joined("matched_source_ids"),
        "resolution_confidence", "f_suffix_agrees", "id_neighborhood_count", joined("id_neighborhood_ids"), "requires_spatial_confirmation",
    )


@query
def resolve_status_counts(spark, d):
    return _resolved(spark, d).groupBy("status", "resolution_method").agg(F.count("*").alias("readings"))


@query
def ambiguous_readings(spark, d):
    a = _resolved(spark, d).filter("status = 'reference_ambiguous'")
    return a.select(*TILE, "pos", "raw_text", joined(F.transform("scored_candidates", lambda c: F.concat(c["pole_id"], F.lit(":"), (c["confidence"] * 10000).cast("int").cast("string"))), "ranked"))


def _judged(spark, d, resolved: DataFrame | None = None):
    """The rules join a page's candidates with its longer ids: candidates are used twice, and made once."""
    found = evidence.candidates(_resolved(spark, d, firsts=True) if resolved is None else resolved, TILE)
    found = found.select(*TILE, "pos", "normalized_text", "catalog_match_status", "catalog_match_count", "resolution_confidence", "model_confidence", "model_reports_complete", "model_reports_edge_clipped")
    return evidence.judged(cut(found), PAGE)


@query
def tile_dedupe(spark, d):
    return evidence.candidates(_resolved(spark, d, firsts=True), TILE).select(*TILE, "pos", "normalized_text", "catalog_match_status", "catalog_match_count")


@query
def evidence_rules(spark, d):
    return _judged(spark, d).select(*TILE, "pos", "normalized_text", joined("review_reasons"), "acceptance_status")


@query
def visual_dedupe(spark, d):
    return evidence.by_pole(_judged(spark, d), sources=index.kept(fx.catalog(spark, d)).ids).select("pole_id", joined("pages"), "tile_observation_count", "maximum_model_confidence", "catalog_match_count", joined("matched_source_ids"))


@query
def visual_totals(spark, d):
    resolved = _resolved(spark, d)
    return evidence.totals(_judged(spark, d, resolved), evidence.ignored(resolved))


@query
def unmatched_ids(spark, d):
    return evidence.unmatched(_judged(spark, d))


@query
def review_queue(spark, d):
    reasons = evidence.review_queue(_judged(spark, d)).select("page_number", F.explode("review_reasons").alias("reason"))
    return reasons.groupBy("page_number", "reason").agg(F.count("*").alias("observations"))


# ---------------------------------------------------------------- merged poles


def _places(spark, d) -> DataFrame:
    """The catalog's coordinates by id, made once: what a join on them infers isn't pushed to records, to be told of each in the few tasks that read them."""
    return cut(cat.coordinates(fx.catalog(spark, d)))


def _pages_of_text(spark, d, ids: DataFrame) -> DataFrame:
    """Native candidates: readings that print an id in full on every third page. The other pages stand for scans, so that poles are found in text, in images
    and in both: the merge needs all three."""
    # a page's poles don't count how often it names them: distinct texts are normalised, not readings, to which Catalyst would push what the join infers of the normal form
    r = cut(fx.readings(spark, d).filter("page_number % 3 = 0").select("page_number", "raw_text").distinct()).withColumn("normalized_text", normalized("raw_text"))
    return r.join(ids.select(F.col("pole_id").alias("normalized_text")), "normalized_text").withColumn("match_status", F.lit("reference_exact"))


def _poles(spark, d, judged: DataFrame | None = None):
    places = _places(spark, d)
    return merge.accepted(_pages_of_text(spark, d, places), _judged(spark, d) if judged is None else judged, places=places)


@query
def merge_poles(spark, d):
    return _poles(spark, d).select("pole_id", joined("discovery_sources"), joined("pages"), "confidence")


@query
def accepted_with_coordinates(spark, d):
    return _poles(spark, d).select("pole_id", "x", "y", "confidence")


@query
def accepted_poles_by_page(spark, d):
    """Accepted visual poles of each page with their coordinates."""
    found = evidence.by_pole(_judged(spark, d).withColumn("page", F.col("page_number")), ["page"])
    return found.join(_places(spark, d), "pole_id").select("page", "pole_id", "x", "y", "tile_observation_count", "maximum_model_confidence")


@query
def discovery_status(spark, d):
    judged = _judged(spark, d)
    return merge.status(_poles(spark, d, judged), judged)


# ---------------------------------------------------------------- permits


def _requests(spark, d):
    return fx.pages(spark, d).select("doc_id").distinct().withColumn("submitted_at", (F.col("doc_id") * 37) % 50)


def _numbered(spark, d):
    return permits.numbers(_requests(spark, d), 1337, by=["submitted_at", "doc_id"], year=F.lit(2026))


def _permit_poles(spark, d):
    """Poles of permits: the accepted poles of a page belong to the permit of that number less one. One permit in ten has none: it has to stay, with counts of zero."""
    found = evidence.accepted(_judged(spark, d)).groupBy((F.col("page_number") - 1).cast("long").alias("doc_id"), F.col("normalized_text").alias("pole_id")).agg(F.max("resolution_confidence").alias("confidence"))
    return found.join(_places(spark, d), "pole_id").filter("doc_id % 10 <> 3")


@query
def permit_numbers(spark, d):
    return _numbered(spark, d).select("doc_id", "number", "permit_number")


@query
def permit_rows(spark, d):
    return permits.permit_rows(_numbered(spark, d), _permit_poles(spark, d), ["doc_id"]).select("doc_id", *permits.WORK_AREA_FIELDS)


@query
def pole_rows(spark, d):
    return permits.pole_rows(permits.identified(_numbered(spark, d)), _permit_poles(spark, d), ["doc_id"])


@query
def work_area_ring(spark, d):
    areas = geometry.work_areas(_permit_poles(spark, d), ["doc_id"])
    return areas.select("doc_id", F.posexplode("ring").alias("vertex", "p")).select("doc_id", "vertex", F.get("p", 0).alias("x"), F.get("p", 1).alias("y"))


@query
def work_area_bbox(spark, d):
    areas = geometry.work_areas(_permit_poles(spark, d), ["doc_id"])
    part = lambda i: F.transform("ring", lambda p: F.get(p, i))
    ends = {f"{f}_{c}": F.round((F.array_min if f == "min" else F.array_max)(part(i)), 4) for i, c in enumerate("xy") for f in ("min", "max")}
    return areas.select("doc_id", *(v.alias(k) for k, v in ends.items()))


@query
def work_area_size(spark, d):
    areas = geometry.measured(geometry.work_areas(_permit_poles(spark, d), ["doc_id"]))
    return areas.select("doc_id", F.round("area", 2).alias("area"), F.round("perimeter", 2).alias("perimeter"))


@query
def field_resolution(spark, d):
    """Pole rows under the names of a sink that spells its fields another way."""
    rows = permits.pole_rows(_numbered(spark, d), _permit_poles(spark, d), ["doc_id"]).drop("doc_id", "wkid")
    return permits.fitted(rows, ["OBJECTID", "Permit_Number", "POLE_ID", "Pole_Owner", "Confidence", "STATUS", "X", "Y"], ["permit_number", "pole_id", "pole_owner", "confidence", "status", "x", "y"])


@query
def message_text(spark, d):
    e = fx.table(spark, d, "events")
    rows = e.select(
        F.when(F.col("event_type") != "click", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))).alias("to_address"), F.concat(F.lit("Reviewer "), F.col("event_type")).alias("sender_label"),
        F.col("props").alias("body"), F.when(F.col("event_type") == "view", F.concat(F.col("event_id").cast("string"), F.lit("\r\n-2026"))).when(F.col("event_type") == "signup", "").alias("permit_number"),
    )
    return permits.messages(rows)


@query
def pdf_validate(spark, d):
    """Checks on bytes, over events as files: some with another suffix, empty, too large or without a header."""
    e = fx.table(spark, d, "events")
    n = F.col("event_id")
    rows = e.select(
        "event_id", F.concat(F.lit("/plans/"), n.cast("string"), F.when(n % 7 == 0, ".txt").when(n % 2 == 0, ".PDF").otherwise(".pdf")).alias("path"),
        F.when(n % 5 == 0, 0).when(n % 11 == 0, 600 * 1024 * 1024).otherwise(n + 1).cast("long").alias("length"), F.encode(F.when(n % 3 == 0, "no header").otherwise("..%PDF-1.7"), "UTF-8").alias("content"),
    )
    return pdf.validated(rows).select("event_id", "error")


# ---------------------------------------------------------------- jobs


@query
def job_state(spark, d):
    return jobs.state(fx.jobs(spark, d).withColumn("text", F.concat(F.lit("event "), F.col("event_id").cast("string"))))


@query
def job_view(spark, d):
    return jobs.serialized(jobs.state(fx.jobs(spark, d).withColumn("text", F.concat(F.lit("event "), F.col("event_id").cast("string")))))


@query
def progress_running_count(spark, d):
    tiles = evidence.candidates(_resolved(spark, d, firsts=True), TILE).groupBy(*TILE).agg(F.count("*").alias("candidate_count"))
    return jobs.progress(tiles, TILE)


