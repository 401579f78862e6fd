"""The whole flow over tables: text and images of many documents to poles and permits, every step a DataFrame keyed by document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmatch.functions.text import explicit_label
from planmatch.operators import evidence, geometry, merge, native, pages, permits, replies, resolver
from planmatch.operators.index import CatalogIndex

DOC, PAGE, TILE = ["doc_id"], ["doc_id", "page_number"], ["doc_id", "page_number", "tile_index"]


class Held:
    """Keeps what several relations are made from as it is computed first, until ``spark.catalog.clearCache()``. A plan that grows from it still holds all that it was made from."""

    def __call__(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.persist()


class Tabled:
    """Writes it to a table below ``folder`` and goes on from there: plans stay as short as their own step, and no lost executor loses it."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __call__(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.folder}/{name}")


Keep = Callable[[str, DataFrame], DataFrame]
Looked = DataFrame | Callable[[DataFrame], DataFrame]


def visual(readings: DataFrame, catalog: DataFrame | CatalogIndex, *, keys: list[str], tile_keys: list[str], threshold: float = 0.80, keep: Keep | None = None) -> dict[str, DataFrame]:
    """Parsed readings (tile_keys, pos, raw_text, label_text, model_*) to judged candidates."""
    if "explicit_pole_context" not in readings.columns:
        readings = readings.withColumn("explicit_pole_context", explicit_label("label_text") | explicit_label("raw_text"))
    keep = keep or Held()
    resolved = keep("resolved", resolver.resolve(readings, catalog, keep=lambda texts: keep("texts", texts)))
    judged = keep("judged", evidence.judged(evidence.candidates(resolved, tile_keys), keys, threshold))
    return {"resolved": resolved, "ignored": evidence.ignored(resolved), "judged": judged, "review_queue": evidence.review_queue(judged)}


def selected_pages(inspected: DataFrame, summaries: DataFrame, found: DataFrame) -> DataFrame:
    """Pages that go on to visual reading. Text pages without a match go on only in documents whose whole text has no exact match."""
    matched = found.filter("match_status = 'reference_exact'").select(*DOC).distinct()
    bare = inspected.filter("content_type = 'embedded_text'").join(matched, DOC, "left_anti")
    both = pages.select(inspected, summaries, keys=PAGE).unionByName(pages.select(bare, summaries, keys=PAGE, with_unmatched_text=True))
    return both.groupBy(*PAGE).agg(F.max_by("content_type", F.size("reasons")).alias("content_type"), F.max_by("reasons", F.size("reasons")).alias("reasons"))


def discover(*, catalog: DataFrame | CatalogIndex, records: DataFrame | None = None, inspections: DataFrame, words: DataFrame, previews: Looked, tile_replies: Looked, documents: DataFrame, keep: Keep | None = None) -> dict[str, DataFrame]:
    """All relations up to poles and the status of each of ``documents`` (doc_id), for any number of documents, which doc_id tells apart throughout.

    inspections, words (raw): doc_id, page_number, ...; previews: doc_id, page_number, raw_response, or what makes them of the selected pages; tile_replies: doc_id, page_number,
    tile_index, raw_response, or what makes them of the grid of tiles. ``records`` are the catalog's where ``catalog`` is an index. What several relations are made from (candidates in text,
    selected pages, assessments, tiles, resolved and judged readings, poles) goes through ``keep``, which holds it by default; all else is lazy.
    """
    records = records if records is not None else catalog
    keep = keep or Held()
    word_rows = native.words(words, DOC)
    found = keep("native", native.candidates(word_rows, records, DOC))
    summaries = native.page_summary(inspections, word_rows, found, DOC)
    inspected = pages.inspect(inspections)
    selected = keep("selected", selected_pages(inspected, summaries, found))
    asked = previews(selected) if callable(previews) else previews
    assessed = keep("assessed", replies.assessments(asked.join(selected.select(*PAGE), PAGE, "left_semi")))
    routed = pages.route(assessed, 0.90)
    chosen = pages.relevant(routed, selected, PAGE)
    grid = keep("grid", pages.tiles(inspected.join(chosen.select(*PAGE), PAGE, "left_semi"), keys=PAGE))
    asked = (tile_replies(grid) if callable(tile_replies) else tile_replies).join(grid.select(*TILE), TILE, "left_semi")
    seen = visual(replies.readings(asked, TILE), catalog, keys=PAGE, tile_keys=TILE, keep=keep)
    poles = keep("poles", merge.accepted(found, seen["judged"], records, DOC))
    return {
        "native": found, "summaries": summaries, "selected": selected, "routed": routed, "skipped": pages.skipped(routed, PAGE), "tiles": grid, **seen, "poles": poles,
        "status": merge.status(poles, seen["judged"], documents.select(*DOC)), "totals": evidence.totals(seen["judged"], seen["ignored"], assessed, replies.errors(asked)),
    }


def permitted(numbered: DataFrame, poles: DataFrame) -> dict[str, DataFrame]:
    """Permits with their work areas, and pole rows, of ``numbered`` requests (doc_id, number, permit_number)."""
    numbered = permits.identified(numbered)
    permit = permits.permit_rows(numbered, poles, DOC)
    return {"permits": geometry.polygons(permit, geometry.work_areas(poles, DOC), DOC), "pole_rows": permits.pole_rows(numbered, poles, DOC)}


def run(*, catalog: DataFrame | CatalogIndex, requests: DataFrame, year: int, last_number: int = 0, **tables) -> dict[str, DataFrame]:
    """Discovery, as ``discover`` has it, and permits of ``requests`` (doc_id, submitted_at) in one go. A request without poles has a permit without a work area; a document without a request has none."""
    found = discover(catalog=catalog, documents=requests, **tables)
    numbered = permits.numbers(requests, last_number, by=["submitted_at", "doc_id"], year=F.lit(year))
    return found | permitted(numbered, found["poles"])
