"""Candidates in a document's own text: single words and neighbours on a line, matched against the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planmatch.functions.text import WS, letter_and_digit, normalized, shape, unwrapped
from planmatch.operators import catalog as cat
from planmatch.operators.bloom import bloom


def words(raw: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Word rows with normalised text and boxes to three places; blank words are left out. ``keys`` tell documents apart, here and below."""
    box = F.array(*[F.round(c, 3) for c in ("x0", "y0", "x1", "y1")])
    seen = raw.filter(F.col("text").rlike(WS.replace("[", "[^", 1)))
    return seen.select(*(keys or []), "page_number", "page_index", "text", normalized("text").alias("normalized_text"), box.alias("bbox"), "block_number", "line_number", "word_number")


PLACE = ["page_number", "page_index", "block_number", "line_number"]


def lines(raw: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row for each line with its ``words`` (array of word_number, text, x0, y0, x1, y1 in order of their numbers), from a source that has them so; blank words are left out.

    Words stay nested until they match: a page's words are never sorted or shuffled as rows.
    """
    # most words begin with a visible character of ASCII, which is told without a pattern
    seen = F.filter("words", lambda w: (w["text"] >= "!") & (w["text"] < "\x7f") | w["text"].rlike(WS.replace("[", "[^", 1)))
    return raw.select(*(keys or []), *PLACE, seen.alias("words"))


def nested(word_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same of word rows, as ``words`` gives them: gathered by line, which bounds what a task holds."""
    word = F.struct("word_number", "text", *[F.get("bbox", i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    return word_rows.groupBy(*(keys or []), *PLACE).agg(F.array_sort(F.collect_list(word)).alias("words"))


def rows_of(line_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Word rows of lines."""
    return words(line_rows.select(*(keys or []), *PLACE, F.inline("words")), keys)


def _read(line_rows: DataFrame, keys: list[str], singles: bool) -> DataFrame:
    """Pairs of words whose numbers follow each other, made by zipping a line with itself, and perhaps the words themselves: raw_text, pass, word_number, x0, y0, x1, y1."""
    if "words" not in line_rows.columns:
        line_rows = nested(line_rows, keys)
    reading = lambda text, turn, w, *box: F.struct(text.alias("raw_text"), F.lit(turn).alias("pass"), w["word_number"].alias("word_number"), *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))])
    both = lambda a, b: F.when(b["word_number"] == a["word_number"] + 1, reading(F.concat_ws(" ", a["text"], b["text"]), 1, a, F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])))
    found = F.array_compact(F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))), both))
    if singles:
        found = F.concat(F.transform("words", lambda w: reading(w["text"], 0, w, w["x0"], w["y0"], w["x1"], w["y1"])), found)
    return line_rows.select(*keys, *PLACE, F.inline(found))


def _boxed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bbox", F.array(*[F.round(c, 3) for c in ("x0", "y0", "x1", "y1")])).drop("x0", "y0", "x1", "y1")


def pairs(word_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each word with its successor on the line, where their numbers follow each other: raw_text, bbox. Takes lines or word rows."""
    keys = keys or []
    return _boxed(_read(word_rows, keys, singles=False)).select(*keys, *PLACE, "word_number", "raw_text", "bbox")


def evaluate(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose text is a catalog id, or has a letter, a digit and the shape of one.

    Nearly all texts are neither: they are dropped where they stand, against ids and shapes that are broadcast when counted to be few, or else against
    filters made of them; only the rest is shuffled.
    """
    bare = rows.withColumn("normalized_text", normalized(unwrapped("raw_text")))
    ids = cat.by_id(catalog).select(F.col("pole_id").alias("id"), "match_count", "source_ids")
    few = cat.few(ids)
    # only the ids travel: their counts and sources join the few rows that matched
    known = ids.select("id")
    shapes = cat.shapes(catalog).select(F.col("shape").alias("known_shape"))
    matched = _matched(bare, F.broadcast(known), F.broadcast(shapes)) if few else _matched(_likely(bare, known, shapes), known, shapes)
    found = matched.join(ids, F.col("normalized_text") == F.col("id"), "left")
    return found.select(*bare.columns, "match_status", F.coalesce("match_count", F.lit(0)).alias("match_count"), F.coalesce("source_ids", F.array().cast("array<string>")).alias("matched_source_ids"))


def _likely(texts: DataFrame, ids: DataFrame, shapes: DataFrame) -> DataFrame:
    """``texts`` without nearly all that are no id and have no id's shape."""
    shaped = letter_and_digit("normalized_text") & bloom(shapes, "known_shape").might_hold(shape("normalized_text"))
    return texts.filter((F.col("normalized_text") != "") & (bloom(ids, "id").might_hold(F.col("normalized_text")) | shaped))


def _matched(texts: DataFrame, ids: DataFrame, shapes: DataFrame) -> DataFrame:
    """Those of ``texts`` (normalized_text and more) that match, with match_status."""
    exact = texts.join(ids.withColumnRenamed("id", "known_id"), F.col("normalized_text") == F.col("known_id"), "left")
    # a join key is a column of its own: a sort would evaluate an expression at each comparison
    shaped = exact.withColumn("own_shape", F.when(F.col("known_id").isNull() & letter_and_digit("normalized_text"), shape("normalized_text")))
    shaped = shaped.join(shapes, F.col("own_shape") == F.col("known_shape"), "left").filter("normalized_text <> '' and (known_id is not null or known_shape is not null)")
    return shaped.select(*texts.columns, F.when(F.col("known_id").isNotNull(), "reference_exact").otherwise("reference_pattern").alias("match_status"))


def candidates(word_rows: DataFrame, catalog: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Single words and pairs, the first of each page, box, text and status: single words come first, in reading order.

    A line gives its words and their pairs in one pass. Takes lines or word rows.
    """
    found = _boxed(evaluate(_read(word_rows, keys or [], singles=True), catalog))
    first = Window.partitionBy(*(keys or []), "page_index", "bbox", "normalized_text", "match_status").orderBy("pass", "block_number", "line_number", "word_number")
    return found.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def in_reading_order(found: DataFrame) -> DataFrame:
    return found.orderBy("page_index", F.get("bbox", 1), F.get("bbox", 0), "normalized_text", "pass", "block_number", "line_number", "word_number")


def page_summary(pages: DataFrame, word_rows: DataFrame, found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts for every page of ``pages`` (keys, page_number), those without words included."""
    keys = [*(keys or []), "page_number"]
    w = word_rows.groupBy(*keys).agg((F.sum(F.size("words")) if "words" in word_rows.columns else F.count("*")).alias("native_word_count"))
    c = found.groupBy(*keys).agg(
        F.count("*").alias("candidate_count"), F.count_if(F.col("match_status") == "reference_exact").alias("exact_match_count"), F.count_if(F.col("match_status") == "reference_pattern").alias("pattern_match_count")
    )
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return pages.select(*keys).distinct().join(w, keys, "left").join(c, keys, "left").select(
        *keys, (F.col("page_number") - 1).alias("page_index"), *map(zero, ("native_word_count", "candidate_count", "exact_match_count", "pattern_match_count"))
    )


def totals(summaries: DataFrame, found: DataFrame) -> DataFrame:
    """One row for the document."""
    exact = F.col("match_status") == "reference_exact"
    c = found.agg(F.count_if(exact).alias("exact_match_occurrence_count"), F.array_sort(F.collect_set(F.when(exact, F.col("normalized_text")))).alias("exact_unique_pole_ids"), F.count_if(~exact).alias("pattern_candidate_count"))
    p = summaries.agg(F.count("*").alias("page_count"), F.coalesce(F.sum("native_word_count"), F.lit(0)).alias("native_word_count"), F.array_sort(F.collect_set(F.when(F.col("native_word_count") == 0, F.col("page_number")))).alias("pages_without_native_text"))
    return p.join(c)
