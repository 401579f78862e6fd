"""Tolerant coercions, boxes, tiles and classes of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planmatch.functions.text import col, trimmed

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def once(value: Column, body) -> Column:
    """``body`` over ``value`` as a lambda variable: evaluated once, where a plain reference would be written out at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(c: Column | str) -> Column:
    """A text as double, or null; underscores between digits are allowed, type suffixes aren't."""
    bare = lambda t: F.when(F.contains(t, F.lit("_")), F.regexp_replace(t, r"(?<=[0-9])_(?=[0-9])", "")).otherwise(t)
    return once(once(trimmed(c), bare), lambda x: F.when(x.rlike(NUMBER), x.try_cast("double")))


def text_or_null(c: Column | str) -> Column:
    return F.nullif(trimmed(col(c).cast("string")), F.lit(""))


def unit(c: Column | str) -> Column:
    """Clamped to 0..1; NaN stays."""
    return F.when(F.isnan(col(c)), col(c)).otherwise(F.least(F.greatest(col(c), F.lit(0.0)), F.lit(1.0)))


def confidence(text: Column) -> Column:
    """A JSON scalar as text (true and false included) as confidence: 0 where it is no number."""
    value = once(text, lambda t: F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(number(t)))
    return once(F.coalesce(value, F.lit(0.0)), lambda v: F.round(unit(v), 4))


def flag(text: Column) -> Column:
    """A JSON scalar as text as a boolean: words, and numbers other than zero."""
    return once(
        F.lower(trimmed(text)), lambda w: F.when(w.isin("true", "yes", "1"), True).when(w.isin("false", "no", "0"), False).otherwise(F.coalesce(number(w) != 0, F.lit(False)))
    )


def whole(c: Column | str, least: int, default: Column | int) -> Column:
    """An integer of at least ``least``, or the default."""
    value = col(c).try_cast("int")
    return F.when(value >= least, value).otherwise(default)


def integer_set(c: Column | str) -> Column:
    """The distinct integers above zero of an array, in order; what is no integer is left out."""
    numbers = F.transform(col(c), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(numbers, F.array().cast("array<int>")), lambda x: x > 0)))


def render_scale(dpi: float) -> float:
    """Pixels for each point of a page."""
    return dpi / 72.0


def joined_box(a: Column, b: Column) -> Column:
    """Smallest box around two, to three places."""
    low, high = F.least, F.greatest
    return F.array(*[F.round(f(F.get(a, i), F.get(b, i)), 3) for i, f in enumerate((low, low, high, high))])


def content_type(words: Column, images: Column, coverage: Column) -> Column:
    return (
        F.when((words > 0) & (images > 0), "mixed").when(words > 0, "embedded_text").when((images > 0) & (coverage >= 0.75), "likely_scanned").when(images > 0, "image_only").otherwise("vector_or_empty")
    )


def coverage(boxes: Column, page_area: Column) -> Column:
    """Largest share of the page that one box covers; boxes: array of arrays of four numbers, nulls skipped."""
    area = lambda b: F.greatest(F.get(b, 2) - F.get(b, 0), F.lit(0.0)) * F.greatest(F.get(b, 3) - F.get(b, 1), F.lit(0.0))
    shares = F.transform(F.filter(boxes, lambda b: b.isNotNull()), lambda b: unit(area(b) / page_area))
    return F.when(page_area > 0, F.round(F.coalesce(F.array_max(shares), F.lit(0.0)), 4)).otherwise(F.lit(0.0))


def axis_starts(length: Column, tile: float, step: float) -> Column:
    """Starts of tiles along one side: every step, and one flush with the end."""
    last = length - F.lit(tile)
    steps = F.ceil(last / F.lit(step)).cast("int")
    regular = F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda k: k * F.lit(float(step)))
    ended = once(regular, lambda r: F.when(last - F.element_at(r, -1) > 0.01, F.concat(r, F.array(last))).otherwise(r))
    return F.when(length <= tile, F.array(F.lit(0.0))).otherwise(ended)


def pole_status(c: Column, threshold: float = 0.85) -> Column:
    return F.when(F.coalesce(c, F.lit(0.0)) >= threshold, "Approved").otherwise("Needs Review")
