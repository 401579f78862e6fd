"""The authoritative catalog: cleaning, lookups, shapes, coordinates and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planmatch.errors import CatalogError
from planmatch.functions.text import normalized, shape
from planmatch.functions.values import number, text_or_null


def load(rows: DataFrame, *, check: bool = False) -> DataFrame:
    """Catalog records of raw rows (source_id, pole_id_raw, x, y and perhaps status, source_updated_at).

    Rows without an id are left out; a row without a source id stops the plan. ``check`` also counts, and stops where no record
    has both coordinates.
    """
    kinds = {c.lower(): kind for c, kind in rows.dtypes}
    given = lambda c: F.col(c) if c in kinds else F.lit(None)
    # a double's text says what it is itself, but for what is no finite number
    place = lambda c: F.when(F.abs(c) < float("inf"), F.col(c)) if kinds[c] == "double" else number(F.col(c).cast("string"))
    source = text_or_null("source_id")
    out = rows.select(
        F.when(source.isNull() & text_or_null("pole_id_raw").isNotNull(), F.raise_error(F.lit("a record has a blank source id"))).otherwise(source).alias("source_id"),
        text_or_null("pole_id_raw").alias("pole_id_raw"),
        *(place(c).alias(c) for c in ("x", "y")),
        *(text_or_null(given(c)).alias(c) for c in ("status", "source_updated_at")),
    ).filter("pole_id_raw is not null")
    out = out.select("source_id", "pole_id_raw", normalized("pole_id_raw").alias("pole_id_normalized"), "x", "y", "status", "source_updated_at")
    if check and not out.filter("x is not null and y is not null").limit(1).count():
        raise CatalogError("no record of the catalog has both coordinates")
    return out


def summary(catalog: DataFrame) -> DataFrame:
    """One row: records, distinct ids, ids and source ids that occur more than once, records with coordinates."""
    ids = catalog.groupBy("pole_id_normalized").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("placed"))
    sources = catalog.groupBy("source_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_source_id_count"))
    by_id = ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"), F.count("*").alias("unique_id_count"), F.count_if(F.col("n") > 1).alias("duplicate_id_count"), F.coalesce(F.sum("placed"), F.lit(0)).alias("with_coordinates_count")
    )
    return by_id.select("*", sources.scalar().alias("duplicate_source_id_count"))


def duplicates(catalog: DataFrame, column: str = "pole_id_normalized") -> DataFrame:
    return catalog.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1").orderBy(column)


def shapes(catalog: DataFrame) -> DataFrame:
    """Shapes of the distinct ids, with how many have each."""
    return catalog.select("pole_id_normalized").distinct().filter("pole_id_normalized <> ''").groupBy(shape("pole_id_normalized").alias("shape")).agg(F.count("*").alias("id_count"))


def top_shapes(catalog: DataFrame, most: int = 20) -> DataFrame:
    return shapes(catalog).orderBy(F.desc("id_count"), "shape").limit(most)


def leading_letters(catalog: DataFrame) -> DataFrame:
    first = F.left("pole_id_normalized", F.lit(1))
    return catalog.select(first.alias("letter")).filter(F.col("letter").rlike(r"\p{L}")).distinct()


def letters_array(catalog: DataFrame) -> Column:
    """The leading letters as one value: a scalar subquery, as long as an alphabet at most."""
    return leading_letters(catalog).agg(F.array_sort(F.collect_set("letter"))).scalar()


def coordinates(catalog: DataFrame) -> DataFrame:
    """pole_id, x, y: the one place on which all records of an id agree, else nulls. A pair of nulls is a place too."""
    # one place: x and y are the same in all records, or null in all; least and greatest need one row for each id, a set of places as many as it has
    ends = [f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("least", F.min), ("most", F.max), ("n", F.count))]
    agreed = catalog.groupBy(F.col("pole_id_normalized").alias("pole_id")).agg(F.count("*").alias("n"), *ends)
    same = lambda c: F.col(f"least_{c}").eqNullSafe(F.col(f"most_{c}")) & F.col(f"n_{c}").isin(F.lit(0), F.col("n"))
    return agreed.select("pole_id", *(F.when(same("x") & same("y"), F.col(f"least_{c}")).alias(c) for c in "xy"))


NEAR = r"^([A-Z]+)(\p{Nd}+)(F?)$"


def blanked(ids: DataFrame) -> DataFrame:
    """pole_id, k: for each digit of an id a key with that digit blanked, without the last F. Ids with a key in common are neighbours."""
    parts = ids.filter(F.col("pole_id").rlike(NEAR)).select("pole_id", F.regexp_extract("pole_id", NEAR, 1).alias("l"), F.regexp_extract("pole_id", NEAR, 2).alias("d"))
    at = parts.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("d"))))
    return at.select("pole_id", F.concat_ws("|", "l", F.length("d").cast("string"), F.col("i").cast("string"), F.expr("concat(left(d, i - 1), '.', substring(d, i + 1))")).alias("k"))


def neighbours_among(ids: DataFrame, all_ids: DataFrame) -> DataFrame:
    """pole_id, neighbours of those of ``ids`` that have any among ``all_ids``: no comparison of all ids with all, but an equi-join of as many keys as digits."""
    pairs = blanked(ids).join(blanked(all_ids).withColumnRenamed("pole_id", "other"), "k").filter("pole_id <> other")
    return pairs.groupBy("pole_id").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def neighbourhood(catalog: DataFrame) -> DataFrame:
    """pole_id, neighbours: ids of the same letters and as many digits that differ in one digit or in a last F only."""
    ids = catalog.select(F.col("pole_id_normalized").alias("pole_id")).distinct().filter(F.col("pole_id").rlike(NEAR))
    return ids.join(neighbours_among(ids, ids), "pole_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))


def few(rows: DataFrame, most: int = 200_000) -> bool:
    """Whether ``rows`` are at most ``most``, by counting no further: what may be broadcast."""
    return rows.limit(most + 1).count() <= most


def by_id(catalog: DataFrame, *, neighbours: bool = False, records: bool = False) -> DataFrame:
    """One row for each id: match_count, source_ids, and perhaps its neighbours and its records: one for each (source_id, x, y), the least of those."""
    row = F.struct("source_id", "x", "y", "pole_id_raw", "status", "source_updated_at")
    if records:
        catalog = catalog.withColumn("again", F.row_number().over(Window.partitionBy("pole_id_normalized", "source_id", "x", "y").orderBy("pole_id_raw", "status", "source_updated_at")))
    extra = [F.array_sort(F.collect_list(F.when(F.col("again") == 1, row))).alias("records")] if records else []
    out = catalog.groupBy(F.col("pole_id_normalized").alias("pole_id")).agg(F.count("*").alias("match_count"), F.array_sort(F.collect_set("source_id")).alias("source_ids"), *extra)
    if neighbours:
        out = out.join(neighbourhood(catalog), "pole_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))
    return out


def by_source(catalog: DataFrame) -> DataFrame:
    """One row for each source id: its records, duplicates kept, in a fixed order."""
    row = F.struct("pole_id_normalized", "pole_id_raw", "x", "y", "status", "source_updated_at")
    return catalog.groupBy("source_id").agg(F.array_sort(F.collect_list(row)).alias("records"))


def exact_match(rows: DataFrame, column: str, catalog: DataFrame) -> DataFrame:
    """Inner lookup: a row for each record of the id."""
    return rows.join(catalog, F.col(column) == F.col("pole_id_normalized"))


def match_exact(rows: DataFrame, column: str, catalog: DataFrame) -> DataFrame:
    """Outer lookup: candidate_normalized, match_status, match_count and records of each row."""
    keyed = rows.withColumn("candidate_normalized", normalized(column))
    out = keyed.join(by_id(catalog, records=True), F.col("candidate_normalized") == F.col("pole_id"), "left")
    return out.select(
        *keyed.columns, F.when(F.col("pole_id").isNotNull(), "reference_exact").otherwise("not_found").alias("match_status"), F.coalesce("match_count", F.lit(0)).alias("match_count"),
        "source_ids", "records",
    )
