"""Permits and their poles: numbers, counts, owners, field names and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planmatch.errors import FieldError
from planmatch.functions.text import owner, single_line
from planmatch.functions.values import pole_status
from planmatch.operators.running import held

WORK_AREA_FIELDS = ["permit_number", "totalcitypolecount", "foreignpolecount", "polereviewstatus"]
POLE_FIELDS = ["permit_number", "permit_globalid", "pole_id", "pole_owner", "confidence", "status"]
WKID = 3734


def numbers(requests: DataFrame, last: int | Column = 0, *, by: list[str], year: Column) -> DataFrame:
    """Consecutive numbers in order of ``by``, after ``last``; the count goes on from year to year.

    The order is made in two steps: numbers within range partitions, then each partition's start, so that no task holds all rows.
    """
    ranged = held(requests.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    counts = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    # a row for each partition, never one for each request
    starts = counts.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__start"))
    start = last if isinstance(last, Column) else F.lit(last)
    out = ranged.withColumn("__p", part).join(F.broadcast(starts), "__p")
    number = (start + F.col("__start") + F.col("__m") - F.shiftleft("__p", 33) + 1).cast("long")
    return out.withColumn("number", number).withColumn("permit_number", F.concat_ws("-", F.col("number").cast("string"), year.cast("string"))).drop("__m", "__p", "__start")


def identified(permits: DataFrame) -> DataFrame:
    """Permits with object_id and global_id, which their poles name: made from the number, so that a batch run again gives the same."""
    d = F.upper(F.md5(F.concat(F.lit("permit "), "permit_number")))
    parts = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return permits.withColumns({"object_id": F.col("number"), "global_id": F.concat(F.lit("{"), F.concat_ws("-", *parts), F.lit("}"))})


def placed(poles: DataFrame) -> DataFrame:
    return poles.filter("x is not null and y is not null")


def permit_rows(requests: DataFrame, poles: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each permit of ``requests`` (keys, permit_number): counts of its placed poles; permits without poles stay."""
    own = placed(poles).withColumn("pole_owner", owner("pole_id"))
    counts = own.groupBy(*keys).agg(F.count_if(F.col("pole_owner") == "City").alias("totalcitypolecount"), F.count_if(F.col("pole_owner") == "Foreign").alias("foreignpolecount"))
    out = requests.join(counts, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("totalcitypolecount", "foreignpolecount")} | {"polereviewstatus": F.lit("Needs Review")})


def pole_rows(requests: DataFrame, poles: DataFrame, keys: list[str], threshold: float = 0.85) -> DataFrame:
    """A row for each placed pole of a permit, with its permit's global id where ``requests`` have one."""
    confidence = F.coalesce("confidence", F.lit(0.0))
    own = [F.col("global_id").alias("permit_globalid")] if "global_id" in requests.columns else []
    return placed(poles).join(requests.select(*keys, "permit_number", *own), keys).select(
        *keys, "permit_number", *(["permit_globalid"] if own else []), "pole_id", owner("pole_id").alias("pole_owner"), confidence.alias("confidence"), pole_status(confidence, threshold).alias("status"), "x", "y", F.lit(WKID).alias("wkid")
    )


def resolve_fields(available: list[str], wanted: list[str], label: str = "the sink") -> dict[str, str]:
    """Actual names of the wanted fields, whatever their case."""
    actual = {name.lower(): name for name in available}
    if missing := sorted(w for w in wanted if w.lower() not in actual):
        raise FieldError(f"{label} is missing expected field(s): {', '.join(missing)}. Available fields: {', '.join(sorted(actual.values()))}")
    return {w: actual[w.lower()] for w in wanted}


def fitted(rows: DataFrame, available: list[str], wanted: list[str], label: str = "the sink") -> DataFrame:
    """``rows`` with the wanted columns under the sink's own names."""
    return rows.withColumnsRenamed(resolve_fields(available, wanted, label))


def messages(rows: DataFrame) -> DataFrame:
    """Subject and body of notifications (to_address, sender_label, body, permit_number); rows without an address are left out."""
    number = F.when(F.coalesce("permit_number", F.lit("")) != "", single_line("permit_number"))
    subject = F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("New message on permit "), number)).otherwise("New message on your request")
    return rows.filter(F.coalesce("to_address", F.lit("")) != "").select("to_address", subject.alias("subject"), F.concat(F.col("sender_label"), F.lit(" wrote:\n\n"), F.col("body")).alias("content"))
