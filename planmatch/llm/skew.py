"""Equi-joins with a table of unique keys, in which no key brings all its rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmatch.llm.names import unused

#: Keys that are dealt over several tasks at most, and with it the rows that are broadcast.
MOST_KEYS = 100_000


def spread_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", rows: int | None = None, least: int = 256, counted: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small``, whose ``key`` is unique; ``how``: inner or left.

    Keys with more than ``limit`` rows of ``big`` are dealt over as many salts as they fill limits. The limit is at least a hundred-thousandth of
    all rows, so that there are no more than ``MOST_KEYS`` such keys, and their list is broadcast. ``rows``: how many rows ``big`` has, if known; ``counted``: a
    table with the same keys as often, where that is less work to count than ``big``.
    """
    limit = max(least, -(-(big.count() if rows is None else rows) // MOST_KEYS))
    copies, salt, own = unused([*big.columns, *small.columns], "key_copies", "key_salt", "key_value")
    heavy = (big if counted is None else counted).groupBy(F.col(key).alias(own)).agg(F.count("*").alias(copies)).filter(F.col(copies) > limit).select(own, F.ceil(F.col(copies) / limit).cast("int").alias(copies))
    # at most MOST_KEYS rows
    heavy = F.broadcast(heavy)
    many = F.coalesce(copies, F.lit(1))
    # rows without a key meet nothing: they are dealt over all tasks
    spread = F.when(F.col(key).isNull(), F.lit(1 << 20)).otherwise(many)
    left = big.join(heavy, F.col(key) == F.col(own), "left").withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), spread).cast("int")).drop(own, copies)
    right = small.join(heavy, F.col(key) == F.col(own), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), many - 1))).drop(own, copies)
    return left.join(right, [key, salt], how).drop(salt)
