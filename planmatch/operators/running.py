"""Running sums in two passes: within range partitions, then what each key has gathered in the partitions before. No task holds all rows of a key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(rows: DataFrame) -> DataFrame:
    """``rows``, kept for several uses as they were computed once, as ranges that are sampled anew may differ: in the checkpoint folder where one is set."""
    return rows.checkpoint() if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else rows.persist()


def _sum(a: Column, b: Column) -> Column:
    return a + b


#: How to gather values, how to add what was gathered, and what an empty start is.
SUM = (F.sum, _sum)
#: Of 64-bit digests: order doesn't matter within, so that parts can be gathered apart.
XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], kind: tuple[Callable, Callable] = SUM, partitions: int | None = None) -> DataFrame:
    """``rows`` with a column for each of ``values`` (long or double, nulls as 0): what it adds up to within the key, up to and with the row, in order of ``order``.

    Rows are put in ranges of (keys, order): a key of any size is spread over as many ranges as it fills, as far as ``order`` tells its rows apart; rows that it
    doesn't tell apart are taken in any order. A second shuffle, by (range, key), makes the sums of each range. Only keys that go on from one range to
    the next need more: there are no more of those than ranges, and a row for each of them and range is broadcast.
    """
    gather, add = kind
    p, names = "__range", list(values)
    marked = rows.withColumns({f"__{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
    by = [*([partitions] if partitions else []), *keys, *order]
    ranged = held(marked.repartitionByRange(*by).withColumn(p, F.spark_partition_id()))
    local = Window.partitionBy(p, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({n: gather(f"__{n}").over(local) for n in names})
    if keys:
        key = F.struct(*keys)
        # a row for each range
        ends = ranged.groupBy(p).agg(F.min(key).alias("a"), F.max(key).alias("z"))
        going_on = ends.withColumn("next", F.lead("a").over(Window.orderBy(p))).filter(F.col("z").eqNullSafe(F.col("next")))
        going_on = going_on.select(*[F.col(f"z.{k}").alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        parts = ranged.join(F.broadcast(going_on), same, "left_semi")
    else:
        parts, same = ranged, F.lit(True)
    gathered = parts.groupBy(F.col(p).alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*[gather(f"__{n}").alias(f"__{n}_all") for n in names])
    before = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = gathered.select("__p", *[f"__k{i}" for i in range(len(keys))], *[gather(f"__{n}_all").over(before).alias(f"__{n}_start") for n in names])
    out = out.join(F.broadcast(starts), (F.col(p) == F.col("__p")) & same, "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in names], *[add(F.col(n), F.coalesce(f"__{n}_start", F.lit(0))).alias(n) for n in names])
