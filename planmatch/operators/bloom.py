"""Bloom filters as values of a plan: built by an aggregate, tested by expressions where rows stand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each value, places of a value, and bits at most (8 MB): beyond, a filter lets more through, and none less.
BITS, PLACES, MOST_BITS = 10, 5, 1 << 26


@dataclass
class Bloom:
    words: Column
    bits: int

    def might_hold(self, value: Column) -> Column:
        """False for values that aren't held, but for some in a hundred; true for all that are."""
        h = F.xxhash64(value)
        return F.coalesce(self._all(h) & value.isNotNull(), F.lit(False))

    def _all(self, h: Column) -> Column:
        out = F.lit(True)
        for place in places(h, self.bits):
            out = out & (F.call_function("shiftright", F.get(self.words, F.shiftright(place, 6)), F.pmod(place, F.lit(64))).bitwiseAND(F.lit(1)) == 1)
        return out


def places(h: Column, bits: int) -> list[Column]:
    """The bits of a value, by two halves of its hash."""
    low, step = h.bitwiseAND(F.lit(2**31 - 1)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [F.pmod(low + F.lit(i) * step, F.lit(bits)).cast("int") for i in range(PLACES)]


def bloom(values: DataFrame, column: str) -> Bloom:
    """A filter of the values of ``column``. They are counted first; the filter is one value of up to MOST_BITS bits, gathered from as many rows as it has words."""
    bits = 64
    n = values.count()
    while bits < min(MOST_BITS, BITS * n):
        bits *= 2
    # the places that values set, a row for each word of the filter: combined before the shuffle
    set_ = values.filter(F.col(column).isNotNull()).select(F.explode(F.array(*places(F.xxhash64(column), bits))).alias("p"))
    words = set_.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)))).alias("v"))
    whole = values.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return Bloom(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"])).scalar(), bits)
