"""Mixing sources to target weights with Sainte-Lague apportionment of equal-token blocks.

Each source's target is its share of the mix, capped at ``most`` times its size with the excess reshared. Targets become whole
blocks of equal tokens: first per source, then per group of shards of a source, then per shard, always by highest quotients (votes over
1, 3, 5, ...), solved by searching the divisor, so that no list of quotients is built. A shard is a seeded line of its documents, laid out ``most`` times;
its quota of blocks begins at a seeded block and goes round, so that documents stay whole but for the two where it begins and ends, and a document
takes as many words as its copies have in those blocks.

Defined results: null or empty texts have size 0 and take 0; a null source is a source of its own, last in order; a null doc_id stays null; repeated rows
are documents of their own, told apart by their place among equal ids and sizes, so equal rows may swap their draws; an empty table gives an empty table. If
all sources are at their cap the mix is smaller than asked for.

A shard is bounded in words and in rows. Up to ``max_sources`` sources are planned on the driver and their list, of that bounded size, is broadcast; of more,
targets and quotas are found by aggregates over a table of sources, and joined by source and a salt.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planmatch.llm.names import unused
from planmatch.llm.storage import cut
from planmatch.llm.words import mix

WEIGHTS = (3, 1, 2)
#: Shards of a source that are apportioned at once.
GROUP = 1 << 12
#: Copies of a source's row where sources are too many to broadcast.
SALTS = 32


def targets(sizes: list[int], weights: list[int], total: Fraction, most: int) -> list[Fraction]:
    """Exact shares of ``total`` by weight, none above ``most`` times its size."""
    # in order of size by weight, those at their limit come first: what is left over by any of them is shared by all after it
    out, left, w = [Fraction(0)] * len(sizes), total, sum(weights)
    common = math.lcm(*weights)
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] * (common // weights[i]))
    for place, i in enumerate(order):
        if left * weights[i] <= most * sizes[i] * w:
            for j in order[place:]:
                out[j] = left * weights[j] / w
            break
        out[i] = Fraction(most * sizes[i])
        left, w = left - out[i], w - weights[i]
    return out


def sainte_lague(votes: np.ndarray, seats: int, limits: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1), none above its limit; ties go to the earlier entry."""
    votes, limits = np.asarray(votes, float), np.asarray(limits, np.int64)
    seats = min(seats, int(limits[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    given = lambda d: np.minimum(limits, np.floor(votes / d + 0.5).astype(np.int64))
    high, low = 2 * votes.max() + 1, votes[votes > 0].min() / (2 * limits.max() + 2)
    for _ in range(200):
        d = (high * low) ** 0.5
        if given(d).sum() >= seats:
            low = d
        else:
            high = d
    out = given(high)
    while (rest := seats - int(out.sum())) > 0:  # quotients equal to the divisor
        quotient = np.where(out < limits, votes / (2 * out + 1), -1)
        out[np.argsort(-quotient, kind="stable")[:rest]] += 1
    return out


def drawn(size: np.ndarray, quota: int, block: int, most: int, seed: int) -> np.ndarray:
    """Words that each document of a shard takes: its overlap with ``quota`` blocks of the shard's line from a seeded one on."""
    ends = np.cumsum(np.tile(size, most))
    if not len(ends) or not ends[-1] or quota <= 0:
        return np.zeros(len(size), np.int64)
    n = -(-int(ends[-1]) // block)
    chosen = np.zeros(n + 1, np.int64)
    start = int(mix(np.array([seed], np.uint64))[0] % np.uint64(n))
    chosen[(start + np.arange(min(quota, n))) % n] = 1
    full = np.concatenate([[0], np.cumsum(chosen[:-1])])
    upto = lambda x: full[x // block] * block + chosen[x // block] * (x % block)
    return (upto(ends) - upto(ends - np.tile(size, most))).reshape(most, -1).sum(0)


def planned(found: list, weights: tuple[int, ...], share: Fraction, most: int, block: int) -> list[tuple]:
    """k, source, source_size, target, seats of each source, from its rows (source, size)."""
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    if not found:
        return []
    seats = sainte_lague(np.array([float(g) for g in goal]), round(sum(goal, Fraction(0)) / block), np.array([-(-most * s // block) for s in sizes]))
    return [(k, r["source"], s, float(g), int(n)) for k, (r, s, g, n) in enumerate(zip(found, sizes, goal, seats))]


def planned_apart(found: DataFrame, weights: tuple[int, ...], share: Fraction, most: int, block: int) -> DataFrame:
    """The same as a table, for any number of sources: each step of the searches is one aggregate over the table of sources."""
    ranged = found.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").sortWithinPartitions("last", "source")
    ranged = cut(ranged.withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    # a row for each partition
    counts = ranged.groupBy(part.alias("p")).agg(F.count("*").alias("c"))
    starts = counts.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("start"))
    k = (F.col("start") + F.col("m") - F.shiftleft(part, 33)).cast("long")
    rows = ranged.join(F.broadcast(starts), part == F.col("p")).select(k.alias("k"), "source", F.col("size").alias("source_size"))
    rows = cut(rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double")))
    total = float(share) * float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    roof = F.col("source_size") * float(most)
    level, capped = 0.0, -1
    while True:
        full = F.col("w") * level >= roof
        n, gone, weight = rows.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, roof)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not weight:
            break
        level, capped = (total - gone) / weight, n
    rows = cut(rows.withColumn("target", F.least(roof, F.col("w") * level)))
    limit = F.ceil(roof / block)
    wanted, high = rows.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.max("target"), F.lit(0.0))).first()
    seats = round(wanted / block)
    given = lambda d: F.least(limit, F.floor(F.col("target") / d + 0.5)).cast("long")
    low, high = 1e-9, 2 * high + 1
    for _ in range(64):
        d = (low * high) ** 0.5
        if rows.agg(F.coalesce(F.sum(given(F.lit(d))), F.lit(0))).first()[0] >= seats:
            low = d
        else:
            high = d
    out = rows.withColumn("seats", given(F.lit(high)))
    rest = seats - rows.agg(F.coalesce(F.sum(given(F.lit(high))), F.lit(0))).first()[0]
    if rest > 0:  # quotients equal to the divisor: as many of the first sources
        more = out.filter(F.col("seats") < limit).orderBy(F.desc(F.col("target") / (2 * F.col("seats") + 1)), "k").limit(int(rest)).select("k", F.lit(1).alias("more"))
        out = out.join(more, "k", "left").withColumn("seats", F.col("seats") + F.coalesce("more", F.lit(0)))
    return cut(out.select("k", "source", "source_size", "target", "seats"))


def seated(votes: DataFrame, keys: list[str], entry: str, block: int, most: int) -> DataFrame:
    """keys, entry, seats: the seats of each of ``keys`` (column ``of``) apportioned to its entries by their votes."""
    kinds = dict(votes.dtypes)

    def go(part: pa.Table) -> pa.Table:
        part = part.sort_by([(entry, "ascending")])
        v = part.column("votes").to_numpy()
        seats = sainte_lague(v, part.column("of")[0].as_py(), -(-most * v // block))
        return pa.table({**{c: part.column(c) for c in (*keys, entry)}, "seats": pa.array(seats, pa.int64())})

    return votes.groupBy(*keys).applyInArrow(go, ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, entry)) + ", seats long")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, block: int = 32, seed: int = 7,
    shard_words: int = 1 << 18, shard_rows: int = 1 << 14, max_sources: int = 100_000, extra: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source), and its columns ``extra`` as x0, x1, ..."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")).cast("long")
    own = [F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.col("source").cast("string").alias("source")]
    rows = docs.select(*own, *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)])
    if not extra:  # three short columns, so that texts are split once
        rows = cut(rows)
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n_rows"))
    listed = found.limit(max_sources + 1).collect()
    shards = lambda words, rows: F.greatest(F.lit(1), F.ceil(words / F.lit(shard_words)), F.ceil(rows / F.lit(shard_rows))).cast("long")
    if len(listed) > max_sources:
        found = cut(found)
        plan = planned_apart(found, weights, share, most, block).join(found.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        plan = plan.select("k", F.col("source").alias("plan_source"), "source_size", "target", "seats", shards(F.col("source_size"), F.col("n_rows")).alias("n_shards"))
        salted = plan.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.lit(SALTS)).cast("int"))
        sized = rows.join(salted, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("salt") == F.col("plan_salt"))).drop("salt", "plan_salt")
    else:
        counts = {r["source"]: r["n_rows"] for r in listed}
        lines = [(*p, counts[p[1]]) for p in planned(listed, weights, share, most, block)]
        plan = spark.createDataFrame(lines, "k long, plan_source string, source_size long, target double, seats long, n_rows long")
        plan = plan.select("k", "plan_source", "source_size", "target", "seats", shards(F.col("source_size"), F.col("n_rows")).alias("n_shards"))
        # at most ``max_sources`` rows
        sized = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source")))
    sized = sized.drop("plan_source", "seats").withColumn("salt", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("shard", F.pmod("salt", "n_shards"))
    sized = spread(sized, shard_rows)
    kinds = dict(sized.dtypes)
    votes = sized.groupBy("k", "shard").agg(F.sum("size").alias("votes"))
    group = F.shiftright("shard", GROUP.bit_length() - 1).alias("part")
    of_source = votes.groupBy("k", group).agg(F.sum("votes").alias("votes")).join(plan.select("k", F.col("seats").alias("of")), "k")
    of_group = seated(of_source, ["k"], "part", block, most).withColumnRenamed("seats", "of")
    quota = seated(votes.withColumn("part", group).join(of_group, ["k", "part"]), ["k", "part"], "shard", block, most).select("k", "shard", F.col("seats").alias("quota"))
    names = ["doc_id", "size", "source_size", "target", *(f"x{i}" for i in range(len(extra)))]

    def draw(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("salt", "doc_id", "size")])
        k, shard = key[0].as_py(), key[1].as_py()
        taken = drawn(part.column("size").to_numpy(), part.column("quota")[0].as_py(), block, most, k * 1_000_003 + shard + seed)
        return pa.table({**{c: part.column(c) for c in names}, "taken": pa.array(taken, pa.int64())})

    out = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["taken long"])
    return sized.join(quota, ["k", "shard"]).groupBy("k", "shard").applyInArrow(draw, out)


def spread(sized: DataFrame, shard_rows: int) -> DataFrame:
    """Rows of an id that has more of them than a shard holds are dealt over the source's shards by place in the input, so that no shard
    gets them all. There are at most the rows over ``shard_rows`` such ids, and few or none where ids are ids."""
    many = sized.groupBy("doc_id").agg(F.count("*").alias("c")).filter(F.col("c") > shard_rows)
    if not many.limit(1).count():
        return sized
    many = many.select(F.col("doc_id").alias("many_id"), "c")
    joined = sized.join(many, F.col("doc_id").eqNullSafe(F.col("many_id")), "left")
    over = F.pmod(F.col("salt") + F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("c") / shard_rows)), F.col("n_shards"))
    return cut(joined.withColumn("shard", F.when(F.col("c").isNull(), F.col("shard")).otherwise(over)).drop("many_id", "c"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document as often as it is taken whole, and once cut to the words that are left."""
    names = docs.columns
    (left,) = unused(names, "words_left")
    found = mix_sources(docs, extra=tuple(names), **options)
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(None).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    rows = found.filter("taken > 0").select(*(F.col(f"x{i}").alias(n) for i, n in enumerate(names)), F.explode(copies).alias(left))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")
    new = {"text": F.when(F.col(left).isNull(), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col(left).cast("int")), " "))}
    rows = rows.withColumns(new)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*[F.col(f"`{c}`") for c in names])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
