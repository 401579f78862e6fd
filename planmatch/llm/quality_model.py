"""Quality scores by Bradley-Terry pairwise ranking of documents.

Each labelled document is a vector of text statistics. Pairs of one document marked good and one marked bad are preferences; the
logistic loss on the difference of their vectors, with a small ridge, gives the weights of a linear score (Newton steps). The score's threshold is the quantile
of the training scores at the share of documents marked bad, and a sigmoid around it puts that threshold at ``cut``.

The fit sees every labelled document: they are dealt to blocks, those of the rarer mark to as many as give each block some, and a block's good and bad
documents are paired all with all. Tasks add up what a Newton step needs, and the threshold is counted out exactly; the driver holds sums and counts only. With ``sample``, at most so many
labelled documents are learnt from, those of the smallest hashes of doc_id, and ``pairs`` seeded pairs of them, on the driver. All statistics are DataFrame
expressions over whole texts; scoring is one expression.

Defined results: null text counts as empty, an empty text has all statistics 0 and a score like any other; labels other than 0 and 1 and
documents marked both ways are not learnt from; without labels of both kinds every score is ``cut``; repeated rows are scored each by itself, and of rows that
share a labelled doc_id the one with the smallest statistics is learnt from; other columns are passed on, and ``score`` replaces one of that name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.quality_rules import WHITE, let, line_words
from planmatch.llm.storage import cut as stored
from planmatch.operators.bloom import bloom

#: Documents of the commoner mark in a block, and of the rarer one at least, in the mean.
COMMON, RARE = 64, 32
#: Labelled documents that may be broadcast by their ids.
FEW = 200_000

FEATURES = ["log_words", "word_length", "upper", "marks", "bars", "symbols", "digits", "distinct", "same_as_last", "repeat_lines", "ends", "line_words"]


def statistics(text: Column) -> Column:
    """Struct of FEATURES."""
    t0 = F.coalesce(text.cast("string"), F.lit(""))

    def stats(t: Column, lw: Column, w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        chars = F.greatest(F.length(F.regexp_replace(t, WHITE, "")), F.lit(1))
        lost = lambda chosen: F.length(t) - F.length(F.translate(t, chosen, ""))
        lines = F.filter(lw, lambda x: F.size(x) > 0)
        same = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get(w, i) == F.get(w, i - 1), F.lit(False))))
        parts = {
            "log_words": F.log1p(F.size(w).cast("double")),
            "word_length": chars / n,
            "upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) / chars,
            "marks": lost("!?") / n,
            "bars": lost("|") / n,
            "symbols": lost("#*$%&<>") / n,
            "digits": lost("0123456789") / chars,
            "distinct": F.size(F.array_distinct(w)) / n,
            "same_as_last": same / n,
            "repeat_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(F.transform(x, lambda y: F.xxhash64(y))))) / F.greatest(F.size(lines), F.lit(1)),
            "ends": F.size(F.filter(w, lambda x: F.right(x, F.lit(1)).isin(".", ",", ";", ":"))) / n,
            "line_words": F.log1p(F.size(w) / F.greatest(F.size(lines), F.lit(1))),
        }
        return F.struct(*[parts[k].cast("double").alias(k) for k in FEATURES])

    return let(t0, lambda t: let(line_words(t), lambda lw: let(F.flatten(lw), lambda w: stats(t, lw, w))))


def fit(x: np.ndarray, good: np.ndarray, pairs: int, ridge: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights of the raw statistics, and the threshold of the score."""
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = (x - middle) / spread
    rng = np.random.default_rng(seed)
    d = z[rng.choice(a, pairs)] - z[rng.choice(b, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * pairs * np.eye(len(w)), d.T @ (1 - p) - ridge * pairs * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / spread, float(np.quantile(x @ (w / spread), len(b) / len(x)))


def blocks(rows: DataFrame, good: int, bad: int, seed: int) -> DataFrame:
    """good, bad (lists of statistics) of each block: every document is in one, those of the rarer mark in as many as give each block RARE of them."""
    n = -(-max(good, bad) // COMMON)
    copies = min(n, max(1, -(-RARE * n // min(good, bad))))
    rare = F.col("quality") == int(good < bad)
    place = F.explode(F.when(rare, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0))))
    dealt = rows.select("quality", F.array(*FEATURES).alias("x"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n)).alias("at"), place.alias("i"))
    own = lambda q: F.collect_list(F.when(F.col("quality") == q, F.col("x")))
    return dealt.groupBy(F.pmod(F.col("at") + F.col("i"), F.lit(n)).alias("block")).agg(own(1).alias("good"), own(0).alias("bad"))


def newton_sums(dealt: DataFrame, weights: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Number of pairs, gradient and curvature of the loss at ``weights``, added up: a row from each task."""
    k = len(weights)

    def add(batches):
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            for good, bad in zip(batch.column("good"), batch.column("bad")):
                a, c = (x.values.flatten().to_numpy().reshape(-1, k) / spread for x in (good, bad))
                d = (a[:, None] - c[None]).reshape(-1, k)
                p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
                total += np.concatenate([[len(d)], d.T @ (1 - p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    parts = np.array(sorted(r["total"] for r in dealt.select("good", "bad").mapInArrow(add, "total array<double>").collect()))
    return parts.sum(0) if len(parts) else np.zeros(1 + k + k * k)


def ranked(values: DataFrame, place: int) -> float:
    """The value (v) at ``place`` in order, from 0: counted in a thousand bins, then in those of the bin that holds it."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low < high:
        at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / 1000)), F.lit(999))
        for _, n, a, z in sorted(values.filter((F.col("v") >= low) & (F.col("v") <= high)).groupBy(at.alias("bin")).agg(F.count("*"), F.min("v"), F.max("v")).collect()):
            if below + n > place:
                low, high = a, z
                break
            below += n
    return low


def fit_whole(rows: DataFrame, ridge: float, seed: int) -> tuple[np.ndarray, float] | None:
    """Weights and threshold from all of ``rows`` (doc_id, quality, FEATURES), one for each document; None without both marks."""
    found = rows.agg(F.count("*"), F.sum("quality"), *[F.var_pop(k) for k in FEATURES]).first()
    n, good = found[0], found[1] or 0
    if not 0 < good < n:
        return None
    spread = np.sqrt(np.array(found[2:], float)) + 1e-9
    dealt = stored(blocks(rows, good, n - good, seed))
    k = len(FEATURES)
    w = np.zeros(k)
    for _ in range(25):
        total = newton_sums(dealt, w, spread)
        pairs, slope, curve = max(total[0], 1), total[1 : k + 1], total[k + 1 :].reshape(k, k)
        step = np.linalg.solve(curve + ridge * pairs * np.eye(k), slope - ridge * pairs * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w = w / spread
    values = rows.select(weighted(lambda name: F.col(name), w).alias("v"))
    place = (n - 1) * ((n - good) / n)
    a = ranked(values, math.floor(place))
    return w, a + (ranked(values, math.ceil(place)) - a) * (place - math.floor(place))


def weighted(value, weights: np.ndarray, start: float = 0.0) -> Column:
    return sum((value(k) * F.lit(float(w)) for k, w in zip(FEATURES, weights)), F.lit(float(start)))


def score_quality(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int | None = None, pairs: int = 50_000, ridge: float = 1e-3, cut: float = 0.3, seed: int = 11
) -> DataFrame:
    """``docs`` with score (0 to 1); ``usable``: which doc_id may be learnt from."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("quality").isin(0, 1).alias("__clear")).filter("__clear and doc_id is not null").drop("__clear")
    if usable is not None:
        marked = marked.filter(usable)
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).filter("a = b").select("doc_id", F.col("a").alias("quality"))
    chosen = stored(marked if sample is None else marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = chosen.limit(FEW + 1).count() <= FEW
    if not few:
        # texts stay where they are: the filter lets few others through, and statistics travel
        asked = asked.filter(bloom(chosen, "doc_id").might_hold(F.col("doc_id")))
    measured = asked.select("doc_id", statistics(F.col("text")).alias("s")) if not few else asked.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select("doc_id", statistics(F.col("text")).alias("s"))
    rows = stored(measured.groupBy("doc_id").agg(F.min("s").alias("s")).join(chosen, "doc_id").select("doc_id", "quality", "s.*"))
    if sample is None:
        learnt = fit_whole(rows, ridge, seed)
    else:
        # a row for each of the at most ``sample`` documents
        held = sorted(rows.collect(), key=lambda r: r["doc_id"])
        good = np.array([r["quality"] == 1 for r in held], bool)
        learnt = fit(np.array([[r[k] for k in FEATURES] for r in held], float), good, pairs, ridge, seed) if good.any() and not good.all() else None
    if learnt is None:
        return docs.withColumn("score", F.lit(float(cut)))
    weights, threshold = learnt
    raw = lambda s: weighted(lambda k: s[k], weights, -threshold)
    return docs.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(let(statistics(F.col("text")), raw) + F.lit(float(np.log(cut / (1 - cut))))))))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = score_quality(docs, labels, fold(F.col("doc_id")) != 0)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
