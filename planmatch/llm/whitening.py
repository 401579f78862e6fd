"""Whitening of embeddings: eigenvectors of their covariance by contour integration (FEAST).

Entries become whole numbers, so that counts and sums are exact. Two passes over the table give the covariance: sums by dimension, then products of the entries less their
dimension's nearest whole mean, summed by blocks of dimensions. What the driver holds is the covariance, bounded by ``MOST_WIDTH`` dimensions, never rows.

Eigenvalue intervals come from inertia counts: a symmetric indefinite factorisation of the covariance less a shift has as many positive pivots as there are eigenvalues above
it. On each interval a quadrature of shifted complex solves around it projects random vectors onto its eigenvectors, Rayleigh-Ritz extracts them, and this
repeats until residuals are at rounding; an interval is done when it has as many eigenvalues as its two counts differ by. The solves, one for each point of each contour,
are rows that Spark's tasks work on. A last Rayleigh-Ritz step over all intervals makes the components orthogonal to each other.

Defined results: a row without a vector, or with a null or non-finite entry or one beyond ``LARGEST``, takes no part; an empty vector has no components; rows without a vec_id and
repeated rows take part, each by itself; vectors of different widths are whitened apart, each width by its own covariance; a direction in which the vectors don't
vary (to rounding) has no component, so that equal vectors and a single one give no rows; equal eigenvalues have any orthogonal vectors of their space; a
component's largest entry is positive; a deviation beyond a long is null; other columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.storage import cut

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond it count as not finite: their whole numbers would have no exact squares in sums.
LARGEST = 2.0**24
#: Dimensions of a covariance that the driver may hold (2 GB), and of the blocks that tasks send.
MOST_WIDTH, TILE = 16_384, 256
#: Eigenvalues of an interval, points of a contour's upper half, and rounds until an interval is split.
MANY, POINTS, ROUNDS = 12, 8, 12


# ---------------------------------------------------------------- eigenvalues in intervals


def positive(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix, by its inertia: pivots of one or two rows, the larger of the two kinds first (Bunch and Parlett)."""
    a, found, alpha = a.copy(), 0, (1 + 17**0.5) / 8
    while (n := len(a)) > 0:
        size = np.abs(a)
        diagonal = size.diagonal()
        r = int(diagonal.argmax())
        off = size - np.diag(diagonal)
        p, q = divmod(int(off.argmax()), n)
        if not max(diagonal[r], off[p, q]):
            break
        chosen = [r] if diagonal[r] >= alpha * off[p, q] else [p, q]
        rest = np.delete(np.arange(n), chosen)
        pivot, column = a[np.ix_(chosen, chosen)], a[np.ix_(rest, chosen)]
        # a pivot of two rows has an eigenvalue of either sign
        found += 1 if len(chosen) == 2 else int(pivot[0, 0] > 0)
        a = a[np.ix_(rest, rest)] - column @ np.linalg.solve(pivot, column.T)
        a = (a + a.T) / 2
    return found


def intervals(v: np.ndarray, wanted: int, least: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues within) that hold the ``wanted`` largest eigenvalues above ``least``, from the top, of at most MANY each but where they can't be told apart."""
    above = lambda x: positive(v - x * np.eye(len(v)))
    top = float(np.abs(v).sum(1).max()) * 1.01
    out, todo = [], [(least, top, above(least), 0)]
    while todo:
        low, high, many, fewer = todo.pop()
        if many == fewer or fewer >= wanted:
            continue
        if many - fewer > MANY and high - low > 1e-11 * top:
            # eigenvalues spread over powers: the middle of their logarithms
            middle = (max(low, 1e-16 * top) * high) ** 0.5
            n = above(middle)
            todo += [(low, middle, many, n), (middle, high, n, fewer)]
        else:
            out.append((low, high, many - fewer))
    return out


# ---------------------------------------------------------------- FEAST


def points(count: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre angles of a half circle, and weights of the projector's quadrature."""
    t, w = np.polynomial.legendre.leggauss(count)
    angle = np.pi / 2 * (1 - t)
    return np.exp(1j * angle), w / 2


def solved(spark: SparkSession, v: np.ndarray, jobs: list[tuple[int, float, float, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each interval (number, low, high, vectors) the vectors, projected: one solve for each point of each contour, dealt to tasks as rows."""
    nodes, weights = points()
    held = spark.sparkContext.broadcast((v, {n: (low, high, y) for n, low, high, y in jobs}))
    rows = spark.createDataFrame([(n, i) for n, *_ in jobs for i in range(len(nodes))], "interval int, point int").repartition(len(jobs) * len(nodes), "interval", "point")

    def go(batches):
        a, each = held.value
        for batch in batches:
            for n, i in zip(batch.column("interval").to_pylist(), batch.column("point").to_pylist()):
                low, high, y = each[n]
                radius = (high - low) / 2
                z = (low + high) / 2 + radius * nodes[i]
                q = (weights[i] * radius * nodes[i] * np.linalg.solve(z * np.eye(len(a)) - a, y.astype(complex))).real
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([i], pa.int32()), pa.array([q.tobytes()], pa.binary())], names=["interval", "point", "q"])

    out = {n: np.zeros_like(y) for n, _, _, y in jobs}
    for r in sorted(rows.mapInArrow(go, "interval int, point int, q binary").collect(), key=lambda r: (r["interval"], r["point"])):
        out[r["interval"]] += np.frombuffer(r["q"]).reshape(out[r["interval"]].shape)
    held.unpersist()
    return out


@dataclass
class Interval:
    low: float
    high: float
    count: int
    y: np.ndarray
    rounds: int = 0


def basis(y: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of ``y``, without what is rounding alone."""
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    return u[:, s > 1e-13 * max(s[0], np.finfo(float).tiny)]


def ritz(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values, falling, and vectors of an orthonormal basis."""
    small = q.T @ v @ q
    e, s = np.linalg.eigh((small + small.T) / 2)
    return e[::-1], (q @ s)[:, ::-1]


def components(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance and their unit vectors, as columns; fewer where others are rounding alone."""
    trace = float(np.trace(v))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    v = v / trace
    rng = np.random.default_rng(11)
    start = lambda low, high, n: Interval(low, high, n, rng.normal(size=(len(v), min(len(v), n + n // 2 + 4))))
    todo, found = [start(*x) for x in intervals(v, wanted, len(v) * 1e-15)], []
    while todo:
        projected = solved(spark, v, [(i, t.low, t.high, t.y) for i, t in enumerate(todo)])
        left = []
        for i, t in enumerate(todo):
            e, x = ritz(v, basis(projected[i]))
            inside = (e > t.low) & (e <= t.high)
            lost = np.linalg.norm(v @ x[:, inside] - x[:, inside] * e[inside], axis=0)
            t.rounds += 1
            if inside.sum() == t.count and (lost < 4e-15 * len(v) ** 0.5).all():
                found.append(x[:, inside])
            elif t.rounds < ROUNDS:
                t.y = x
                left.append(t)
            else:
                # too near its ends, or too many: more vectors on a wider contour, cut back to the interval by the same count
                wide = (t.high - t.low) / 4
                n = min(len(v), 2 * t.y.shape[1])
                q = basis(np.hstack([x, rng.normal(size=(len(v), max(0, n - x.shape[1])))]))
                if n == len(v) or t.rounds > 4 * ROUNDS:
                    e, x = ritz(v, q if q.shape[1] == len(v) else np.linalg.qr(np.hstack([q, np.eye(len(v))]))[0][:, : len(v)])
                    inside = (e > t.low) & (e <= t.high)
                    found.append(x[:, inside])
                else:
                    low, high = t.low - wide, t.high + wide
                    many = positive(v - low * np.eye(len(v))) - positive(v - high * np.eye(len(v)))
                    left.append(Interval(low, high, many, q, t.rounds))
        todo = left
    e, x = ritz(v, basis(np.hstack(found)))
    e, x = e[:wanted] * trace, x[:, :wanted]
    return e, x * np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)


# ---------------------------------------------------------------- the table


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, width and x: the whole numbers of rows that take part."""
    out = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    good = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    out = out.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(good, F.lit(False)))
    return out.select("vec_id", F.size("v").alias("width"), F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def by_width(batch: pa.RecordBatch):
    """Rows of each width of a batch: their places, and their numbers as a matrix."""
    widths, column = batch.column("width").to_numpy(), batch.column("x")
    at, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        yield width, own, values[at[own][:, None] + np.arange(width)[None]]


def sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each width the number of vectors and the sum of each dimension, exact."""

    def go(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for width, own, x in by_width(batch):
                n, s = held.get(width, (0, 0))
                held[width] = n + len(own), s + x.sum(0)
        for width, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(s, pa.int64())], names=["width", "d", "n", "s"])

    found: dict[int, tuple[int, list[int]]] = {}
    # a row for each dimension of each width: no more than MOST_WIDTH for one
    for r in rows.mapInArrow(go, "width int, d int, n long, s long").groupBy("width", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("width", "d").collect():
        found.setdefault(r["width"], (r["n"], []))[1].append(r["s"])
    return found


def scatter(rows: DataFrame, column: str, centres: dict[int, np.ndarray], tile: int = TILE) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each width the number of rows, and sums and products of ``column`` less the centres. Tasks send tiles of their sums, which are added up by tile."""

    def go(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for width, own, x in by_width(batch.rename_columns([c if c != column else "x" for c in batch.schema.names])):
                y = x - centres[width]
                # whole numbers below 2**53 in all: the products' sums are exact
                for a in range(0, len(y), 1024):
                    part = y[a : a + 1024].astype(np.float64)
                    n, s, p = held.get(width, (0, 0.0, 0.0))
                    held[width] = n + len(part), s + part.sum(0), p + part.T @ part
        for width, (n, s, p) in held.items():
            for i in range(0, width, tile):
                for j in range(i, width, tile):
                    own = s[i : i + tile] if i == j else np.zeros(0)
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([n], pa.int64()), pa.array([own.tobytes()]), pa.array([np.ascontiguousarray(p[i : i + tile, j : j + tile]).tobytes()])], names=names)

    names = ["width", "i", "j", "n", "s", "p"]
    form = "width int, i int, j int, n long, s binary, p binary"

    def added(table: pa.Table) -> pa.Table:
        # in an order of their own, so that reruns agree
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("n", "s", "p"))))
        n, s, p = sum(x[0] for x in parts), sum(np.frombuffer(x[1]) for x in parts), sum(np.frombuffer(x[2]) for x in parts)
        return pa.table({**{c: table.column(c).slice(0, 1) for c in names[:3]}, "n": pa.array([n], pa.int64()), "s": pa.array([s.tobytes()], pa.binary()), "p": pa.array([p.tobytes()], pa.binary())})

    # first in groups, so that no task adds up what all tasks sent
    sent = rows.mapInArrow(go, form).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64)))
    tiles = sent.groupBy("width", "i", "j", "g").applyInArrow(added, form).groupBy("width", "i", "j").applyInArrow(added, form)
    out: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in tiles.toLocalIterator():
        width, i, j = r["width"], r["i"], r["j"]
        n, s, p = out.setdefault(width, (r["n"], np.zeros(width), np.zeros((width, width))))
        own = np.frombuffer(r["p"]).reshape(min(tile, width - i), min(tile, width - j))
        p[i : i + tile, j : j + tile] = own
        p[j : j + tile, i : i + tile] = own.T
        if i == j:
            s[i : i + tile] = np.frombuffer(r["s"])
    return out


def covariance(n: int, s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """From sums and products about centres that are near the means."""
    return p / n - np.outer(s / n, s / n)


@dataclass
class Fit:
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def fit(rows: DataFrame, wanted: int) -> dict[int, Fit]:
    """Components of each width of ``rows`` (vec_id, width, x)."""
    found = sums(rows)
    if max(found, default=0) > MOST_WIDTH:
        raise ValueError(f"vectors of more than {MOST_WIDTH} dimensions have no covariance that the driver can hold")
    centres = {w: np.array([(2 * s + n) // (2 * n) for s in each], np.int64) for w, (n, each) in found.items()}
    out = {}
    for width, (n, s, p) in scatter(rows, "x", centres).items():
        v = covariance(n, s, p)
        e, x = components(rows.sparkSession, v, min(wanted, width))
        out[width] = Fit(n, found[width][1], float(np.trace(v)), e, x)
    return out


def whiten(rows: DataFrame, wanted: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and component."""
    own = usable(rows, vec_id, vector)
    fits = fit(own, wanted)
    # what tasks need: a mean and a matrix for each width
    model = {w: (f.n, np.array(f.sums, object), np.array([s / f.n for s in f.sums]), f.vectors / np.sqrt(f.values)) for w, f in fits.items()}

    def go(batches):
        for batch in batches:
            for width, own, x in by_width(batch):
                n, s, mean, matrix = model[width]
                whole = np.array([int(c) // n for c in s], np.int64)
                rest = np.array([int(c) % n for c in s], np.int64)
                y = x - whole
                deviation = exact(y, n, rest)
                # the mean's whole part goes first: what is left has all its digits
                w = (y - rest / n) @ matrix
                m = matrix.shape[1]
                lists = pa.ListArray.from_arrays(np.arange(0, len(own) * m + 1, m, dtype=np.int32) if m else np.zeros(len(own) + 1, np.int32), w.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(own)), pa.array(np.full(len(own), width), pa.int32()), deviation, lists], names=["vec_id", "width", "deviation", "w"])

    done = cut(own.mapInArrow(go, "vec_id long, width int, deviation long, w array<double>"))
    # the whitened table's own covariance, by a pass over it
    some = done.filter(F.size("w") > 0).select(F.size("w").alias("width"), F.col("width").alias("of"), F.col("w").alias("x"))
    errors = {}
    for width, f in fits.items():
        if m := len(f.values):
            n, s, p = scatter(some.filter(F.col("of") == width).select("width", "x"), "x", {m: np.zeros(m)})[m]
            errors[width] = float(np.abs(covariance(n, s, p) - np.eye(m)).max())
    facts = [(w, i + 1, f.n, float(f.values[i] / f.trace), errors[w]) for w, f in fits.items() for i in range(len(f.values))]
    facts = rows.sparkSession.createDataFrame(facts, "width int, component int, n long, explained double, identity_error double")
    each = done.select("vec_id", "width", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    # a row for each component of each width
    return each.join(F.broadcast(facts), ["width", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def exact(y: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Sums of squares of n * y - rest, exact; null beyond a long."""
    size = n * (int(np.abs(y).max(initial=0)) + 1)
    if size**2 * y.shape[1] < 1 << 63:
        z = n * y - rest
        return pa.array((z * z).sum(1), pa.int64())
    z = n * y.astype(object) - rest.astype(object)
    return pa.array([int(t) if t < 1 << 63 else None for t in (z * z).sum(1)], pa.int64())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
