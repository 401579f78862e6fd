"""Nearest neighbours by block matrix join: int8 product tiles with error bounds, then exact distances of what survives.

Vectors are packed in blocks of one width. A vector is stored as int8 numbers times its own scale, with the exact norm of what that loses. For a
block of candidates and a block of queries one product of int8 numbers gives every distance within a bound by Cauchy-Schwarz; it is summed over at most
``EXACT`` columns at a time, where single precision holds the sums exactly, and then in double. A candidate whose lower bound is above the k-th
smallest upper bound of its tile cannot be among a query's k nearest; the others are computed in double precision from the original vectors, and
the tiles' lists are merged by heaps.

Blocks meet on a grid: query blocks are dealt to its rows and candidate blocks to its columns, and each goes to all cells of its own, so that
what is sent grows with the square root of the number of cells. Defined results: vectors that are null, zero, empty, or with a null or
non-finite part take no part; a query meets the candidates of its own width; ties go to the smaller vec_id; a query never finds its own row, by
vec_id, and rows without a vec_id take no part; every row of candidates counts, so that repeated rows take a place each, and of rows of queries with
one vec_id all distances count together, as in the SQL; fewer than k candidates give all; columns other than the two named are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

PACKED = "width int, ids binary, vectors binary"
#: Columns whose int8 products sum to less than 2**24.
EXACT = 1024
BLOCK = 4096
#: Bytes of candidates for which another task is worth while.
LEAST = 1 << 20


def pack(rows: DataFrame, block: int, kind: str) -> DataFrame:
    """Blocks of up to ``block`` vectors of one width in rows of two blobs: ids, and numbers of ``kind``."""
    schema = pa.schema([("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def go(batches):
        held: dict[int, list] = {}

        def out(width: int):
            ids, vecs = zip(*held.pop(width))
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vecs).tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            at = vectors.offsets.to_numpy().astype(np.int64)
            values, widths = vectors.values.to_numpy(zero_copy_only=False).astype(kind), np.diff(at)
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                for k in range(0, len(own), block):
                    chosen = own[k : k + block]
                    held.setdefault(width, []).append((ids[chosen], values[at[chosen][:, None] + np.arange(width)[None]]))
                    if sum(len(x) for x, _ in held[width]) >= block:
                        yield out(width)
        for width in list(held):
            yield out(width)

    return rows.mapInArrow(go, PACKED)


def unpack(ids: bytes, vectors: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, kind).reshape(len(i), -1)


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scales, and norms of the vectors and of what rounding loses."""
    v = v.astype(np.float64)
    scale = np.maximum(np.abs(v).max(1) / 127, np.finfo(float).tiny)
    q = np.rint(v / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((v - q * scale[:, None]) ** 2).sum(1))
    return q, scale, np.sqrt((v**2).sum(1)), lost


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows, as doubles."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return out


def tile(ids_c: np.ndarray, c: np.ndarray, ids_q: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, candidate id and distance of each query's k nearest in the block."""
    with np.errstate(over="ignore", invalid="ignore"):
        ci, cs, cn, ce = quantised(c)
        qi, qs, qn, qe = quantised(q)
        out = []
        for a in range(0, len(q), 256):
            b = slice(a, a + 256)
            dot = products(qi[b], ci) * qs[b, None] * cs[None]
            # |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|, and |q'| <= |q| + |q - q'|
            slack = 2 * (qe[b, None] * cn[None] + (qn[b] + qe[b])[:, None] * ce[None])
            far = qn[b, None] ** 2 + cn[None] ** 2 - 2 * dot
            slack += 1e-9 * (qn[b, None] ** 2 + cn[None] ** 2)
            own = ids_q[b, None] == ids_c[None]
            low, up = far - slack, far + slack
            beyond = ~(np.isfinite(low) & np.isfinite(up))  # squares beyond doubles: no bound
            low[beyond], up[beyond | own] = -np.inf, np.inf
            kth = np.partition(up, min(k, up.shape[1]) - 1, axis=1)[:, min(k, up.shape[1]) - 1]
            r, s = np.nonzero((low <= kth[:, None]) & ~own)
            d = np.sqrt(((q[b][r].astype(np.float64) - c[s].astype(np.float64)) ** 2).sum(1))
            order = np.lexsort((ids_c[s], d, r))
            r, s, d = r[order], s[order], d[order]
            top = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((ids_q[b][r[top]], ids_c[s[top]], d[top]))
    return tuple(np.concatenate(x) for x in zip(*out))


def usable(vector: Column) -> Column:
    good = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def push(heap: list, k: int, found) -> None:
    """Keeps the k nearest of (distance, id) pairs; those of a heap are negative, so that the farthest is on top."""
    for d, i in found:
        if len(heap) < k:
            heapq.heappush(heap, (-d, -i))
        elif (-d, -i) > heap[0]:
            heapq.heapreplace(heap, (-d, -i))


def nearest(
    queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = BLOCK, cell_bytes: int = 1 << 24, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: exactly the k nearest of each query by Euclidean distance.

    ``cell_bytes``: about how many bytes of either side meet in one task.
    """
    single = all(isinstance(df.schema[vector].dataType.elementType, FloatType) for df in (queries, candidates))
    kind, item = ("<f4", 4) if single else ("<f8", 8)
    part = lambda df: df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(f"array<{'float' if single else 'double'}>").alias("v")).filter(F.col("vec_id").isNotNull())
    q, c = (part(df).filter(usable(F.col("v"))) for df in (queries, candidates))
    bytes_q, bytes_c, width = (
        max(1, x) for x in (*(df.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] * item for df in (q, c)), c.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0])
    )
    down, over = -(-bytes_q // cell_bytes), max(-(-bytes_c // cell_bytes), min(queries.sparkSession.sparkContext.defaultParallelism, -(-bytes_c // LEAST)))
    block = min(block, max(1, LEAST // (width * item)))
    place = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    qb = pack(q, block, kind).withColumn("down", place(down)).select("*", every(over).alias("over"))
    cb = pack(c, block, kind).withColumn("over", place(over)).select("*", every(down).alias("down"))
    cell = ["width", "down", "over"]

    def blocks(table: pa.Table) -> list:
        return [unpack(i, v, kind) for i, v in zip(table.column("ids").to_pylist(), table.column("vectors").to_pylist())]

    def met(asked: pa.Table, given: pa.Table) -> pa.Table:
        theirs, heaps = blocks(given), {}
        for ids_q, vq in blocks(asked):
            for ids_c, vc in theirs:
                qid, cid, d = tile(ids_c, vc, ids_q, vq, k)
                order = np.argsort(qid, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(qid[order]) != 0)) if len(qid) else []
                for i, j in zip(at, [*at[1:], len(qid)]):
                    o = order[i:j]
                    push(heaps.setdefault(int(qid[o[0]]), []), k, zip(d[o].tolist(), cid[o].tolist()))
        lists = [(x, np.array([-i for _, i in h], np.int64).tobytes(), np.array([-d for d, _ in h]).tobytes()) for x, h in heaps.items()]
        columns = list(zip(*lists)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "ids": pa.array(columns[1], pa.binary()), "scores": pa.array(columns[2], pa.binary())})

    lists = qb.groupBy(*cell).cogroup(cb.groupBy(*cell)).applyInArrow(met, "query_id long, ids binary, scores binary")

    def merge(batches):
        heap, key, done = [], None, []

        def out():
            rows = [(key, n, -i, -d) for n, (d, i) in enumerate(sorted(heap, reverse=True), 1)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for qid, ids, scores in zip(*(batch.column(n).to_pylist() for n in ("query_id", "ids", "scores"))):
                if qid != key:
                    if heap:
                        done.append(out())
                    heap, key = [], qid
                push(heap, k, zip(np.frombuffer(scores, np.float64).tolist(), np.frombuffer(ids, np.int64).tolist()))
            yield from done
            done = []
        if heap:
            yield out()

    # a query has a list of at most k for each column of the grid, and for each row that one of its rows is in
    return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows.filter(F.col("vec_id") % 100 == 0), rows)


SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, list_distance(q.e, c.e) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from p) where rank <= 10
"""
