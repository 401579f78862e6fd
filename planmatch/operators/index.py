"""What lookups need of a catalog: all spellings that reach an id with what is known of the id, shapes and leading letters; made for one plan, or kept by version.

A kept index is a folder of tables that many runs read. Spellings are bucketed and sorted by themselves, ids by id, so that a join with them moves the other side only. The version
is a digest of the catalog's records: the same records in any order have one index. Where a catalog differs from one that is kept, what hangs on
changed ids is made anew (their own rows, and the neighbours of ids whose neighbours came or went); the rest is carried over.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.functions.text import shape
from planmatch.operators import catalog as cat
from planmatch.operators.spelling import forms
from planmatch.sources.shared import shared_folder

#: Changes with what the tables hold, so that a kept index of other code isn't read.
FORMAT = 1
#: Bytes that a bucket is made for, of some hundred for each spelling.
BUCKET_ROWS = 500_000
IDS = "pole_id string, match_count long, source_ids array<string>, neighbours array<string>, digest long"
FORMS = "form string, pole_id string, phase int, ord int, cost int, made array<string>, match_count long, source_ids array<string>, neighbours array<string>"


@dataclass
class CatalogIndex:
    """ids: IDS; spellings: FORMS; shapes: shape, id_count; letters: the leading letters as one value."""

    ids: DataFrame
    spellings: DataFrame
    shapes: DataFrame
    letters: Column
    version: str | None = None


def records_digest() -> Column:
    """Of the records of an id, whatever their order."""
    row = F.xxhash64("source_id", "pole_id_raw", "x", "y", "status", "source_updated_at")
    # equal records cancel each other out in the exclusive or: their number tells them apart
    return F.xxhash64(F.bit_xor(row), F.sum(F.pmod(row, F.lit(2**31 - 1))), F.count("*"))


def digested(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(F.col("pole_id_normalized").alias("pole_id")).agg(records_digest().alias("digest"))


def version(catalog: DataFrame) -> str:
    found = digested(catalog).agg(F.bit_xor(F.xxhash64("pole_id", "digest")).alias("h"), F.count("*").alias("n")).first()
    return f"{FORMAT}-{found['n']}-{(found['h'] or 0) & (1 << 64) - 1:016x}"


def spelt(catalog_ids: DataFrame) -> DataFrame:
    """FORMS of IDS."""
    return forms(catalog_ids.select("pole_id")).join(catalog_ids.drop("digest"), "pole_id").select("form", "pole_id", "phase", "ord", "cost", "made", "match_count", "source_ids", "neighbours")


def shapes_of(ids: DataFrame) -> DataFrame:
    return ids.filter("pole_id <> ''").groupBy(shape("pole_id").alias("shape")).agg(F.count("*").alias("id_count"))


def plain(catalog: DataFrame) -> CatalogIndex:
    """An index that is made where it is used."""
    ids = cat.by_id(catalog, neighbours=True).join(digested(catalog), "pole_id")
    return CatalogIndex(ids, spelt(ids), cat.shapes(catalog), cat.letters_array(catalog))


# ---------------------------------------------------------------- kept


def _made(catalog: DataFrame, path: str) -> DataFrame:
    """IDS of ``catalog``, whose records are read once and gathered by id below ``path``: all else is told of ids, which may be far fewer."""
    gathered = catalog.groupBy(F.col("pole_id_normalized").alias("pole_id")).agg(F.count("*").alias("match_count"), F.array_sort(F.collect_set("source_id")).alias("source_ids"), records_digest().alias("digest"))
    gathered.write.parquet(path)
    own = catalog.sparkSession.read.schema(gathered.schema).parquet(path)
    ids = own.select("pole_id")
    return own.join(cat.neighbours_among(ids, ids), "pole_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))


def _table(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A bucketed table whose files lie at ``path``, under a name of this session."""
    name = "planmatch_" + path.rsplit("/", 2)[1].replace("-", "_") + "_" + path.rsplit("/", 1)[1]
    spark.sql(f"create table if not exists {name} ({schema}) using parquet clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{path}'")
    return spark.table(name)


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    name = "planmatch_new_" + uuid.uuid4().hex
    rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    # the name alone: a table with a path of its own leaves its files
    rows.sparkSession.sql(f"drop table {name}")


def _pointer(spark: SparkSession, folder: str):
    """Of the kept indexes, the newest of each version: version, path, buckets, made."""
    try:
        return spark.read.schema("version string, path string, buckets int, shapes long, made timestamp").parquet(f"{folder}/made")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def opened(spark: SparkSession, path: str, buckets: int, shape_count: int, version_: str) -> CatalogIndex:
    shapes = spark.read.schema("shape string, id_count long").parquet(f"{path}/shapes")
    letters = spark.read.schema("letter string").parquet(f"{path}/letters").agg(F.array_sort(F.collect_set("letter"))).scalar()
    # counted when they were made
    return CatalogIndex(_table(spark, f"{path}/ids", IDS, "pole_id", buckets), _table(spark, f"{path}/forms", FORMS, "form", buckets), F.broadcast(shapes) if shape_count <= 200_000 else shapes, letters, version_)


def kept(catalog: DataFrame, folder: str | None = None) -> CatalogIndex:
    """The index of ``catalog`` below ``folder`` (the shared folder if none is named): read if it is there, else made, from the newest other version where one is."""
    spark = catalog.sparkSession
    folder = folder or f"{shared_folder(spark)}/catalog-index"
    own = version(catalog)
    before = _pointer(spark, folder)
    rows = before.orderBy(F.desc("made")).limit(100).collect() if before is not None else []
    for r in rows:
        if r["version"] == own:
            return opened(spark, r["path"], r["buckets"], r["shapes"], own)
    path = f"{folder}/v{uuid.uuid4().hex}"
    # an index of other code has another layout
    old = next((r for r in rows if r["version"].startswith(f"{FORMAT}-")), None)
    ids = renewed(catalog, opened(spark, old["path"], old["buckets"], old["shapes"], old["version"])) if old else _made(catalog, f"{path}/records")
    buckets = max(1, -(-int(own.split("-")[1]) * 9 // BUCKET_ROWS))
    _write(ids.select("pole_id", "match_count", "source_ids", "neighbours", "digest"), f"{path}/ids", "pole_id", buckets)
    ids = _table(spark, f"{path}/ids", IDS, "pole_id", buckets)
    _write(spelt(ids), f"{path}/forms", "form", buckets)
    shapes_of(ids).write.parquet(f"{path}/shapes")
    ids.select(F.left("pole_id", F.lit(1)).alias("letter")).filter(F.col("letter").rlike(r"\p{L}")).distinct().write.parquet(f"{path}/letters")
    count = spark.read.parquet(f"{path}/shapes").count()
    # last: an index that broke off is never found
    spark.createDataFrame([(own, path, buckets, count)], "version string, path string, buckets int, shapes long").withColumn("made", F.current_timestamp()).write.mode("append").parquet(f"{folder}/made")
    return opened(spark, path, buckets, count, own)


def renewed(catalog: DataFrame, old: CatalogIndex) -> DataFrame:
    """IDS of ``catalog``, of which only ids with other records than in ``old``, and neighbours of ids that came or went, are made anew."""
    now, then = digested(catalog), old.ids.select("pole_id", F.col("digest").alias("before"))
    changed = now.join(then, "pole_id", "full").filter(~F.col("digest").eqNullSafe(F.col("before"))).select("pole_id", F.col("digest").isNotNull().alias("there"), F.col("before").isNull().alias("new"))
    came_or_went = changed.filter("not there or new").select("pole_id")
    keys = cat.blanked(came_or_went).select("k").distinct()
    # ids that have a neighbour among them, now or before
    beside = cat.blanked(now.select("pole_id")).join(keys, "k", "left_semi").select("pole_id")
    again = changed.filter("there").select("pole_id").union(beside).distinct()
    fresh = catalog.withColumnRenamed("pole_id_normalized", "pole_id").join(again, "pole_id", "left_semi").withColumnRenamed("pole_id", "pole_id_normalized")
    near = cat.neighbours_among(again, now.select("pole_id"))
    own = cat.by_id(fresh).join(digested(fresh), "pole_id").join(near, "pole_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))
    gone = changed.select("pole_id").union(beside).distinct()
    columns = ["pole_id", "match_count", "source_ids", "neighbours", "digest"]
    return old.ids.join(gone, "pole_id", "left_anti").select(*columns).unionByName(own.select(*columns))
