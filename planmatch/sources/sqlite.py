"""Read-only SQLite data source for catalogs, with configured column names.

    spark.dataSource.register(CatalogSource)
    spark.read.format("sqlite_catalog").options(path=..., table=..., id=..., source_id=..., x=..., y=...).load()

Large tables are read in ranges of rowid, one partition each; views and tables without one in a single partition.
"""

from __future__ import annotations

import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from planmatch.errors import CatalogError
from planmatch.operators import catalog

COLUMNS = {"id": "pole_id_raw", "source_id": "source_id", "x": "x", "y": "y", "status": "status", "updated": "source_updated_at"}
SCHEMA = "source_id string, pole_id_raw string, x string, y string, status string, source_updated_at string"
DEFAULTS = {"table": "SupportStructure", "id": "FacilityID", "source_id": "OBJECTID", "x": "X", "y": "Y"}


def connect(path: str) -> sqlite3.Connection:
    file = Path(path).expanduser().resolve()
    if not file.exists():
        raise CatalogError(f"the catalog database does not exist: {file}")
    return sqlite3.connect(f"{file.as_uri()}?mode=ro", uri=True, timeout=30)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def resolved(options: dict[str, str]) -> tuple[str, str, dict[str, str]]:
    """Path, actual table name and actual column names; stops with what there is instead where something is missing."""
    given = {**DEFAULTS, **{k: v.strip() for k, v in options.items() if v is not None}}
    with connect(given.get("path", "")) as db:
        there = [r[0] for r in db.execute("select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name")]
        table = next((t for t in there if t.lower() == given["table"].lower()), None)
        if table is None:
            raise CatalogError(f"table or view {given['table']!r} was not found. Available: {', '.join(there) or 'none'}")
        names = {r[1].lower(): r[1] for r in db.execute(f"pragma table_info({quoted(table)})")}
    wanted = {k: given.get(k, "") for k in COLUMNS}
    if missing := [f"{k}={v!r}" for k, v in wanted.items() if v and v.lower() not in names]:
        raise CatalogError(f"configured columns not found in {table!r}: {', '.join(missing)}. Available columns: {', '.join(names.values())}")
    if bare := [k for k in ("id", "source_id", "x", "y") if not wanted[k]]:
        raise CatalogError(f"these columns must be configured: {', '.join(bare)}")
    return given["path"], table, {k: names[v.lower()] for k, v in wanted.items() if v}


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_catalog"

    def schema(self) -> str:
        resolved(dict(self.options))
        return SCHEMA

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(dict(self.options))


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table, self.columns = resolved(options)
        self.rows = int(options.get("rowsPerPartition", 500_000))

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as db:
            try:
                low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [InputPartition(None)]
        if low is None or isinstance(low, str):
            return [InputPartition(None)]
        return [InputPartition((a, min(a + self.rows - 1, high))) for a in range(low, high + 1, self.rows)]

    def read(self, partition: InputPartition):
        names = ["source_id", "id", "x", "y", "status", "updated"]
        select = ", ".join(quoted(self.columns[n]) if n in self.columns else "null" for n in names)
        where, limits = (" where rowid between ? and ?", partition.value) if partition.value else ("", ())
        with connect(self.path) as db:
            for row in db.execute(f"select {select} from {quoted(self.table)}{where}", limits):
                yield tuple(None if v is None else str(v) for v in row)


def load_catalog(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Checked catalog records of a database."""
    spark.dataSource.register(CatalogSource)
    return catalog.load(spark.read.format("sqlite_catalog").options(path=path, **options).load(), check=True)
