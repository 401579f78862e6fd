"""A ledger of small records by key in the shared folder: what was done, so that work that runs again does no part of it twice.

A record is a file of its own, written whole and then moved to its name: a reader sees the one before or the one after. Looking up or adding a record costs the same however many
there are, and is done where the rows are, in tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's address: local, file:, hdfs:, s3: and others that pyarrow knows."""
    if re.match(r"file:/|/", address) or "://" not in address:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", address)
    return fs.FileSystem.from_uri(address)


class Ledger:
    def __init__(self, folder: str):
        self.folder = folder

    def _at(self, key: str) -> tuple[fs.FileSystem, str, str]:
        system, top = store(self.folder)
        name = hashlib.sha256(key.encode()).hexdigest()
        return system, f"{top}/{name[:2]}", name

    def get(self, key: str) -> dict | None:
        system, folder, name = self._at(key)
        try:
            with system.open_input_stream(f"{folder}/{name}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, key: str, record: dict) -> None:
        system, folder, name = self._at(key)
        system.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(record | {"key": key}).encode())
        try:
            system.move(part, f"{folder}/{name}.json")
        except OSError:  # stores whose names can't be moved over
            system.delete_file(f"{folder}/{name}.json")
            system.move(part, f"{folder}/{name}.json")

    def known(self, rows: DataFrame, key: str, column: str = "known") -> DataFrame:
        """``rows`` with the record of their ``key`` as JSON text, null where there is none."""
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != column), f"`{column}` string"])
        names = [c for c in rows.columns if c != column]

        def go(batches):
            for batch in batches:
                found = [None if k is None else self.get(str(k)) for k in batch.column(key).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([None if x is None else json.dumps(x) for x in found], pa.string())], names=[*names, column])

        return rows.select(*names).mapInArrow(go, schema)

    def enter(self, rows: DataFrame, key: str) -> None:
        """Adds or replaces the record of each row, made of its other columns."""
        own = rows.select(F.col(key).cast("string").alias("k"), F.to_json(F.struct(*[c for c in rows.columns if c != key]), {"ignoreNullFields": "false"}).alias("v"))

        def go(part):
            for r in part:
                if r["k"] is not None:
                    self.put(r["k"], json.loads(r["v"]))

        own.foreachPartition(go)
