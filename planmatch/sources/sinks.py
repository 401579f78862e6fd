"""Sinks: feature tables, attachments, evidence as JSON, and options from the environment."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def option(values: Mapping[str, str] | None, name: str, default, kind: Callable = str):
    """A setting; blank counts as absent."""
    text = (values if values is not None else os.environ).get(name, "").strip()
    return kind(text) if text else default


def ascii_json(value: Column) -> Column:
    """JSON text with all but ASCII escaped, characters beyond 16 bits as two."""
    escaped = lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")).otherwise(c)
    return F.when(value.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), escaped), "")).otherwise(value)


def evidence(report: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """A JSON document for each row, all ASCII; the write is committed as a whole. With ``keys`` each is indented and lies in a folder of its own, named by the row's keys; without, they are lines."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true" if keys else "false"})
    written = report.select(*(keys or []), ascii_json(text).alias("value")).write.mode("overwrite")
    (written.partitionBy(*keys) if keys else written).text(path)


def write_features(permits: DataFrame, poles: DataFrame, folder: str, batch_id: int = 0) -> None:
    """Permits first, then their poles: the order in which a remote service would be told. Each batch has folders of its own, which the same
    batch run again replaces and other batches leave as they are; permits without their poles show where a batch broke off."""
    permits.write.mode("overwrite").parquet(f"{folder}/permits/batch={batch_id}")
    poles.write.mode("overwrite").parquet(f"{folder}/poles/batch={batch_id}")


def attachments(permits: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(permit_number, path, content) of the plan sets that permits were made from."""
    return permits.select(*keys, "permit_number").join(files, keys).select("permit_number", "path", "content")


def remote(send: Callable[[list[dict]], None], connect: Callable[[], object] | None = None, size: int = 500):
    """A ``foreachBatch`` function that sends rows in batches from the executors, over a connection opened for each partition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def go(rows):
            if connect is not None:
                connect()
            held = []
            for row in rows:
                held.append(row.asDict(recursive=True))
                if len(held) == size:
                    send(held)
                    held = []
            if held:
                send(held)

        batch.foreachPartition(go)

    return write
