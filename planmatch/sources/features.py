"""A sink of permits and their poles in a remote feature service, as a data source that Spark writes batches and streams to.

    permits.write.format("features").mode("append").option("client", "module:function").option("item", "…").option("ledger", "…").save()

A row is a permit: doc_id, WORK_AREA_FIELDS, poles (array of structs with pole_id, pole_owner, confidence, status, x, y), perhaps geometry (JSON text) and content. ``client`` names a
function that takes the options and opens a session; it is called in the task, once for all of its permits. Each step on a permit is entered in a ledger by permit number, before and
after: a task that was cut off and runs again asks the service for what a step that was begun has left, and goes on from there. So a permit is added once, and its
poles once each, as long as no two attempts of one task run at the same time (no speculative execution for this stage).

What the service refuses, or any error on a permit's way, is that permit's result and no one else's; ``results`` has a row for each. A later write of the same permit goes on where it failed.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from planmatch.errors import EngineError, FieldError, ServiceError
from planmatch.operators.permits import POLE_FIELDS, WKID, WORK_AREA_FIELDS, resolve_fields
from planmatch.sources.ledger import Ledger, store
from planmatch.sources.service import member

RESULT = "doc_id string, permit_number string, object_id long, global_id string, pole_count long, step string, error string"
NEEDED = ["client", "item", "ledger"]
#: Poles that are added at once.
SIZE = 500


@dataclass
class Written(WriterCommitMessage):
    """Of a task: permits that are done and that failed."""

    done: int
    failed: int


class Layers:
    """The two layers of a session and their fields' names, looked up once a task."""

    def __init__(self, options: dict[str, str]):
        module, name = options["client"].split(":")
        open_: Callable = getattr(importlib.import_module(module), name)
        session = open_(options)
        # a refused item is tried once more over another session
        sessions = iter([session])
        connect = lambda: next(sessions, None) or open_(options)
        self.permits = member(connect, options["item"], int(options.get("permits_at", "0")))
        self.poles = member(lambda: session, options["item"], int(options.get("poles_at", "1")))
        self.own = resolve_fields(self.permits.fields, WORK_AREA_FIELDS, "the layer of permits")
        self.theirs = resolve_fields(self.poles.fields, POLE_FIELDS, "the layer of poles")

    def permit(self, row: dict) -> dict:
        shape = json.loads(row["geometry"]) if row.get("geometry") else None
        return {"attributes": {self.own[c]: row[c] for c in WORK_AREA_FIELDS}} | ({"geometry": shape} if shape else {})

    def pole(self, pole: dict, number: str, global_id: str) -> dict:
        values = pole | {"permit_number": number, "permit_globalid": global_id}
        return {"geometry": {"x": pole["x"], "y": pole["y"], "spatialReference": {"wkid": WKID}}, "attributes": {self.theirs[c]: values[c] for c in POLE_FIELDS}}


def settle(row: dict, layers: Layers, ledger: Ledger) -> dict:
    """Brings one permit as far as it goes, from wherever the ledger has it; gives its record. Steps: begun, permit, poles, done."""
    number, poles = row["permit_number"], row.get("poles") or []
    before = ledger.get(number)
    now = before or {"doc_id": str(row["doc_id"]), "permit_number": number, "object_id": None, "global_id": None, "pole_count": 0, "step": "begun", "error": None}
    if now["step"] == "done":
        return now

    def reached(**values) -> None:
        now.update(values)
        ledger.put(number, now)

    reached(error=None)
    try:
        if now["step"] == "begun":
            # an attempt before may have added it and not come back
            left = layers.permits.find(layers.own["permit_number"], number) if before else []
            if not left:
                (added,) = layers.permits.add([layers.permit(row)])
                if not added.get("success"):
                    raise ServiceError(f"the permit wasn't created: {added.get('error')}")
                left = [added]
            reached(step="permit", object_id=left[0]["objectId"], global_id=left[0]["globalId"])
        if now["step"] == "permit":
            key = layers.theirs["pole_id"]
            there = {p["attributes"][key] for p in layers.poles.find(layers.theirs["permit_globalid"], now["global_id"])} if before else set()
            missing = [p for p in poles if p["pole_id"] not in there]
            failed: list[dict] = []
            for i in range(0, len(missing), SIZE):
                failed += [r for r in layers.poles.add([layers.pole(p, number, now["global_id"]) for p in missing[i : i + SIZE]]) if not r.get("success")]
            reached(pole_count=len(poles) - len(failed))
            if failed:
                raise ServiceError(f"permit {number} was created, but {len(failed)} of {len(poles)} poles weren't: {failed[0].get('error')}")
            reached(step="poles")
        if row.get("content") is not None and not (before and layers.permits.attached(now["object_id"])) and not layers.permits.attach(now["object_id"], bytes(row["content"])):
            raise ServiceError(f"permit {number} was created with {len(poles)} poles, but its file couldn't be attached")
        reached(step="done")
    except (ServiceError, FieldError) as e:
        reached(error=str(e))
    except Exception as e:  # whatever a client library raises is this permit's failure
        reached(error=f"Unexpected error: {e}")
    return now


def written(rows: Iterator[Row], options: dict[str, str]) -> Written:
    ledger, layers, fault, done, failed = Ledger(options["ledger"] + "/permits"), None, None, 0, 0
    for row in rows:
        row = row.asDict(recursive=True)
        if layers is None and fault is None:
            try:
                layers = Layers(options)
            except Exception as e:  # no permit of this task can be written
                fault = str(e) if isinstance(e, (ServiceError, FieldError)) else f"Unexpected error: {e}"
        if layers is None:
            empty = {"doc_id": str(row["doc_id"]), "permit_number": row["permit_number"], "object_id": None, "global_id": None, "pole_count": 0, "step": "begun"}
            found = (ledger.get(row["permit_number"]) or empty) | {"error": fault}
            ledger.put(row["permit_number"], found)
        else:
            found = settle(row, layers, ledger)
        done, failed = done + (found["error"] is None), failed + (found["error"] is not None)
    return Written(done, failed)


def noted(options: dict[str, str], name: str, messages: list) -> None:
    """What became of a write: a few numbers, from as many as there are tasks."""
    own = [m for m in messages if m is not None]
    system, top = store(options["ledger"])
    system.create_dir(f"{top}/writes", recursive=True)
    with system.open_output_stream(f"{top}/writes/{name}.json") as f:
        f.write(json.dumps({"write": name, "tasks": len(messages), "ended": len(own), "done": sum(m.done for m in own), "failed": sum(m.failed for m in own)}).encode())


class Features(DataSource):
    """Options: client, item and ledger; permits_at and poles_at (places of the layers, 0 and 1); and whatever the client takes."""

    @classmethod
    def name(cls) -> str:
        return "features"

    def _checked(self) -> dict[str, str]:
        options = dict(self.options)
        if missing := [n for n in NEEDED if not options.get(n)]:
            raise EngineError(f"the sink of features needs the options {', '.join(missing)}")
        return options

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise EngineError("permits can only be appended")
        return Writer(self._checked())

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return StreamWriter(self._checked())


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options, self.run = options, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        return written(iterator, self.options)

    def commit(self, messages: list) -> None:
        noted(self.options, f"{self.run}-done", messages)

    def abort(self, messages: list) -> None:
        """Nothing is taken back: the ledger knows what was written, and the next write goes on from there."""
        noted(self.options, f"{self.run}-broken-off", messages)


class StreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator[Row]) -> Written:
        return written(iterator, self.options)

    def commit(self, messages: list, batchId: int) -> None:
        noted(self.options, f"batch-{batchId}-done", messages)

    def abort(self, messages: list, batchId: int) -> None:
        noted(self.options, f"batch-{batchId}-broken-off", messages)


def results(spark: SparkSession, ledger: str) -> DataFrame:
    """RESULT of every permit that was ever begun."""
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{ledger}/permits")
