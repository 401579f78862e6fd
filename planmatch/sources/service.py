"""A remote feature service as a sink: connections, layers, permits with their poles, messages. The client library is the caller's.

A connection is opened where it is used, in the task, and never sent. What a service refuses is data: each permit has a row that says what was written of it.
"""

from __future__ import annotations

import hmac
import logging
import uuid
from collections.abc import Callable, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmatch.errors import EngineError, FieldError, ServiceError
from planmatch.operators.permits import POLE_FIELDS, WKID, WORK_AREA_FIELDS, resolve_fields

log = logging.getLogger(__name__)
RESULT = "doc_id long, permit_number string, object_id long, global_id string, pole_count long, error string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("permit_number", pa.string()), ("object_id", pa.int64()), ("global_id", pa.string()), ("pole_count", pa.int64()), ("error", pa.string())])
NEEDED = {"profile": ["profile"], "credentials": ["url", "username", "password"]}


def allowed(given: str | None, key: str) -> bool:
    """Whether a shared key is right, compared in constant time; no key configured lets all pass."""
    return not key or bool(given) and hmac.compare_digest(given.encode(), key.encode())


def upload(folder: str, content: bytes) -> str:
    """Lands a file in ``folder`` under a new job's id, where a stream of binary files picks it up; gives the id."""
    job = uuid.uuid4().hex
    target = Path(folder) / job / "input"
    target.mkdir(parents=True)
    part = target / ".source.part"
    part.write_bytes(content)
    part.rename(target / "source.pdf")
    return job


def connection(options: Mapping[str, str], open_: Callable[..., object]) -> object:
    """A session by ``mode``, profile or credentials; one that belongs to nobody is refused. ``open_`` takes the mode's options by name."""
    mode = options.get("mode", "")
    if mode not in NEEDED:
        raise EngineError(f"unsupported connection mode {mode!r}: expected profile or credentials")
    if missing := [n for n in NEEDED[mode] if not options.get(n)]:
        raise EngineError(f"connection mode {mode} needs {', '.join(missing)}")
    session = open_(**{n: options[n] for n in NEEDED[mode]})
    if getattr(session, "user", None) is None:
        shown = ", ".join(f"{n}={options[n]!r}" for n in NEEDED[mode] if n != "password")
        raise ServiceError(f"connected as nobody (mode {mode}, {shown}): check that the account can log in")
    return session


def member(connect: Callable[[], object], item_id: str, index: int, kind: str = "layers") -> object:
    """A layer or table of an item by its place. A refusal for lack of permission is tried once more over a fresh connection."""
    session = connect()
    try:
        item = session.item(item_id)
    except Exception as first:
        if "permission" not in str(first).lower():
            raise
        session = connect()
        try:
            item = session.item(item_id)
        except Exception as second:
            raise ServiceError(f"item {item_id} can't be accessed as {session.user}, nor could it be over another connection. First: {first}. Then: {second}") from second
    if item is None:
        raise ServiceError(f"item {item_id} was not found")
    found = getattr(item, kind)
    if index >= len(found):
        raise ServiceError(f"item {item_id} has no {kind[:-1]} at index {index}; it has {len(found)}: {', '.join(x.name for x in found)}")
    return found[index]


def created(permit: dict, connect: Callable[[], object], item_id: str, permits_at: int, poles_at: int) -> tuple:
    """Writes one permit, then its poles with the permit's global id, then its file; gives RESULT. What was written stays when a later part fails."""
    number, poles, ids = permit["permit_number"], permit["poles"] or [], (None, None)
    try:
        areas, points = member(connect, item_id, permits_at), member(connect, item_id, poles_at)
        own, theirs = resolve_fields(areas.fields, WORK_AREA_FIELDS, "the layer of permits"), resolve_fields(points.fields, POLE_FIELDS, "the layer of poles")
        feature = {"attributes": {own[c]: permit[c] for c in WORK_AREA_FIELDS}} | ({"geometry": permit["geometry"]} if permit.get("geometry") else {})
        (added,) = areas.add([feature])
        if not added.get("success"):
            return permit["doc_id"], number, None, None, 0, f"the permit wasn't created: {added.get('error')}"
        ids = added["objectId"], added["globalId"]
        if poles:
            rows = [{"geometry": {"x": p["x"], "y": p["y"], "spatialReference": {"wkid": WKID}}, "attributes": {theirs[c]: ids[1] if c == "permit_globalid" else number if c == "permit_number" else p[c] for c in POLE_FIELDS}} for p in poles]
            failed = [r for r in points.add(rows) if not r.get("success")]
            if failed:
                return permit["doc_id"], number, *ids, len(poles) - len(failed), f"permit {number} was created, but {len(failed)} of {len(poles)} poles weren't: {failed[0].get('error')}"
        if permit.get("content") is not None and not areas.attach(ids[0], permit["content"]):
            return permit["doc_id"], number, *ids, len(poles), f"permit {number} was created with {len(poles)} poles, but its file couldn't be attached"
    except (ServiceError, FieldError) as e:
        return permit["doc_id"], number, *ids, 0, str(e)
    except Exception as e:  # whatever the client raises fails this permit, and isn't written again by a retry of its task
        return permit["doc_id"], number, *ids, 0, f"Unexpected error: {e}"
    return permit["doc_id"], number, *ids, len(poles), None


def write_permits(permits: DataFrame, poles: DataFrame, connect: Callable[[], object], item_id: str, permits_at: int = 0, poles_at: int = 1, files: DataFrame | None = None) -> DataFrame:
    """RESULT of each permit (doc_id, WORK_AREA_FIELDS, perhaps geometry); poles: doc_id and the columns of ``permits.pole_rows``; files: doc_id, content.

    Each evaluation writes: save the result, and evaluate it no second time. A task that is run again writes its permits again: the data source ``features``
    keeps a ledger and doesn't.
    """
    row = F.struct("pole_id", "pole_owner", "confidence", "status", "x", "y")
    owned = poles.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("poles"))
    rows = permits.join(owned, "doc_id", "left")
    if files is not None:
        rows = rows.join(files.select("doc_id", "content"), "doc_id", "left")

    def go(batches):
        for batch in batches:
            for permit in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(created(permit, connect, item_id, permits_at, poles_at), _RESULT)], schema=_RESULT)

    return rows.mapInArrow(go, RESULT)


def send_messages(messages: DataFrame, deliver: Callable[[str, str, str], None] | None) -> None:
    """Delivers messages (to_address, subject, content) from the executors as well as it can: what fails is logged. Without ``deliver`` none are sent."""
    if deliver is None:
        log.warning("no mail host is configured: messages aren't sent")
        return

    def go(rows):
        for row in rows:
            try:
                deliver(row["to_address"], row["subject"], row["content"])
            except Exception:
                logging.getLogger(__name__).exception("a message could not be sent")

    messages.foreachPartition(go)
