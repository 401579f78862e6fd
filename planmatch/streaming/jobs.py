"""Jobs over time: their current state, as a batch and as keyed state of a stream, and permit numbers given out once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from planmatch.operators.running import held, running
from planmatch.sources.ledger import Ledger

STATUSES = ["queued", "processing", "completed", "failed"]


def state(events: DataFrame) -> DataFrame:
    """Current state of jobs from (job_id, seq, event, perhaps text).

    Jobs exist from their ``queued`` event on; what comes before is ignored. The last status wins, whatever it was before; ``progress`` sets
    the detail only.
    """
    text = F.col("text") if "text" in events.columns else F.lit(None).cast("string")
    born = F.min(F.when(F.col("event") == "queued", F.col("seq")))
    first = events.groupBy("job_id").agg(born.alias("born")).filter("born is not null")
    live = events.withColumn("text", text).join(first, "job_id").filter("seq >= born")
    is_status = F.col("event").isin(STATUSES)
    return live.groupBy("job_id").agg(
        F.max_by(F.when(is_status, F.col("event")), F.when(is_status, F.col("seq"))).alias("status"),
        F.max_by("text", F.when(F.col("event") == "progress", F.col("seq"))).alias("detail"), F.max_by("text", F.when(F.col("event") == "failed", F.col("seq"))).alias("error"), F.max("seq").alias("last_seq"),
    )


STATE = StructType([StructField("status", StringType()), StructField("detail", StringType()), StructField("error", StringType()), StructField("last_seq", LongType())])
OUTPUT = StructType([StructField("job_id", StringType()), *STATE.fields])


class JobState(StatefulProcessor):
    """Value state of one job; every batch gives the jobs that changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = list(self.value.get()) if self.value.exists() else None
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if now is None and row.event != "queued":
                continue
            now = now or [None, None, None, None]
            text = getattr(row, "text", None)
            if row.event in STATUSES:
                now[0] = row.event
            if row.event == "progress":
                now[1] = text
            if row.event == "failed":
                now[2] = text
            now[3] = int(row.seq)
        if now is not None:
            self.value.update(tuple(now))
            yield pd.DataFrame([[str(key[0]), *now]], columns=["job_id", *STATE.names])

    def close(self) -> None:
        pass


def stream_state(events: DataFrame) -> DataFrame:
    """The same state over a stream of events; needs the RocksDB state store."""
    keyed = events.withColumn("job_id", F.col("job_id").cast("string"))
    return keyed.groupBy("job_id").transformWithStateInPandas(JobState(), OUTPUT, "Update", "None")


def serialized(jobs: DataFrame, permits: DataFrame | None = None) -> DataFrame:
    """What a caller sees of a job: the status, and the error or detail that goes with it; with ``permits`` (job_id, object_id, global_id, permit_number,
    pole_count) also the permit of a completed one."""
    out = jobs.select("job_id", "status", F.when(F.col("status") == "failed", F.col("error")).alias("error"), F.when(F.col("status").isin("queued", "processing"), F.col("detail")).alias("detail"))
    if permits is None:
        return out
    names = {"objectId": "object_id", "globalId": "global_id", "permitNumber": "permit_number", "poleCount": "pole_count"}
    own = permits.select("job_id", F.struct(*[F.col(c).alias(n) for n, c in names.items()]).alias("permit"))
    return out.join(own, "job_id", "left").withColumn("permit", F.when(F.col("status") == "completed", F.col("permit")))


#: What a job says while it runs, by step.
STEPS = {
    "validate": "Checking the plan set...", "catalog": "Loading the pole catalog...", "native": "Searching the text of %d page(s)...", "preview": "Looking at page %d of %d...", "tile": "Reading tile %d of %d; %d candidate(s) so far...",
    "create": "Creating the permit and %d pole(s)...", "empty": "No poles were found: creating an empty permit...",
}


def message(step: str, *values: Column | str) -> Column:
    """A step's text with its numbers."""
    return F.format_string(STEPS[step], *values)


def progress(readings: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Running number of candidates after each tile (keys, order, candidate_count) and the text that says so, by document or, without keys, over all."""
    keys = keys if keys is not None else [c for c in ("doc_id",) if c in readings.columns]
    return running(readings.select(*keys, *order, "candidate_count"), keys, order, {"found_so_far": F.col("candidate_count")})


def progress_messages(progressed: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """Events (keys, seq, event, text) of tiles read, for the job state."""
    window = Window.partitionBy(*keys)
    seq = F.row_number().over(window.orderBy(*order))
    return progressed.select(*keys, seq.alias("seq"), F.lit("progress").alias("event"), message("tile", seq, F.count("*").over(window), F.col("found_so_far")).alias("text"))


class PermitNumbers:
    """Sink of micro-batches that numbers each job once; ``number`` gives the batch's numbers as a table.

    The last number after each batch is a record of its own, and so is each job's number: a batch reads the record of the batch before and those of its own jobs, however
    many were ever issued. A batch that runs again has its numbers from the same start and in the same order, whether it ended before or not.
    """

    def __init__(self, path: str, year: int, last: int = 0):
        self.path, self.year, self.first = path, year, last
        self.jobs, self.ends = Ledger(f"{path}/jobs"), Ledger(f"{path}/ends")

    def last(self, batch_id: int) -> int:
        """The last number before a batch: that of the nearest batch before, which is the one before but where numbers were skipped."""
        for i in range(batch_id - 1, -1, -1):
            if (found := self.ends.get(str(i))) is not None:
                return found["last"]
        return self.first

    def number(self, batch: DataFrame, batch_id: int, key: str = "job_id", ts: str = "ts") -> DataFrame:
        """job_id, number, permit_number, batch of the batch's jobs; those that another batch numbered keep what they have."""
        from planmatch.operators.permits import numbers

        asked = batch.select(F.col(key).cast("string").alias("job_id"), F.col(ts).alias("ts")).groupBy("job_id").agg(F.min("ts").alias("ts"))
        known = self.jobs.known(asked, "job_id")
        part = lambda name: F.get_json_object("known", f"$.{name}")
        known = held(known.select("job_id", "ts", part("number").cast("long").alias("number"), part("permit_number").alias("permit_number"), part("batch").cast("long").alias("batch")))
        before = known.filter(F.col("batch") != batch_id).select("job_id", "number", "permit_number", "batch")
        last = self.last(batch_id)
        new = numbers(known.filter(F.col("batch").isNull() | (F.col("batch") == batch_id)).select("job_id", "ts"), last, by=["ts", "job_id"], year=F.lit(self.year))
        new = new.select("job_id", "number", "permit_number", F.lit(batch_id).cast("long").alias("batch"))
        self.jobs.enter(new, "job_id")
        self.ends.put(str(batch_id), {"last": last + new.count()})
        return before.unionByName(new)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.number(batch, batch_id)

    def issued(self, spark) -> DataFrame:
        """All numbers ever issued, for reports."""
        schema = "key string, number long, permit_number string, batch long"
        return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{self.path}/jobs").withColumnRenamed("key", "job_id")


class Outbox:
    """Sink of micro-batches of messages (key, to_address, subject, content) that sends each key once. A message is marked when it is sent: a batch that runs
    again sends those without a mark. Only a task that ends between the two sends one of its messages twice."""

    def __init__(self, path: str, deliver: Callable[[str, str, str], None]):
        self.sent, self.deliver = Ledger(f"{path}/sent"), deliver

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        sent, deliver = self.sent, self.deliver

        def go(rows):
            for r in rows:
                if (sent.get(r["key"]) or {}).get("sent"):
                    continue
                try:
                    deliver(r["to_address"], r["subject"], r["content"])
                except Exception as e:  # best effort: the next run of the batch, or a message of the same key, tries again
                    sent.put(r["key"], {"sent": False, "batch": batch_id, "error": str(e)})
                else:
                    sent.put(r["key"], {"sent": True, "batch": batch_id, "error": None})

        # one task for all messages of a key, so that it is looked up after it was marked
        batch.filter("key is not null").dropDuplicates(["key"]).foreachPartition(go)


def outbox(messages: DataFrame, path: str, deliver: Callable[[str, str, str], None], delay: str = "1 day"):
    """A stream of messages (ts, key, to_address, subject, content) into an outbox: copies of a key within ``delay`` are dropped by the stream's own state, later ones by the marks."""
    once = messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])
    return once.writeStream.foreachBatch(Outbox(path, deliver))
