"""From arriving files to permits: a stream of plan sets, each batch run through the whole flow, every document with a job of its own.

    query = runner.start(spark, "…/uploads", Runner(folder, catalog, …), checkpoint)

What goes wrong in a document is its job's failure and leaves the others of its batch alone: checks and parsing give errors as data, and where the flow itself stops on a document,
the batch is halved until that document is alone. Errors that aren't a document's (a lost executor, a full disk) stop the stream, which starts the batch again.

All tables have a folder for each batch, written whole at its end: a batch that runs again replaces them by equal ones. Permit numbers, features and messages are in ledgers by
document, so that a second run issues, writes and sends nothing twice. A document that arrives again in a later batch is passed over once its job has completed, and tried anew if it failed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException, PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from planmatch.operators import index
from planmatch.plans import flow
from planmatch.sources import pdf
from planmatch.sources.features import results
from planmatch.sources.ledger import Ledger, store
from planmatch.streaming.jobs import STEPS, PermitNumbers

JOB = "doc_id string, status string, error string, permit_number string, object_id long, global_id string, pole_count long"
FILE = "doc_id string, path string, length long, submitted_at timestamp, error string"
EVENT = "doc_id string, seq long, event string, text string"
#: Tables of the flow that are kept.
KEPT = {"poles": "doc_id string, pole_id string, x double, y double, discovery_sources array<string>, pages array<int>, confidence double", "status": None, "review_queue": None}


def job_of(path) -> F.Column:
    """A file's job: the folder of its upload, or its own address elsewhere."""
    folder = F.regexp_extract(path, r"/([^/]+)/input/[^/]+$", 1)
    return F.when(folder != "", folder).otherwise(path)


def of_a_document(e: Exception) -> bool:
    """Whether an error came from the data or the code that reads it, and not from the cluster."""
    text = str(e)
    if any(x in text for x in ("ExecutorLostFailure", "FetchFailed", "No space left", "OutOfMemory", "Connection refused", "cancelled")):
        return False
    return isinstance(e, PythonException) or isinstance(e, PySparkException) and bool(e.getCondition()) or "org.apache.spark.api.python.PythonException" in text


class Runner:
    """A ``foreachBatch`` function over files (path, modificationTime, length, content).

    catalog: gives the catalog's records. previews, tiles: from (pages or tiles, files) to their replies, as ``flow.discover`` takes them; without one a page is taken as unread. load: the PDF library.
    features: options of the sink of features; without them permits stay in tables.
    """

    def __init__(self, folder: str, catalog: Callable[[SparkSession], DataFrame], *, year: int, load: Callable = pdf.parser, previews: Callable | None = None, tiles: Callable | None = None, features: dict[str, str] | None = None, last_number: int = 0):
        self.folder, self.catalog, self.load, self.previews, self.tiles, self.features = folder, catalog, load, previews, tiles, features
        self.numbers, self.finished = PermitNumbers(f"{folder}/numbers", year, last_number), Ledger(f"{folder}/finished")

    # ------------------------------------------------------------ tables of a batch

    def table(self, spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
        """A table over all batches."""
        reader = spark.read.schema(f"{schema}, batch long") if schema else spark.read
        return reader.parquet(f"{self.folder}/{name}")

    def save(self, rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def say(self, docs: DataFrame, batch_id: int, step: int, event: str, text: F.Column) -> None:
        """An event of each document's job, which a caller sees while the batch runs; the same step said again replaces it."""
        docs.select("doc_id", F.lit(batch_id * 1000 + step).cast("long").alias("seq"), F.lit(event).alias("event"), text.cast("string").alias("text")).write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch_id}/step={step}")

    # ------------------------------------------------------------ a batch

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = batch.select(job_of(F.col("path")).alias("doc_id"), "path", "length", F.col("modificationTime").alias("submitted_at"), "content")
        known = self.finished.known(files.select("doc_id").distinct(), "doc_id")
        done = known.filter((F.get_json_object("known", "$.status") == "completed") & (F.get_json_object("known", "$.batch").cast("long") != batch_id)).select("doc_id")
        # one file for each job: the first of those of one address
        files = files.join(self.save(done, "passed_over", batch_id), "doc_id", "left_anti")
        checked = pdf.opened(pdf.validated(files), self.load)
        arrived = self.save(checked.drop("content").groupBy("doc_id").agg(*[F.min_by(c, "path").alias(c) for c in ("path", "length", "submitted_at", "error")]), "files", batch_id)
        self.say(arrived, batch_id, 0, "queued", F.lit(None))
        self.say(arrived, batch_id, 1, "processing", F.lit(None))
        self.say(arrived, batch_id, 2, "progress", F.lit(STEPS["validate"]))
        good = arrived.filter("error is null").select("doc_id", "path")
        content = self.save(pdf.content(files.join(good, ["doc_id", "path"], "left_semi").withColumn("error", F.lit(None).cast("string")), self.load, faults=True).withColumn("path", F.col("doc_id")).withColumn("doc_id", job_of(F.col("path"))), "content", batch_id)
        unread = content.filter("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))
        self.say(content.filter("error is null").groupBy("doc_id").count(), batch_id, 3, "progress", F.format_string(STEPS["native"], "count"))
        whole = good.join(unread, "doc_id", "left_anti").select("doc_id")
        found, failed = self.attempt(spark, self.save(whole, "tried", batch_id), content.filter("error is null").drop("error"), files)
        failures = [arrived.filter("error is not null").select("doc_id", "error"), unread, spark.createDataFrame(failed, "doc_id string, error string")]
        failures = self.save(reduce(DataFrame.unionByName, failures), "failures", batch_id)
        kept = {name: self.save(rows, name, batch_id) for name, rows in found.items()}
        self.permit(spark, arrived.join(failures, "doc_id", "left_anti"), kept.get("poles"), failures, files, batch_id)

    def attempt(self, spark: SparkSession, docs: DataFrame, content: DataFrame, files: DataFrame) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
        """KEPT tables of ``docs``, and those in which the flow stops, each with its error: a batch that stops is halved by a hash of doc_id until one document is alone."""
        scratch, tables, failed, todo = f"{self.folder}/work/{uuid.uuid4().hex}", [], [], [(docs, 0)]
        while todo:
            part, depth = todo.pop()
            count = part.count()
            if not count:
                continue
            path = f"{scratch}/{len(tables)}-{depth}-{len(todo)}"
            try:
                self.discover(spark, part, content, files, path)
                tables.append(path)
            except Exception as e:
                if not of_a_document(e):
                    raise
                if count == 1:
                    failed.append((part.first()["doc_id"], f"Unexpected error: {said(e)}"))
                else:
                    half = F.pmod(F.xxhash64("doc_id", F.lit(depth)), F.lit(2))
                    todo += [(part.filter(half == i), depth + 1) for i in (0, 1)]
        return {name: reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/{name}") for p in tables]) for name in KEPT if tables}, failed

    def discover(self, spark: SparkSession, docs: DataFrame, content: DataFrame, files: DataFrame, path: str) -> None:
        """The flow over some documents, its tables written below ``path``."""
        own = content.join(docs, "doc_id", "left_semi")
        theirs = files.join(docs, "doc_id", "left_semi").select("doc_id", "content")
        nothing = lambda keys: spark.createDataFrame([], ", ".join(["doc_id string", *(f"{k} int" for k in keys), "raw_response string"]))
        records, keep = self.catalog(spark), flow.Tabled(path)
        got = flow.discover(
            catalog=index.kept(records, f"{self.folder}/catalog-index"), records=records, inspections=pdf.pages(own), words=pdf.words(own), documents=docs, keep=keep,
            previews=(lambda pages: self.previews(pages, theirs)) if self.previews else nothing(["page_number"]), tile_replies=(lambda grid: self.tiles(grid, theirs)) if self.tiles else nothing(["page_number", "tile_index"]),
        )
        keep("status", got["status"])
        keep("review_queue", got["review_queue"])

    def permit(self, spark: SparkSession, good: DataFrame, poles: DataFrame | None, failures: DataFrame, files: DataFrame, batch_id: int) -> None:
        """Numbers, permits, poles and features of the documents that came through, and the batch's jobs."""
        poles = poles if poles is not None else spark.createDataFrame([], KEPT["poles"])
        counts = good.select("doc_id").join(poles.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        self.say(counts, batch_id, 4, "progress", F.when(F.col("n") > 0, F.format_string(STEPS["create"], "n")).otherwise(STEPS["empty"]))
        numbered = self.save(self.numbers.number(good, batch_id, "doc_id", "submitted_at").withColumnRenamed("job_id", "doc_id").drop("batch"), "permit_numbers", batch_id)
        made = flow.permitted(numbered, poles)
        permits, rows = self.save(made["permits"], "permits", batch_id), self.save(made["pole_rows"], "pole_rows", batch_id)
        count = rows.groupBy("doc_id").agg(F.count("*").alias("pole_count"))
        if self.features:
            written = self.write(spark, permits, rows, files)
            own = written.select("doc_id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error", "permit_number", "object_id", "global_id", "pole_count")
        else:
            own = permits.join(count, "doc_id", "left").select("doc_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"), "permit_number", "object_id", "global_id", F.coalesce("pole_count", F.lit(0)).alias("pole_count"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("permit_number", "string"), ("object_id", "long"), ("global_id", "string"), ("pole_count", "long"))]
        jobs = self.save(own.unionByName(failures.select("doc_id", F.lit("failed").alias("status"), "error", *none)), "jobs", batch_id)
        self.say(jobs.filter("status = 'completed'"), batch_id, 5, "completed", F.col("permit_number"))
        self.say(jobs.filter("status = 'failed'"), batch_id, 6, "failed", F.col("error"))
        self.finished.enter(jobs.select("doc_id", "status", "permit_number", F.lit(batch_id).alias("batch")), "doc_id")

    def write(self, spark: SparkSession, permits: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
        """Permits with their poles and files into the service; RESULT of each."""
        owned = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pole_id", "pole_owner", "confidence", "status", "x", "y"))).alias("poles"))
        shaped = permits.withColumn("geometry", F.to_json("geometry")).join(owned, "doc_id", "left").join(files.select("doc_id", "content"), "doc_id", "left")
        ledger = f"{self.folder}/features"
        shaped.write.format("features").mode("append").options(**(self.features | {"ledger": ledger})).save()
        return results(spark, ledger).join(permits.select("permit_number"), "permit_number", "left_semi")

    # ------------------------------------------------------------ what a caller sees

    def events(self, spark: SparkSession) -> DataFrame:
        """(job_id, seq, event, text), as ``jobs.state`` takes them; those of batches that still run included."""
        return spark.read.schema(f"{EVENT}, batch long, step int").parquet(f"{self.folder}/events").withColumnRenamed("doc_id", "job_id").drop("batch", "step")

    def messages(self, spark: SparkSession, to: F.Column) -> DataFrame:
        """A message for each job that has ended, keyed by job and status, as an outbox takes them."""
        jobs = self.table(spark, "jobs", JOB)
        subject = F.when(F.col("status") == "completed", F.concat(F.lit("Permit "), "permit_number")).otherwise("Your plan set could not be read")
        content = F.when(F.col("status") == "completed", F.format_string("%d pole(s) were found.", F.coalesce("pole_count", F.lit(0)))).otherwise(F.col("error"))
        return jobs.select(F.concat_ws(":", "doc_id", "status").alias("key"), to.alias("to_address"), subject.alias("subject"), content.alias("content"))


def said(e: Exception) -> str:
    """The last line of what an error says of the cause."""
    lines = [x.strip() for x in str(e).split("JVM stacktrace")[0].splitlines() if x.strip() and not x.lstrip().startswith(("at ", "File "))]
    named = [x for x in lines if x.split(":")[0].endswith(("Error", "Exception"))]
    return (named or lines or [type(e).__name__])[-1][:500]


def start(spark: SparkSession, uploads: str, runner: Runner, checkpoint: str, files_per_batch: int = 100, once: bool = True) -> StreamingQuery:
    """The stream of files below ``uploads`` into a runner; ``once``: until all that are there are done, else for ever."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").option("maxFilesPerTrigger", files_per_batch).load(uploads)
    writer = stream.writeStream.foreachBatch(runner).option("checkpointLocation", checkpoint).queryName("plan_sets")
    return (writer.trigger(availableNow=True) if once else writer).start()


class Progress(StreamingQueryListener):
    """Events of the queries themselves, as records of a ledger's folder that anyone may read while they run: started, a batch with its rows and seconds, ended and why."""

    def __init__(self, folder: str):
        self.folder, self.place = folder, 0

    def _note(self, run: str, event: str, **values) -> None:
        system, top = store(self.folder)
        system.create_dir(top, recursive=True)
        self.place += 1
        with system.open_output_stream(f"{top}/{run}-{self.place:08d}.json") as f:
            f.write(json.dumps({"run": run, "seq": self.place, "event": event, **values}).encode())

    def onQueryStarted(self, event) -> None:
        self._note(str(event.runId), "started", text=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._note(str(p.runId), "batch", batch=p.batchId, rows=p.numInputRows, seconds=p.batchDuration / 1000, text=f"Batch {p.batchId}: {p.numInputRows} file(s) in {p.batchDuration / 1000:.1f} s")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._note(str(event.runId), "ended", text=event.exception)

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("run string, seq long, event string, batch long, rows long, seconds double, text string").json(self.folder)
