"""From files to permits: failures are one job's, batches run again change nothing, and a caller sees how far a job is."""

import json
import time

import pandas as pd
import pytest
from fake_pdf import library
from fake_service import session
from pyspark.sql import functions as F

from planmatch.operators import catalog as cat
from planmatch.sources.features import Features
from planmatch.sources.ledger import Ledger
from planmatch.streaming import jobs, runner

IDS = [("S1", "O131F", "1", "2"), ("S2", "O200", "5", "6"), ("S3", "D044", "9", "9")]


def records(spark):
    return cat.load(spark.createDataFrame(IDS, "source_id string, pole_id_raw string, x string, y string"))


def land(folder, job, pages, head=b"%PDF-"):
    """A plan set as an upload lands it."""
    target = folder / job / "input"
    target.mkdir(parents=True, exist_ok=True)
    (target / "source.pdf").write_bytes(head + json.dumps({"pages": pages}).encode())


def tables(own, spark):
    return {n: sorted(str(tuple(r)) for r in own.table(spark, n).collect()) for n in ("jobs", "permits", "pole_rows", "permit_numbers", "failures", "files", "poles")}


@pytest.fixture
def uploads(tmp_path):
    land(tmp_path / "up", "good", [{"words": ["O131F", "and", "O", "200"]}])
    land(tmp_path / "up", "broken", [{"words": ["D044"]}, {"words": [], "fault": "page 2 is torn"}])
    land(tmp_path / "up", "other", [{"words": ["plain"]}], b"no header")
    return tmp_path / "up"


def test_two_files_and_a_replay(spark, tmp_path, uploads):
    spark.dataSource.register(Features)
    own = runner.Runner(f"{tmp_path}/out", records, year=2026, load=library, last_number=10, features={"client": "fake_service:session", "item": "it", "folder": f"{tmp_path}/service"})
    heard = runner.Progress(f"{tmp_path}/heard")
    spark.streams.addListener(heard)
    try:
        runner.start(spark, str(uploads), own, f"{tmp_path}/ck").awaitTermination()
        deadline = time.time() + 30
        while time.time() < deadline and not any(r["event"] == "ended" for r in (heard.events(spark).collect() if (tmp_path / "heard").exists() else [])):
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(heard)
    job = {r["doc_id"]: r for r in own.table(spark, "jobs", runner.JOB).collect()}
    assert {d: r["status"] for d, r in job.items()} == {"good": "completed", "broken": "failed", "other": "failed"}
    assert (job["good"]["permit_number"], job["good"]["pole_count"]) == ("11-2026", 2) and job["broken"]["error"] == "Unexpected error: page 2 is torn" and "header" in job["other"]["error"]
    areas, poles = session({"folder": f"{tmp_path}/service"}).item("it").layers
    assert len(areas.all()) == 1 and sorted(p["attributes"]["POLE_ID"] for p in poles.all()) == ["O131F", "O200"] and job["good"]["global_id"] == areas.all()[0]["globalId"]
    # what the queries said of themselves
    assert [r["event"] for r in heard.events(spark).orderBy("seq").collect()][:2] == ["started", "batch"]
    # the batch again, from its files
    before = tables(own, spark)
    own(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(uploads)), 0)
    assert tables(own, spark) == before and len(areas.all()) == 1 and len(poles.all()) == 2
    state = {r["job_id"]: r for r in jobs.serialized(jobs.state(own.events(spark))).collect()}
    assert state["good"]["status"] == "completed" and state["broken"]["error"] == "Unexpected error: page 2 is torn"
    # mended and sent again with a new one; the good one is there still, and isn't run again
    land(uploads, "broken", [{"words": ["D044"]}])
    land(uploads, "late", [{"words": ["nothing"]}])
    own(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(uploads)), 1)
    second = {r["doc_id"]: (r["status"], r["permit_number"]) for r in own.table(spark, "jobs", runner.JOB).filter("batch = 1").collect()}
    assert second == {"broken": ("completed", "12-2026"), "late": ("completed", "13-2026"), "other": ("failed", None)} and len(areas.all()) == 3
    # a message for each end of a job, once each
    sent = tmp_path / "sent"
    sent.mkdir()
    post = jobs.Outbox(f"{tmp_path}/outbox", lambda to, subject, content: (sent / f"{subject}-{time.time_ns()}").touch())
    for _ in range(2):
        post(own.messages(spark, F.lit("a@b")), 1)
    assert len(list(sent.iterdir())) == 5


def test_detail_while_it_runs(spark, tmp_path, uploads):
    seen = []

    class Watched(runner.Runner):
        def discover(self, spark, *rest):
            seen.append({r["job_id"]: r["detail"] for r in jobs.serialized(jobs.state(self.events(spark))).collect()})
            super().discover(spark, *rest)

    Watched(f"{tmp_path}/out", records, year=2026, load=library)(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(uploads)), 0)
    assert seen[0]["good"] == "Searching the text of 1 page(s)..." and seen[0]["other"] == "Checking the plan set..."


def test_a_document_that_stops_the_flow_is_alone(spark, tmp_path):
    for i in range(4):
        land(tmp_path / "up", f"d{i}", [{"words": ["O200" if i == 0 else "plain"]}])

    def previews(pages, files):
        def look(batches):
            for b in batches:
                if (b["doc_id"] == "d2").any():
                    raise ValueError("d2 can't be drawn")
                yield pd.DataFrame({"doc_id": b["doc_id"], "page_number": b["page_number"], "raw_response": "{}"})

        return files.select("doc_id", F.lit(1).alias("page_number")).mapInPandas(look, "doc_id string, page_number int, raw_response string")

    own = runner.Runner(f"{tmp_path}/out", records, year=2026, load=library, previews=previews)
    own(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/up"), 0)
    got = {r["doc_id"]: (r["status"], r["error"]) for r in own.table(spark, "jobs", runner.JOB).collect()}
    assert {d: s for d, (s, _) in got.items()} == {"d0": "completed", "d1": "completed", "d2": "failed", "d3": "completed"} and got["d2"][1] == "Unexpected error: ValueError: d2 can't be drawn"
    assert own.table(spark, "poles").count() == 1
    # no error of a document: the batch stops
    down = runner.Runner(f"{tmp_path}/out2", records, year=2026, load=library)
    down.discover = lambda *_: (_ for _ in ()).throw(OSError("No space left on device"))
    with pytest.raises(OSError):
        down(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/up"), 0)


def test_numbers_cost_no_history(spark, tmp_path):
    numbers = jobs.PermitNumbers(f"{tmp_path}/n", 2026, last=5)
    batch = lambda *ids: spark.createDataFrame([(j, i) for i, j in enumerate(ids)], "job_id string, ts long")
    asked = []
    numbers.ends.get, get = lambda k: asked.append(k) or get(k), numbers.ends.get
    for i, ids in enumerate([("a", "b"), ("b", "c"), ("d",), ("e", "a")]):
        numbers(batch(*ids), i)
    assert asked == ["0", "1", "2"]
    want = {"a": 6, "b": 7, "c": 8, "d": 9, "e": 10}
    assert {r["job_id"]: r["number"] for r in numbers.issued(spark).collect()} == want
    # again, one whole and one of which only some was entered
    numbers(batch("b", "c"), 1)
    book = Ledger(f"{tmp_path}/n/jobs")
    assert book.get("c")["number"] == 8
    assert {r["job_id"]: r["number"] for r in numbers.number(batch("e", "a"), 3).collect()} == {"e": 10, "a": 6}
    assert {r["job_id"]: r["number"] for r in numbers.issued(spark).collect()} == want


def test_outbox_sends_once(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    def deliver(to, subject, content):
        if subject == "bad" and not (tmp_path / "tried").exists():
            (tmp_path / "tried").touch()
            raise ConnectionError("no line")
        (sent / f"{subject}-{time.time_ns()}").touch()

    rows = [("2026-01-01 10:00:00", k, "a@b", s, "x") for k, s in (("1", "one"), ("1", "one"), ("2", "bad"), ("3", "three"))]
    schema = "ts timestamp, key string, to_address string, subject string, content string"
    frame = spark.createDataFrame([(pd.Timestamp(r[0]).to_pydatetime(), *r[1:]) for r in rows], schema).coalesce(1)
    frame.write.parquet(f"{tmp_path}/in")
    query = jobs.outbox(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/box", deliver).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(p.name.split("-")[0] for p in sent.iterdir()) == ["one", "three"] and Ledger(f"{tmp_path}/box/sent").get("2")["error"] == "no line"
    box = jobs.Outbox(f"{tmp_path}/box", deliver)
    for _ in range(2):
        box(frame.drop("ts"), 0)
    assert sorted(p.name.split("-")[0] for p in sent.iterdir()) == ["bad", "one", "three"]
