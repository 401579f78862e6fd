"""The sink of features: one permit and each pole once, wherever an attempt breaks off; failures of one permit are its own."""

import json

import pytest
from fake_service import session
from pyspark.sql import functions as F

from planmatch.errors import EngineError
from planmatch.sources import features
from planmatch.sources.ledger import Ledger

ROWS = "doc_id string, permit_number string, totalcitypolecount long, foreignpolecount long, polereviewstatus string, geometry string, content binary, poles array<struct<pole_id:string,pole_owner:string,confidence:double,status:string,x:double,y:double>>"


def permit(i, poles=3, content=b"pdf"):
    return (f"d{i}", f"{i}-2026", poles, 0, "Needs Review", '{"rings": []}' if i % 2 else None, content, [(f"O{i}{k}", "City", 0.9, "Approved", 1.0 * k, 2.0) for k in range(poles)])


@pytest.fixture
def sink(spark, tmp_path):
    spark.dataSource.register(features.Features)

    def write(rows, **options):
        own = {"client": "fake_service:session", "item": "it", "ledger": f"{tmp_path}/ledger", "folder": f"{tmp_path}/service"} | options
        spark.createDataFrame(rows, ROWS).coalesce(2).write.format("features").mode("append").options(**own).save()

    layers = lambda: session({"folder": f"{tmp_path}/service"}).item("it").layers
    results = lambda: {r["doc_id"]: r for r in features.results(spark, f"{tmp_path}/ledger").collect()}
    return write, layers, results


def test_written(sink, tmp_path):
    write, layers, results = sink
    write([permit(1), permit(2, 0, None)])
    areas, poles = layers()
    assert sorted(f["attributes"]["PERMIT_NUMBER"] for f in areas.all()) == ["1-2026", "2-2026"] and len(poles.all()) == 3
    got = results()
    assert (got["d1"]["pole_count"], got["d1"]["step"], got["d1"]["error"]) == (3, "done", None) and got["d2"]["pole_count"] == 0
    assert {p["attributes"]["PERMIT_GLOBALID"] for p in poles.all()} == {got["d1"]["global_id"]} and areas.attached(got["d1"]["object_id"]) and not areas.attached(got["d2"]["object_id"])
    # written again, nothing is added
    write([permit(1), permit(2, 0, None)])
    assert len(areas.all()) == 2 and len(poles.all()) == 3
    notes = [json.loads(p.read_text()) for p in (tmp_path / "ledger/writes").glob("*-done.json")]
    assert [(n["done"], n["failed"]) for n in notes] == [(2, 0)] * 2


@pytest.mark.parametrize("place", ["before-permits", "after-permits", "before-poles", "after-poles", "after-file"])
def test_a_killed_task_is_made_up_for(sink, place, tmp_path):
    write, layers, results = sink
    with pytest.raises(Exception):  # noqa: B017  the worker is gone
        write([permit(1)], once=place, kill="y")
    assert len(list((tmp_path / "ledger/writes").glob("*-broken-off.json"))) == 1
    write([permit(1)], once=place, kill="y")
    areas, poles = layers()
    assert len(areas.all()) == 1 and sorted(p["attributes"]["POLE_ID"] for p in poles.all()) == ["O10", "O11", "O12"]
    assert len(list(areas.folder.glob("*.pdf"))) == 1 and results()["d1"]["step"] == "done"


@pytest.mark.parametrize("place", ["before-permits", "after-permits", "before-poles", "after-poles", "after-file"])
def test_an_error_is_one_permits(sink, place):
    write, layers, results = sink
    write([permit(1), permit(2), permit(3)], once=place)
    got = results()
    assert sorted(r["step"] == "done" for r in got.values()) == [False, True, True]
    (failed,) = [r for r in got.values() if r["step"] != "done"]
    assert failed["error"] == "Unexpected error: the line went dead"
    write([permit(1), permit(2), permit(3)], once=place)
    areas, poles = layers()
    assert len(areas.all()) == 3 and len(poles.all()) == 9 and len(list(areas.folder.glob("*.pdf"))) == 3
    assert all(r["step"] == "done" and r["error"] is None and r["pole_count"] == 3 for r in results().values())


def test_refused(sink):
    write, layers, results = sink
    write([permit(1), permit(2)], refuse="O11")
    assert results()["d1"]["error"] == "permit 1-2026 was created, but 1 of 3 poles weren't: full" and results()["d1"]["pole_count"] == 2 and results()["d2"]["error"] is None
    write([permit(1)])
    assert results()["d1"]["error"] is None and len(layers()[1].all()) == 6
    write([permit(4)], down="y")
    assert results()["d4"]["error"] == "nobody is there" and results()["d4"]["step"] == "begun"


def test_as_a_stream(spark, sink, tmp_path):
    write, layers, results = sink
    spark.createDataFrame([permit(1), permit(2)], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in")
    own = {"client": "fake_service:session", "item": "it", "ledger": f"{tmp_path}/ledger", "folder": f"{tmp_path}/service"}
    for _ in range(2):
        q = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in").writeStream.format("features").options(**own).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    assert len(layers()[0].all()) == 2 and all(r["step"] == "done" for r in results().values())
    assert (tmp_path / "ledger/writes/batch-0-done.json").exists()


def test_options(spark, sink):
    with pytest.raises(Exception, match="needs the options item, ledger"):
        spark.createDataFrame([permit(1)], ROWS).write.format("features").mode("append").option("client", "a:b").save()
    assert issubclass(EngineError, ValueError)


def test_ledger(spark, tmp_path):
    book = Ledger(f"file:{tmp_path}/book")
    rows = spark.range(40).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    book.enter(rows.filter("id % 2 = 0"), "k")
    book.put("2", {"v": 99})
    got = {r["k"]: r["v"] for r in book.known(rows.select("k").repartition(4), "k").select("k", F.get_json_object("known", "$.v").cast("long").alias("v")).collect()}
    assert got == {str(i): None if i % 2 else 99 if i == 2 else 2 * i for i in range(40)}
