"""Replies, tiles, geometry, sources, sinks and streams on small inputs."""

import json
import math
import sqlite3
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from planmatch.errors import CatalogError, EngineError, FieldError, ServiceError
from planmatch.functions import values
from planmatch.operators import catalog, geometry, pages, permits, replies
from planmatch.plans import flow
from planmatch.sources import pdf, render, service, sinks, sqlite, vision
from planmatch.streaming import jobs


def read(spark, text):
    rows = spark.createDataFrame([(1, text)], "k int, raw_response string")
    return [(r["raw_text"], r["model_confidence"], r["model_reports_complete"], r["model_reports_edge_clipped"], r["context_type"], r["label_text"]) for r in replies.readings(rows, ["k"]).orderBy("pos").collect()]


PLAIN = ("O131F", 0.0, False, False, "unknown", "O131F")


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []), ("   ", []), ('Sure: {"candidates": []} done', []), ('{"candidates": [], "pole_ids": ["O131F"]}', [PLAIN]), ('["O131F"]', [PLAIN]), ('{"candidates": {"a": 1}}', []), ('"O131F"', []),
        ('{"candidates": [{"text": "", "id": "O1", "complete": null, "is_complete": true}]}', [("O1", 0.0, False, False, "unknown", "O1")]),
        ('[{"text": "O1", "is_complete": true, "confidence": "0.9"}]', [("O1", 0.9, True, False, "unknown", "O1")]), ('[{"text": "O1", "confidence": "90%"}]', [("O1", 0.0, False, False, "unknown", "O1")]),
        ('[{"text": "O1", "confidence": 1.7, "complete": "yes"}]', [("O1", 1.0, True, False, "unknown", "O1")]), ('[{"text": "O1", "confidence": true, "complete": 2}]', [("O1", 1.0, True, False, "unknown", "O1")]),
        ("note " + "[" * 100_000, []), ("note " + '[{"a": ' * 30_000 + "x", []), ('[5, null, {"text": "  "}]', []), ('```json\n["O131F"]\n```', [PLAIN]),
    ],
)
def test_replies(spark, text, want):
    assert read(spark, text) == want


def test_unreadable_previews_stay_relevant(spark):
    rows = spark.createDataFrame([(1, '{"confidence": 0.95}'), (2, '{"confidence": 0.5}'), (3, "no"), (4, '{"confidence": 0.95, "contains_pole_drawing": "yes"}')], "page int, raw_response string")
    got = {r["page"]: r["relevant_for_tiles"] for r in pages.route(replies.assessments(rows), 0.9).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}
    with pytest.raises(EngineError):
        pages.route(replies.assessments(rows), 1.5)


def test_tiles(spark):
    page = spark.createDataFrame([(1, 2592.0, 1728.0)], "page int, width_points double, height_points double")
    got = pages.tiles(page, keys=["page"]).orderBy("tile_index").collect()
    assert len(got) == 24 and got[-1]["pdf_bbox"] == [2016.0, 1152.0, 2592.0, 1728.0] and [r["pdf_bbox"][0] for r in got[:6]] == [0.0, 489.6, 979.2, 1468.8, 1958.4, 2016.0]


def test_work_areas(spark):
    groups = {"one": [(0, 0)], "two": [(0, 0), (100, 0)], "line": [(0, 0), (50, 0), (100, 0)], "twice": [(0, 0), (0, 0)], "square": [(0, 0), (0, 100), (100, 0), (100, 100), (50, 50)]}
    rows = spark.createDataFrame([(k, float(x), float(y)) for k, ps in groups.items() for x, y in ps], "k string, x double, y double")
    for r in geometry.work_areas(rows, ["k"]).collect():
        ring, points = np.array(r["ring"]), np.array(groups[r["k"]], float)
        assert (ring[0] == ring[-1]).all()
        x, y = ring[:-1].T
        assert (x * np.roll(y, -1) - y * np.roll(x, -1)).sum() < 0  # clockwise
        assert np.allclose(ring.min(0), points.min(0) - 50) and np.allclose(ring.max(0), points.max(0) + 50)


def test_measured_work_areas(spark):
    """One pole has the polygon that stands for its circle, two poles a band between two halves of it; coordinates far from zero don't blur this."""
    rows = spark.createDataFrame([("one", 2e6, 6e5)] * 3 + [("two", 2e6, 6e5), ("two", 2e6, 6e5 + 300), ("none", None, 6e5)], "k string, x double, y double")
    got = {r["k"]: (r["area"], r["perimeter"]) for r in geometry.measured(geometry.work_areas(rows, ["k"])).collect()}
    area, length = 32 * 2500 * math.sin(math.pi / 32), 6400 * math.sin(math.pi / 64)
    assert got["one"] == pytest.approx((area, length), abs=1e-5) and got["two"] == pytest.approx((area + 300 * 100, length + 600), abs=1e-5) and len(got) == 2
    assert geometry.measured(geometry.work_areas(rows.limit(0), ["k"])).count() == 0


def test_work_areas_by_brute_force(spark):
    """Rings against the corners of all circles, found one by one as those that no triangle of others covers on either side."""
    rng = np.random.default_rng(4)
    big = [9007199254740993, 9007199254740995, None]
    points = {k: rng.integers(0, 400, (n, 2)).astype(float) for k, n in zip(big, (1, 7, 30))}
    rows = [(k, *map(float, p)) for k, ps in points.items() for p in ps] + [(big[0], None, 1.0)]
    got = {r["k"]: r["ring"] for r in geometry.work_areas(spark.createDataFrame(rows, "k long, x double, y double").repartition(3), ["k"]).collect()}
    assert set(got) == set(big)
    ways = np.array(geometry.directions(geometry.SEGMENTS)) * geometry.BUFFER
    for k, ps in points.items():
        corners = np.unique((ps[:, None] + ways[None]).reshape(-1, 2), axis=0)
        at = corners[np.lexsort((corners[:, 1], corners[:, 0]))[0]]
        walk = [at]
        for _ in range(len(corners) + 1):  # the next corner is the one that all others lie to the left of
            d = corners - at
            turn = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
            length = (d**2).sum(1)
            good = (turn >= -1e-9).all(1) & (length > 0)
            at = corners[np.flatnonzero(good)[np.argmax(length[good])]]
            if np.allclose(at, walk[0]):
                break
            walk.append(at)
        ring = np.array(got[k])[:-1][::-1]
        start = int(np.argmin(np.abs(ring - walk[0]).sum(1)))
        assert np.allclose(np.roll(ring, -start, 0), np.array(walk))


def test_numbers_go_on(spark):
    rows = spark.range(0, 1000, 1, 7).select(F.col("id").alias("doc_id"), (F.col("id") % 10).alias("at"))
    got = permits.numbers(rows, 5, by=["at", "doc_id"], year=F.lit(2026)).orderBy("at", "doc_id").collect()
    assert [r["number"] for r in got] == list(range(6, 1006)) and got[0]["permit_number"] == "6-2026"


def test_sinks(spark, tmp_path):
    permit = spark.createDataFrame([(1, "7-2026")], "doc_id long, permit_number string")
    for batch, number in ((0, "7-2026"), (1, "8-2026"), (1, "9-2026")):
        sinks.write_features(permit.withColumn("permit_number", F.lit(number)), permit, str(tmp_path), batch)
    assert sorted(r["permit_number"] for r in spark.read.parquet(f"{tmp_path}/permits").collect()) == ["7-2026", "9-2026"]
    sinks.evidence(permit.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ['{"doc_id":1,"permit_number":"7-2026","none":null}']
    odd = spark.createDataFrame([(1, 'pö\U0001f600\n"x\\'), (2, "plain")], "doc_id long, t string")
    sinks.evidence(odd, str(tmp_path / "documents"), ["doc_id"])
    (one,) = (tmp_path / "documents" / "doc_id=1").glob("*.txt")
    assert one.read_text().isascii() and json.loads(one.read_text()) == {"doc_id": 1, "t": 'pö\U0001f600\n"x\\'} and len(one.read_text().splitlines()) == 4
    files = spark.createDataFrame([(1, "a.pdf", b"x"), (2, "b.pdf", b"y")], "doc_id long, path string, content binary")
    assert [tuple(r) for r in sinks.attachments(permit, files, ["doc_id"]).collect()] == [("7-2026", "a.pdf", bytearray(b"x"))]
    assert sinks.option({"A": " "}, "A", 3, int) == 3 and sinks.option({"A": "5"}, "A", 3, int) == 5


def test_vision(spark, tmp_path):
    images = spark.createDataFrame([(1, b"ab"), (2, None), (3, b"c")], "page int, image binary")
    got = {r["page"]: r["raw_response"] for r in vision.replay(images, spark.createDataFrame([(1, "{}")], "page int, raw_response string"), ["page"]).collect()}
    assert got == {1: "{}", 2: None, 3: None}
    read = vision.model_reader(lambda: lambda image, prompt, tokens: f"{len(image)} {prompt} {tokens}", "p", 180)
    assert {r["page"]: r["r"] for r in images.select("page", read("image").alias("r")).collect()} == {1: "2 p 180", 2: None, 3: "1 p 180"}
    with pytest.raises(EngineError, match="lacks"):
        vision.check_model_folder(str(tmp_path))
    for name in vision.REQUIRED:
        (tmp_path / name).write_text('{"model_type": "a"}')
    (tmp_path / "one.safetensors").write_bytes(b"x")
    with pytest.raises(EngineError, match="no complete weights"):
        vision.check_model_folder(str(tmp_path))
    shapes = spark.createDataFrame([(["A999"],), ([],)], "s array<string>").select(vision.tile_prompt(F.col("s")).alias("t")).collect()
    assert shapes[0]["t"].endswith("A999") and shapes[1]["t"].endswith("alphanumeric IDs")


def test_fields():
    assert permits.resolve_fields(["Permit_Number", "X"], ["permit_number"]) == {"permit_number": "Permit_Number"}
    with pytest.raises(FieldError, match="a, b"):
        permits.resolve_fields(["x"], ["b", "a"])


def test_sqlite_catalog(spark, tmp_path):
    path = str(tmp_path / "poles.db")
    with sqlite3.connect(path) as db:
        db.execute('create table supportstructure ("facilityid" text, objectid integer, x real, y text)')
        db.executemany("insert into supportstructure values (?, ?, ?, ?)", [("o 1", 1, 1.5, "2"), (None, 2, 1, 1), ("  ", 3, 1, 1), ("P2", 4, None, "bad")])
    got = sqlite.load_catalog(spark, path, rowsPerPartition="2").orderBy("source_id").collect()
    assert [(r["source_id"], r["pole_id_normalized"], r["x"], r["y"]) for r in got] == [("1", "O1", 1.5, 2.0), ("4", "P2", None, None)]
    for options, said in (({"table": "none"}, "Available: supportstructure"), ({"x": "east"}, "x='east'"), ({"path": path + "x"}, "does not exist"), ({"y": ""}, "must be configured")):
        with pytest.raises(CatalogError, match=said):
            sqlite.resolved({"path": path, **options})


def test_pdf_checks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"..%PDF-1.7")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    empty = spark.createDataFrame([("/x/b.pdf", 0, b"")], "path string, length long, content binary")
    rows = pdf.files(spark, str(tmp_path)).select("path", "length", "content").unionByName(empty)
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in pdf.validated(rows).select("path", "error").collect()}
    assert got == {"a.pdf": None, "b.pdf": "the PDF is empty: b.pdf", "c.txt": "the file must have a .pdf extension: c.txt"}


class FakePage:
    def __init__(self, width, height, words):
        self.rect, self.words = SimpleNamespace(x0=0.0, y0=0.0, x1=width, y1=height, width=width, height=height, get_area=lambda: width * height), words

    def get_text(self, kind, sort):
        return [(10.0 * i, 0.0, 10.0 * i + 8, 10.0, w, 0, 0, i) for i, w in enumerate(self.words)]

    def get_image_info(self):
        return [{"bbox": (0, 0, 50, 100)}, {}]

    def get_pixmap(self, matrix, clip=None, **_):
        w, h = (clip[2] - clip[0], clip[3] - clip[1]) if clip else (self.rect.width, self.rect.height)
        return SimpleNamespace(width=round(w * matrix[0]), height=round(h * matrix[1]), tobytes=lambda kind: f"{kind} {w}".encode())


class FakeDocument(list):
    is_pdf, needs_pass = True, False
    page_count = property(len)

    def load_page(self, i):
        return self[i]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def fake_library():
    """A parser of made-up files: '%PDF-' and a word for each fault, or the pages' words."""

    def open_(stream, filetype):
        text = bytes(stream).decode()[5:]
        if text == "broken":
            raise RuntimeError("no")
        document = FakeDocument() if text == "none" else FakeDocument(FakePage(0.0 if text == "flat" else 100.0, 100.0, page.split()) for page in text.split("|"))
        document.needs_pass, document.is_pdf = text == "secret", text != "other"
        return document

    return SimpleNamespace(open=open_, Matrix=lambda a, b: (a, b), Rect=lambda *x: x, csRGB=0)


def test_pdf_content(spark):
    rows = [(f"/x/{n}.pdf", len(t), b"%PDF-" + t.encode()) for n, t in (("a", "O131F x|"), ("b", "broken"), ("c", "none"), ("d", "flat"), ("e", "secret"), ("f", "other"))]
    checked = pdf.opened(pdf.validated(spark.createDataFrame(rows, "path string, length long, content binary")), fake_library)
    said = {r["path"][3]: (r["error"] or "").split(":")[0] for r in checked.select("path", "error").collect()}
    assert said == {"a": "", "b": "the PDF could not be opened or is damaged", "c": "the PDF has no pages", "d": "the first page has invalid dimensions", "e": "the PDF is password protected", "f": "the file isn't recognised as a PDF"}
    content = pdf.content(checked, fake_library)
    assert [tuple(r) for r in pdf.pages(content).orderBy("page_number").collect()] == [("/x/a.pdf", 1, 0, 100.0, 100.0, 2, 1, 0.5), ("/x/a.pdf", 2, 1, 100.0, 100.0, 0, 1, 0.5)]
    assert [(r["page_number"], r["text"], r["x0"], r["word_number"]) for r in pdf.words(content).orderBy("word_number").collect()] == [(1, "O131F", 0.0, 0), (1, "x", 10.0, 1)]


def test_renders(spark):
    files = spark.createDataFrame([("a", b"%PDF-x|y"), ("b", b"%PDF-z")], "doc_id string, content binary")
    chosen = spark.createDataFrame([("a", 2, 1), ("b", 1, 0)], "doc_id string, page_number int, page_index int")
    grid = pages.tiles(chosen.withColumns({"width_points": F.lit(100.0), "height_points": F.lit(1000.0)}), keys=["doc_id", "page_number", "page_index"])
    images = render.drawn(render.previews(chosen, 144).unionByName(render.tiles(grid, 72)), files, fake_library)
    got = {(r["doc_id"], r["image_path"]): (r["pixel_width"], r["pixel_height"], r["pdf_bbox"], r["tile_index"], bytes(r["image"])) for r in images.collect()}
    assert got["a", "page_0002_preview.png"] == (200, 200, [0.0, 0.0, 100.0, 100.0], None, b"png 100.0")
    assert got["b", "page_0001/tile_0002_r02_c01.png"] == (100, 576, [0.0, 424.0, 100.0, 1000.0], 2, b"png 100.0") and len(got) == 6
    assert sorted(map(tuple, render.summary(chosen, images).collect())) == [("a", 1, 1, 2), ("b", 1, 1, 2)]


class FakeLayer:
    def __init__(self, name, fields, refuse=()):
        self.name, self.fields, self.refuse, self.rows, self.files = name, fields, refuse, [], []

    def add(self, features):
        self.rows += features
        return [{"success": False, "error": "full"} if f["attributes"].get("POLE_ID") in self.refuse or f["attributes"].get("Permit_Number") in self.refuse else {"success": True, "objectId": 5, "globalId": "{G}"} for f in features]

    def attach(self, object_id, content):
        self.files.append((object_id, bytes(content)))
        return content != b"bad"


def test_service():
    areas = FakeLayer("areas", ["Permit_Number", "TotalCityPoleCount", "ForeignPoleCount", "PoleReviewStatus"], ["2-2026"])
    poles = FakeLayer("poles", ["permit_number", "Permit_GlobalID", "POLE_ID", "pole_owner", "confidence", "status"], ["BAD"])
    item = SimpleNamespace(layers=[areas, poles], tables=[])
    calls = []

    def connect(fail=0):
        calls.append(1)
        refused = len(calls) <= fail
        return SimpleNamespace(user="u", item=lambda i: (_ for _ in ()).throw(RuntimeError("You lack Permission")) if refused else item if i == "it" else None)

    permit = {"doc_id": 1, "permit_number": "1-2026", "totalcitypolecount": 1, "foreignpolecount": 0, "polereviewstatus": "Needs Review", "poles": [{"pole_id": "O1", "pole_owner": "City", "confidence": 1.0, "status": "Approved", "x": 1.0, "y": 2.0}]}
    assert service.created(permit | {"content": b"pdf"}, connect, "it", 0, 1) == (1, "1-2026", 5, "{G}", 1, None)
    assert poles.rows[0]["attributes"]["Permit_GlobalID"] == "{G}" and "geometry" not in areas.rows[0] and areas.files == [(5, b"pdf")]
    bad = permit["poles"][0] | {"pole_id": "BAD"}
    assert service.created(permit | {"poles": [*permit["poles"], bad]}, connect, "it", 0, 1)[2:] == (5, "{G}", 1, "permit 1-2026 was created, but 1 of 2 poles weren't: full")
    assert service.created(permit | {"permit_number": "2-2026"}, connect, "it", 0, 1)[2:] == (None, None, 0, "the permit wasn't created: full")
    assert "couldn't be attached" in service.created(permit | {"content": b"bad"}, connect, "it", 0, 1)[5]
    assert "no layer at index 7" in service.created(permit, connect, "it", 0, 7)[5] and "was not found" in service.created(permit, connect, "no", 0, 1)[5]
    calls.clear()
    assert service.member(lambda: connect(1), "it", 1) is poles and len(calls) == 2
    calls.clear()
    with pytest.raises(ServiceError, match="nor could it be over another"):
        service.member(lambda: connect(2), "it", 1)
    assert service.connection({"mode": "profile", "profile": "p"}, lambda profile: SimpleNamespace(user=profile)).user == "p"
    for options, said in (({"mode": "x"}, "unsupported"), ({"mode": "credentials", "url": "u"}, "needs username, password")):
        with pytest.raises(EngineError, match=said):
            service.connection(options, lambda **_: None)
    with pytest.raises(ServiceError, match="nobody"):
        service.connection({"mode": "profile", "profile": "p"}, lambda profile: SimpleNamespace(user=None))
    assert service.allowed(None, "") and service.allowed("k", "k") and not service.allowed("j", "k") and not service.allowed(None, "k")


def test_upload_is_picked_up(spark, tmp_path):
    job = service.upload(str(tmp_path / "up"), b"%PDF-x")
    got = pdf.validated(pdf.files(spark, f"{tmp_path}/up/*/input/*.pdf").select("path", "length", "content")).collect()
    assert len(got) == 1 and f"/{job}/input/source.pdf" in got[0]["path"] and got[0]["error"] is None


def test_written_permits_and_messages(spark, tmp_path):
    out = str(tmp_path)

    class Layer:
        name, fields = "l", ["permit_number", "totalcitypolecount", "foreignpolecount", "polereviewstatus", "permit_globalid", "pole_id", "pole_owner", "confidence", "status"]

        def add(self, features):
            with open(f"{out}/log", "a") as f:
                f.writelines(f"{x['attributes'].get('pole_id')} {x['attributes']['permit_number']}\n" for x in features)
            return [{"success": True, "objectId": 3, "globalId": "{H}"} for _ in features]

    def connect():
        return SimpleNamespace(user="u", item=lambda i: SimpleNamespace(layers=[Layer(), Layer()]))

    numbered = permits.identified(permits.numbers(spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, at long"), 5, by=["at"], year=F.lit(2026)))
    owned = spark.createDataFrame([(1, "O1", 1.0, 2.0, 0.9), (1, "O2F", 3.0, 4.0, 0.5)], "doc_id long, pole_id string, x double, y double, confidence double")
    rows = permits.pole_rows(numbered, owned, ["doc_id"])
    assert rows.select("permit_globalid").distinct().count() == 1
    result = service.write_permits(permits.permit_rows(numbered, owned, ["doc_id"]), rows, connect, "it").collect()
    assert sorted((r["doc_id"], r["permit_number"], r["pole_count"], r["error"]) for r in result) == [(1, "6-2026", 2, None), (2, "7-2026", 0, None)]
    assert sorted((tmp_path / "log").read_text().split("\n"))[1:] == ["None 6-2026", "None 7-2026", "O1 6-2026", "O2F 6-2026"]

    def deliver(to, subject, content):
        if to == "bad":
            raise RuntimeError("no")
        with open(f"{out}/mail", "a") as f:
            f.write(f"{to} {subject}\n")

    mail = permits.messages(spark.createDataFrame([("bad", "A", "x", None), ("c", "A", "x", "1\n2"), ("", "A", "x", None)], "to_address string, sender_label string, body string, permit_number string"))
    service.send_messages(mail.coalesce(1), deliver)
    assert (tmp_path / "mail").read_text() == "c New message on permit 1 2\n"
    service.send_messages(mail, None)


def test_job_view_and_progress(spark):
    state = spark.createDataFrame([("a", "completed", "d", "e"), ("b", "failed", "d", "e"), ("c", "processing", "d", "e")], "job_id string, status string, detail string, error string")
    issued = spark.createDataFrame([("a", 3, "{H}", "6-2026", 2), ("c", 4, "{I}", "7-2026", 0)], "job_id string, object_id long, global_id string, permit_number string, pole_count long")
    got = {r["job_id"]: (r["error"], r["detail"], r["permit"] and tuple(r["permit"])) for r in jobs.serialized(state, issued).collect()}
    assert got == {"a": (None, None, (3, "{H}", "6-2026", 2)), "b": ("e", None, None), "c": (None, "d", None)}
    tiles = spark.createDataFrame([(1, 1, 2), (1, 2, 0), (2, 1, 5)], "doc_id long, tile_index int, candidate_count long")
    said = jobs.progress_messages(jobs.progress(tiles, ["tile_index"]), ["tile_index"], ["doc_id"]).orderBy("doc_id", "seq").collect()
    assert [r["text"] for r in said] == ["Reading tile 1 of 2; 2 candidate(s) so far...", "Reading tile 2 of 2; 2 candidate(s) so far...", "Reading tile 1 of 1; 5 candidate(s) so far..."]


def test_native_both_ways(spark, sf_dir, monkeypatch):
    """Ids that are broadcast and ids that are joined by shuffle match the same words."""
    from planmatch.operators import catalog as cat
    from planmatch.operators import native
    from planmatch.plans import fixtures

    words = fixtures.words(spark, sf_dir).filter("page_number <= 40")
    once = sorted(map(tuple, native.candidates(words, fixtures.text_catalog(spark, sf_dir)).collect()), key=repr)
    monkeypatch.setattr(cat, "few", lambda *_: False)
    # nearly all words are dropped where they stand
    bare = native.rows_of(fixtures.lines(spark, sf_dir)).select(F.col("normalized_text"))
    ids, shapes = (cat.by_id(fixtures.text_catalog(spark, sf_dir)).select(F.col("pole_id").alias("id")), cat.shapes(fixtures.text_catalog(spark, sf_dir)).select(F.col("shape").alias("known_shape")))
    assert native._likely(bare, ids, shapes).count() < 0.1 * bare.count()
    assert once and sorted(map(tuple, native.candidates(words, fixtures.text_catalog(spark, sf_dir)).collect()), key=repr) == once


def test_bloom(spark):
    from planmatch.operators.bloom import bloom

    held = spark.range(3000).select(F.concat(F.lit("O"), "id").alias("v"))
    found = bloom(held.union(spark.createDataFrame([(None,)], "v string")), "v")
    asked = spark.range(6000).select(F.concat(F.lit("O"), "id").alias("v"), "id").union(spark.createDataFrame([(None, -1)], "v string, id long"))
    passed = {r["id"] for r in asked.filter(found.might_hold(F.col("v"))).collect()}
    assert set(range(3000)) <= passed and len(passed) < 3000 + 120 and -1 not in passed
    assert asked.filter(bloom(held.limit(0), "v").might_hold(F.col("v"))).count() == 0


def test_lines_and_rows_alike(spark, sf_dir):
    """Words nested by the source, or gathered from rows, give the same pairs and candidates; without a sort or shuffle of all words where they are nested."""
    from planmatch.operators import native
    from planmatch.plans import fixtures

    few = fixtures.lines(spark, sf_dir).filter("page_number <= 30")
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    order = ["page_number", "line_number", "word_number", "raw_text", "bbox"]
    assert text(native.pairs(few).select(order)) == text(native.pairs(native.rows_of(few)).select(order)) != []
    plan = native.pairs(few)._jdf.queryExecution().executedPlan().toString()
    # the source deals whole texts to tasks; their words stay where they are
    assert "Sort" not in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_integer_sets(spark):
    rows = spark.createDataFrame([(["3", "x", "1", "-2", "3"],), (None,)], "v array<string>")
    assert [r[0] for r in rows.select(values.integer_set("v")).collect()] == [[1, 3], []]
    assert values.render_scale(144) == 2.0


def test_catalog_indexes(spark):
    rows = catalog.load(spark.createDataFrame([("S1", "O1", "1", "2"), ("S1", "O2", "1", "2"), ("S2", "O1", "1", "2"), ("S1", " o1", "1", "2")], "source_id string, pole_id_raw string, x string, y string"))
    assert {r["source_id"]: [x["pole_id_normalized"] for x in r["records"]] for r in catalog.by_source(rows).collect()} == {"S1": ["O1", "O1", "O2"], "S2": ["O1"]}
    got = {r["pole_id"]: (r["match_count"], [x["source_id"] for x in r["records"]]) for r in catalog.by_id(rows, records=True).collect()}
    assert got == {"O1": (3, ["S1", "S2"]), "O2": (1, ["S1"])}


def test_flow_of_two_plan_sets(spark, tmp_path):
    """Two documents with equal page numbers and one without findings: nothing of one reaches another."""
    poles = catalog.load(spark.createDataFrame([("S1", "O131F", "1", "2"), ("S2", "O200", "5", "6"), ("S3", "D044", "9", "9")], "source_id string, pole_id_raw string, x string, y string"))
    text = "doc_id long, page_number int, page_index int, block_number int, line_number int, word_number int, text string, x0 double, y0 double, x1 double, y1 double"
    words = spark.createDataFrame([(7, 1, 0, 0, 0, 0, "O131F", 0.0, 0.0, 8.0, 10.0), (8, 1, 0, 0, 0, 0, "plain", 0.0, 0.0, 8.0, 10.0)], text)
    page = spark.createDataFrame([(7, 1, 2592.0, 1728.0, 1, 1, 0.2), (8, 1, 2592.0, 1728.0, 1, 1, 0.2), (8, 2, 500.0, 500.0, 0, 1, 0.9), (9, 1, 500.0, 500.0, 1, 0, 0.0)], "doc_id long, page_number int, width_points double, height_points double, embedded_word_count int, image_count int, largest_image_coverage double")
    previews = spark.createDataFrame([(7, 1, '{"contains_pole_drawing": true}'), (8, 1, '{"confidence": 0.99}'), (8, 2, "unreadable"), (9, 1, "{}")], "doc_id long, page_number int, raw_response string")
    found = '{"candidates": [{"text": "%s", "confidence": 0.95, "complete": true, "touches_tile_edge": false}]}'
    tiles = spark.createDataFrame([(7, 1, 1, found % "P#O200"), (8, 1, 1, found % "D044"), (8, 2, 1, found % "O200"), (8, 2, 2, "no such tile"), (9, 1, 1, "not json")], "doc_id long, page_number int, tile_index int, raw_response string")
    asked = spark.createDataFrame([(8, 1), (7, 2), (9, 3)], "doc_id long, submitted_at long")
    got = flow.run(catalog=poles, inspections=page, words=words, previews=previews, tile_replies=tiles, requests=asked, year=2026, last_number=10, keep=flow.Tabled(str(tmp_path)))
    assert sorted((r["doc_id"], r["pole_id"], r["discovery_sources"], r["x"]) for r in got["poles"].collect()) == [(7, "O131F", ["native_text"], 1.0), (7, "O200", ["visual"], 5.0), (8, "O200", ["visual"], 5.0)]
    issued = {r["doc_id"]: (r["permit_number"], r["totalcitypolecount"], r["foreignpolecount"], r["geometry"] is not None) for r in got["permits"].collect()}
    assert issued == {8: ("11-2026", 1, 0, True), 7: ("12-2026", 1, 1, True), 9: ("13-2026", 0, 0, False)}
    assert sorted((r["doc_id"], r["permit_number"], r["pole_id"]) for r in got["pole_rows"].collect()) == [(7, "12-2026", "O131F"), (7, "12-2026", "O200"), (8, "11-2026", "O200")]
    assert sorted(map(tuple, got["status"].collect())) == [(7, "completed", 2, 0), (8, "completed", 1, 0), (9, "no_poles_found", 0, 0)]
    assert sorted(map(tuple, got["skipped"].collect())) == [(8, 1)]
    total = got["totals"].first()
    assert (total["preview_assessment_count"], total["preview_error_count"], total["tile_count"], total["tile_error_count"]) == (4, 1, 3, 1)
    spark.catalog.clearCache()


def test_stream_equals_batch(spark, tmp_path):
    events = [(j, s, e, f"{j}{s}") for j in "abc" for s, e in enumerate(["processing", "queued", "processing", "progress", "completed" if j == "a" else "failed"]) if not (j == "c" and e == "queued")]
    schema = "job_id string, seq long, event string, text string"
    for i in range(0, len(events), 5):
        spark.createDataFrame(events[i : i + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {r["job_id"]: tuple(r) for r in jobs.state(spark.createDataFrame(events, schema)).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stream_state(stream).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {}
    for r in spark.table("job_states").collect():
        if r["job_id"] not in got or got[r["job_id"]][4] < r["last_seq"]:
            got[r["job_id"]] = tuple(r)
    assert got == want and set(got) == {"a", "b"}


def test_permit_numbers_once(spark, tmp_path):
    sink = jobs.PermitNumbers(str(tmp_path / "numbers"), 2026)
    first = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, ts long")
    second = spark.createDataFrame([("b", 2), ("c", 3)], "job_id string, ts long")
    for batch, i in ((first, 0), (second, 1), (second, 1)):
        sink(batch, i)
    assert {r["job_id"]: r["number"] for r in sink.issued(spark).collect()} == {"a": 1, "b": 2, "c": 3}
