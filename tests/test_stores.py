import json

import pytest
from pyspark.sql import functions as F

from ledgerline import cli
from ledgerline.functions import text
from ledgerline.operators import cells, handlers, sheets
from ledgerline.sources import catalog, guard
from ledgerline.streaming import worker


def test_secrets_stay_out_of_messages(spark):
    said = "no route to postgresql://kim:s3cret@db:5432/x?password=abc, token = 'x y'; api-key: k1"
    want = "no route to postgresql://***@db:5432/x?password=***, token = ***; api-key: ***"
    assert text.scrub_text(said) == want
    assert spark.createDataFrame([(said,)], "m string").select(text.scrub(F.col("m")).alias("m")).first().m == want
    assert text.scrub_text("a hunter2 b", ("hunter2", "")) == "a *** b"
    assert text.describe_url("jdbc:postgresql://kim:pw@db:5432/x?password=abc") == "postgresql://db:5432/x"
    assert "s3cret" not in guard.message(ValueError(said))


def test_one_writer_at_a_time(spark, tmp_path):
    root = str(tmp_path)
    with guard.writer_lock(spark, root), pytest.raises(guard.Locked), guard.writer_lock(spark, root):
        pass
    with guard.writer_lock(spark, root):
        pass
    (tmp_path / ".writer.lock").write_text("gone")
    with pytest.raises(guard.Locked), guard.writer_lock(spark, root):
        pass
    with guard.writer_lock(spark, root, stale_s=-1):
        pass


def test_folders_for_exports(tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    (tmp_path / "inbox" / "x").mkdir(parents=True)
    assert guard.check_out_folder(str(tmp_path / "out"), (str(tmp_path / "inbox"),)) == (tmp_path / "out").resolve()
    for bad in ("repo", "inbox/x", "nowhere"):
        with pytest.raises(ValueError):
            guard.check_out_folder(str(tmp_path / bad), (str(tmp_path / "inbox"),))
    with pytest.raises(ValueError):
        guard.check_out_folder(str(tmp_path), (str(tmp_path / "inbox"),))
    guard.write_atomic(tmp_path / "out" / "f", b"x")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["f"]


def test_kinds_of_failure():
    class Refused(Exception):
        def __init__(self, state):
            self.sqlstate = state

    assert [guard.failure_kind(Refused(s)) for s in ("55P03", "57014", "23505", "08006", "42P01")] == ["lock_timeout", "statement_timeout", "conflict", "connection_lost", "other"]
    assert guard.failure_kind(ConnectionResetError()) == "connection_lost" and guard.failure_kind(ValueError()) == "other"
    done = []

    def conflict():
        raise RuntimeError from Refused("23505")

    assert guard.publish_with_fallback(conflict, lambda: done.append(1)) == "everything" and done == [1]
    with pytest.raises(Refused):
        guard.publish_with_fallback(lambda: (_ for _ in ()).throw(Refused("57014")), lambda: done.append(2))
    assert [guard.exit_code(0, 0), guard.exit_code(1, 0), guard.exit_code(0, 2), guard.exit_code(1, 0, "lock_timeout"), guard.exit_code(0, 0, differences=1)] == [0, 1, 1, 2, 1]


def form(**more):
    region = {"name": "tab", "role": "meter", "header_rows": 1, "xs": [0, 10, 20, 30], "ys": [0, 10, 20], "columns": [{"idx": 0, "name": "start", "kind": "handwritten_number", "format": "reading"}, {"idx": 1, "name": "end", "kind": "handwritten_number"}], "rows": [{"row": 0, "key": "k", "item": "coal"}]}
    return {"name": "a", "family": "f", "regions": [region], "fields": [{"name": "operator", "kind": "handwritten_text", "meta_key": "operator"}]} | more


def test_templates_become_tables(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(form()))
    t = catalog.tables(spark, [catalog.read_template(str(tmp_path / "t.json"))])
    assert [(r.name, r.format) for r in t["column"].orderBy("idx").collect()] == [("start", "reading"), ("end", "integer")]
    assert t["row"].first().meta == {"item": "coal"} and t["template"].first().handler == "generic"
    assert catalog.problems(form()) == []
    bad = form(valid_from="2025-02-01", valid_to="2025-01-01", regions=[form()["regions"][0] | {"role": "odd", "xs": [0], "ys": [0], "columns": [{"idx": 0, "name": "x", "kind": "no", "format": "no"}] * 2}])
    assert len(catalog.problems(bad)) == 9
    with pytest.raises(ValueError, match="faulty"):
        catalog.tables(spark, [bad])
    assert catalog.family_problems([form(valid_to="2025-01-31"), form(name="b", valid_from="2025-01-31")]) == ["family f: a and b are valid on a common day"]
    assert catalog.family_problems([form(concurrent=True), form(name="b", concurrent=True, fields=[])])[0].startswith("family f: b and a differ")
    assert catalog.family_problems([form(), form(name="b", family="g")]) == []
    hauls = [{"row": i, "key": str(i), "material": "m", "level": "l"} for i in range(2)]
    twice = form(regions=[form()["regions"][0] | {"role": None, "rows": hauls, "ys": [0, 1, 2, 3]}])
    assert catalog.problems(twice) == ["material m, level l occurs 2 times"]
    assert catalog.route_problems({"reading": "r", "odd": "r"}, {"signature": "s"}, {"r": {"formats": ["reading"]}}) == ["no such entry of formats: odd", "no recogniser s"]


def test_models_are_checked(tmp_path):
    import hashlib

    good = tmp_path / "good"
    good.mkdir()
    (good / "model.onnx").write_bytes(b"net")
    card = {"name": "digits", "reads": ["integer"], "threshold": 0.9, "sha256": hashlib.sha256(b"net").hexdigest()}
    (good / "card.json").write_text(json.dumps(card))
    for name, change in (("stale", {"sha256": "0"}), ("odd", {"threshold": 2, "temperature": 0})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "model.onnx").write_bytes(b"net")
        (tmp_path / name / "card.json").write_text(json.dumps(card | change))
    (tmp_path / "x.staging" / "y").mkdir(parents=True)
    assert {n: len(p) for n, p in catalog.models(str(tmp_path)).items()} == {"good": 0, "odd": 2, "stale": 1}
    assert catalog.clear_staging(str(tmp_path)) == ["x.staging"] and not (tmp_path / "x.staging").exists()


def test_sweeps_and_retries(spark):
    days = spark.createDataFrame([("2025-01-03",), ("2024-12-01",), (None,)], "d string")
    done = []
    assert worker.sweep(days, "d", done.append) == ["2024-12", "2025-01", None] == done
    assert worker.sweep(days, "d", done.append, begun="2024-12") == ["2025-01", None, "2024-12"]
    now, fail = [0.0], [True]
    job = worker.Retry(lambda: now[0])

    def work():
        if fail[0]:
            raise ConnectionError

    said = []
    for now[0] in (0.0, 10.0, 30.0, 60.0, 95.0):
        said.append(job.run(work))
    assert said == ["ConnectionError", None, None, None, None] and job.failures == 3
    fail[0], now[0] = False, 1000.0
    assert job.run(work) == "ok" and job.run(work) is None


def test_worst_of_several(spark):
    rows = [("value", None, "empty"), ("empty", "empty", None), (None, None, None), ("pending", "value", "illegible"), ("pending", "empty", None)]
    got = spark.createDataFrame(rows, "a string, b string, c string").coalesce(1).select(sheets.worst_of(F.col("a"), F.col("b"), F.col("c")).alias("w")).collect()
    assert [r.w for r in got] == ["value", "empty", "value", "illegible", "pending"]


def test_blobs_and_handlers(spark):
    boxes = spark.createDataFrame([("p", "a", 0, 0, 10, 10), ("p", "b", 10, 0, 20, 10), ("p", "c", 20, 0, 30, 10)], "page_id string, cell_id string, x0 int, y0 int, x1 int, y1 int")
    blobs = spark.createDataFrame([("p", 1, 1, 1, 9, 9, 5), ("p", 2, 8, 1, 14, 9, 7), ("p", 3, 0, 2, 30, 8, 9), ("p", 4, 50, 50, 55, 55, 3), ("q", 5, 0, 0, 5, 5, 1)], "page_id string, blob_id int, x0 int, y0 int, x1 int, y1 int, ink int")
    ink, seen = cells.assign_blobs(blobs, boxes, F.lit(10))
    assert {r.cell_id: r.ink for r in ink.collect()} == {"a": 5, "b": 7}
    assert {r.blob_id: (r.hits, r.note) for r in seen.collect()} == {1: (1, False), 2: (2, False), 3: (3, True), 4: (0, False), 5: (0, False)}
    with pytest.raises(KeyError, match="generic"):
        handlers.load("odd", blobs, blobs, blobs, blobs)
    assert set(handlers.load("generic", blobs, blobs, blobs, blobs)) == {"doc_field"}


def test_commands(spark, tmp_path, capsys):
    t = str(tmp_path)
    spark.createDataFrame([("d1", "scan", "processed", None, None, 0, 0)], "document_id string, source_name string, status string, warning string, date_source string, work_requested int, work_done int").write.parquet(f"{t}/doc_document.parquet")
    spark.createDataFrame([("p1", "d1", 1, "a", "loaded", 0, 1.0, {"a": 1.0}, None), ("p2", "d9", 1, "b", "error", 0, 3.0, {"a": 1.0}, None)], "page_id string, document_id string, page_no int, template_name string, status string, rotation int, classify_margin double, variant_errs map<string,double>, work_date string").write.parquet(f"{t}/doc_page.parquet")
    assert cli.main(["info", "--tables", t], spark) == 0
    assert cli.main(["report", "--tables", t], spark) == 0
    assert cli.main(["pages", "--tables", t, "--margin-below", "2"], spark) == 0
    assert cli.main(["orphans", "--tables", t], spark) == 1
    assert cli.main(["regress", "--tables", t, "--other", t], spark) == 0
    assert cli.main(["checks", "--tables", t], spark) == 1
    out, err = capsys.readouterr()
    assert "doc_document\t1" in out and "scan#1\tloaded\ta" in out and '{"doc_page": 1}' in out and "KeyError" in err
