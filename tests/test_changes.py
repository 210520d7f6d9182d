import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline import model
from ledgerline.operators import diff, latest, reconcile, sampling
from ledgerline.sources import files, recognizers, sinks
from ledgerline.streaming import worker

ROWS = "day string, k int, v string"


def table(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_publish_writes_only_what_changed(spark):
    old = [("d1", 1, "a"), ("d1", 2, "b"), ("d2", 3, "c"), ("d3", 4, "d"), ("d4", 5, None)]
    new = [("d1", 2, "b"), ("d1", 1, "a"), ("d2", 3, "changed"), ("d5", 4, "d"), ("d4", 5, "")]  # d3 gone, row 4 moved
    kept = []
    plan = sinks.publish(table(spark, new), table(spark, old), table(spark, new), ["day"], ["k", "v"], lambda df: kept.extend(as_set(df)))
    assert {r.day: r.action for r in plan.collect()} == {"d2": "replace", "d3": "remove", "d4": "replace", "d5": "replace"}
    assert kept == sorted(new, key=str)
    assert sinks.publish(table(spark, new), table(spark, new[::-1]), table(spark, new), ["day"], ["k", "v"], None, check=True).count() == 0


def test_publish_skips_what_a_target_refuses_and_guards(spark):
    new = [("d1", 1, "a\x00b"), ("d2", 2, "b")]
    kept = []
    sinks.publish(table(spark, new), None, table(spark, new), ["day"], ["k", "v"], lambda df: kept.extend(as_set(df)))
    assert kept == [("d2", 2, "b")]
    with pytest.raises(ValueError):
        diff.guard_publish(0, 5, "s", "s")
    with pytest.raises(ValueError):
        diff.guard_publish(5, 5, "s", "other")
    diff.guard_publish(0, 0, "s", None)


def test_upsert_keeps_insert_only_columns_and_is_idempotent(spark):
    old = table(spark, [("r1", 1, "a"), ("r2", 2, "b")])
    new = table(spark, [("now", 2, "B"), ("now", 3, "C")])
    once = diff.upsert(old, new, ["k"], ["day"])
    assert as_set(once) == [("now", 3, "C"), ("r1", 1, "a"), ("r2", 2, "B")]
    assert as_set(diff.upsert(once, new, ["k"], ["day"])) == as_set(once)


def test_merge_table_versions(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.merge_table(spark, p, table(spark, [("r1", 1, "a")]), ["k"], ["day"], "v1")
    last = sinks.merge_table(spark, p, table(spark, [("r2", 1, "b"), ("r2", 2, "c")]), ["k"], ["day"], "v2")
    assert as_set(spark.read.parquet(last)) == [("r1", 1, "b"), ("r2", 2, "c")]


HAUL = "haul_id string, work_date string, source_role string, page_id string, slot string, vehicle_no string, operator string, material string, level string, shift string, has_value_raw int, has_value int, trips int, trips_raw int"


def random_haul(rng, days):
    out = []
    for d in range(days):
        for i in range(rng.randrange(2, 9)):
            role = rng.choice(["log", "matrix"])
            trips = rng.choice([None, 1, 2])
            out.append((f"{d}-{i}", f"2025-01-{d + 1:02d}", role, f"{role}{d}{i % 3}", f"{i % 2}" if role == "matrix" else None, rng.choice(["1", "2", None]), rng.choice(["a", "b", None]), "ore", rng.choice(["L0", "L1"]), None, 1, rng.choice([0, 1]), trips, trips))
    return out


def test_incremental_equals_full(spark):
    rng = random.Random(6)
    before = random_haul(rng, 9)
    after = [(*r[:12], 7, r[13]) if rng.random() < 0.08 else r for r in before if rng.random() > 0.05]
    b, a = table(spark, before, HAUL), table(spark, after, HAUL)
    run = lambda df: reconcile.crosscheck(df)[0]
    dirty = diff.dirty_keys(diff.row_changes(b, a, ["haul_id"]), b, a, ["haul_id"], ["work_date"])
    assert 0 < dirty.count() < 9
    fresh = run(a.join(dirty, "work_date", "left_semi").select(*a.columns))
    assert as_set(diff.recompute(run(b), dirty, fresh, ["work_date"])) == as_set(run(a))


def test_order_of_rows_does_not_matter(spark):
    df = table(spark, random_haul(random.Random(8), 12), HAUL)
    want = as_set(reconcile.crosscheck(df)[0])
    assert as_set(reconcile.crosscheck(df.orderBy(F.rand(1)).repartition(7))[0]) == want


def test_orphans_and_deleted_pages(spark):
    t = {"doc_document": table(spark, [("d1",)], "document_id string"), "doc_page": table(spark, [("p1", "d1"), ("p2", "gone")], "page_id string, document_id string"), "doc_field": table(spark, [("f1", "p1"), ("f2", "p9"), ("f3", None)], "field_id string, page_id string"), "prod_haul": table(spark, [("h", None)], "haul_id string, work_date string")}
    assert {r.table: r.n for r in diff.orphans(t).collect()} == {"doc_page": 1, "doc_field": 2, "prod_haul": 1}
    left = diff.delete_pages(t, table(spark, [("p1",)], "page_id string"))
    assert [r.page_id for r in left["doc_page"].collect()] == ["p2"] and left["doc_document"].count() == 1


def test_flat_diff(spark):
    m = "key string, value double"
    got = diff.flat_diff(table(spark, [("a", 1.0), ("b", 1.0), ("c", None), ("e", 2.0)], m), table(spark, [("a", 1.005), ("b", 2.0), ("d", 1.0), ("c", 1.0)], m), ["key"])
    assert {r.key: r.kind for r in got.collect()} == {"b": "changed", "c": "changed", "d": "new", "e": "missing"}


def test_stratified_round_robin(spark):
    df = spark.range(500).select("id", (F.col("id") % 3 * F.when(F.col("id") < 400, 1).otherwise(0)).alias("s"))
    got = sampling.stratified(df, ["s"], "id", "x", 30)
    counts = {r.s: r["count"] for r in got.groupBy("s").count().collect()}
    assert counts == {0: 10, 1: 10, 2: 10}
    assert as_set(got) == as_set(sampling.stratified(df.orderBy(F.rand(2)), ["s"], "id", "x", 30))


def test_blind_sample_leaves_reviewed_out(spark):
    f = spark.range(200).select(F.col("id").cast("string").alias("field_id"), (F.col("id") % 2).cast("int").alias("has_value"), (F.col("id") % 5).alias("s"))
    r = f.where("s = 0").select("field_id")
    got = sampling.blind_sample(f, r, ["s"], "q", 20, 0.25).collect()
    assert len(got) == 20 and sum(x.has_value == 0 for x in got) == 5 and all(x.s != 0 for x in got)


def test_logs_skip_broken_lines_and_keep_their_order(spark, tmp_path):
    p = tmp_path / "reviews.jsonl"
    good = [{"review_id": f"r{i}", "field_id": "f", "verdict": "value", "value": str(i), "reviewed_at": "t", "machine": {"has_value": 1, "confidence": 0.5}, "bbox": [1, 2, 3, 4]} for i in range(4)]
    p.write_text("\n".join([json.dumps(good[0]), "not json", json.dumps(good[1]), "", json.dumps({"field_id": "f"}), json.dumps(good[2]), json.dumps(good[3])[:25]]))
    rows, bad = files.jsonl(spark, str(p), files.REVIEW, ["review_id", "field_id", "verdict"])
    got = rows.orderBy("seq").collect()
    assert [r.review_id for r in got] == ["r0", "r1", "r2"] and got[0].machine.has_value == 1 and bad.count() == 3


def test_documents_by_content(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in (("a/one.pdf", b"%PDF-1.4 /Type /Pages /Count 3"), ("two.PDF", b"%PDF-1.4 /Type /Pages /Count 3"), ("x.png", b"\x89PNG..."), ("bad.pdf", b"oops"), ("notes.txt", b"t")):
        (tmp_path / name).write_bytes(data)
    docs = files.documents(spark, str(tmp_path)).collect()
    assert sorted(d.copies for d in docs) == [1, 1, 2] and {d.source_name for d in docs} == {"one.pdf", "x.png", "bad.pdf"}
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).where(files.is_supported(F.col("path")))
    pages = {r.path.rsplit("/", 1)[1]: r.n for r in raw.select("path", files.page_count(F.col("content"), F.col("path")).alias("n")).collect()}
    assert pages == {"one.pdf": 3, "two.PDF": 3, "x.png": 1, "bad.pdf": None}


def test_truth_and_labels(spark, tmp_path):
    (tmp_path / "2025-03-01.csv").write_bytes("h\nh\nh\n1,점검?함\n2\n".encode("cp949"))
    (tmp_path / "2025-03-02.csv").write_bytes("h\nh\nh\n3,€‰\n".encode())
    got = as_set(files.inspection_csv(spark, str(tmp_path / "*.csv"), ["no", "remark"]))
    assert got[:2] == [("2025-03-01", "1", "점검 함"), ("2025-03-01", "2", None)] and got[2][:2] == ("2025-03-02", "3")
    (tmp_path / "pages.json").write_text(json.dumps({"a": {"date": "2025-01-01"}, "a#2": {"operator": "kim"}}))
    assert as_set(files.labels(spark, str(tmp_path / "pages.json"))) == [("a", 2, "operator", "kim"), ("a", None, "date", "2025-01-01")]
    (tmp_path / "site.toml").write_text("[haul]\ntrips_max = -1\n")
    with pytest.raises(ValueError):
        files.site(str(tmp_path / "site.toml"))


def test_test_rows_may_not_be_trained_on(spark):
    df = table(spark, [("2025-01-01", 1, "x")])
    assert files.training_rows(df, F.col("day"), F.lit("train")).count() == 1
    with pytest.raises(Exception, match="a test row"):
        files.training_rows(df, F.col("day"), F.lit("test")).collect()


def test_recognizers(spark):
    cells = table(spark, [("c1", "s1", "d1", "t", "r", "f", "k"), ("c2", "s2", "d1", "t", "r", "f", "k")], "cell_id string, source string, work_date string, template string, region string, field_name string, row_key string")
    assert {r.answer for r in recognizers.recognize(cells, "null").collect()} == {"reject"}
    recognizers.register("upper", lambda b: b.assign(text=b["cell_id"].str.upper(), answer="value", confidence=1.0, backend="u")[["cell_id", "text", "answer", "confidence", "backend"]])
    recognizers.register("mend", lambda b: b.assign(text=b["text"] + "!"), corrector=True)
    assert {r.text for r in recognizers.recognize(cells, "upper", "mend").collect()} == {"C1!", "C2!"}
    answers = table(spark, [("s1", None, "t", "r", "f", "k", "one"), (None, "d1", "t", "r", "f", "k", "day")], files.ANSWER)
    assert {r.cell_id: r.text for r in recognizers.oracle(cells, answers).collect()} == {"c1": "one", "c2": "day"}


def test_stream_equals_batch_and_survives_a_failing_job(spark, tmp_path):
    src, store, errors = tmp_path / "in", tmp_path / "store", []
    rows = [(i, i % 7, float(i)) for i in range(400)]
    for part in range(4):
        spark.createDataFrame(rows[part::4], "event_id long, user_id long, value double").coalesce(1).write.parquet(str(src / f"p{part}"))
    stream = worker.file_stream(spark, f"{src}/*", spark.read.parquet(f"{src}/*").schema, files_a_round=1)
    process = lambda b, n: worker.running_counts(b, ["user_id"]).write.mode("overwrite").parquet(f"{store}/round={n}")

    def broken(batch, n):
        raise RuntimeError("no connection")

    for _ in range(2):  # nothing is new the second time
        worker.run_rounds(stream, process, str(tmp_path / "cp"), after=(broken,), errors=errors).awaitTermination()
    got = spark.read.parquet(str(store)).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    assert as_set(got) == as_set(worker.running_counts(spark.read.parquet(f"{src}/*"), ["user_id"]))
    assert len(errors) == 4


def test_inbox_and_queue(spark):
    f = table(spark, [("a", 5, 0.0), ("b", 5, 95.0), ("c", 0, 0.0), ("d", 9, 0.0)], "path string, length long, modified double")
    seen = table(spark, [("a", 5, 50.0), ("b", 5, 50.0), ("c", 0, 1.0), ("d", 8, 50.0)], "path string, length long, first_seen double")
    got = {r.path: r.state for r in worker.settled(f, seen, 100.0, 10.0, 90.0).collect()}
    assert got == {"a": "ready", "b": "wait", "c": "failed", "d": "wait"}
    docs = table(spark, [("x", "received", 0, 0), ("y", "processed", 2, 1), ("z", "processed", 1, 1)], "document_id string, status string, work_requested int, work_done int")
    assert [r.document_id for r in worker.pending(docs).orderBy("document_id").collect()] == ["x", "y"]
    done = worker.mark_done(docs, table(spark, [("y", 1)], "document_id string, asked int"))
    assert "y" in {r.document_id for r in worker.pending(done).collect()}  # asked for again meanwhile
    assert [worker.retry_after(n) for n in (0, 1, 2, 20)] == [0.0, 30.0, 60.0, 3600.0]
    days = table(spark, [("2025-01-03",), ("2024-12-01",), ("odd",), (None,)], "d string")
    assert worker.month_slices(days, "d") == ["2024-12", "2025-01", None]


def test_model():
    assert len(model.TABLES) == 16 and "received_at" not in model.published("doc_document")
    assert all(set(k) <= {f.name for f in s} for k, s in model.TABLES.values())
    assert '"trips" BIGINT' in model.ddl("prod_haul") and "PRIMARY KEY (\"work_date\", \"slot\")" in model.ddl("eq_assignment_obs")
    with pytest.raises(ValueError):
        model.check_version(7)
    model.check_version("8")


def test_log_order_is_that_of_writing(spark, tmp_path):
    log = str(tmp_path / "log")
    say = lambda rows: spark.createDataFrame([(f"{v}{i}", "d1", "date", v, "kim", "t", None) for i, v in rows], "decision_id string, target string, kind string, value string, decided_by string, decided_at string, note string")
    sinks.append_jsonl(say([(0, "2025-01-01")]), log)
    sinks.append_jsonl(say([(i, f"2025-02-{i % 28 + 1:02d}" + "x" * 2000) for i in range(60)] + [(99, "2025-03-01")]).coalesce(1), log)
    got = files.decisions(spark, log).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 63)) and got[0].value == "2025-01-01" and got[-1].value == "2025-03-01"
    assert latest.effective_decisions(files.decisions(spark, log)).first().date == "2025-03-01"
    for n in range(3, 13):  # ten batches, whose names sort as numbers do
        sinks.append_jsonl(say([(n, f"2025-04-{n:02d}")]), log, order=["decision_id"])
    assert latest.effective_decisions(files.decisions(spark, log)).first().date == "2025-04-12"


def test_versions_are_numbers_and_half_written_ones_do_not_count(spark, tmp_path):
    p = str(tmp_path / "t")
    for n in range(8, 12):
        sinks.merge_table(spark, p, table(spark, [("r", n, "a")]), ["k"], [], f"v{n}")
    (tmp_path / "t" / "v12").mkdir()
    assert sinks.newest_version(spark, p).endswith("v11")
    assert sorted(r.k for r in spark.read.parquet(f"{p}/v11").collect()) == [8, 9, 10, 11]
    assert sinks.merge_table(spark, p, table(spark, [("r", 20, "a")]), ["k"], []).endswith("v13")
    assert spark.read.parquet(f"{p}/v13").count() == 5
    with pytest.raises(ValueError):
        sinks.merge_table(spark, p, table(spark, [("r", 20, "a")]), ["k"], [], "v2")


def test_publish_guards_its_target(spark):
    old, none, kept = [("d1", 1, "a"), ("d2", 2, "b")], [], []
    write = lambda df: kept.append(as_set(df))
    with pytest.raises(ValueError):
        sinks.publish(table(spark, none), table(spark, old), table(spark, none), ["day"], ["k", "v"], write)
    with pytest.raises(ValueError):
        sinks.publish(table(spark, old), table(spark, old), table(spark, old), ["day"], ["k", "v"], write, site="a", target_site="b")
    assert kept == []
    new = [("d1", 1, "a\x00"), ("d3", 3, "c")]
    plan = sinks.publish(table(spark, new), table(spark, old), table(spark, new), ["day"], ["k", "v"], write)
    assert {r.day: r.action for r in plan.collect()} == {"d1": "skip", "d2": "remove", "d3": "replace"}
    assert kept == [[("d1", 1, "a"), ("d3", 3, "c")]]
    plan = sinks.publish(table(spark, old), table(spark, old), table(spark, old), ["day"], ["k", "v"], write, rebuild=True)
    assert {r.day: r.action for r in plan.collect()} == {"d1": "replace", "d2": "replace"} and kept[-1] == sorted(old)


def test_tiff_frames(spark):
    import struct

    def tiff(order, following):
        return (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(f"{order}IHHHII", 8, 1, 256, 3, 1, 1) + struct.pack(f"{order}I", following)

    rows = [("a.tif", bytearray(tiff("<", 0))), ("b.tif", bytearray(tiff(">", 0))), ("c.tif", bytearray(tiff("<", 99))), ("d.tiff", bytearray(tiff(">", 70000)))]
    got = {r.path: r.n for r in spark.createDataFrame(rows, "path string, content binary").select("path", files.page_count(F.col("content"), F.col("path")).alias("n")).collect()}
    assert got == {"a.tif": 1, "b.tif": 1, "c.tif": None, "d.tiff": None}
