import zlib

import numpy as np

import corpus_pipeline as p
from ledgerline.llm.language import train_on_documents
from ledgerline.llm.simhash import fingerprints
from test_line_dedup import brute as lines_brute
from test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def groups(rows):
    prints = {i: fingerprints(t, 5, 3) for i, t in rows}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            d = [(a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)]
            if d[0] <= 11 and sum(d) <= 39:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_run_is_the_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = train_on_documents(docs)
    langs, _ = model.predict([t for _, t in rows])
    rows = [r for r, lang in zip(rows, langs, strict=True) if lang != "und"]
    rows = [(i, t) for i, t, *_ in lines_brute(rows)]
    of = groups(rows)
    rows = [(i, t) for i, t in rows if of[i] == i]
    n, least = check_packing(p.run(spark, SF).collect(), rows, 2048)
    assert n <= least + 2


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "text without id", None, None, 3), (9003, "12 34", "en", None, 5), (0, "another text of zero", "en", "s", 1), (9004, "word " * 60_000, "en", "s", 300_000)], base.schema)
    docs = base.unionByName(odd).selectExpr("*", "1 AS lost", "2 AS rep", "3 AS _row2", "4 AS lang_pred")
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            ids = [r.doc_id for r in docs.collect()]
            if name == "language":
                assert not {9001, 9002, 9003} & set(ids) and None in ids and ids.count(0) == 2
            if name == "near_dedup":
                assert None not in ids and len(set(ids)) == len(ids) and 9004 in ids
    assert out.count() > 0
    empty = base.limit(0)
    for _, stage in p.STAGES[:-1]:
        empty = spark.createDataFrame(stage(spark, empty, SF).collect(), base.schema)
        assert empty.count() == 0
    assert p.pack(spark, empty, SF).count() == 0


def test_texts_stay_where_no_language_is_known(spark):
    rows = [(1, "words of a text", None, "s", 3), (2, "12 34", None, "s", 5), (3, None, None, "s", None), (4, "été", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.keep_identified(spark, docs, SF).collect()) == [1, 4]


def test_callers_columns_come_through(spark):
    rows = [(i, f"the cat and the dog are here {i} " + " ".join(f"w{i}x{k}" for k in range(40)), None, "s", 3, 7.5, "xx", "f", i, "d", "p") for i in range(1, 30)]
    rows.append((40, "\u4f60\u597d\u4e16\u754c " * 9, None, "s", 3, 7.5, "xx", "f", 1, "d", "p"))
    rows += [(50 + i, f"le chat et le chien {i} " + " ".join(f"v{i}y{k}" for k in range(40)), "fr", "s", 3, 7.5, "xx", "f", i, "d", "p") for i in range(9)]
    rows += [(70 + i, f"the dog and the cat {i} here " + " ".join(f"u{i}z{k}" for k in range(40)), "en", "s", 3, 7.5, "xx", "f", i, "d", "p") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _found string, _row int, doc string, place string")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF).collect()
        assert len(out) == len(rows) - 1
        for r in out:
            assert (r.score, r.lang_pred, r._found, r.doc, r.place) == (7.5, "xx", "f", "d", "p")
            assert r._row == (r.doc_id if r.doc_id < 30 else r.doc_id - 50 if r.doc_id < 60 else r.doc_id - 70)
            assert r.lang == ("fr" if 50 <= r.doc_id < 60 else "en")
        docs = spark.createDataFrame(out, docs.schema)
    packed = p.pack(spark, docs, SF).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in packed)
