import math

import numpy as np

from ledgerline.llm.language import Model, has_letter, held_out, identify, is_held_out, op9_language, places, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op9_language(spark, SF).collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == is_held_out(i) and 0 <= r.score <= 1 for i, r in got.items())
    tested = [i for i in got if is_held_out(i) and has_letter(truth[i][1])]
    assert sum(got[i].lang_pred == truth[i][0] for i in tested) >= 0.98 * len(tested)
    for lang in {x for x, _ in truth.values()}:
        own = [i for i in tested if truth[i][0] == lang]
        assert sum(got[i].lang_pred == lang for i in own) >= 0.95 * len(own)


def test_cases(spark):
    rows = [(i, f"the cat and the dog are here {i}", "en") for i in range(40)] + [(100 + i, f"le chat et le chien sont ici {i}", "fr") for i in range(20)]
    rows += [(200, None, "en"), (201, "", None), (202, "123 !?", "fr"), (None, "the dog", "en"), (203, "und so weiter", None), (204, "the cat", "en"), (204, "the cat", "en")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = train(df)
    assert model.languages == ["en", "fr"]
    got = {(r.doc_id, r.text): r for r in identify(df, model).collect()}
    assert got[(200, None)].lang_pred == got[(201, "")].lang_pred == got[(202, "123 !?")].lang_pred == "und"
    assert got[(None, "the dog")].lang_pred == "en" and got[(105, "le chat et le chien sont ici 5")].lang_pred == "fr"
    assert identify(df, model).count() == len(rows) and identify(df, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    nothing = train(df.limit(0))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}
    assert identify(df.limit(0), model).count() == 0
    # lang and id of the scored rows don't matter
    other = df.selectExpr("text", "'zz' AS lang", "doc_id + 7 AS doc_id")
    assert {r.text: r.lang_pred for r in identify(other, model).collect()} == {t: r.lang_pred for (_, t), r in got.items()}


def test_sample_does_not_depend_on_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = train(df, per_language=20), train(df.repartition(7), per_language=20)
    assert np.array_equal(a.columns, b.columns) and np.allclose(a.weights, b.weights, atol=1e-4)


def test_places_of_long_text_are_those_of_its_parts():
    t = "".join(chr(97 + i * i % 26) for i in range(2_200_000))
    data = t.encode()
    want = set()
    for n, m in zip((1, 2, 3, 4), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), strict=True):
        grams = {data[i : i + n] for i in range(len(data) - n + 1)}
        want |= {(int.from_bytes(g, "big") * m % 2**32) >> 12 for g in grams}
    assert set(places(t).tolist()) == want
    assert len(places("")) == 0 and len(places("a")) == 1


def test_held_out_matches_crc32(spark):
    got = spark.range(500).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == is_held_out(r.id) for r in got)


def test_folded_weights_equal_the_kernel():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 900, 60)).astype(np.int32) for _ in range(40)]
    langs = ["a" if r[0] % 2 else "b" for r in rows]
    model = Model.fit(rows, langs, 16, 0.1)
    assert model.scores(rows).sum(1).round(6).tolist() == [1.0] * 40


def test_rare_languages_are_learned(spark):
    rows = [(i * 20 + k, f"{'abcdefghij'[i] * 3} word {k}", f"l{i}") for i in range(10) for k in range(20)]
    rows += [(1000 + i, f"{'klmnopqrst'[i] * 3} rare", f"rare{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df, per_language=10, most=25, landmarks=8)
    assert model.languages == sorted({r[2] for r in rows})
    many = train(spark.createDataFrame([(i, f"t{i} text", f"m{i:04}") for i in range(1100)], df.schema), most=1100, landmarks=1)
    assert len(many.languages) == 1100
    fitted = Model.fit([np.arange(i * 9, i * 9 + 9, dtype=np.int32) for i in range(6)], list("uvwxyz"), 2, 0.01)
    assert len(np.flatnonzero(fitted.columns)) == 54


def plain_values(rows, langs, marks, ridge):
    """One-against-rest kernel ridge regression on Nyström features, from the kernel by its definition; a function that
    gives a set's values for each language."""
    seen = set().union(*(rows[i] for i in marks))

    def kernel(x, y):
        x = x & seen
        return len(x & y) / max(1.0, math.sqrt(len(x))) / max(1.0, math.sqrt(len(y)))

    values, vectors = np.linalg.eigh(np.array([[kernel(rows[i], rows[j]) for j in marks] for i in marks]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.array([[kernel(r, rows[j]) for j in marks] for r in rows]) @ root
    names = sorted(set(langs))
    w = np.array([len(langs) / len(names) / langs.count(x) for x in langs])
    a = np.vstack([np.sqrt(w)[:, None] * z, math.sqrt(ridge) * np.eye(z.shape[1])])
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs]) * np.sqrt(w)[:, None]
    beta = np.linalg.lstsq(a, np.vstack([y, np.zeros((z.shape[1], len(names)))]), rcond=None)[0]
    return lambda r: np.array([kernel(r, rows[j]) for j in marks]) @ root @ beta


def test_values_are_those_of_the_unfolded_kernel():
    rng = np.random.default_rng(3)
    words = {"a": "the and of here there".split(), "b": "le la et ici voila".split(), "c": "der die und hier da".split()}
    texts = [(" ".join(rng.choice(words[x], 12)), x) for x in "abcab" * 9]
    rows, langs = [places(t) for t, _ in texts], [x for _, x in texts]
    model = Model.fit(rows, langs, 12, 0.05)
    turn, order = {}, []
    for i, x in enumerate(langs):
        turn[x] = turn.get(x, 0) + 1
        order.append((turn[x], i))
    marks = [i for _, i in sorted(order)[:12]]
    plain = plain_values([set(r.tolist()) for r in rows], langs, marks, 0.05)
    tried = rows + [places("the cat and the dog"), places("xyz"), places("le chat"), np.zeros(0, np.int32)]
    got, known = model.values(tried)
    assert np.allclose(got, [plain(set(r.tolist())) for r in tried], atol=1e-4)
    assert known[-1] == 0 and (got[-1] == 0).all()
    langs, best, familiar = model.judge(["the and of", "", None, "12", "你好"])
    assert langs == ["a", "und", "und", "und", langs[4]] and best[1:4] == [0, 0, 0] and familiar[0] == 1 and familiar[4] < 0.1


def test_names_and_long_texts(spark):
    rows = [(1, "the cat and the dog " * 30_000, "en", 7.0, "x"), (2, "le chat et le chien", "fr", 8.0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _found double, answer string")
    got = {r.doc_id: r for r in identify(df, train(df), familiar=True).collect()}
    assert (got[1].lang_pred, got[1]._found, got[2].answer) == ("en", 7.0, "y") and got[1].familiar > 0.9
    assert identify(df, train(df), keep=[]).columns == ["lang_pred", "score"]


def test_sample_is_bounded_in_bytes(spark):
    df = spark.createDataFrame([(i, f"{'the dog' if i % 2 else 'le chien'} {i} " * 500, "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    assert train(df, most_bytes=400_000).languages == ["en", "fr"]
    assert train(df, most_bytes=10).languages == []


def test_ties_go_to_the_first_language():
    r = [np.array([1, 2, 3], np.int32), np.array([1, 2, 3], np.int32)]
    model = Model.fit(r, ["b", "a"], 2, 0.1)
    assert model.scores(r).round(6).tolist() == [[0.5, 0.5]] * 2 and model.languages == ["a", "b"]
    assert model.scores(r).argmax(1).tolist() == [0, 0]
