import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.pieces import BPE, MARK, NORMAL, UNIGRAM, UNKNOWN, PieceModel, decode_pieces, encode_pieces, op6_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
OWN, LIBRARY = PieceModel.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "a b", "  a   b ", "\n x", "café е́ \U0001f600", "<s> </s> <0x41> <unk>", f"a{MARK}b", "　x \xa0y ﬁ", "a\x00b", "tab\tx", "x" * 3000, "internationalisation unbelievable thththth " * 3, " " * 40 + "x", "word " * 50_000]


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in OWN.encode(texts)]


def test_equals_the_library():
    assert ids(TEXTS) == LIBRARY.encode(TEXTS)
    assert [OWN.decode(x) for x in ids(TEXTS)] == [t.replace(MARK, " ") for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \nthesianorTE.,é▁"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_equals_the_library(text):
    assert ids([text])[0] == LIBRARY.encode(text)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op6_sentencepiece(spark, d).collect()}
    assert got.keys() == rows.keys()
    for i, t in rows.items():
        x = LIBRARY.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        assert got[i].round_trip and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_operator_cases(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (50, None), (1, "again"), (1, "again")]
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in rows], "doc_id long, text string, ids array<int>, n_tokens string")
    encoded = encode_pieces(df, PATH)
    got = sorted(str((r.doc_id, r.ids)) for r in encoded.collect())
    assert got == sorted(str((i, LIBRARY.encode(t or ""))) for i, t in rows)
    back = sorted(str(tuple(r)) for r in decode_pieces(encoded, PATH).collect())
    assert back == sorted(str((i, (t or "").replace(MARK, " "))) for i, t in rows)
    assert encode_pieces(df.limit(0), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=7), min_size=1, max_size=6), st.randoms(use_true_random=False))
def test_unigram_is_the_best_cut(words, rng):
    parts = ["".join(p) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)]
    model = PieceModel([("<unk>", 0.0, UNKNOWN), *((p, -rng.random() * 9, NORMAL) for p in parts)], UNIGRAM)

    def best(word):
        if not word:
            return 0.0
        return max(best(word[n:]) + (model.score[word[:n]] if word[:n] in model.score else model.outside) for n in range(1, min(4, len(word) + 1)) if n == 1 or word[:n] in model.score)

    for word, pieces in model.cut(words).items():
        assert "".join(pieces) == word
        assert sum(model.score.get(p, model.outside) for p in pieces) == pytest.approx(best(word))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=9), min_size=1, max_size=8), st.randoms(use_true_random=False))
def test_bpe_is_what_merging_makes(words, rng):
    parts = ["".join(p) for n in (2, 3, 4) for p in itertools.product("ab", repeat=n)]
    rng.shuffle(parts)
    model = PieceModel([("<unk>", 0.0, UNKNOWN), ("a", -99.0, NORMAL), *((p, -float(i), NORMAL) for i, p in enumerate(parts[:12]))], BPE)
    assert model.cut(words) == {w: model.merge(w) for w in words}
