import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import token_files
from ledgerline.llm.packing import op10_packing, pack_documents, sum_of_squares
from ledgerline.llm.token_files import decode_block, encode_block, op5_token_files, pack, read_token_files, token_file_digests, unpack, write_token_files
from ledgerline.llm.tokens import Encoder
from ledgerline.llm.words import AT_ONCE, IDS, WordTable

FILES = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
TEXTS = ["", " ", "\n\n a  b\t\tc \n", "It's we'll 's  x's 123 45,6!?", "café café ́x ÉTÉ İ Σσς", "a b   c\x1cd \x85", "a<|endoftext|> b <|startoftext|>", "你好 世界 \U0001f600\U0001f600", "x" * 5000, "tab\there\r\nline \x0b\x0c end ", "  lead", "trail  ", "\x00\x01 a"]


@pytest.mark.parametrize("name", FILES)
def test_words_give_the_ids_of_whole_texts(name):
    own, plain = Encoder(FILES[name]), Tokenizer.from_file(FILES[name])
    assert own.pattern is not None
    for _ in range(2):
        got = own.encode([*TEXTS, None])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in [*TEXTS, ""]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b'sST1.,é́ \x1c<|"), st.characters(codec="utf-8")), max_size=40))
@pytest.mark.parametrize("name", FILES)
def test_any_text(name, text):
    own, plain = _ENC[name]
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


_ENC = {n: (Encoder(p), Tokenizer.from_file(p)) for n, p in FILES.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 7), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    x = np.array(values, np.uint64)
    words, escapes = pack(x)
    assert unpack(words, escapes, len(x)).tolist() == values
    assert len(escapes) == sum(v >= 1 << 60 for v in values)


def test_simple8b_is_dense():
    assert len(pack(np.zeros(1200, np.uint64))[0]) == 10
    assert len(pack(np.full(400, 2**15 - 1, np.uint64))[0]) == 100
    docs, offsets, ids = decode_block(encode_block([3, None], [np.array([5, 2**63], np.uint64), np.array([], np.uint64)]))
    assert (docs, offsets.tolist(), ids.tolist()) == ([3, None], [0, 2, 2], [5, 2**63])


def brute_files(rows):
    t, out, at = Tokenizer.from_file(FILES["byte_bpe_50k.json"]), [], 0
    for i, x in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def documents(spark):
    d = "/root/testdata/sf0.001"
    return d, [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


def test_token_files_query(spark):
    d, rows = documents(spark)
    assert sorted(tuple(r) for r in op5_token_files(spark, d).collect()) == brute_files(rows)


def test_token_files_cases(spark, tmp_path, monkeypatch):
    rows = [(9 - i, t) for i, t in enumerate(TEXTS)] + [(20, None), (21, "long " * 60_000), (None, "no id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    write_token_files(df, str(tmp_path / "t"), FILES["byte_bpe_50k.json"])
    got = read_token_files(spark, str(tmp_path / "t")).collect()
    t, at = Tokenizer.from_file(FILES["byte_bpe_50k.json"]), 0
    got.sort(key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += len(r.ids)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows if i is not None) + [None]
    want = sorted(str((i, t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in rows)
    assert sorted(str((r.doc_id, r.ids)) for r in got) == want
    write_token_files(df.limit(0), str(tmp_path / "e"), FILES["byte_bpe_50k.json"])
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError):
        decode_block(b"what is this, then, that has more than 28 bytes")
    assert token_files.LAYOUTS[15] == (120, 0) and all(c * b <= 60 for c, b in token_files.LAYOUTS)


def test_texts_of_more_than_a_slice(spark, tmp_path):
    rows = [(i, f"w{i} word of it " * 80_000) for i in range(33)]
    assert sum(len(t) for _, t in rows) > 2 * AT_ONCE
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    write_token_files(df, str(tmp_path / "t"), FILES["byte_bpe_50k.json"])
    got = {r.doc_id: r for r in token_file_digests(spark, str(tmp_path / "t")).collect()}
    packed = {}
    for r in pack_documents(df, FILES["word_bpe_49k.json"]).collect():
        packed.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, x in rows[::8]:
        ids = Tokenizer.from_file(FILES["byte_bpe_50k.json"]).encode(x).ids + [0]
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        ids = Tokenizer.from_file(FILES["word_bpe_49k.json"]).encode(x, add_special_tokens=False).ids + [0]
        parts = [np.array(ids[a : a + 2048], "<u4") for a in range(0, len(ids), 2048)]
        assert sorted(packed[i]) == [(k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(parts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="abc", max_size=3), max_size=12), max_size=8), st.integers(1, 12))
def test_word_table_forgets_nothing_it_needs(calls, kept):
    def ids(word):
        return [len(word), *word.encode()]

    table = WordTable(lambda words: pa.array([ids(w) for w in words.to_pylist()], IDS), kept)
    for words in calls:
        assert table.encode(pa.array(words, pa.string())).to_pylist() == [ids(w) for w in words]
        assert len(table.words) == len(table.ids) == len(table.calls) <= kept


def check_packing(got, rows, capacity):
    t, want = Tokenizer.from_file(FILES["word_bpe_49k.json"]), []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in got) // capacity)


def test_packing_query(spark):
    d, rows = documents(spark)
    n, least = check_packing(op10_packing(spark, d).collect(), rows, 2048)
    assert n <= least + 2


def test_packing_cases(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(30, None), (None, "no id"), (7, "again"), (7, "again"), (31, "word " * 5000), (32, "one " * 15), (33, "two " * 16)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, piece int, offset int")
    got = pack_documents(df, FILES["word_bpe_49k.json"], capacity=16, with_ids=True, slice_rows=7).collect()
    check_packing(got, rows, 16)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert pack_documents(df.limit(0), FILES["word_bpe_49k.json"]).count() == 0


def test_sum_of_squares_fills():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 150, 5000)
    sequence, offset = sum_of_squares(lengths, 400)
    assert sequence.max() + 1 <= -(-lengths.sum() // 400) + 2
    assert len(sum_of_squares(np.zeros(0, np.int64), 5)[0]) == 0
    assert sum_of_squares(np.array([5, 5, 2, 3]), 5)[0].tolist() == [0, 1, 2, 2]
