"""SentencePiece encoding and decoding with forward states shared along common prefixes.

Text is marked (white space becomes a mark, one mark goes before the text) and cut into marked words: marks and what
follows them. No piece of the supported models reaches past the end of a marked word, so words are encoded one by one,
and each distinct word once.

New words are sorted; in that order a depth-first walk through their trie goes from word to word, and the forward states
of a common prefix are kept. A state is the best way to cut the prefix: its last piece and its score.

* In a unigram model the score is the sum of the pieces' scores, and the best is the highest (Viterbi).
* In a BPE model a cut of a prefix is the model's if and only if each two neighbouring pieces are what BPE makes of
  the two together, and one cut has that property. So a piece may follow a state only if it stands that test with
  the state's last piece; no scores are added up. Tests of pairs are kept.

A character outside the vocabulary is encoded as the pieces of its UTF-8 bytes if the model has these, else as unknown.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import only, read
from .words import WordTable, flat, in_order, joined, lists, slices

MARK = "▁"
#: Steps of the automaton that are kept, pieces that are remembered for what they stand before, and the longest of these.
KEPT_STEPS, KEPT_LEFT, LONGEST_KEPT = 1_000_000, 1_000, 64
#: Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Texts whose words aren't all parted by single spaces, or that have what keys of words mean something by.
_VARIED = f"\\A(?: |\\z)|  | \\z| \\n|[\\x00{MARK}]"
_VARIED_OR_LINES = _VARIED + r"|\n"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class PieceModel:
    """pieces: (text, score, type) by id."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.texts = [p for p, _, _ in pieces]
        self.types = [t for _, _, t in pieces]
        if USER_DEFINED in self.types:
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("models with pieces that go on past white space are not supported")
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.outside = min(self.score.values(), default=0.0) - 10.0
        # pieces that a cut may have: in BPE only those that merging can make
        self.usable = {p for p in self.ids if len(p) > 1 and (kind != BPE or self.merge(p) == [p])}
        self._build()
        spelled = [p.encode().replace(MARK.encode(), b" ") if t == NORMAL else bytes([int(p[3:5], 16)]) if t == BYTE else b"" for p, _, t in pieces]
        self.spelled = pa.array(spelled, pa.binary())
        # words may be cut at line ends too if no piece reaches across one
        self.at_lines = dummy_prefix and not any("\n" in p for p in self.usable)
        self.piece_ids = _PieceIds(self)
        self.table = WordTable(self._new)

    def _build(self) -> None:
        """An automaton over the usable pieces. A node stands for a piece's beginning; ``ends`` has the pieces that end
        where a text has led to a node, the longest first, each with what is known of pieces before it."""
        self.step: list[dict[str, int]] = [{}]
        self.fails, self.ends, self.known = [0], [()], 0
        at: list[str | None] = [None]
        for piece in sorted(self.usable):
            node = 0
            for c in piece:
                after = self.step[node].get(c)
                if after is None:
                    after = self.step[node][c] = len(self.step)
                    self.step.append({})
                    self.fails.append(0)
                    self.ends.append(())
                    at.append(None)
                node = after
            at[node] = piece
        self.memo: list[dict[str, int]] = [{} for _ in self.step]
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, after in self.step[node].items():
                fail = self.fails[after] = self._next(self.fails[node], c) if node else 0
                own = at[after]
                self.ends[after] = (((len(own), own, {"": True}),) if own else ()) + self.ends[fail]
                queue.append(after)

    def _next(self, node: int, c: str) -> int:
        while node and c not in self.step[node]:
            node = self.fails[node]
        return self.step[node].get(c, 0)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        pieces, kind, dummy, extra, mapped = [], UNIGRAM, True, True, b""
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                mapped, dummy, extra = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if mapped or extra or kind not in (UNIGRAM, BPE):
            raise ValueError("only BPE and unigram models that leave text and white space as they are, are supported")
        return cls(pieces, kind, dummy)

    def _merges(self, parts: list[str], cut: int = 0) -> bool:
        """BPE by its definition, in place: join the neighbours with the best-scored joint piece, the leftmost first, until
        there are none. With ``cut``, stop and return False when the parts from there on would join those before."""
        score, none = self.score, float("-inf")
        pairs = [score.get(a + b, none) for a, b in itertools.pairwise(parts)]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)
            if i + 1 == cut:
                return False
            if i < cut:
                cut -= 1
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score.get(parts[i] + parts[i + 1], none)
        return True

    def merge(self, text: str) -> list[str]:
        parts = list(text)
        self._merges(parts)
        return parts

    def _stands(self, a: str, b: str) -> bool:
        """Whether BPE leaves a and b, which it can both make, next to each other: no merge ever crosses their border."""
        return self._merges([*a, *b], len(a))

    def _walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Words, in sorted order, and their pieces from the last to the first. ``last`` has the state of each prefix, its
        last piece, ``total`` its score; what a word shares with the one before isn't gone through again."""
        nodes, last, total, before = [0], [""], [0.0], ""
        memo, ends, unigram = self.memo, self.ends, self.kind != BPE
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del nodes[shared + 1 :], last[shared + 1 :], total[shared + 1 :]
            node = nodes[shared]
            for n in range(shared + 1, len(word) + 1):
                c = word[n - 1]
                after = memo[node].get(c)
                if after is None:
                    after = self._next(node, c)
                    if after and self.known < KEPT_STEPS:
                        memo[node][c] = after
                        self.known += 1
                node = after
                nodes.append(node)
                if unigram:
                    best, score = c, total[n - 1] + self.score.get(c, self.outside)
                    for length, piece, _ in ends[node]:
                        if total[n - length] + self.score[piece] > score or len(best) == 1 and total[n - length] + self.score[piece] == score:
                            best, score = piece, total[n - length] + self.score[piece]
                    last.append(best)
                    total.append(score)
                    continue
                for length, piece, follows in ends[node]:
                    left = last[n - length]
                    stands = follows.get(left)
                    if stands is None:
                        stands = self._stands(left, piece)
                        if len(left) <= LONGEST_KEPT and len(follows) < KEPT_LEFT:
                            follows[left] = stands
                    if stands:
                        last.append(piece)
                        break
                else:
                    last.append(c)
            n, pieces = len(word), []
            while n:
                pieces.append(last[n])
                n -= len(last[n])
            yield word, pieces
            before = word

    def cut(self, words: list[str]) -> dict[str, list[str]]:
        """The pieces of each word, in one walk through the trie of the words."""
        return {w: pieces[::-1] for w, pieces in self._walk(sorted(set(words)))}

    def _ids(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def marked(self, text: str) -> str:
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def _new(self, keys: pa.Array) -> pa.ListArray:
        """Ids of new words, by their keys: \\0 and the marked word, or \\n and what follows a line's end, or a word that
        one mark goes before."""
        raw = [k[1:] if k[:1] == "\0" else k if k[:1] == "\n" and self.at_lines else MARK + k for k in keys.to_pylist()]
        words = pa.array(raw, pa.string())
        order = pc.sort_indices(words).to_numpy()
        of, counts = self.piece_ids, []

        def ids() -> Iterator[int]:
            for _, pieces in self._walk(words.take(pa.array(order)).to_pylist()):
                pieces.reverse()
                got = [of[p] for p in pieces]
                if all(map(_one, got)):
                    counts.append(len(got))
                    yield from got
                else:
                    got = [i for x in got for i in ((x,) if _one(x) else x)]
                    counts.append(len(got))
                    yield from got

        found = np.fromiter(ids(), np.uint32)
        return in_order([(order, lists(np.array(counts, np.int64), found))])

    def _texts(self, texts: pa.Array) -> pa.ListArray:
        varied = pc.match_substring_regex(texts, _VARIED if self.at_lines else _VARIED_OR_LINES).to_numpy(zero_copy_only=False)
        if not self.dummy_prefix:
            varied[:] = True
        groups = []
        rows = np.flatnonzero(~varied)
        if len(rows):
            some = texts if len(rows) == len(texts) else texts.take(pa.array(rows))
            words = pc.split_pattern(pc.replace_substring(some, "\n", " \n") if self.at_lines else some, " ")
            groups.append((rows, joined(self.table.encode(words.values), words.offsets.to_numpy())))
        rows = np.flatnonzero(varied)
        if len(rows):
            cut = [_WORDS.findall(self.marked(t)) for t in texts.take(pa.array(rows)).to_pylist()]
            words = pa.array(["\0" + w for ws in cut for w in ws], pa.string())
            groups.append((rows, joined(self.table.encode(words), np.cumsum([0, *map(len, cut)]))))
        return in_order(groups)

    def encode_arrow(self, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.ListArray]]:
        """Some texts at a time, null ones as empty, and the ids of each; an empty text has none."""
        return ((part, self._texts(part)) for part in slices(texts))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return [np.array(x, "<u4").tobytes() for _, part in self.encode_arrow(pa.array(texts, pa.string())) for x in part.to_pylist()]

    def decode_arrow(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids. Null lists give the empty text, unknown and control ids nothing; bytes that aren't UTF-8
        give replacement characters."""
        ids = pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids
        values, at = flat(ids)
        joint = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.spelled.take(pa.array(values))), b"")
        try:
            texts = joint.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([x.decode("utf-8", "replace") for x in joint.to_pylist()], pa.string())
        texts = pc.replace_substring(texts, MARK, " ")
        if not self.dummy_prefix:
            return texts
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)

    def decode(self, ids: list[int]) -> str:
        return self.decode_arrow(pa.array([ids], pa.list_(pa.uint32())))[0].as_py()


class _PieceIds(dict):
    """A piece's id, or the ids that a character outside the vocabulary has instead."""

    def __init__(self, model: PieceModel):
        super().__init__(model.ids)
        self.model = model

    def __missing__(self, piece: str) -> int | tuple[int, ...]:
        got = self.model._ids(piece)
        return got[0] if len(got) == 1 else tuple(got)


def _one(x: int | tuple[int, ...]) -> bool:
    return x.__class__ is int


@cache
def model(path: str) -> PieceModel:
    """One for each worker and file."""
    return PieceModel.load(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part, found in model(path).encode_arrow(batch.column("text")):
                yield pa.record_batch([batch.column("doc_id").slice(done, len(part)), found.cast(pa.list_(pa.int32()))], names=["doc_id", "ids"])
                done += len(part)

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                yield pa.record_batch([part.column("doc_id"), model(path).decode_arrow(part.column("ids"))], names=["doc_id", "text"])

    return run


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part, found in model(path).encode_arrow(batch.column("text")):
                back = model(path).decode_arrow(found)
                ids, at = flat(found)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in itertools.pairwise(at.tolist())]
                sha = [hashlib.sha256(x).hexdigest() for x in back.cast(pa.binary()).to_pylist()]
                yield pa.record_batch([batch.column("doc_id").slice(done, len(part)), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pc.equal(back, part)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])
                done += len(part)

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids for each row of ``docs``. Null and empty texts have no ids; repeated rows get the same ids, null doc_ids
    stay null, an empty table gives an empty result, and other columns play no part."""
    return _rows(docs, id_col, text_col).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for each row. Null ids give the empty text. The mark itself, where a text had it, comes back as a
    space."""
    return only(encoded, doc_id=id_col, ids=ids_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_decode(path), "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), the decoded text's SHA-256, and whether it is the text
    that was encoded; as encode_pieces() and decode_pieces(), but ids don't leave the task."""
    return _rows(docs, id_col, text_col).mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
