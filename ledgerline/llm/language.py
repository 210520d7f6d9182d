"""Language identification by string kernels.

The kernel is the blended spectrum of n-gram presence: for two texts, the number of distinct byte n-grams (n = 1 to 4,
of the lower-cased text) that both have, divided by the root of the product of their own numbers. Training rows are
mapped to Nyström features, K(x, landmarks) K(landmarks, landmarks)^(-1/2), on which kernel ridge regression is solved
for one language against the rest. A text's kernel values with the landmarks are linear in its presence vector over
the landmarks' n-grams, so the product presence x landmarks x coefficients is formed from its right end once, and
a batch of texts is scored by one product: the batch's sparse presence matrix, held as the places of its rows one after
another, times the weights, a column for each language.

n-grams are hashed to 2**20 places; the kernel counts places that occur in any landmark. Whole texts are read, for
training and for scoring.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_table, give_back, materialise, only, read

PLACE_BITS, LONGEST = 20, 4
#: Bounds of what is fitted on the driver: training rows for each language and in all, landmarks, ridge.
TRAIN_PER_LANGUAGE, TRAIN_ROWS, LANDMARKS, RIDGE = 300, 3000, 256, 1e-2
#: Bytes of places that are gathered for fitting, and of weights that are sent to executors, at most.
TRAIN_BYTES, WEIGHT_BYTES = 1 << 27, 1 << 29
#: How steeply scores of one language against the rest are turned into shares.
STEEPNESS = 8.0
UNDETERMINED = "und"
#: Letters, and some numbers.
_LETTER = re.compile(r"[^\W\d_]")
_MIX = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F]
#: Bytes whose n-grams are looked at together; pieces overlap so that no n-gram is lost.
_AT_ONCE = 1 << 20
#: Texts that are taken together, and places of texts that are scored together, about.
_ROWS, _BATCH = 1000, 1 << 21


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def _codes(data: np.ndarray) -> np.ndarray:
    """The places of all n-grams, one for each occurrence."""
    part = data.astype(np.uint32)
    out, code = [], part
    for n in range(1, LONGEST + 1):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | part[n - 1 :]
        out.append((code * np.uint32(_MIX[n - 1])) >> np.uint32(32 - PLACE_BITS))
    return np.concatenate(out)


@cache
def _stamps() -> np.ndarray:
    return np.zeros(1 << PLACE_BITS, np.int32)


def places(text: str) -> np.ndarray:
    """The distinct places of all n-grams of a whole text, in order."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= _AT_ONCE >> 4:  # an occurrence counts if it is the last to have written its number at its place
        codes, stamps = _codes(data), _stamps()
        number = np.arange(len(codes), dtype=np.int32)
        stamps[codes] = number
        return np.sort(codes[stamps[codes] == number]).astype(np.int32)
    seen = np.zeros(1 << PLACE_BITS, bool)
    for a in range(0, len(data), _AT_ONCE):
        seen[_codes(data[a : a + _AT_ONCE + LONGEST - 1])] = True
    return np.flatnonzero(seen).astype(np.int32)


class Model:
    """columns: by place, the row of ``weights`` plus one, or zero for places that no landmark has."""

    def __init__(self, languages: list[str], columns: np.ndarray, weights: np.ndarray):
        self.languages, self.columns, self.weights = languages, columns, weights
        self.by_language = np.ascontiguousarray(weights.T)

    @classmethod
    def fit(cls, rows: list[np.ndarray], langs: list[str], landmarks: int, ridge: float) -> Model:
        languages = sorted(set(langs))
        # landmarks take turns among the languages, in the rows' order
        turns: dict[str, int] = {}
        order = sorted(range(len(rows)), key=lambda i: ((turns.__setitem__(langs[i], turns.get(langs[i], 0) + 1), turns[langs[i]])[1], i))
        marks = order[: max(landmarks, len(languages))]  # one of each language at least
        spectrum = np.unique(np.concatenate([rows[i] for i in marks]))
        columns = np.zeros(1 << PLACE_BITS, np.int32)
        columns[spectrum] = np.arange(1, len(spectrum) + 1)
        if len(spectrum) * len(languages) * 4 > WEIGHT_BYTES:
            raise ValueError("too many languages for weights of a bounded size: learn fewer")
        # which landmarks have a place: a bit for each
        m = np.zeros((len(spectrum), -(-len(marks) // 8)), np.uint8)
        for j, i in enumerate(marks):
            m[columns[rows[i]] - 1, j >> 3] |= np.uint8(1 << (j & 7))
        sizes = np.sqrt([max(1, len(rows[i])) for i in marks])
        k = np.zeros((len(rows), len(marks)))
        for i, r in enumerate(rows):
            c = columns[r]
            c = c[c > 0] - 1
            both = sum((np.unpackbits(m[c[a : a + 65_536]], axis=1, count=len(marks), bitorder="little").sum(0, dtype=np.int64) for a in range(0, len(c), 65_536)), np.zeros(len(marks), np.int64))
            k[i] = both / (sizes * max(1.0, np.sqrt(len(c))))
        values, vectors = np.linalg.eigh(k[marks])
        good = values > 1e-6 * max(values.max(), 1e-12)
        root = vectors[:, good] / np.sqrt(values[good])
        z = k @ root
        y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in langs])
        # each language weighs the same, however many rows it has
        w = np.array([1 / langs.count(x) for x in langs])[:, None]
        w *= len(langs) / w.sum()
        beta = np.linalg.solve(z.T @ (w * z) + ridge * np.eye(z.shape[1]), z.T @ (w * y))
        coefficients = (root @ beta) / sizes[:, None]
        weights = np.zeros((len(languages), len(spectrum)))
        for j, i in enumerate(marks):
            weights[:, columns[rows[i]] - 1] += coefficients[j][:, None]
        return cls(languages, columns, weights.T.astype(np.float32))

    def values(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each row of places its value for each language, one against the rest, and how many places the model knows."""
        sizes = np.array([len(r) for r in rows])
        c = self.columns[np.concatenate(rows)] if sizes.sum() else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(c > 0)])[np.concatenate([[0], np.cumsum(sizes)])]
        known = np.diff(ends)
        c = c[c > 0] - 1
        out = np.zeros((len(rows), len(self.languages)))
        some = known > 0
        for k, column in enumerate(self.by_language if len(c) else ()):
            out[some, k] = np.add.reduceat(column[c], ends[:-1][some], dtype=np.float64)
        return out / np.sqrt(np.maximum(known, 1))[:, None], known

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Shares of the languages, for each row."""
        return self._shares(self.values(rows)[0])

    def _shares(self, out: np.ndarray) -> np.ndarray:
        if not self.languages:
            return out
        e = np.exp(STEEPNESS * (out - out.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, best, _ = self.judge(texts)
        return langs, best

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """For each text its language, the language's share, and which part of its distinct n-grams any landmark has."""
        langs, best, familiar = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        waiting, rows, held = [], [], 0
        lettered = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for i in lettered:
            waiting.append(i)
            rows.append(places(texts[i]))
            held += len(rows[-1])
            if held >= _BATCH or i == lettered[-1]:
                values, known = self.values(rows)
                shares = self._shares(values)
                for j, k, s, n, r in zip(waiting, shares.argmax(1).tolist(), shares.max(1).tolist(), known.tolist(), rows, strict=True):
                    langs[j], best[j], familiar[j] = self.languages[k], s, n / len(r)
                waiting, rows, held = [], [], 0
        return langs, best, familiar


def _rank(column: str):
    """A number from 0 to 1 that an id always gets."""
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [places(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("rank"), batch.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["rank", "lang", "places"])


def train(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, most: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on a sample of rows with doc_id, text and lang, of about ``per_language`` rows for each language and at most
    ``most`` in all, whose places take at most ``most_bytes``, the first row of each language before others, so that up
    to ``most`` languages are learned, the most frequent ones; an id is always in or out, whatever the order. Rows
    without text, letter or lang are left out; without any row the model knows no language."""
    rows = only(labelled, doc_id="doc_id", text="text", lang="lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    if not counts:
        return _nothing()
    shares = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, share double")
    chosen = rows.withColumn("rank", _rank("doc_id")).join(F.broadcast(shares), "lang").where("rank < share AND text <> ''")
    # the first row of each language goes before all others
    first = F.row_number().over(Window.partitionBy("lang").orderBy("rank", F.xxhash64("text"), "text")) == 1
    chosen = chosen.select((F.col("rank") / F.col("share") - first.cast("int")).alias("rank"), "lang", "text")
    chosen, path = materialise(chosen, "language-sample")  # about per_language rows of each language
    # a byte starts four n-grams at most, of four bytes each, and there are only so many places
    size = F.least(16 * F.octet_length("text").cast("long"), F.lit(4 << PLACE_BITS)).alias("size")
    sizes = chosen.select("rank", size).orderBy("rank", "size").limit(most).collect()
    within = [r.rank for r, total in zip(sizes, np.cumsum([r["size"] for r in sizes]), strict=True) if total <= most_bytes]
    got = chosen.where(F.col("rank") <= F.lit(max(within, default=-2.0))).mapInArrow(_places_of, "rank double, lang string, places binary").orderBy("rank", "lang", "places").limit(len(within)).collect() if within else []
    drop_table(rows.sparkSession, path)
    own = [(np.frombuffer(r.places, np.int32), r.lang) for r in got if len(r.places)]
    return Model.fit([x for x, _ in own], [x for _, x in own], landmarks, ridge) if own else _nothing()


def _nothing() -> Model:
    return Model([], np.zeros(1 << PLACE_BITS, np.int32), np.zeros((0, 0), np.float32))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, familiar: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, by default) with lang_pred and score, replacing columns so named; with
    ``familiar`` also that, the part of a text's distinct n-grams that any of the model's landmarks has.

    A null text, and one without a letter, is ``und`` with score 0, as is every text for a model without languages; ties
    go to the language that sorts first. Each row stands for itself, so repeated rows get the same answer; an empty table
    gives an empty result. Other names don't clash. Texts of any length are looked at whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.columns, model.weights))  # 4 MB, and at most WEIGHT_BYTES

    @F.arrow_udf("struct<lang_pred: string, score: double, familiar: double>")
    def score(texts: pa.Array) -> pa.Array:
        own, parts = Model(*shared.value), []
        for a in range(0, len(texts), _ROWS):
            langs, best, known = own.judge(texts.slice(a, _ROWS).to_pylist())
            parts.append(pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(best, pa.float64()), pa.array(known, pa.float64())], ["lang_pred", "score", "familiar"]))
        give_back()
        return pa.concat_arrays(parts)

    score = score.asNondeterministic()  # else a condition on an answer would have texts scored once more
    new = ["lang_pred", "score", *(["familiar"] if familiar else [])]
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    # one struct, so that the answer's name is beside no other
    found = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row") if names else F.lit(0).alias("row"), score(docs[f"`{text_col}`"]).alias("answer"))
    return found.select(*[F.col("row")[c].alias(c) for c in names], *[F.col("answer")[c].alias(c) for c in new])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, train_on_documents(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
