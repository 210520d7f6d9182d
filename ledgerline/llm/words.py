"""Ids of many words at once: distinct words are looked up in a table that a worker keeps, as Arrow and numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import give_back

#: Words that a worker keeps, and the longest that it keeps, in bytes.
KEPT_WORDS, KEPT_BYTES = 500_000, 64
#: Texts whose words are looked up at once hold about so many bytes.
AT_ONCE = 8 << 20
IDS = pa.list_(pa.uint32())


def lists(counts: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    """``ids`` in lists of the given lengths."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.uint32()))


def joined(parts: pa.ListArray, ends: np.ndarray) -> pa.ListArray:
    """Neighbouring lists made one: the i-th goes from list ``ends[i]`` to before ``ends[i + 1]``."""
    return pa.ListArray.from_arrays(pa.array(parts.offsets.to_numpy()[ends]), parts.values)


def flat(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each list begins and the last ends."""
    at = x.offsets.to_numpy()
    return x.values.to_numpy()[at[0] : at[-1]], at - at[0]


def with_end(x: pa.ListArray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids with ``end`` after each list, and where each list begins and the last ends."""
    ids, at = flat(x)
    return np.insert(ids, at[1:], np.uint32(end)), at + np.arange(len(at))


def slices(texts: pa.Array, most: int = AT_ONCE) -> Iterator[pa.Array]:
    """Null texts made empty, some at a time: those of about ``most`` bytes, or one that is longer."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy())
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        yield pa.concat_arrays([texts.slice(a, b - a)])
        give_back()
        a = b


class WordTable:
    """Ids of words by ``new``, which gives those of distinct words that the table doesn't have.

    Beyond ``kept`` words the table keeps the half that occurred in most calls, of equal ones the latest.
    """

    def __init__(self, new: Callable[[pa.Array], pa.ListArray], kept: int = KEPT_WORDS):
        self.new, self.kept = new, kept
        self.words, self.ids = pa.array([], pa.string()), pa.array([], IDS)
        self.calls, self.last, self.call = np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def find(self, words: pa.Array) -> np.ndarray:
        """Where the table has each word, -1: nowhere."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()

    def encode(self, words: pa.Array) -> pa.ListArray:
        """The ids of each word."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        at, self.call = self.find(distinct).copy(), self.call + 1
        hit = at[at >= 0]
        self.calls[hit] += 1
        self.last[hit] = self.call
        fresh = np.flatnonzero(at < 0)
        ids = self.ids
        if len(fresh):
            more = distinct.take(pa.array(fresh))
            got = self.new(more)
            at[fresh] = len(ids) + np.arange(len(fresh))
            ids = pa.concat_arrays([ids, got])
            self._keep(more, got)
        return ids.take(pa.array(at[coded.indices.to_numpy()]))

    def _keep(self, words: pa.Array, ids: pa.ListArray) -> None:
        short = pc.less_equal(pc.binary_length(words), KEPT_BYTES)
        words, ids = words.filter(short), ids.filter(short)
        self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
        self.calls = np.concatenate([self.calls, np.ones(len(words), np.int32)])
        self.last = np.concatenate([self.last, np.full(len(words), self.call, np.int32)])
        if len(self.words) > self.kept:
            best = np.sort(np.lexsort((-self.last, -self.calls))[: self.kept // 2])
            self.words, self.ids = self.words.take(pa.array(best)), self.ids.take(pa.array(best))
            self.calls, self.last = self.calls[best] // 2, self.last[best]


def in_order(groups: list[tuple[np.ndarray, pa.ListArray]]) -> pa.ListArray:
    """Lists put back to the rows that each group names."""
    rows = np.concatenate([r for r, _ in groups])
    place = np.empty(len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    return pa.concat_arrays([x for _, x in groups]).take(pa.array(place))
