"""Whole texts to token ids with the tokenizers library, each distinct word encoded once while a worker remembers it.

Where a tokenizer never merges across the words that its splitting pattern makes, the ids of a text are the ids of its
words in order. Two kinds of tokenizer.json are known to be so: byte-level with the pattern of the library, and
word-end BPE that lower-cases and drops white space. For these, texts are cut at ASCII white space as the pattern cuts
them, many texts at once by Arrow functions, and distinct words are looked up in a bounded table. A text that may not be
cut so (it has other white space, control characters, or something like a special token) is encoded as a whole, as are
all texts of other tokenizers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from operator import attrgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import WordTable, in_order, joined, lists, slices

#: New words that aren't of Latin letters are encoded so many at once.
JOINED = 500

_BYTE_LEVEL = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_WORD_END = re.compile(r"[^ \t-\r]+")
#: A key of letters that both kinds of pattern leave whole, with ASCII punctuation after them: Latin letters without the
#: dotted capital I, whose small form has a combining mark.
_LATIN = r"^(?P<mark>[\x00\n]?)(?P<letters>[A-Za-z%s-%s%s-%s%s-%s%s-%s]+)(?P<tail>[!-/:-@\[-`{-~]*)$" % tuple(map(chr, (0xC0, 0xD6, 0xD8, 0xF6, 0xF8, 0x12F, 0x131, 0x24F)))
#: Byte-level names: printable bytes name themselves, the others follow from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_SPACE_NAME = chr(_BYTE_NAMES[32])
#: The mark of a word without a space before it, itself or named.
_UNSPACED = ("\0", chr(_BYTE_NAMES[0]))
#: What a text with single spaces and line ends between its words doesn't have.
_NOT_SINGLE = r"[\x00\t\x0b\x0c\r]|  | \n|\n |\n\n|\A[ \n]|[ \n]\z|\A\z"
#: Characters that Python and other engines may not agree on as white space, and the start of special tokens.
_ODD = [(0, 8), (0x1C, 0x1F), (0x7F, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
_WHOLE = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ODD) + "]|<\\|"
_id = attrgetter("id")


def _word_pattern(config: dict) -> re.Pattern | None:
    """How to cut texts for this tokenizer.json; None: not at all."""
    special = [x["content"] for x in config.get("added_tokens") or []]
    if config.get("post_processor") not in (None,) and config["post_processor"].get("type") != "ByteLevel":
        return None
    if config.get("truncation") or config.get("padding") or any(not x.startswith("<|") or re.search(r"\s", x) for x in special):
        return None
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in config.get("added_tokens") or []):
        return None
    before, split = config.get("normalizer"), config.get("pre_tokenizer") or {}
    if before is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
        return _BYTE_LEVEL
    steps = [x.get("type") for x in (before or {}).get("normalizers", [])]
    cuts = split.get("pretokenizers", [{}])
    drops = cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") and cuts[0]["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    if steps == ["NFC", "Replace", "Lowercase"] and drops and config["model"].get("end_of_word_suffix"):
        return _WORD_END
    return None


class Encoder:
    """Ids of texts. A word's key, by which the table knows it, is the word if a space goes before it, or a mark and the
    word: \\0 for one without a space before it, \\n for one right after a line's end, which the key includes, \\t for a
    run of white space. Where only white space separates words, each is its own key."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pattern = _word_pattern(json.loads(Path(path).read_text()))
        self.table = WordTable(self._new)
        self.line_end = lists(np.array([1]), np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids[:1] or [0]))

    def _each(self, texts: list[str]) -> pa.ListArray:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return lists(np.array([len(x) for x in got], np.int64), np.fromiter(chain.from_iterable(got), np.uint32))

    def _keys(self, text: str) -> list[str]:
        return [x[1:] if x[0] == " " and not x.isspace() else ("\t" if x.isspace() else "\0") + x for x in self.pattern.findall(text)]

    def _texts(self, texts: pa.Array) -> pa.ListArray:
        if self.pattern is None:
            return self._each(texts.to_pylist())
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        if self.pattern is _BYTE_LEVEL:
            varied = pc.match_substring_regex(texts, _NOT_SINGLE).to_numpy(zero_copy_only=False) & ~whole
        else:
            varied = np.zeros(len(texts), bool)
        groups = []
        for mask, do in ((whole, self._whole), (varied, self._varied), (~whole & ~varied, self._single)):
            rows = np.flatnonzero(mask)
            if len(rows):
                groups.append((rows, do(texts if len(rows) == len(texts) else texts.take(pa.array(rows)))))
        return groups[0][1] if len(groups) == 1 else in_order(groups)

    def _whole(self, texts: pa.Array) -> pa.ListArray:
        return self._each(texts.to_pylist())

    def _varied(self, texts: pa.Array) -> pa.ListArray:
        """Texts with runs of white space, cut by the pattern itself."""
        keys = [self._keys(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, keys)])
        return joined(self.table.encode(pa.array(list(chain.from_iterable(keys)), pa.string())), ends)

    def _single(self, texts: pa.Array) -> pa.ListArray:
        """Texts that splitting at white space, or at single spaces and line ends, cuts as the pattern does."""
        if self.pattern is _WORD_END:
            words = pc.ascii_split_whitespace(texts)
        else:
            marked = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), "")
            words = pc.split_pattern(marked, " ")
        return joined(self.table.encode(words.values), words.offsets.to_numpy())

    def _new(self, keys: pa.Array) -> pa.ListArray:
        """Ids of new keys. A word of Latin letters goes to the library's BPE model itself: both kinds of pattern leave
        it whole, and it is in its normal form, so what comes before the model is lower-casing and the naming of bytes."""
        parts = pc.extract_regex(keys, _LATIN)
        latin = parts.is_valid().to_numpy(zero_copy_only=False)
        groups = []
        if latin.any():
            groups.append((np.flatnonzero(latin), self._latin(*parts.drop_null().flatten())))
        rest = np.flatnonzero(~latin)
        if len(rest):
            groups.append((rest, self._others(keys.take(pa.array(rest)).to_pylist())))
        return in_order(groups)

    def _latin(self, marks: pa.Array, letters: pa.Array, tails: pa.Array) -> pa.ListArray:
        n = len(letters)
        after = pc.equal(marks, "\n").to_numpy(zero_copy_only=False)
        if self.pattern is _WORD_END:
            letters = pc.utf8_lower(letters)
        else:
            letters = pc.binary_join_element_wise(pc.if_else(pc.equal(marks, ""), "", "\0"), letters, "")
        coded, ends = letters.dictionary_encode(), tails.dictionary_encode()
        at = self.table.find(coded.dictionary).copy()  # as a key, a word without marks or punctuation
        fresh = np.flatnonzero(at < 0)
        at[fresh] = len(self.table.ids) + np.arange(len(fresh))
        pool = pa.concat_arrays([self.table.ids, self._simple(coded.dictionary.take(pa.array(fresh)).to_pylist()), self._each(ends.dictionary.to_pylist()), self.line_end, lists(np.array([0]), np.array([], np.uint32))])
        none = len(pool) - 1
        three = np.empty((n, 3), np.int64)
        three[:, 0] = np.where(after, none - 1, none)
        three[:, 1] = at[coded.indices.to_numpy()]
        three[:, 2] = len(self.table.ids) + len(fresh) + ends.indices.to_numpy()
        return joined(pool.take(pa.array(three.ravel())), np.arange(0, 3 * n + 1, 3))

    def _simple(self, keys: list[str]) -> pa.ListArray:
        tokenize, counts = self.model.tokenize, []

        def ids() -> Iterator[int]:
            for k in keys:
                if not k.isascii():
                    k = k.encode().decode("latin-1").translate(_BYTE_NAMES)
                if self.pattern is _BYTE_LEVEL:
                    k = k[1:] if k[0] in _UNSPACED else _SPACE_NAME + k
                got = tokenize(k)
                counts.append(len(got))
                yield from map(_id, got)

        flat = np.fromiter(ids(), np.uint32)
        return lists(np.array(counts, np.int64), flat)

    def _others(self, keys: list[str]) -> pa.ListArray:
        if self.pattern is _WORD_END:
            return self._joined(keys)
        words = [k[1:] if k[:1] in ("\0", "\n", "\t") else " " + k for k in keys]
        got = self._joined(words)
        after = np.array([k[:1] == "\n" for k in keys])
        pool = pa.concat_arrays([got, self.line_end, lists(np.array([0]), np.array([], np.uint32))])
        two = np.stack([np.where(after, len(got), len(got) + 1), np.arange(len(got))], axis=1)
        return joined(pool.take(pa.array(two.ravel())), np.arange(0, 2 * len(got) + 1, 2))

    def _joined(self, words: list[str]) -> pa.ListArray:
        """Ids of words, many of them encoded as one text: words that begin with a space follow one another, others have
        a separator between them. A word's tokens are those that start within it."""
        spaced = [i for i, w in enumerate(words) if w[:1] == " " and not w.isspace()]
        plain = [i for i, w in enumerate(words) if w and w[0] != " " and not w.isspace()]
        blank = [i for i, w in enumerate(words) if not w or w.isspace()]
        rows, counts, ids = [], [], []
        for these, between in ((spaced, ""), (plain, " " if self.pattern is _WORD_END else "\n")):
            groups = [these[a : a + JOINED] for a in range(0, len(these), JOINED)]
            got = self.tokenizer.encode_batch([between.join([words[i] for i in g]) for g in groups], add_special_tokens=False)
            for g, e in zip(groups, got, strict=True):
                sizes = np.array([len(words[i]) for i in g])
                first = np.cumsum(sizes + len(between)) - sizes - len(between)
                starts = np.array([x for x, _ in e.offsets])
                a, b = np.searchsorted(starts, first), np.searchsorted(starts, first + sizes)
                own = np.array(e.ids, np.uint32)
                inside = np.zeros(len(own) + 1, np.int64)
                np.add.at(inside, a, 1)
                np.add.at(inside, b, -1)
                rows += g
                counts.append(b - a)
                ids.append(own[np.cumsum(inside)[:-1] > 0])
        out = [(np.array(rows, np.int64), lists(np.concatenate(counts), np.concatenate(ids)))] if rows else []
        if blank:
            out.append((np.array(blank), self._each([words[i] for i in blank])))
        return in_order(out)

    def encode_arrow(self, texts: pa.Array) -> Iterator[pa.ListArray]:
        """The ids of each text, for some texts at a time; a null text counts as empty."""
        return map(self._texts, slices(texts))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return [np.array(x, "<u4").tobytes() for part in self.encode_arrow(pa.array(texts, pa.string())) for x in part.to_pylist()]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(path)
