"""Ids of the word-level tokenizer, word by word.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its words (split at ASCII white
space) in a row. Texts are split, words are numbered and their ids put in a row by Arrow, many texts at a time, so Python sees
each distinct word once. Words not met so far are encoded by the tokenizers library, many in one call; the others come from a
bounded table of words met lately.
"""

from __future__ import annotations

import functools
import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Recent, give_back

#: Words that the table of words met lately holds at most.
MET_WORDS = 1 << 19
#: Bytes of text split at once, but for a single longer text.
TEXT_BYTES = 16 << 20

#: Characters tried as a separator: neither letters nor digits, and not composed by normalisation.
SEPARATORS = "\u2122\u2605\u2022\u2192"
JOINED = 128
#: Letters and digits that stay what they are, whatever mark follows.
PLAIN = frozenset(string.ascii_letters + string.digits + "".join(map(chr, range(0xDF, 0x100))).replace("\u00f7", ""))
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
#: ASCII marks of which none begins or ends a match of its own with letters (as the apostrophe does).
MARKS = "".join(c for c in string.punctuation if c != "'")


_PLAIN_END = f"[{re.escape(''.join(sorted(PLAIN)))}]$"
_LAST_MARKS = f"(?P<marks>[{re.escape(MARKS)}]+)$"


class Met:
    """The ids of words met lately, as Arrow arrays: they are looked up all at once. Words of over Recent.LONGEST bytes aren't kept."""

    def __init__(self, entries: int = MET_WORDS):
        self.entries, self.words, self.ids = entries, pa.array([], pa.string()), pa.array([], pa.binary())

    @property
    def new(self) -> list[str]:
        return self.words.to_pylist()

    def of(self, words: pa.Array, encode) -> pa.Array:
        """The ids of distinct words; encode makes those of a list of words."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unmet = np.flatnonzero(at < 0)
        new = words.take(pa.array(unmet))
        ids = pa.concat_arrays([self.ids, pa.array(encode(new.to_pylist()), pa.binary())])
        at[unmet] = len(self.words) + np.arange(len(unmet))
        out = ids.take(pa.array(at))
        kept = pa.concat_arrays([self.words, new])
        if len(kept) > self.entries:  # starts over with the words in use
            kept, ids = words[: self.entries], out[: self.entries]
        short = pc.less_equal(pc.binary_length(kept), Recent.LONGEST)
        self.words, self.ids = (kept, ids) if pc.all(short).as_py() is not False else (kept.filter(short), ids.filter(short))
        return out


def in_a_row(texts: pa.Array, encode) -> tuple[memoryview, np.ndarray]:
    """What encode makes of each word of the texts, in a row, and the places where the texts begin and end in it. encode gets
    distinct words: an array of strings for one of bytes."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    found = encode(words.dictionary.cast(pa.string())).cast(pa.large_binary()).take(words.indices)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)])
    if not len(found):
        return memoryview(b""), ends
    offsets = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)
    return memoryview(found.buffers()[2] or b""), offsets[ends]


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        self.cache, self.separator = Met(), self._separator()
        self.plain = self._plain(Tokenizer.from_file(path))

    def _plain(self, copy):
        """A copy that skips normalisation and splits at white space only, for words of lower-case Latin-1 letters; None where
        it gives other ids than the tokenizer does for some samples."""
        from tokenizers import pre_tokenizers

        copy.encode_special_tokens, copy.normalizer = True, None
        copy.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = sorted(c for c in PLAIN if c.islower())
        samples = [*letters, *("".join(letters[k::n]) for n in (2, 3, 5, 7) for k in range(n)), "the cat " + " ".join(letters)]
        same = all(copy.encode(t, add_special_tokens=False).ids == self.tokenizer.encode(t, add_special_tokens=False).ids for t in samples)
        return copy if same else None

    def _separator(self) -> tuple[str, int] | None:
        """A character that is one id by itself: between words it parts their ids, since no other text has that id."""
        for c in SEPARATORS:
            if len(ids := self.tokenizer.encode(c, add_special_tokens=False).ids) == 1:
                return c, ids[0]
        return None

    def _each(self, texts: list[str], tokenizer=None) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word; short words go through the tokenizer JOINED at a time, with the separator between them."""
        if self.separator is None:
            return self._each(words)
        mark, sep = self.separator
        out: list = [None] * len(words)
        short: tuple[list[int], list[int]] = [], []
        for k, w in enumerate(words):
            if len(w) <= Recent.LONGEST and mark not in w:
                short[self.plain is not None and _LETTERS(w) is not None].append(k)
        for some, tokenizer in zip(short, (self.tokenizer, self.plain), strict=True):
            runs = [some[at : at + JOINED] for at in range(0, len(some), JOINED)]
            for run, raw in zip(runs, self._each([f" {mark} ".join([words[k] for k in run]) for run in runs], tokenizer), strict=True):
                ends = [*(np.flatnonzero(np.frombuffer(raw, self.kind) == sep) * self.width).tolist(), len(raw)]
                start = 0
                for k, end in zip(run, ends, strict=True):
                    out[k] = raw[start:end]
                    start = end + self.width
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self._each([words[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _encode_all(self, words: list[str]) -> list[bytes]:
        return [ids for at in range(0, len(words), 4096) for ids in self._encode(words[at : at + 4096])]

    def encode(self, words: pa.Array) -> pa.Array:
        """The ids of each of many distinct words. The tokenizer parts a word before the ASCII marks it ends with, where a letter
        or digit that normalisation leaves alone stands before them, so words that differ in these, or in the case of ASCII
        letters, are encoded once."""
        bare = pc.ascii_rtrim(words, MARKS)
        plain = pc.match_substring_regex(bare, _PLAIN_END)
        cores = pc.if_else(plain, pc.if_else(pc.string_is_ascii(bare), pc.ascii_lower(bare), bare), words)
        marked = pc.and_(plain, pc.not_equal(pc.binary_length(bare), pc.binary_length(words)))
        marks = pc.struct_field(pc.extract_regex(words.filter(marked), _LAST_MARKS), "marks")
        parts = pa.concat_arrays([cores, marks]).dictionary_encode()
        ids = self.cache.of(parts.dictionary, self._encode_all).take(parts.indices)
        ends = pc.replace_with_mask(pa.nulls(len(words), pa.binary()), marked, ids[len(words) :])
        return pc.binary_join_element_wise(ids[: len(words)], pc.fill_null(ends, b""), b"")

    def of(self, texts) -> list[bytes]:
        """The little-endian ids of each text (null: none), self.width bytes each; texts: a list or an Arrow array."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        ends, at, out = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0, []
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, side="right")))
            out += self._of(texts[at:stop])
            at = stop
        return out

    def _of(self, texts: pa.Array) -> list[bytes]:
        raw, bounds = in_a_row(texts, self.encode)
        return [bytes(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def forget() -> None:
    """Drops the caches of this worker and returns what they held to the system, for stages that need it for something else."""
    _loaded.clear()
    give_back()


def lean(run):
    """run over a task's Arrow batches, in a worker that drops what former tasks left it and gives back what this one frees."""

    @functools.wraps(run)
    def call(batches):
        forget()
        yield from run(batches)
        give_back()

    return call
