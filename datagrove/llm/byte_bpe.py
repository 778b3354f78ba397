"""Operator 3: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut where the split pattern always cuts (before a space that precedes a word, and around white space), each
piece is split by the pattern, and each match is merged on its own. The matches of many texts stand in one linked list of
bytes, with a gap after each. Every merge rank has a bucket of list positions; a two-level bitmap marks the ranks whose
buckets hold entries, so that find-first-set gives the next rank to merge. A bucket is merged in one step for all matches,
leftmost first where its pairs overlap; entries whose pair changed since they were queued are skipped. Where a merge calls for
a lower rank than its own, the match's entries behind it are queued again.

The cut rule holds for patterns that match white space as byte-level BPE patterns do (an optional space before a word, runs of
white space up to the last one): digests() takes such patterns only, encode() any.

Null texts count as empty and give no ids. Very long matches and texts are merged like others and kept in no cache. Repeated
rows, null ids and further columns are passed or ignored as they are; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, Recent, cat_ranges, slices

WORD_BITS = 256
#: Bytes of matches that are merged in one linked list, but for a single longer match; and of text looked at together.
BYTES_AT_ONCE, TEXT_AT_ONCE = 8 << 20, 8 << 20
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class RankQueue:
    """Buckets of list positions by merge rank, the least rank first."""

    def __init__(self, ranks: int):
        self.words, self.top, self.buckets = [0] * (ranks // WORD_BITS + 1), 0, {}

    def push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        buckets, words = self.buckets, self.words
        for rank, place in zip(ranks.tolist(), places.tolist(), strict=True):
            if (bucket := buckets.get(rank)) is not None:
                bucket.append(place)
            else:
                buckets[rank] = [place]
                high = rank // WORD_BITS
                words[high] |= 1 << rank % WORD_BITS
                self.top |= 1 << high

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank and its positions in ascending order."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        word = self.words[high]
        rank = high * WORD_BITS + (word & -word).bit_length() - 1
        self.words[high] = word = word & (word - 1)
        if not word:
            self.top &= self.top - 1
        return rank, np.array(sorted(set(self.buckets.pop(rank))), np.int64)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.size = max(ranks.values(), default=0) + 1
        by_rank = sorted((r, b) for b, r in ranks.items())
        self.token_starts, self.token_lengths = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        lengths = np.array([len(b) for _, b in by_rank], np.int64)
        at = np.array([r for r, _ in by_rank], np.int64)
        self.token_lengths[at], self.token_starts[at] = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(b for _, b in by_rank), np.uint8)
        self.byte_ranks = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        # The pairs of tokens that make a token, and the ranks whose merge may call for a lower rank.
        pairs, self.falling = {}, set()
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None:
                    pairs[left * (self.size + 1) + right] = rank
                    self.falling.update(r for r, part in ((left, k), (right, len(token) - k)) if part > 1 and r >= rank)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.queue, self.ids, self.words = RankQueue(self.size), Recent(CACHE_ENTRIES // 2), Recent(CACHE_ENTRIES // 3)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of tokens, -1 where there is none; a gap is the token self.size."""
        keys = left * (self.size + 1) + right
        if not len(self.pair_keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all matches in a row, and how many each has."""
        lengths = np.array([len(m) for m in matches], np.int64)
        raw = np.frombuffer(b"\0".join(matches) + b"\0", np.uint8)  # a gap of one place after each match
        gaps = np.cumsum(lengths + 1) - 1
        token = self.byte_ranks[raw]
        token[gaps] = self.size
        if (token < 0).any():
            raise ValueError("a byte has no rank")
        n = len(token)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank_at = np.full(n, -1, np.int64)  # of the pair that begins at a place
        rank_at[:-1] = self._pair(token[:-1], token[1:])
        alive, queue = np.ones(n, bool), self.queue
        some = np.flatnonzero(rank_at >= 0)
        queue.push(rank_at[some], some)
        while (entry := queue.pop()) is not None:
            rank, places = entry
            queued = places = places[rank_at[places] == rank]  # the others' pairs changed meanwhile
            if len(places) > 1:
                overlaps = np.concatenate([[False], following[places[:-1]] == places[1:]])
                if overlaps.any():  # every second one of a run
                    run = np.maximum.accumulate(np.where(overlaps, 0, np.arange(len(places))))
                    places = places[(np.arange(len(places)) - run) % 2 == 0]
                if rank in self.falling:
                    places, later = self._until_lower(rank, queued, places, token, following, before, gaps)
                    queue.push(np.full(len(later), rank), later)
            if not len(places):
                continue
            middle = following[places]
            ends = following[middle]
            token[places], following[places], before[ends] = rank, ends, places
            alive[middle], rank_at[middle] = False, -1
            left = before[places]
            changed = np.concatenate([places, left[left >= 0]])
            ranks = self._pair(token[changed], token[following[changed]])
            fresh = ranks != rank_at[changed]  # a place that stands in changed twice is queued twice, and merged once
            rank_at[changed] = ranks
            fresh &= ranks >= 0
            queue.push(ranks[fresh], changed[fresh])
        alive[gaps] = False
        sums = np.concatenate([[0], np.cumsum(alive)])
        return token[alive], sums[gaps] - sums[gaps - lengths]

    def _until_lower(self, rank, queued, places, token, following, before, gaps):
        """The places up to each match's first one whose merge calls for a lower rank, and the queued ones behind it."""
        ends = following[following[places]]
        left = np.where(before[places] >= 0, token[before[places]], self.size)
        left[1:][ends[:-1] == places[1:]] = rank  # merged just before
        lower = np.zeros(len(places), bool)
        for found in (self._pair(left, np.full(len(places), rank)), self._pair(np.full(len(places), rank), token[ends])):
            lower |= (found >= 0) & (found < rank)
        if not lower.any():
            return places, places[:0]
        matches, first = np.unique(np.searchsorted(gaps, places[lower]), return_index=True)
        stop = places[lower][first]

        def behind(some):
            own = np.searchsorted(gaps, some)
            at = np.minimum(np.searchsorted(matches, own), len(matches) - 1)
            return (matches[at] == own) & (some > stop[at])

        return places[~behind(places)], queued[behind(queued)]

    def encode(self, text: str) -> list[int]:
        matches = [m.encode() for m in self.split.findall(text)]
        return self.merge(matches)[0].tolist() if matches else []

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.token_bytes[cat_ranges(self.token_starts[ids], self.token_lengths[ids])].tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces not met lately: decimal ids joined by commas."""
        new = self.ids.missing(pieces)
        split, words, known = [self.split.findall(p) for p in new], self.words, self.ranks
        unmet = words.missing({m for found in split for m in found})
        at = 0
        while at < len(unmet):
            some, size = [], 0
            while at < len(unmet) and (not some or size + 4 * len(unmet[at]) < BYTES_AT_ONCE):
                some.append(unmet[at])
                size += 4 * len(unmet[at])
                at += 1
            raw = [m.encode() for m in some]
            whole = [known.get(m) for m in raw]
            open_ = [k for k, rank in enumerate(whole) if rank is None]
            for m, rank in zip(some, whole, strict=True):
                if rank is not None:
                    words.new[m] = str(rank)
            if open_:
                ids, counts = self.merge([raw[k] for k in open_])
                shown, start = list(map(str, ids.tolist())), 0
                for k, n in zip(open_, counts.tolist(), strict=True):
                    words.new[some[k]] = ",".join(shown[start : start + n])
                    start += n
        get, ids = words.new.__getitem__, self.ids.new
        for piece, found in zip(new, split, strict=True):
            ids[piece] = get(found[0]) if len(found) == 1 else ",".join(map(get, found))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, hash of the ids, hash of the bytes that they decode to, of each text."""
        cut = [_PIECES.findall(t) for t in texts]
        self.learn(set().union(*cut))
        get, out = self.ids.new.__getitem__, []
        for pieces in cut:
            joined = ",".join(map(get, pieces)).encode()
            ids = np.fromstring(joined, np.int64, sep=",") if joined else np.zeros(0, np.int64)
            digest = hashlib.sha256()
            for at in range(0, len(ids), 1 << 18):
                digest.update(self.decode(ids[at : at + (1 << 18)]))
            out.append((len(ids), hashlib.sha256(joined).hexdigest(), digest.hexdigest()))
        return out


_loaded: dict[tuple[str, str], ByteBPE] = {}


def _bpe(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE.from_file(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of each text."""

    def run(batches):
        bpe = _bpe(path, pattern)
        for batch in batches:
            for keys, texts in slices(batch, ["k", "t"]):
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([bpe.encode(t or "") for t in texts], pa.list_(pa.int32()))], [id_col, "ids"])

    kind = pa.int64()
    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"{id_col} long, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded (binary) of each array of ids."""

    def run(batches):
        bpe = _bpe(path, pattern)
        for batch in batches:
            for keys, rows in slices(batch, ["k", "i"]):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([bpe.decode(r or ()) for r in rows], pa.binary())], [id_col, "decoded"])

    return ids.select(F.col(id_col).cast("long").alias("k"), F.col(ids_col).alias("i")).mapInArrow(run, f"{id_col} long, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded in one pass."""

    def run(batches):
        bpe = _bpe(path, pattern)
        for batch in batches:
            for keys, texts in slices(batch, ["doc_id", "text"], batch.num_rows, TEXT_AT_ONCE):
                n, ids, back = zip(*bpe.digests([t or "" for t in texts]), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
