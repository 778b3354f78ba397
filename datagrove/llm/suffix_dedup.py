"""Operator 1: removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte is removed when a LENGTH-byte string that covers it also starts in a document with a smaller doc_id. Texts are taken as
UTF-8; matches never cross documents and are judged on the input.

1. Documents are dealt into batches by a hash of the id. In every LENGTH-byte window the least hash of its GRAM-byte strings
   is the window's anchor; equal windows have equal anchors. Runs of windows with one anchor form a segment. Batches send
   their distinct anchors to buckets, and buckets answer which of them several documents have.
2. Batches send the segments of those anchors, equal ones once with their places. A segment holds every window of its
   anchor whole, so what can match meets in one bucket. Anchors of over HOT documents are dealt by whole windows instead,
   so that no bucket holds more of a frequent passage than each batch's one copy.
3. In a bucket the segments are dealt over shards. Each shard sorts its own suffixes and forms its Burrows-Wheeler
   transform. The shards are merged by iterative interleave refinement: the interleave sorted by k symbols and the
   transforms' symbols in that order (STEP at a time, as one code), stably dealt by code, give the interleave sorted by
   k + STEP symbols; where codes or block differ a new block starts. After LENGTH steps the blocks are the intervals of suffixes with a common prefix of
   LENGTH bytes, and each interval's least doc_id decides for all its windows. The merged suffixes are never sorted.
4. Batches get the repeated stretches of their documents back and cut them out.

Null texts count as empty. Rows that share an id don't remove each other's bytes; a null id comes after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, cat_ranges, parts_for
from .word_ids import forget

LENGTH, GRAM = 50, 25
HOT = 1000
SHARDS, BLOCK_BYTES, SCAN_BYTES = 2, 1 << 16, 1 << 17
LONGEST_RUN = 64
STEP = 8  # symbols that a step of the merge deals by
_RNG = np.random.default_rng(50)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.int64(a.nbytes).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


# --- anchors ------------------------------------------------------------------------------------------------------


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    known = {1: _BYTE[x]}
    k = 1
    while 2 * k <= GRAM:
        h = known[k]
        known[2 * k] = h[:-k] * _power(k) + h[k:]
        k *= 2
    out, size = known[k], k
    for k in sorted(known, reverse=True)[1:]:
        if GRAM - size >= k:
            n = len(x) - size - k + 1
            out, size = out[:n] * _power(k) + known[k][size : size + n], size + k
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if width > k else h


def _runs(texts: list[bytes]):
    """Of all texts: place of the text, first window, windows and anchor of each run of windows with one anchor."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < SCAN_BYTES):
            size += len(texts[end])
            end += 1
        n = np.array([len(t) for t in texts[at:end]], np.int64)
        x = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        if len(x) >= LENGTH:
            anchors = _sliding_min(_gram_hashes(x), LENGTH - GRAM + 1)
            ends = np.cumsum(n)
            inside = np.arange(len(anchors)) + LENGTH <= np.repeat(ends, n)[: len(anchors)]
            new = np.ones(len(anchors), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | ~inside[:-1]
            starts_of_texts = (ends - n)[n > 0]
            new[starts_of_texts[starts_of_texts < len(anchors)]] = True
            starts = np.flatnonzero(new & inside)
            stops = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
            length = stops - starts
            pieces = -(-length // LONGEST_RUN)
            part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, length = np.repeat(starts, pieces) + part * LONGEST_RUN, np.minimum(np.repeat(length, pieces) - part * LONGEST_RUN, LONGEST_RUN)
            text = np.searchsorted(ends, starts, side="right")
            mixed = anchors[starts] * np.uint64(0x94D049BB133111EB)
            yield text + at, starts - (ends - n)[text], length, mixed ^ (mixed >> np.uint64(32))
        at = end


class Batch:
    """The distinct (doc_id, text) of a batch in a fixed order."""

    def __init__(self, table: pa.Table):
        ids = [LAST_ID if k is None else k for k in table.column("__id").to_pylist()]
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("__text").to_pylist()]
        keys = list(zip(ids, map(xxhash.xxh3_128_digest, texts), strict=True))
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.place, self.ids, self.texts, last = [0] * len(keys), [], [], None
        for k in order:
            if keys[k] != last:
                self.ids.append(ids[k])
                self.texts.append(texts[k])
                last = keys[k]
            self.place[k] = len(self.ids) - 1
        self.ids = np.array(self.ids, np.int64)


def _dealt(anchors: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and a key of 40 bits within it."""
    return (anchors % np.uint64(parts)).astype(np.int64), anchors >> np.uint64(24)


def _split(part: np.ndarray):
    order = np.argsort(part, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []


def _ask(parts: int):
    def run(key, table):
        forget()  # the first step: what other operators' tasks left to this worker
        batch = Batch(table)
        found = list(_runs(batch.texts))
        out = []
        if found:
            text, _, _, anchors = (np.concatenate(c) for c in zip(*found, strict=True))
            doc = batch.ids[text]
            order = np.lexsort((doc, anchors))
            anchors, doc = anchors[order], doc[order]
            once = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])])
            anchors, count = np.unique(anchors[once], return_counts=True)
            part, small = _dealt(anchors, parts)
            for some in _split(part):
                out.append((int(part[some[0]]), _pack((small[some] & np.uint64(0xFFFFFFFF)).astype("<u4"), (small[some] >> np.uint64(32)).astype("u1"), count[some].astype("<u4"))))
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "batch": pa.array([key[0].as_py()] * len(out), pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """To each batch: which of its keys several documents have, and which of these very many."""
    given = [_unpack(d, "<u4", "u1", "<u4") for d in table.column("data").to_pylist()]
    if not given:
        return table.select(["part", "batch", "data"])
    keys = [low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)) for low, high, _ in given]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate([c for *_, c in given]).astype(float), len(every))
    out, at = [], 0
    for (low, high, _), k in zip(given, keys, strict=True):
        n = total[place[at : at + len(k)]]
        at += len(k)
        keep = n >= 2
        out.append(_pack(low[keep], high[keep], (n[keep] >= HOT).astype("u1")))
    return pa.table({"part": table.column("part"), "batch": table.column("batch"), "data": pa.array(out, pa.binary())})


# --- segments -----------------------------------------------------------------------------------------------------


def _send(parts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and answers.num_rows:
            keys, hots = [], []
            for part, data in zip(answers.column("part").to_pylist(), answers.column("data").to_pylist(), strict=True):
                low, high, hot = _unpack(data, "<u4", "u1", "u1")
                keys.append((low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))) * np.uint64(parts) + np.uint64(part))
                hots.append(hot)
            keys, hots = np.concatenate(keys), np.concatenate(hots)
            order = np.argsort(keys)
            keys, hots = keys[order], hots[order]
            batch, segments = Batch(docs), {}
            for text, first, length, anchors in _runs(batch.texts) if len(keys) else ():
                part, small = _dealt(anchors, parts)
                own = small * np.uint64(parts) + part.astype(np.uint64)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                known = keys[at] == own
                hot = known & (hots[at] > 0)
                plain = known & ~hot
                for t, f, n, a in zip(text[plain].tolist(), first[plain].tolist(), length[plain].tolist(), anchors[plain].tolist(), strict=True):
                    s = batch.texts[t][f : f + n + LENGTH - 1]
                    held = segments.get(s)
                    if held is None:
                        segments[s] = (a, [t], [f])
                    else:
                        held[1].append(t)
                        held[2].append(f)
                for t, f, n in zip(text[hot].tolist(), first[hot].tolist(), length[hot].tolist(), strict=True):
                    for w in range(f, f + n):
                        s = batch.texts[t][w : w + LENGTH]
                        held = segments.get(s)
                        if held is None:
                            segments[s] = (xxhash.xxh3_64_intdigest(s), [t], [w])
                        else:
                            held[1].append(t)
                            held[2].append(w)
            if segments:
                strings, held = list(segments), list(segments.values())
                part = np.array([h[0] % parts for h in held])
                for some in _split(part):
                    rows = [held[k] for k in some.tolist()]
                    text = np.array([t for r in rows for t in r[1]], np.int64)
                    data = _pack(
                        np.array([len(strings[k]) for k in some.tolist()], "<u2"), np.frombuffer(b"".join(strings[k] for k in some.tolist()), np.uint8),
                        np.array([r[0] for r in rows], np.uint64), np.array([len(r[1]) for r in rows], "<u4"), text.astype("<u4"), batch.ids[text], np.array([f for r in rows for f in r[2]], "<u4"),
                    )
                    out.append((int(part[some[0]]), data))
        number = docs.column("__batch")[0].as_py() if docs.num_rows else 0
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "batch": pa.array([number] * len(out), pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    return run


# --- merging ------------------------------------------------------------------------------------------------------


def _dense(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each value, from 0, equal ones alike; ordered: the values as order sorts them."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return out


def _codes(texts: list[np.ndarray], depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """At each place of each text (a circle) the rank of the STEP symbols from there on among those of all texts, and that of
    the depth % STEP symbols from there on."""
    keys = []
    for x in texts:
        key, k = np.resize(x, len(x) + STEP - 1).astype(np.uint64), 1
        while k < STEP:
            key = (key[:-k] << np.uint64(8 * k)) | key[k:]
            k *= 2
        keys.append(key)
    key, ends = np.concatenate(keys), np.cumsum([len(x) for x in texts])[:-1]
    order = np.argsort(key)
    ordered = key[order]
    first = _dense(ordered >> np.uint64(8 * (STEP - depth % STEP)), order) if depth % STEP else np.zeros(len(key), np.int64)
    return np.split(_dense(ordered, order), ends), np.split(first, ends)


def _stable(codes: np.ndarray) -> np.ndarray:
    """The order that deals by code; what stood first stays first. Radix passes over 16 bits each."""
    order = np.argsort(codes.astype(np.uint16), kind="stable")
    high = codes >> 16
    return order[np.argsort(high[order].astype(np.uint16), kind="stable")] if high.any() else order


class Shard:
    """The suffixes of strings (each closed by a symbol 0, the whole taken as a circle), sorted by depth symbols at least, and
    their transform: the codes of the STEP symbols before each, and of the depth % STEP symbols before each."""

    def __init__(self, steps: np.ndarray, first: np.ndarray, depth: int = LENGTH):
        n, rank, k = len(steps), steps, STEP
        while True:
            bits = max(1, int(rank.max()).bit_length())
            times = min(63 // bits, -(-depth // k))  # ranks of k symbols that one key holds
            key = rank << (bits * (times - 1))
            for t in range(1, times):
                key |= np.roll(rank, -(t * k % n)) << (bits * (times - 1 - t))
            order = np.argsort(key)
            k *= times
            if k >= depth:
                break
            rank = _dense(key[order], order)
        self.suffixes = order
        self.step = steps[order - STEP].astype(np.int32)
        self.first = first[order - depth % STEP].astype(np.int32)


def merge(shards: list[Shard], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The interleave (the shard of each merged suffix) and the number of its interval of suffixes with depth common symbols.

    A step deals by the code of STEP symbols at once; where these don't divide depth, the first deals by the symbols left over.
    """
    inter = np.repeat(np.arange(len(shards), dtype=np.int32), [len(s.step) for s in shards])
    state = inter  # interval << 2 | shard
    new = np.ones(len(inter), bool)
    for left_over in [True] * (depth % STEP > 0) + [False] * (depth // STEP):
        symbols = np.empty(len(inter), np.int32)
        for k, s in enumerate(shards):
            symbols[np.flatnonzero((state & 3) == k)] = s.first if left_over else s.step
        order = _stable(symbols)  # dealt by code; what stood first stays first
        state, drawn = state[order], symbols[order]
        block = state >> 2
        np.not_equal(block[1:], block[:-1], out=new[1:])
        new[1:] |= drawn[1:] != drawn[:-1]
        state = (np.cumsum(new, dtype=np.int32) << 2) | (state & 3)
    return state & 3, state >> 2


def least_owner(strings: list[bytes], owners: np.ndarray) -> list[np.ndarray]:
    """For each string and each of its LENGTH-byte windows, the least owner of a string that has the window."""
    lengths = np.array([len(s) for s in strings], np.int64)
    out = [None] * len(strings)
    shares = [np.arange(k, len(strings), SHARDS) for k in range(min(SHARDS, len(strings)))]
    texts, owner, starts = [], [], []
    for share in shares:
        n = lengths[share] + 1
        x = np.zeros(int(n.sum()), np.uint8)
        starts.append(np.cumsum(n) - n)
        x[cat_ranges(starts[-1], n - 1)] = np.frombuffer(b"".join(strings[k] for k in share.tolist()), np.uint8) + np.uint8(1)
        texts.append(x)
        has = np.full(len(x), LAST_ID)
        windows = lengths[share] - LENGTH + 1
        has[cat_ranges(starts[-1], windows)] = np.repeat(owners[share], windows)
        owner.append(has)
    shards = [Shard(steps, first) for steps, first in zip(*_codes(texts, LENGTH), strict=True)]
    inter, block = merge(shards)
    places = [np.flatnonzero(inter == k) for k in range(len(shards))]
    least = np.empty(len(inter), np.int64)
    for place, shard, has in zip(places, shards, owner, strict=True):
        least[place] = has[shard.suffixes]
    least = np.minimum.reduceat(least, np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])))
    for place, shard, start, share in zip(places, shards, starts, shares, strict=True):
        found = np.empty(len(shard.suffixes), np.int64)
        found[shard.suffixes] = least[block[place] - 1]
        for k, s in zip(share.tolist(), start.tolist(), strict=True):
            out[k] = found[s : s + lengths[k] - LENGTH + 1]
    return out


def _meet(table: pa.Table) -> pa.Table:
    """A bucket: to each batch the stretches of its documents that repeat what a smaller doc_id has."""
    batches, data = table.column("batch").to_pylist(), table.column("data").to_pylist()
    place, anchors, owners, given = {}, [], [], []
    for d in data:
        lengths, raw, anchor, members, text, ids, first = _unpack(d, "<u2", "u1", "<u8", "<u4", "<u4", "<i8", "<u4")
        raw, ends = raw.tobytes(), np.cumsum(lengths.astype(np.int64))
        own = np.minimum.reduceat(ids, np.cumsum(members.astype(np.int64)) - members)
        where = np.empty(len(lengths), np.int64)
        for k, (a, b, h, o) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), anchor.tolist(), own.tolist(), strict=True)):
            s = raw[a:b]
            at = place.get(s)
            if at is None:
                at = place[s] = len(anchors)
                anchors.append(h)
                owners.append(o)
            elif o < owners[at]:
                owners[at] = o
            where[k] = at
        given.append((np.repeat(where, members), text, ids, first))
    strings, owners = list(place), np.array(owners, np.int64)
    order = np.argsort(np.array(anchors, np.uint64), kind="stable")
    least: list = [None] * len(strings)
    some, size = [], 0
    for n, k in enumerate(order.tolist()):
        some.append(k)
        size += len(strings[k]) + 1
        if n + 1 == len(order) or size >= BLOCK_BYTES and anchors[order[n + 1]] != anchors[k]:
            for j, found in zip(some, least_owner([strings[j] for j in some], owners[some]), strict=True):
                least[j] = found
            some, size = [], 0
    windows = np.array([len(f) for f in least], np.int64)
    flat = np.concatenate(least) if least else np.zeros(0, np.int64)
    starts, out = np.cumsum(windows) - windows, []
    for where, text, ids, first in given:
        n = windows[where]
        again = flat[cat_ranges(starts[where], n)] < np.repeat(ids, n)
        offset = cat_ranges(first.astype(np.int64), n)
        owner = np.repeat(np.arange(len(where)), n)
        edge = np.ones(len(again), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (again[1:] != again[:-1])
        begin = np.flatnonzero(edge)
        stop = np.append(begin[1:], len(again)) - 1
        keep = again[begin] if len(begin) else np.zeros(0, bool)
        begin, stop = begin[keep], stop[keep]
        out.append(_pack(text[owner[begin]].astype("<u4"), offset[begin].astype("<u4"), (offset[stop] + LENGTH).astype("<u4")))
    return pa.table({"batch": pa.array(batches, pa.int32()), "data": pa.array(out, pa.binary())})


def _cut(carried: list[str], as_text: bool):
    def run(docs: pa.Table, stretches: pa.Table) -> pa.Table:
        batch = Batch(docs)
        n = np.array([len(t) for t in batch.texts], np.int64)
        parts = [_unpack(d, "<u4", "<u4", "<u4") for d in stretches.column("data").to_pylist()] if stretches.num_rows else []
        text, begin, stop = (np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(text, kind="stable")
        bounds = np.searchsorted(text[order], np.arange(len(n) + 1))
        kept, removed, spans = [], [], []
        for k in range(len(n)):
            some = order[bounds[k] : bounds[k + 1]]
            if not len(some):
                kept.append(batch.texts[k])
                removed.append(0)
                spans.append(0)
                continue
            depth = np.bincount(begin[some], minlength=n[k] + 1) - np.bincount(stop[some], minlength=n[k] + 1)
            gone = np.cumsum(depth)[: n[k]] > 0
            kept.append(np.frombuffer(batch.texts[k], np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        at = batch.place
        made = [pa.array(n[at] if at else [], pa.int64()), pa.array([removed[k] for k in at], pa.int64()), pa.array([spans[k] for k in at], pa.int64()), pa.array([kept[k].decode("utf-8", "ignore") if as_text else kept[k] for k in at], pa.string() if as_text else pa.binary())]
        return pa.Table.from_arrays([docs.column(c) for c in carried] + made, names=carried + ["n_bytes", "n_removed", "n_spans", "kept"])

    return run


def deduplicate(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """docs without text, with n_bytes, n_removed, n_spans and kept (the remaining bytes, or as text without broken characters)."""
    parts = parts_for(docs)
    columns = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "kept")]
    carried = [f"c{k}" for k in range(len(columns))]
    dealt = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(parts)).cast("int").alias("__batch"), *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, carried, strict=True)])
    answers = "part int, batch int, data binary"
    # One plan: the documents are dealt once, all three steps that read them share the exchange.
    batches = dealt.groupBy("__batch")
    known = batches.applyInArrow(_ask(parts), answers).groupBy("part").applyInArrow(_answer, answers)
    sent = batches.cogroup(known.groupBy("batch")).applyInArrow(_send(parts), answers)
    found = sent.groupBy("part").applyInArrow(_meet, "batch int, data binary")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in carried] + ["n_bytes long", "n_removed long", "n_spans long", f"kept {'string' if as_text else 'binary'}"])
    out = batches.cogroup(found.groupBy("batch")).applyInArrow(_cut(carried, as_text), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(columns, carried, strict=True)], "n_bytes", "n_removed", "n_spans", "kept")
