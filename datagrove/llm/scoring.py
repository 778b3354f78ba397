"""Operator 2: language-model scoring with a causal self-attention model on subword ids.

One pass cuts the texts into words (A-Z lower-cased, split at ASCII white space) and writes each chunk of documents as its
distinct words, their subword ids and the words' places. From these tables come, over all training documents: how often each
word occurs (dealt by hash, each chunk asking for its own words, so a frequent word is one entry a chunk), how often each
subword id occurs, and how often the frequent ids follow each other.

The model: P(id | before) = P(class | before) * P(id | class, last id). Classes part the vocabulary by the company that ids
keep. P(class | before) is the softmax of a causal self-attention layer over the ids before: every id has its own embedding,
places see each other through learned biases by distance, and nothing but the layer's output reaches the classes. Embeddings
start from a decomposition of the class counts; then every window of every training document trains the layer once. Each task
over the table of chunks is a trainer that runs Adam on its own, chunk by chunk; after each of ROUNDS rounds, which share the
windows out between them, the trainers' weights are averaged (embeddings by how often an id was met).
P(id | class, last id) comes from the counts over all training documents, discounted in favour of the class's own shares, so
all probabilities of a step add up to one.
Texts are scored in overlapping windows of WINDOW ids that move on by STRIDE: each id is scored once, in the last STRIDE places
of a window, with at least WINDOW - STRIDE ids before it where the text has them, by batched masked attention.
Single-precision sums of the layer run in onnxruntime where it is installed (fused.py), in numpy else and in double precision.
Queries and keys meet in one matrix there, M = Q K' / sqrt(WIDTH), values and classes in another, V U.

Null and empty texts have only the end token. Rows with a null id belong to the fold of the empty id text. Tables without
training documents give base scores of counts of zero.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fused
from .common import cat_ranges, parts_for, small_batches, written
from .word_ids import forget, word_ids

TOP = 2048  # ids with a row and a column of their own
CLASSES, WIDTH, WINDOW, STRIDE = 64, 32, 32, 24
ROUNDS, BATCH = 2, 32
TRAIN_EVERY = 1  # windows for each one that trains: all do
ID_BLOCK = 1024  # embeddings averaged in one group
CHUNK_BYTES = 6 << 20
CHUNKS_AT_ONCE = 4  # in one Arrow batch
AT_ONCE = 96  # windows scored together
LONG_WORD = 64  # bytes of a word hashed together with others
ROWS_TOGETHER = 16  # of the table of what follows, in one message
STEEPEST = 40  # an attention score's size at most, before the bias of its distance
MOST = 60  # a class's logit at most
DISCOUNT = 0.75
#: The places of a window that see each other, and how far back each one sees.
_SEEN = np.flatnonzero(np.tri(WINDOW, dtype=bool))
_BACK = _SEEN // WINDOW - _SEEN % WINDOW
_DISTANCE = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
_LN10 = float(np.log(10))
_NONE = 0xFFFFFFFF


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.int64(len(a)).tobytes() + a.tobytes() for a in arrays))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        n, d = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(kind)
        out.append(np.frombuffer(raw, d, n, at + 8))
        at += 8 + n * d.itemsize
    return out


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of 64 bits of each word (strings): eight bytes of all words at a time, and those of over LONG_WORD bytes one by one."""
    if not len(words):
        return np.zeros(0, "<u8")
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    first, size = ends[:-1], np.diff(ends)
    raw = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))  # the eight bytes from each one on
    inside = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")
    out = size.astype("<u8") * np.uint64(0x9E3779B97F4A7C15)
    some = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        some = some[size[some] > at]
        h = out[some] ^ (eight[first[some] + at] & inside[np.minimum(size[some] - at, 8)])
        for factor, shift in ((0xBF58476D1CE4E5B9, 32), (0x94D049BB133111EB, 29), (0xD6E8FEB86659FD93, 32)):
            h *= np.uint64(factor)
            h ^= h >> np.uint64(shift)
        out[some] = h
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(raw[first[k] : first[k] + size[k]])
    return out


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


# --- chunks -------------------------------------------------------------------------------------------------------


class Chunk:
    """Documents as places of words: doc_ids, words a document, place of each word, ids of each distinct word, its hash."""

    def __init__(self, known, doc_ids, n_words, places, n_ids, ids, hashes):
        self.known, self.doc_ids, self.n_words, self.places, self.n_ids, self.ids, self.hashes = known, doc_ids, n_words, places, n_ids, ids, hashes
        self.training = np.array([not held_out(int(k) if ok else None) for k, ok in zip(doc_ids, known, strict=True)], bool)

    KINDS = ("u1", "<i8", "<i8", "<u4", "<u4", "<u4", "<u8")

    @classmethod
    def read(cls, data: bytes) -> Chunk:
        return cls(*_unpack(data, *cls.KINDS))

    def written(self) -> bytes:
        return _pack(*(np.asarray(a, k) for a, k in zip((self.known, self.doc_ids, self.n_words, self.places, self.n_ids, self.ids, self.hashes), self.KINDS, strict=True)))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.places[np.repeat(self.training, self.n_words)], minlength=len(self.hashes))

    def id_counts(self, end: int) -> np.ndarray:
        counts = np.bincount(self.ids, np.repeat(self.word_counts(), self.n_ids), end + 1).astype("<i8")
        counts[end] += self.training.sum()
        return counts

    def windows(self, end: int) -> np.ndarray:
        """Training windows (WINDOW + 1 ids, _NONE behind the text's end): all of the training documents."""
        wanted, out = np.flatnonzero(self.training), [np.zeros((0, WINDOW + 1), "<u4")]
        for at in range(0, len(wanted), 256):
            some = wanted[at : at + 256]
            flat, n = self.sequences(end, some)
            count = -(-(n - 1) // WINDOW)
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            first = np.repeat(np.cumsum(n) - n, count) + place * WINDOW
            left = np.repeat(n, count) - place * WINDOW
            inside = np.arange(WINDOW + 1)
            made = flat.astype("<u4").take(first[:, None] + inside, mode="clip")
            last = np.flatnonzero(left <= WINDOW)
            made[last] = np.where(inside < left[last, None], made[last], _NONE)
            out.append(made)
        return np.concatenate(out)

    def pairs(self, place: np.ndarray, end: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What follows each other in training documents, as place of one times side plus place of the next: the pairs inside
        distinct words and how often these occur; the pairs across words and the documents' ends."""
        per = self.n_ids.astype(np.int64)
        stop, p = np.cumsum(per), place[self.ids]
        inner = np.ones(max(0, len(p) - 1), bool)
        inner[stop[(stop > 0) & (stop < len(p))] - 1] = False
        inside, times = (p[:-1] * side + p[1:])[inner], np.repeat(self.word_counts(), per)[:-1][inner]
        words, n = self.places[np.repeat(self.training, self.n_words)], self.n_words[self.training]
        if not per.all():  # words of no ids
            held = per[words] > 0
            n = np.diff(np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], np.cumsum(n)])])
            words = words[held]
        firsts, lasts = (np.full(len(words) + 2 * len(n), place[end], np.int64) for _ in range(2))
        at = cat_ranges(np.cumsum(n + 2) - n - 1, n)
        if len(words):
            firsts[at], lasts[at] = p[np.minimum(stop - per, len(p) - 1)][words], p[stop - 1][words]
        across = lasts[:-1] * side + firsts[1:]
        keep = np.ones(len(across), bool)
        keep[(np.cumsum(n + 2) - 1)[:-1]] = False
        return inside, times, across[keep]

    def sequences(self, end: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """end, the ids, end for each document wanted (by place), one after another; and their lengths."""
        starts = np.cumsum(self.n_words) - self.n_words
        words = self.places[cat_ranges(starts[wanted], self.n_words[wanted])]
        per = self.n_ids.astype(np.int64)
        first = np.cumsum(per) - per
        ids = self.ids[cat_ranges(first[words], per[words])].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(self.n_words[wanted])])
        sums = np.concatenate([[0], np.cumsum(per[words])])
        n = sums[bounds[1:]] - sums[bounds[:-1]]
        out = np.full(int(n.sum()) + 2 * len(n), end, np.int64)
        out[cat_ranges(np.cumsum(n + 2) - n - 1, n)] = ids
        return out, n + 2


def chunks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The table of chunks: chunk (a number), data (the chunk), windows (its training windows, null where it has none) and counts
    (the ids of its training documents, and how often each occurs)."""

    def run(batches):
        words_of, part, seq, waiting, size = word_ids(tokenizer), TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, waiting, size
            keys, texts = (pa.concat_arrays([b.column(b.schema.get_field_index(c)) for b in waiting]) for c in ("doc_id", "text"))
            number, seq, waiting, size = part << 24 | seq, seq + 1, [], 0
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
            words = split.flatten()
            full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # a text that begins or ends with space has empty ones there
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)])
            n = np.diff(np.concatenate([[0], np.cumsum(full)])[ends])
            words = words.filter(pa.array(full)).dictionary_encode()
            distinct = words.dictionary.cast(pa.string())
            encoded = words_of.encode(distinct)
            n_ids = pc.binary_length(encoded).to_numpy(zero_copy_only=False) // words_of.width
            ids = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(encoded)], encoded), b"")[0].as_py(), words_of.kind)
            hashes = _hashes(distinct)
            known = pc.is_valid(keys).to_numpy(zero_copy_only=False).astype(np.uint8)
            made = Chunk(known, pc.fill_null(keys, 0).to_numpy(), n, words.indices.to_numpy().astype("<u4"), n_ids, ids, hashes)
            windows = made.windows(end_id)
            packed = _pack(windows.reshape(-1)) if len(windows) else None
            times = made.id_counts(end_id)
            some = np.flatnonzero(times)
            binary = [pa.array([x], pa.binary()) for x in (made.written(), packed, _pack(some.astype("<i8"), times[some]))]
            return pa.RecordBatch.from_arrays([pa.array([number]), *binary], ["chunk", "data", "windows", "counts"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = int(np.searchsorted(ends, before + CHUNK_BYTES - size)) + 1  # the text that reaches the size ends its chunk
                waiting.append(batch.slice(at, stop - at))
                if stop <= batch.num_rows:
                    yield flush()
                else:
                    size += int(ends[-1]) - before
                at = stop
        if waiting:
            yield flush()

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(plain.mapInArrow(run, "chunk long, data binary, windows binary, counts binary"), "chunks", packed=True)


# --- counts over all training documents ---------------------------------------------------------------------------


def word_counts(table: DataFrame, parts: int) -> DataFrame:
    """chunk, data (each distinct word's count in training, in the chunk's order of hashes of this part), tokens and words new to this part."""

    def ask(batches):
        forget()
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.read(row["data"])
                part, counts = (chunk.hashes % np.uint64(parts)).astype(np.int64), chunk.word_counts()
                order = np.argsort(part, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array([int(part[some[0]])], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([_pack(chunk.hashes[some], counts[some].astype("<u4"))], pa.binary())], ["part", "chunk", "data"])

    def answer(asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return asked.select(["part", "chunk", "data"]).append_column("n", pa.array([], pa.int64())).append_column("v", pa.array([], pa.int64()))
        given = [_unpack(d, "<u8", "<u4") for d in asked.column("data").to_pylist()]
        hashes, place = np.unique(np.concatenate([h for h, _ in given]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([c for _, c in given]).astype(float), len(hashes)).astype(np.int64)
        ends = np.cumsum([len(h) for h, _ in given])
        replies = [_pack(counts[place[e - len(h) : e]]) for e, (h, _) in zip(ends, given, strict=True)]
        n, v = np.zeros(len(given), np.int64), np.zeros(len(given), np.int64)
        n[0], v[0] = counts.sum(), (counts > 0).sum()
        return pa.table({"part": asked.column("part"), "chunk": asked.column("chunk"), "data": pa.array(replies, pa.binary()), "n": n, "v": v})

    asked = table.select("chunk", "data").mapInArrow(ask, "part int, chunk long, data binary")
    return written(asked.groupBy("part").applyInArrow(answer, "part int, chunk long, data binary, n long, v long"), "word-counts", packed=True)


def id_counts(table: DataFrame, end: int) -> np.ndarray:
    """How often each id occurs in training documents, their end included; as many rows as ids."""

    def run(batches):
        total = np.zeros(end + 1, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                some, n = _unpack(data, "<i8", "<i8")
                total = np.concatenate([total, np.zeros(max(0, int(some.max(initial=0)) + 1 - len(total)), np.int64)])
                total[some] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["id", "n"])

    found = table.select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = found.column("id").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(max(end + 1, int(ids.max(initial=0)) + 1), np.int64)
    out[ids] = n
    return out


def following_counts(table: DataFrame, place: np.ndarray, end: int) -> np.ndarray:
    """How often place b follows place a in training documents; (TOP + 1) squared at most."""
    side = TOP + 1

    def run(batches):
        forget()
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.read(row["data"])
                inside, times, across = chunk.pairs(place, end, side)
                counts = np.bincount(across, minlength=side * side)
                counts += np.bincount(inside, times, side * side).astype(np.int64)
                if total is None:
                    total = counts
                else:
                    total += counts
        if total is not None:
            for at in range(0, side * side, ROWS_TOGETHER * side):
                rows = total[at : at + ROWS_TOGETHER * side]
                some = np.flatnonzero(rows)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_pack(some.astype("<u2"), rows[some])], pa.binary())], ["at", "data"])

    def merged(rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows
        total = np.zeros(ROWS_TOGETHER * side, np.int64)
        for data in rows.column("data").to_pylist():
            some, n = _unpack(data, "<u2", "<i8")
            total[some] += n
        some = np.flatnonzero(total)
        return pa.table({"at": rows.column("at")[:1].cast(pa.int32()), "data": pa.array([_pack(some.astype("<u2"), total[some])], pa.binary())})

    out = np.zeros(side * side, np.int64)
    found = table.select("data").mapInArrow(run, "at int, data binary").groupBy("at").applyInArrow(merged, "at int, data binary")
    for row in found.toLocalIterator():
        some, n = _unpack(row.data, "<u2", "<i8")
        out[row.at + some.astype(np.int64)] = n
    return out.reshape(side, side)


# --- the model ----------------------------------------------------------------------------------------------------


def _grouped(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of x, and which of them each place has; ids are below size."""
    flat, met, rank = x.reshape(-1), np.zeros(size, bool), np.empty(size, np.int64)
    met[flat] = True
    ids = np.flatnonzero(met)
    rank[ids] = np.arange(len(ids))
    return ids, rank.take(flat)


def _at_most(x: np.ndarray, high: float, low: float | None = None) -> np.ndarray:
    """x, cut in place to what is between low and high, if anything isn't."""
    if x.size and (x.max() > high or low is not None and x.min() < low):
        np.clip(x, low, high, out=x)
    return x


def _turned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.transpose(0, 2, 1))


class Layer:
    """The causal self-attention layer: E embeds ids, R is the bias of a distance, U and b lead to the classes."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self.tables = weights, None

    def projected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a trained layer: what each id asks of the embeddings it sees, made once; the embeddings; what leads from a mix of them to the classes."""
        if self.tables is None:
            w = self.weights
            self.tables = w["E"] @ ((w["Q"] @ w["K"].T) * np.float32(WIDTH**-0.5)), w["E"], w["V"] @ w["U"]
        return self.tables

    def mask(self) -> np.ndarray:
        return np.where(_DISTANCE >= 0, self.weights["R"].take(_DISTANCE, mode="clip"), np.float32(-1e9)).astype("<f4", copy=False)

    def gradients(self, x: np.ndarray, y: np.ndarray, m: np.ndarray, of_ids: tuple | None = None, own: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean loss over the places m; x: ids, y: the classes that follow. E has a row for each distinct id of x; of_ids:
        _grouped(x), own: the distinct ids' embeddings, where they are known."""
        w, (rows, places) = self.weights, x.shape
        kind, n = w["E"].dtype, x.size
        ids, at = of_ids or _grouped(x, len(w["E"]))
        own = w["E"].take(ids, 0) if own is None else own
        scale = kind.type(WIDTH**-0.5)
        meet, lead = (w["Q"] @ w["K"].T) * scale, w["V"] @ w["U"]  # queries and keys, values and classes
        part = m.reshape(-1, 1).astype(kind) / kind.type(max(1, np.count_nonzero(m)))
        run = fused.gradients(places, WIDTH, STEEPEST, MOST) if kind == np.float32 else None
        if run:
            d_meet, d_lead, d_b, by_place, d_own = run(own=own, at=at.reshape(rows, places), m=meet, w=lead, b=w["b"], bias=self.mask(), y=y.reshape(-1, 1), part=part)
        else:
            h, t = (z.take(at, 0).reshape(rows, places, WIDTH) for z in (own, own @ meet))
            turned = np.ascontiguousarray(h.transpose(0, 2, 1))
            s = _at_most(t @ turned, STEEPEST, -STEEPEST)
            s += self.mask()
            np.exp(s, out=s)
            s *= (1 / (s @ np.ones(places, kind)))[..., None]
            mixed = (s @ h).reshape(-1, WIDTH)
            g = mixed @ lead
            g += w["b"]
            np.exp(_at_most(g, MOST), out=g)
            g *= part / (g @ np.ones(g.shape[1], kind))[:, None]
            g.reshape(-1)[np.arange(n) * g.shape[1] + y.reshape(-1)] -= part[:, 0]
            d_lead, d_b = mixed.T @ g, np.ones(n, kind) @ g
            back = g @ lead.T
            mean = np.einsum("ab,ab->a", back, mixed)
            back = back.reshape(rows, places, WIDTH)
            ds = back @ turned
            ds -= mean.reshape(rows, places, 1)
            ds *= s
            by_place = (np.ones(rows, kind) @ ds.reshape(rows, -1)).reshape(places, places)
            dt = (ds @ h).reshape(-1, WIDTH)
            d_meet = h.reshape(-1, WIDTH).T @ dt
            dh = ds.transpose(0, 2, 1) @ t
            dh += s.transpose(0, 2, 1) @ back
            dh, cells = dh.reshape(-1, WIDTH) + dt @ meet.T, (at * WIDTH)[:, None] + np.arange(WIDTH)
            d_own = np.bincount(cells.reshape(-1), dh.reshape(-1), own.size).reshape(own.shape).astype(kind)
        d_meet = d_meet * scale
        grads = {"Q": d_meet @ w["K"], "K": d_meet.T @ w["Q"], "V": d_lead @ w["U"].T, "U": w["V"].T @ d_lead, "b": d_b, "E": d_own}
        return grads | {"R": np.bincount(_BACK, by_place.reshape(-1)[_SEEN], WINDOW).astype(kind)}

    def train(self, windows: np.ndarray, class_of: np.ndarray, rate: float = 0.01, seed: int = 3) -> None:
        """One pass of Adam over windows (WINDOW + 1 ids, _NONE behind the end)."""
        there = windows[:, 1:] != _NONE
        x = np.where(windows[:, :-1] != _NONE, windows[:, :-1], 0).astype(np.int64)
        y = class_of[np.where(there, windows[:, 1:], 0)]
        w, order, self.tables = self.weights, np.random.default_rng(seed).permutation(len(x)), None
        dense = [k for k in w if k != "E"]
        flat, at = np.concatenate([w[k].reshape(-1) for k in dense]), 0
        for k in dense:  # parts of one array, which moves at once
            w[k], at = flat[at : at + w[k].size].reshape(w[k].shape), at + w[k].size
        table, first, second = w["E"], np.zeros_like(w["E"]), np.zeros_like(w["E"])
        a, b = np.zeros_like(flat), np.zeros_like(flat)
        for step, at in enumerate(range(0, len(order), BATCH), 1):
            some = order[at : at + BATCH]
            now = rate * (1 - at / len(order)) / (1 - 0.9**step)
            seen = x.take(some, 0)
            of_ids = _grouped(seen, len(table))
            ids = of_ids[0]  # of the embeddings only those met move
            own, c, d = (z.take(ids, 0) for z in (table, first, second))
            grads = self.gradients(seen, y.take(some, 0), there.take(some, 0), of_ids, own)
            _moved(flat, np.concatenate([grads[k].reshape(-1) for k in dense]), a, b, now, step)
            _moved(own, grads["E"], c, d, now, step)
            table[ids], first[ids], second[ids] = own, c, d


def _moved(w: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, rate: float, step: int) -> None:
    """A step of Adam in place; g is used up."""
    t = g - first
    t *= 0.1
    first += t
    g *= g
    g -= second
    g *= 0.01
    second += g
    np.multiply(second, 1 / (1 - 0.99**step), out=g)
    np.sqrt(g, out=g)
    g += 1e-8
    np.divide(first, g, out=t)
    t *= rate
    w -= t


def of_round(windows: np.ndarray, number: int) -> np.ndarray:
    """The windows of a chunk that a round trains on: each is in one round."""
    return windows[number::ROUNDS]


def averaged(windows: DataFrame, layer: Layer, class_of: np.ndarray, number: int) -> Layer:
    """A round: each task is a trainer that goes once through this round's windows of its chunks; the average of their weights."""
    dense, size = sorted(k for k in layer.weights if k != "E"), len(layer.weights["E"])

    def run(batches):
        forget()
        own, trained, met = Layer({k: v.copy() for k, v in layer.weights.items()}), 0, np.zeros(size)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                mine = of_round(_unpack(data, "<u4")[0].reshape(-1, WINDOW + 1), number)
                if len(mine):
                    own.train(mine, class_of)
                    trained += len(mine)
                    met += np.bincount(mine[:, :-1][mine[:, :-1] != _NONE], minlength=size)
        if not trained:
            return
        flat = np.concatenate([own.weights[k].reshape(-1) for k in dense])
        out = [(-1, _pack(np.array([-1], "<i8"), np.array([trained], "<f8"), flat * np.float32(trained)))]
        ids = np.flatnonzero(met)
        for some in np.split(ids, np.flatnonzero(np.diff(ids // ID_BLOCK)) + 1):
            if len(some):
                out.append((int(some[0] // ID_BLOCK), _pack(some.astype("<i8"), met[some], (own.weights["E"][some] * met[some, None]).astype("<f4").reshape(-1))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary()), strict=True)], ["block", "data"])

    def summed(rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows
        parts = [_unpack(d, "<i8", "<f8", "<f4") for d in sorted(rows.column("data").to_pylist())]
        ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts]))
        total = np.zeros((len(ids), len(parts[0][2]) // len(parts[0][0])))
        np.add.at(total, at, np.concatenate([p[2].reshape(len(p[0]), -1) for p in parts]))
        return pa.table({"block": rows.column("block")[:1], "data": pa.array([_pack(ids, n, (total / n[:, None]).astype("<f4").reshape(-1))], pa.binary())})

    made = windows.mapInArrow(run, "block int, data binary")  # no windows are shuffled
    out = {k: v.copy() for k, v in layer.weights.items()}
    for row in made.groupBy("block").applyInArrow(summed, "block int, data binary").collect():  # the size of the layer
        ids, _, values = _unpack(row.data, "<i8", "<f8", "<f4")
        if row.block >= 0:
            out["E"][ids] = values.reshape(len(ids), WIDTH)
            continue
        at = 0
        for k in dense:
            out[k] = values[at : at + out[k].size].reshape(out[k].shape).copy()
            at += out[k].size
    return Layer(out)


class Model:
    """The count tables and the layer; place maps an id to its row of the tables (TOP for the others)."""

    def __init__(self, counts: np.ndarray, place: np.ndarray, follows: np.ndarray, end: int, seed: int = 2):
        self.end, self.place = end, place
        rng = np.random.default_rng(seed)
        size = len(counts)
        company = np.concatenate([follows, follows.T], 1).astype(float)
        self.class_of = _classes(company, place, size, rng)
        share = (counts + 1.0) / np.bincount(self.class_of, counts + 1.0, CLASSES)[self.class_of]
        self.log_share = np.log(share).astype("<f4")  # P(id | class)
        top_class = np.full(TOP + 1, -1)
        known = np.flatnonzero(place < TOP)
        top_class[place[known]] = self.class_of[known]
        exact, kinds = np.zeros((TOP + 1, CLASSES)), np.zeros((TOP + 1, CLASSES))  # following ids of a class that have a column of their own
        for c in range(CLASSES):
            exact[:, c] = follows[:, top_class == c].sum(1)
            kinds[:, c] = (follows[:, top_class == c] > 0).sum(1)
        rest = (DISCOUNT * kinds + 1) / (exact + 1)  # what the class's own shares get, by last id and class
        in_class = np.zeros(TOP)
        in_class[place[known]] = share[known]
        some = top_class[:TOP] >= 0
        table = np.full((TOP + 1, TOP), -30.0)
        pick = np.flatnonzero(some)
        c = top_class[pick]
        table[:, pick] = np.log(np.maximum(follows[:, pick] - DISCOUNT, 0) / (exact[:, c] + 1) + rest[:, c] * in_class[pick])
        self.log_after = table.astype("<f4")  # P(id | class, last id) of the ids with a column
        self.log_rest = np.log(rest).astype("<f4")
        # Ids without a column follow like their class at large.
        by_class = exact + follows[:, TOP, None] * (np.bincount(self.class_of, counts * (place >= TOP), CLASSES) / max(1, (counts * (place >= TOP)).sum()))
        overall = np.bincount(self.class_of, counts + 1.0, CLASSES)
        overall /= overall.sum()
        bias = np.log(overall)
        left, strength, right = np.linalg.svd(self._class_logs(by_class, overall) - bias, full_matrices=False)
        rows = np.zeros((TOP + 1, WIDTH))
        d = min(WIDTH, CLASSES)
        rows[:, :d] = left[:, :d] * np.sqrt(strength[:d])
        out = np.zeros((WIDTH, CLASSES))
        out[:d] = np.sqrt(strength[:d])[:, None] * right[:d]
        scale = 0.3 / np.sqrt(WIDTH)
        distance = np.full(WINDOW, 0.0)
        distance[0] = 4.0  # at first a place sees itself most
        weights = {"E": rows[place] + rng.normal(0, 0.01, (size, WIDTH)), "R": distance, "Q": rng.normal(0, scale, (WIDTH, WIDTH)), "K": rng.normal(0, scale, (WIDTH, WIDTH)), "V": np.eye(WIDTH), "U": out, "b": bias}
        self.layer = Layer({k: v.astype("<f4") for k, v in weights.items()})

    @staticmethod
    def _class_logs(by_class: np.ndarray, overall: np.ndarray) -> np.ndarray:
        """log P(class | last id) of the counts, smoothed."""
        return np.log((by_class + 20 * overall) / (by_class.sum(1, keepdims=True) + 20))

    def log10(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each sequence (end, ids, end), the log10 probability of all but its first id."""
        w, lead = self.layer.weights, WINDOW - STRIDE
        run = fused.class_logs(WIDTH, lead, STEEPEST, MOST)
        asked, lead_in, out = self.layer.projected()
        mask = self.layer.mask()[lead:]
        biases = np.stack([mask, np.where(np.arange(WINDOW) < lead, np.float32(-1e9), mask)])  # a text's first window has nothing before its first id
        seen, ones = np.exp(biases), np.ones(out.shape[1], "<f4")
        starts, steps = np.cumsum(n) - n, n - 1
        place, of_class = self.place.take(ids), self.class_of.take(ids)
        inner = self.log_after.reshape(-1).take(place[:-1] * TOP + np.minimum(place[1:], TOP - 1))
        others = np.flatnonzero(place[1:] >= TOP)
        inner[others] = self.log_rest[place[others], of_class[others + 1]] + self.log_share[ids[others + 1]]
        inner[starts[1:] - 1] = 0  # from one sequence to the next
        scores = np.bincount(np.repeat(np.arange(len(n)), n)[1:], inner, len(n))
        count = -(-steps // STRIDE)  # windows; each scores the STRIDE ids after its last STRIDE places
        owner = np.repeat(np.arange(len(n)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        left = steps[owner] - number * STRIDE
        first, kind = starts[owner] + number * STRIDE - lead, (number == 0).astype(np.int64)
        for at in range(0, len(owner), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            here = first[some, None] + np.arange(WINDOW + 1)  # what is outside of the text is never seen, or not counted
            x, y = ids.take(here[:, :-1], mode="clip"), of_class.take(here[:, lead + 1 :], mode="clip").reshape(-1, 1)
            if run:
                log = run(x=x, e=lead_in, em=asked, w=out, b=w["b"], biases=biases, kind=kind[some], y=y)[0]
            else:
                h = lead_in.take(x, 0)
                s = _at_most(asked.take(x[:, lead:], 0) @ _turned(h), STEEPEST, -STEEPEST)
                np.exp(s, out=s)
                s *= seen.take(kind[some], 0)
                mixed = s @ h
                mixed *= (1 / (s @ np.ones(WINDOW, "<f4")))[..., None]
                logits = mixed.reshape(-1, WIDTH) @ out
                logits += w["b"]
                log = np.take_along_axis(_at_most(logits, MOST), y, 1)
                log = log - np.log(np.exp(logits, out=logits) @ ones)[:, None]
            counted = np.arange(STRIDE) < left[some, None]
            scores += np.bincount(owner[some], np.where(counted, log.reshape(-1, STRIDE), 0).sum(1, dtype=float), len(n))
        return scores / _LN10


def _classes(company: np.ndarray, place: np.ndarray, size: int, rng) -> np.ndarray:
    """A class for each id: clusters of the frequent ids by what precedes and follows them; the others by number."""
    weight = company.sum(1)
    x = np.sqrt(company / np.maximum(1, weight[:, None]))
    sketch = x @ rng.normal(size=(x.shape[1], 96)) / 10
    q, _ = np.linalg.qr(x.T @ sketch)
    x = x @ q
    some = np.flatnonzero(weight[:TOP] > 0)
    group = np.zeros(TOP + 1, np.int64)
    if len(some) > CLASSES:
        centres = x[some[np.argsort(-weight[some], kind="stable")[:CLASSES]]]
        for _ in range(12):
            near = np.argmax(x[some] @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
            for c in range(CLASSES):
                if (near == c).any():
                    centres[c] = np.average(x[some[near == c]], axis=0, weights=weight[some[near == c]])
        group[some] = near
    out = np.arange(size) % CLASSES
    known = np.flatnonzero(place < TOP)
    out[known] = group[place[known]]
    return out


def fit(table: DataFrame, end: int) -> Model:
    counts = id_counts(table, end)
    order = np.argsort(-counts, kind="stable")[:TOP]
    order = order[counts[order] > 0]
    place = np.full(len(counts), TOP, np.int64)
    place[order] = np.arange(len(order))
    model = Model(counts, place, following_counts(table, place, end), end)
    windows = table.where("windows is not null").select("windows")
    for number in range(ROUNDS):
        model.layer = averaged(windows, model.layer, model.class_of, number)
    return model


def score(docs: DataFrame, tokenizer: str, end_id: int = 49407) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    table = chunks(docs, tokenizer, end_id)
    parts = parts_for(docs, 16 << 20)
    with small_batches(docs.sparkSession, CHUNKS_AT_ONCE):
        counts = word_counts(table, parts)
        model = fit(table, end_id)
    words, distinct = counts.agg(F.sum("n"), F.sum("v")).first()
    folds = F.sum((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2).cast("long"))
    ends = docs.select("doc_id").agg(folds).first()[0] or 0
    tokens, vocabulary = (words or 0) + ends, (distinct or 0) + (ends > 0)

    def run(whole: pa.Table, replies: pa.Table) -> pa.Table:
        forget()
        out = [[] for _ in range(7)]
        given = dict(zip(replies.column("part").to_pylist(), replies.column("data").to_pylist(), strict=True))
        for data in whole.column("data").to_pylist():
            chunk = Chunk.read(data)
            part, c = (chunk.hashes % np.uint64(parts)).astype(np.int64), np.zeros(len(chunk.hashes), np.int64)
            order = np.argsort(part, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(some):
                    c[some] = _unpack(given[int(part[some[0]])], "<i8")[0]
            logs = np.log10((c + 1) / (tokens + vocabulary + 1))
            owner = np.repeat(np.arange(len(chunk.doc_ids)), chunk.n_words)
            docs_ = len(chunk.doc_ids)
            base = np.bincount(owner, logs[chunk.places], docs_) + np.log10((ends + 1) / (tokens + vocabulary + 1))
            known = np.bincount(owner, c[chunk.places] > 0, docs_).astype(np.int64) + (ends > 0)
            scores = np.concatenate([model.log10(*chunk.sequences(end_id, np.arange(at, min(docs_, at + 128)))) for at in range(0, docs_, 128)]) if docs_ else np.zeros(0)
            for column, values in zip(out, ([int(k) if ok else None for k, ok in zip(chunk.doc_ids, chunk.known, strict=True)], (~chunk.training).tolist(), (chunk.n_words + 1).tolist(), known.tolist(), [tokens] * docs_, base.tolist(), scores.tolist()), strict=True):
                column += values
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, out, kinds, strict=True)})

    whole = table.select("chunk", "data")
    return whole.groupBy("chunk").cogroup(counts.select("chunk", "part", "data").groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
