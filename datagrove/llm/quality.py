"""Operator 4: quality classifier on hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Words are runs of letters and digits, lower-cased; every other visible character is a word of its own, and a mark goes
before words in capitals. Features are hashed words and word pairs (pairs of one word with itself share a slot), as shares
of the text's features, so a score is a sparse dot product. Training reads a bounded sample of labelled rows (max_rows, least hash of the id first); scoring reads
whole texts. The label table is joined by id for training only; no id, label, language or source enters a score.

Of rows that share a labelled id, the least text is learned from. Null and empty texts get the score of the bias alone; a table without labels trains to a score of 0.5 for every text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTES_AT_ONCE, ROWS_AT_ONCE, crc_rest, pieces
from .word_ids import TEXT_BYTES, Met, in_a_row, lean

BITS = 18
SCALE = 40.0
MAX_ROWS = 8_000
_WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")


class WordHashes:
    """Hashes of the words of each space-separated piece; those of pieces met lately come from a bounded table."""

    def __init__(self):
        self.met = Met()

    @staticmethod
    def _of(piece: str) -> bytes:
        out = []
        for w in _WORDS.findall(piece):
            if len(w) > 1 and w.isupper():
                out.append("\x00caps")
            out.append(w.lower())
        return np.array([xxhash.xxh32_intdigest(w) for w in out], "<u4").tobytes()

    def of(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All hashes in a row, and how many each text has (null: none); texts: a list or an Arrow array."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        raw, bounds = in_a_row(texts, lambda words: self.met.of(words, lambda new: list(map(self._of, new))))
        return np.frombuffer(raw, "<u4", int(bounds[-1]) // 4), np.diff(bounds) // 4


def features(hashes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words, and of the pairs that begin at each word but the last."""
    shift = np.uint32(32 - bits)
    one = (hashes * np.uint32(2654435761)) >> shift
    two = ((hashes[:-1] * np.uint32(2246822519)) ^ (hashes[1:] * np.uint32(3266489917))) * np.uint32(668265263) >> shift
    two[hashes[:-1] == hashes[1:]] = 0
    return one, two


class FTRL:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last slot is the bias."""

    def __init__(self, slots: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0):
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, epochs: int = 4, bits: int = BITS) -> np.ndarray:
    """Weights, the bias last, from at most max_rows labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(crc_rest("of", 5) != 0)
    picked = known.orderBy(F.xxhash64("of"), "of", "y").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), F.col("doc_id") == F.col("of")).select("of", "y", "text")
    rows = rows.groupBy("of", "y").agg(F.min("text").alias("text"))  # one text for each label, so the bound holds

    def run(batches):
        words = WordHashes()
        for batch in batches:
            for part in pieces(batch, ROWS_AT_ONCE, BYTES_AT_ONCE):
                keys, ys, texts = (part.column(part.schema.get_field_index(c)) for c in ("of", "y", "text"))
                at, x, (hashes, n) = [], [], words.of(texts)
                for some in np.split(hashes, np.cumsum(n)[:-1]):
                    slots = np.concatenate(features(some, bits))
                    u, n = np.unique(slots, return_counts=True)
                    at.append(u.astype("<u4").tobytes())
                    x.append((n * (SCALE / max(1, len(slots)))).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([keys, ys, pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["of", "y", "at", "x"])

    sample = sorted(rows.mapInArrow(lean(run), "of long, y int, at binary, x binary").collect(), key=lambda r: (r.of, r.y, bytes(r.at), bytes(r.x)))  # max_rows at most
    model, order = FTRL(1 << bits), np.random.default_rng(4)
    for _ in range(epochs):
        for k in order.permutation(len(sample)):
            r = sample[k]
            model.learn(np.append(np.frombuffer(r.at, "<u4"), 1 << bits).astype(np.int64), np.append(np.frombuffer(r.x, "<f4"), 1.0).astype(float), r.y)
    return model.weights().astype("<f4")


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """docs with held_out, score and predicted; the columns named so before are replaced."""
    plain = docs.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    table = np.ascontiguousarray(weights[:-1]) * np.float32(SCALE)
    bias = float(weights[-1])

    def run(batches):
        words = WordHashes()
        for batch in batches:
            place = batch.schema.get_field_index("__text")
            keep = [k for k in range(batch.num_columns) if k != place]
            for whole in pieces(batch, batch.num_rows, TEXT_BYTES):
                every, each = words.of(whole.column(place))
                done = at = 0
                for part in pieces(whole, 128, 4 << 20):
                    n = each[done : done + part.num_rows]
                    ends = np.cumsum(n)
                    hashes = every[at : at + int(ends[-1])]
                    done, at = done + part.num_rows, at + int(ends[-1])
                    one, two = features(hashes, bits)
                    w = table[one].astype(np.float64)
                    if len(two):
                        pairs = table[two]
                        inner = ends[(ends > 0) & (ends < len(hashes))] - 1
                        pairs[inner] = 0
                        w[:-1] += pairs
                    sums = np.concatenate([[0.0], np.cumsum(w)])
                    total = sums[ends] - sums[ends - n]
                    scores = 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(1, 2 * n - 1), -35, 35)))
                    yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(scores)], [part.schema.field(k).name for k in keep] + ["score"])

    held = plain.drop("held_out", "predicted", "score")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in held.schema if f.name != "__text")
    scored = held.mapInArrow(lean(run), f"{fields}, score double")
    return scored.withColumn("held_out", crc_rest("doc_id", 5) == 0).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
