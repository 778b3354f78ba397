"""Operator 9: token-id files with bit-plane shuffling.

A shard image is one self-contained file: a header, the documents' ids and lengths, a chunk index and the chunks. A chunk
is a fixed-size block of ids, transposed into byte planes (or bit planes); planes of zeros are left out, each other plane
is compressed with zstandard on its own. The chunk index gives the length of every plane, so a range of ids is read without
the rest. Images are written as rows of a table in the shared folder, by Spark's own writer, so any store will do and a
lost task leaves nothing behind; save_files() puts them into a mounted folder as single files.

Ids go out in ascending order of doc_id (null ids first, equal ids by text). Null texts count as empty: only the end id.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, pieces, written
from .word_ids import TEXT_BYTES, word_ids

MAGIC = b"DGPLANE1"
BLOCK_IDS = 1 << 15
SHARD_IDS = 1 << 22
_HEAD = struct.Struct("<8sBIQQQ")  # magic, bit planes or not, block size, documents, ids, first id's position in the partition


def _planes(block: np.ndarray, bits: bool) -> list[np.ndarray]:
    raw = np.ascontiguousarray(block, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, p]) for p in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, p], bitorder="little") for p in range(32)]


def _block(planes: list[np.ndarray | None], n: int, bits: bool) -> np.ndarray:
    if not bits:
        out = np.zeros((n, 4), np.uint8)
        for p, plane in enumerate(planes):
            if plane is not None:
                out[:, p] = plane
        return out.reshape(-1).view("<u4")
    each = np.zeros((n, 32), np.uint8)
    for p, plane in enumerate(planes):
        if plane is not None:
            each[:, p] = np.unpackbits(plane, count=n, bitorder="little")
    return np.packbits(each, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack_image(doc_ids: list[int | None], ids: list[np.ndarray], first: int = 0, bits: bool = False, block: int = BLOCK_IDS, level: int = 3) -> bytes:
    press = zstandard.ZstdCompressor(level=level)
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    known = np.array([k is not None for k in doc_ids], np.uint8)
    keys = np.array([k or 0 for k in doc_ids], "<i8")
    table = press.compress(b"".join([known.tobytes(), keys.tobytes(), np.array([len(x) for x in ids], "<u8").tobytes()]))
    index, chunks = [], []
    for at in range(0, len(flat), block):
        for plane in _planes(flat[at : at + block], bits):
            chunk = press.compress(plane.tobytes()) if plane.any() else b""
            index.append(len(chunk)), chunks.append(chunk)
    places = press.compress(np.array(index, "<u4").tobytes())
    return b"".join([_HEAD.pack(MAGIC, bits, block, len(doc_ids), len(flat), first), struct.pack("<QQ", len(table), len(places)), table, places, *chunks])


class Image:
    """A shard image as read back: documents, lengths, and ids by range."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.docs, self.ids, self.first = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard image")
        a, b = struct.unpack_from("<QQ", data, _HEAD.size)
        self.press, self.data = zstandard.ZstdDecompressor(), data
        at = _HEAD.size + 16
        table, n = self.press.decompress(data[at : at + a]), self.docs
        known, keys = np.frombuffer(table, np.uint8, n), np.frombuffer(table, "<i8", n, n)
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known, strict=True)]
        self.lengths = np.frombuffer(table, "<u8", n, 9 * n).astype(np.int64)
        self.index = np.frombuffer(self.press.decompress(data[at + a : at + a + b]), "<u4").astype(np.int64)
        self.places = at + a + b + np.cumsum(self.index) - self.index

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop); reads the chunks that hold them."""
        per, out = 32 if self.bits else 4, []
        for k in range(start // self.block, -(-stop // self.block)):
            n = min(self.block, self.ids - k * self.block)
            planes = [np.frombuffer(self.press.decompress(self.data[p : p + size]), np.uint8) if size else None for p, size in zip(self.places[k * per : (k + 1) * per].tolist(), self.index[k * per : (k + 1) * per].tolist(), strict=True)]
            out.append(_block(planes, n, bool(self.bits))[max(0, start - k * self.block) : stop - k * self.block])
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, bits: bool = False) -> DataFrame:
    """Encodes docs and writes the images in ascending doc_id order; returns the table of images (part, seq, n_ids, image)."""

    def run(batches):
        words, part, seq, first = word_ids(tokenizer), TaskContext.get().partitionId(), 0, 0
        end, keys, ids, held = np.array([end_id], "<u4"), [], [], 0

        def image():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([pack_image(keys, ids, first, bits)], pa.binary())], ["part", "seq", "n_ids", "image"])

        for batch in batches:
            for some in pieces(batch, batch.num_rows, TEXT_BYTES):
                keys += some.column(some.schema.get_field_index("doc_id")).to_pylist()
                for raw in words.of(some.column(some.schema.get_field_index("text"))):
                    ids.append(np.concatenate([np.frombuffer(raw, words.kind).astype("<u4"), end]))
                    held += len(ids[-1])
                if held >= SHARD_IDS:
                    yield image()
                    seq, first, keys, ids, held = seq + 1, first + held, [], [], 0
        if keys:
            yield image()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = ordered.repartitionByRange(parts_for(ordered), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "part int, seq int, n_ids long, image binary"), "token-files")


def save_files(images: DataFrame, folder: str) -> DataFrame:
    """Puts each image into a folder that is mounted on every executor; returns the paths and sizes."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{folder}/ids-{row['part']:06d}-{row['seq']:04d}.dgp"
                own = f"{path}.{TaskContext.get().taskAttemptId()}"
                with open(own, "wb") as f:
                    f.write(row["image"])
                os.replace(own, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(row["image"])], pa.int64())], ["path", "bytes"])

    return images.select("part", "seq", "image").mapInArrow(run, "path string, bytes long")


def read(images: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the images."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                image = Image(row["image"])
                ids = image.range(0, image.ids)
                ends = np.cumsum(image.lengths)
                starts = ends - image.lengths
                raw, n = memoryview(ids.tobytes()), image.docs
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array(image.doc_ids, pa.int64()), pa.array(starts + image.first), pa.array(image.lengths), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = images.select("part", "image").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    totals = images.groupBy("part").agg(F.sum("n_ids").alias("held"))  # a row for each partition written
    bases = totals.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
