"""Operator 7: exact top-k search of binary codes by incremental multi-index hashing.

A code has 64 bits, cut into SEGMENTS segments. Codes that differ in d bits differ in at most d // SEGMENTS bits in one
segment, so after all segments were searched with radius r every code within SEGMENTS * (r + 1) - 1 bits is found. A
query's radius grows until the distance of its kth verified code is covered. Codes are dealt into blocks and queries into
chunks; a task searches one chunk in one block with tables of the block's segments, and the blocks' best k are merged.

Equal codes are one entry with their k + 1 least ids, so a code that many rows share stays small. Ties go to the lesser
id; a row is not its own neighbour. Rows with a null id or vector are left out; components that are null count as 0.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cat_ranges, written

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
BLOCK_CODES, CHUNK_QUERIES = 1 << 15, 128


def sign_code(vector: Column) -> Column:
    """Bit i is set where component i is positive; of longer vectors the first 64 components count."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"),
        lambda code, i: code.bitwiseOR(F.when(F.coalesce(F.get(vector, i) > 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
    )


class Block:
    """Segment tables over distinct codes; rows come in the order of code_of (place in codes) and ids."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes.astype(np.uint64)
        self.orders, self.starts = [], []
        for s in range(SEGMENTS):
            part = self.part(self.codes, s)
            self.orders.append(np.argsort(part, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << WIDTH))]))

    @staticmethod
    def part(codes, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, code: int, ids_of, k: int) -> list[tuple[int, int]]:
        """The k least (distance, id); ids_of gives the ids of a place among the codes."""
        code, found, distances = np.uint64(code), [], []
        parts = [int(self.part(code, s)) for s in range(SEGMENTS)]
        held = 0
        for radius in range(WIDTH + 1):
            masks = _masks(radius)
            for s in range(SEGMENTS):
                keys = masks ^ parts[s]
                starts = self.starts[s][keys]
                places = self.orders[s][cat_ranges(starts, self.starts[s][keys + 1] - starts)]
                if len(places):
                    differs = self.codes[places] ^ code
                    each = np.stack([np.bitwise_count(self.part(differs, t)) for t in range(SEGMENTS)])
                    new = (each[:s] > radius).all(0) & (each[s + 1 :] >= radius).all(0)  # not found before
                    found.append(places[new])
                    distances.append(each[:, new].sum(0))
                    held += int(new.sum())
            if held:
                d, p = np.concatenate(distances), np.concatenate(found)
                near = np.argsort(d, kind="stable")
                best, at = [], 0
                while at < len(near) and (len(best) < k or d[near[at]] <= best[k - 1][0]):
                    same = near[at : at + np.searchsorted(d[near[at:]], d[near[at]], side="right")]
                    best += sorted((int(d[near[at]]), i) for q in same for i in ids_of(p[q]))[:k]
                    at += len(same)
                if len(best) >= k and best[k - 1][0] <= SEGMENTS * (radius + 1) - 1 or held == len(self.codes):
                    return best[:k]
        return []


_known_masks: dict[int, np.ndarray] = {}


def _masks(radius: int) -> np.ndarray:
    if radius not in _known_masks:
        _known_masks[radius] = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], np.int64)
    return _known_masks[radius]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, distance and rank of the k rows (id, code) nearest to each of queries (id, code)."""
    known = rows.where("id is not null and code is not null").select("id", "code").distinct()
    least = Window.partitionBy("code").orderBy("id")
    entries = written(known.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = written(queries.where("id is not null and code is not null").select("id", "code").distinct(), "queries")
    own = asked.select("code").distinct()
    blocks, chunks = entries.count() // BLOCK_CODES + 1, own.count() // CHUNK_QUERIES + 1
    left = entries.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = own.withColumn("chunk", F.pmod(F.xxhash64("code", F.lit(7)), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(codes: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        if codes.num_rows:
            block, ids = Block(codes.column("code").to_numpy().astype(np.int64).view(np.uint64)), codes.column("ids").to_pylist()
            for code in wanted.column("code").to_pylist():
                out += [(code, i, d) for d, i in block.search(code & (1 << BITS) - 1, ids.__getitem__, k + 1)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"code": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "distance": pa.array(columns[2], pa.int32())})

    best = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, "code long, vec_id long, distance int")
    near = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    merged = Window.partitionBy("code").orderBy("distance", "vec_id")
    best = best.withColumn("r", F.row_number().over(merged)).where(F.col("r") <= k + 1).drop("r")
    pairs = asked.select(F.col("id").alias("query_id"), "code").join(best, "code").where("query_id <> vec_id")
    return pairs.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "vec_id", "distance", "rank")
