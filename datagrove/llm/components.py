"""Connected components of an edge table: forests within tasks, then least-label hooking and pointer jumping.

First, tasks of EDGES_AT_ONCE edges each replace their edges by stars to the least node they reach (union-find). If there was
more than one task, rounds follow. Every round moves each node to the least label among its neighbours and then to its label's label; rounds end when no label
moves. The tables of a round are written to the shared folder, so that lost executors cost one round at most. Hot nodes are
only ever a group-by key with partial aggregation or the many side of a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


EDGES_AT_ONCE = 200_000


def forest(left, right) -> dict[int, int]:
    """Union-find: node -> the least node it is joined with."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(left, right, strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def _stars(batches):
    """A task's edges as edges to the least node that they reach within the task."""
    held = [(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches]
    star = forest(*([x for part in c for x in part] for c in zip(*held, strict=True))) if held else {}
    pairs = [(a, r) for a, r in star.items() if a != r]
    for at in range(0, len(pairs), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*pairs[at : at + 10_000], strict=True)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least reachable node) for each node of edges (a, b), both non-null longs."""
    plain = edges.select("a", "b")
    tasks = plain.count() // EDGES_AT_ONCE + 1
    stars = written(plain.repartition(tasks).mapInArrow(_stars, "a long, b long"), "stars")
    if tasks == 1:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    both = written(stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("of")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("of")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("up"))
        moved = written(hooked.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", "up").alias("component")), "labels")
        changed = moved.where("component < old").limit(1).count()
        discard(labels)
        labels = moved.drop("old")
        if not changed:
            discard(both)
            return labels
