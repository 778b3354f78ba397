"""Set-similarity joins over units (item_id, unit), both strings; pairs are id1 < id2 as strings."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERMUTATIONS, BANDS, ROWS, PRIME = 128, 25, 5, (1 << 31) - 1


def coefficients(count: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """a and b of (a * h + b) mod PRIME; one rule for all engines."""
    rng = random.Random(128)
    return [(rng.randrange(1, PRIME), rng.randrange(0, PRIME)) for _ in range(count)]


def unit_hash(unit: Column) -> Column:
    """28 bits of md5, the same number in every engine."""
    return F.conv(F.substring(F.md5(unit.cast("binary")), 1, 7), 16, 10).cast("long")


def signatures(units: DataFrame, count: int = PERMUTATIONS) -> DataFrame:
    """item_id and sig, the minima of count permutations; one aggregation with partial minima."""
    hashed = units.select("item_id", unit_hash(F.col("unit")).alias("h")).distinct()
    minima = [F.min((F.lit(a) * F.col("h") + F.lit(b)) % F.lit(PRIME)).alias(f"m{k}") for k, (a, b) in enumerate(coefficients(count))]
    return hashed.groupBy("item_id").agg(*minima).select("item_id", F.array(*[f"m{k}" for k in range(count)]).alias("sig"))


def lsh_candidates(signed: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Pairs of items with one whole band in common."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("sig", b * rows + 1, rows)) for b in range(bands)])
    banded = signed.select("item_id", F.posexplode(keys).alias("band", "key"))
    left, right = banded.withColumnRenamed("item_id", "id1"), banded.withColumnRenamed("item_id", "id2")
    return left.join(right, ["band", "key"]).where("id1 < id2").select("id1", "id2").distinct()


def estimated(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs with j_sim, the share of equal minima."""
    one, two = signed.select(F.col("item_id").alias("id1"), F.col("sig").alias("sig1")), signed.select(F.col("item_id").alias("id2"), F.col("sig").alias("sig2"))
    equal = F.aggregate(F.zip_with("sig1", "sig2", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.join(one, "id1").join(two, "id2").select("id1", "id2", (equal / F.size("sig1")).alias("j_sim"))


def minhash_pairs(units: DataFrame, threshold: float = 0.5) -> DataFrame:
    signed = signatures(units)
    return estimated(lsh_candidates(signed), signed).where(F.col("j_sim") >= threshold)


#: Pairs of items with a common unit up to which the prefix join is taken without a closer look; rows of a block of sets; blocks are dealt
#: over so many partitions at most, and their pairs over the square.
FEW_PAIRS, BLOCK, BLOCK_PARTS = 10_000_000, 4096, 100


def exact_pairs(units: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs with an exact Jaccard similarity of at least threshold.

    Items with equal sets are one class, and only a member of each is compared. Classes are found by rare prefixes, unless their
    prefixes have more pairs in common than there are pairs of classes (a few units that are all frequent): then all are compared,
    in blocks that need no disk for candidates. Pairs of classes are spread over their members at the end.
    """
    hashed = units.where("item_id is not null and unit is not null").select("item_id", F.xxhash64("unit").alias("unit"))
    sets = hashed.groupBy("item_id").agg(F.sort_array(F.collect_set("unit")).alias("u"))
    classes = sets.groupBy("u").agg(F.min("item_id").alias("rep"), F.collect_list("item_id").alias("items"))
    reps = classes.select(F.col("rep").alias("item_id"), "u", F.size("u").alias("n"))
    count = _dense(reps, threshold)
    found = _prefix_pairs(reps, threshold) if count is None else _block_pairs(reps, threshold, count)
    members = classes.select("rep", F.explode("items").alias("item"))
    one, two = members.toDF("id1", "a"), members.toDF("id2", "b")
    across = found.join(one, "id1").join(two, "id2").select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "j_sim")
    return across.unionAll(_within(classes))


def _within(classes: DataFrame) -> DataFrame:
    """The pairs inside of classes (rep, items)."""
    several = classes.where(F.size("items") > 1)
    one, two = (several.select("rep", F.explode("items").alias(name)) for name in ("id1", "id2"))
    return one.join(two, "rep").where("id1 < id2").select("id1", "id2", F.lit(1.0).alias("j_sim"))


def _prefix_length(threshold: float) -> Column:
    return F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1


def _prefixes(reps: DataFrame, threshold: float) -> DataFrame:
    """item_id, unit and n of the rarest units of each set (item_id, u, n): two similar sets share one of these at least."""
    own = reps.select("item_id", "n", F.explode("u").alias("unit"))
    rare = own.groupBy("unit").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = Window.partitionBy("item_id").orderBy("df", "unit")
    ranked = own.join(rare, "unit").withColumn("r", F.row_number().over(by_rarity))
    return ranked.where(F.col("r") <= _prefix_length(threshold)).select("item_id", "unit", "n")


def _dense(reps: DataFrame, threshold: float) -> int | None:
    """How many sets there are, if comparing them all is less than joining their prefixes; else None."""

    def shared(rows):
        sizes = rows.groupBy("unit").agg(F.count(F.lit(1)).cast("double").alias("n"))
        return sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()[0]

    if shared(reps.select(F.explode("u").alias("unit"))) <= FEW_PAIRS:
        return None
    count = reps.count()
    return count if shared(_prefixes(reps, threshold)) > float(count) ** 2 else None


def _prefix_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """Prefixes are joined, so frequent units hardly ever are; candidates of a fitting size are verified on the units themselves."""
    prefix = _prefixes(reps, threshold)
    one, two = prefix.toDF("id1", "unit", "n1"), prefix.toDF("id2", "unit", "n2")
    fits = (F.col("id1") < F.col("id2")) & (F.least("n1", "n2") >= threshold * F.greatest("n1", "n2") - 1e-9)
    found = one.join(two, "unit").where(fits).select("id1", "id2", "n1", "n2").distinct()
    sets = reps.select("item_id", "u")
    full = found.join(sets.toDF("id1", "u1"), "id1").join(sets.toDF("id2", "u2"), "id2")
    both = F.size(F.array_intersect("u1", "u2"))
    return full.select("id1", "id2", (both / (F.col("n1") + F.col("n2") - both)).alias("j_sim")).where(F.col("j_sim") >= threshold)


def _block_pairs(reps: DataFrame, threshold: float, count: int) -> DataFrame:
    """All pairs of blocks of sets; what two blocks have in common is counted by products of 0/1 matrices. Blocks are dealt once and
    read again for each pair, candidates never leave memory."""
    blocks = -(-count // BLOCK)
    rows = F.struct("item_id", F.array_sort("u").alias("u"))
    whole = reps.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list(rows).alias("sets"))
    packed = whole.select("block", F.col("sets.item_id").alias("ids"), F.transform("sets.u", F.size).alias("n"), F.flatten("sets.u").alias("units"))
    packed = packed.repartition(min(blocks, BLOCK_PARTS), "block")
    one, two = (packed.select(*[F.col(c).alias(f"{c}{k}") for c in packed.columns]) for k in (1, 2))
    both = one.join(two, F.col("block1") <= F.col("block2"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _compared(batch.slice(row, 1), threshold)

    return both.mapInArrow(run, "id1 string, id2 string, j_sim double")


def _compared(row: pa.RecordBatch, threshold: float):
    """id1, id2 and j_sim of the pairs of two blocks' sets that are alike enough."""
    value = lambda name: row.column(name).flatten()
    same = row.column("block1")[0] == row.column("block2")[0]
    ids, sizes, places = [], [], []
    for k in "12":
        ids.append(value(f"ids{k}"))
        sizes.append(value(f"n{k}").to_numpy())
        places.append(value(f"units{k}").to_numpy())
    common = np.intersect1d(np.unique(places[0]), np.unique(places[1]), assume_unique=True)
    counts = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)  # exact up to 2 ** 24 units of a set
    owners = [np.repeat(np.arange(len(n)), n) for n in sizes]
    for begin in range(0, len(common), 1024):
        part = common[begin : begin + 1024]
        sides = []
        for own, units in zip(owners, places, strict=True):
            at = np.searchsorted(part, units)
            hit = np.flatnonzero(part[np.minimum(at, len(part) - 1)] == units)
            side = np.zeros((counts.shape[len(sides)], len(part)), np.float32)
            side[own[hit], at[hit]] = 1
            sides.append(side)
        counts += sides[0] @ sides[1].T
    for begin in range(0, len(counts), 512):
        met = counts[begin : begin + 512].astype(np.float64)
        j = met / (sizes[0][begin : begin + 512, None] + sizes[1][None, :] - met)
        a, b = np.nonzero(j >= threshold)
        j, a = j[a, b], a + begin
        if same:
            j, a, b = j[a < b], a[a < b], b[a < b]
        yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(a)), ids[1].take(pa.array(b)), pa.array(j)], ["id1", "id2", "j_sim"])


def threshold_counts(pairs: DataFrame, low: int = 45, high: int = 95) -> DataFrame:
    """n pairs with j_sim over each threshold (in hundredths), in one aggregation."""
    sums = pairs.agg(*[F.sum((F.col("j_sim") > t / 100).cast("long")).alias(str(t)) for t in range(low, high + 1)])
    grid = sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("percent"), F.coalesce(F.col(str(t)), F.lit(0)).cast("long").alias("n")) for t in range(low, high + 1)])).alias("g"))
    return grid.select((F.col("g.percent") / 100).alias("threshold"), F.col("g.n").alias("n"))


def steepest(counts: DataFrame) -> DataFrame:
    """The threshold at which n falls fastest: central differences, one-sided at the ends; the first of equals."""
    w = Window.orderBy("threshold")  # a row for each threshold of the grid
    before, after = F.lag("n").over(w), F.lead("n").over(w)
    slope = F.when(before.isNull(), (after - F.col("n")) / 0.01).when(after.isNull(), (F.col("n") - before) / 0.01).otherwise((after - before) / 0.02)
    return counts.withColumn("slope", F.round(slope, 6)).orderBy("slope", "threshold").limit(1).select("threshold", "slope")
