"""Operator 5: mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. A window takes from every queue in proportion to its weight (by default the queue's
tokens, so that all queues end together); what a queue is owed but not yet given, its deficit, is carried to the next
window. The next token always comes from the queue that is owed most: token k of a queue with weight w is due when
(k + 1/2) / w of the round has passed. How much each queue has given after x tokens has a closed form, so a task
starts at any window with the exact deficits, and windows run across partitions without a gap. Where weights are given, a
queue that runs out leaves the round, and the others share the windows in the proportions of their weights.

The largest max_queues sources have a queue of their own, further ones are dealt over as many shared queues by hash.
With weights, every source named has a queue of its own too.
Null sources form a source. Null texts count as empty: only the end id. Repeated rows, null ids and ties are documents of their
own, in the order of the table's parts; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTES_AT_ONCE, ROWS_AT_ONCE, give_back, pieces, written
from .word_ids import TEXT_BYTES, lean, word_ids

WINDOW = 4096
MAX_QUEUES = 1024
#: Rows of the table of queue offsets up to which it is broadcast (40 bytes each).
BROADCAST_ROWS = 50_000
#: Numbers (of 8 bytes, two for each window and queue) that a task keeps of the windows it passed.
KEPT_NUMBERS = 1 << 21
#: Weights are shares of one in this many parts.
WEIGHT_PARTS = 1 << 40


def _turn(half_tokens: int, weight: int) -> int:
    """half_tokens / weight as an integer in the same order: exact for weights below 2**48."""
    return (half_tokens << 96) // weight


class Schedule:
    """What each queue has given after x tokens of all."""

    def __init__(self, tokens: list[int], weights: list[int] | None = None):
        self.tokens, self.total = tokens, sum(tokens)
        self.phases = []  # start, weights, tokens given before
        given, x, wanted = [0] * len(tokens), 0, list(weights or tokens)
        while x < self.total:
            active = [w if g < t else 0 for w, g, t in zip(wanted, given, tokens, strict=True)]
            if not any(active):
                active = [t - g for g, t in zip(given, tokens, strict=True)]
            whole = sum(active)
            length, ends = min(((t - g) * whole // w, q) for q, (w, g, t) in enumerate(zip(active, given, tokens, strict=True)) if w)
            if not length:  # less than a token's turn is left in this queue
                active = [w if q == ends else 0 for q, w in enumerate(active)]
                length = tokens[ends] - given[ends]
            self.phases.append((x, active, given))
            x += length
            given = self.given(x)

    def given(self, x: int) -> list[int]:
        start, weights, before = next(p for p in reversed(self.phases) if p[0] < x or p is self.phases[0])
        x -= start
        whole = sum(weights)
        room = [t - b for t, b in zip(self.tokens, before, strict=True)]
        out = [min(r, (2 * x * w + whole) // (2 * whole)) for w, r in zip(weights, room, strict=True)]
        short = x - sum(out)
        if short > 0:
            due = [(_turn(2 * n + 1, w), q) for q, (n, w, r) in enumerate(zip(out, weights, room, strict=True)) if w and n < r]
            heapq.heapify(due)
            for _ in range(short):
                q = due[0][1]
                out[q] += 1
                if out[q] < room[q]:
                    heapq.heapreplace(due, (_turn(2 * out[q] + 1, weights[q]), q))
                else:
                    heapq.heappop(due)
        elif short < 0:
            last = [(-_turn(2 * n - 1, w), -q) for q, (n, w) in enumerate(zip(out, weights, strict=True)) if n]
            heapq.heapify(last)
            for _ in range(-short):
                q = -last[0][1]
                out[q] -= 1
                if out[q]:
                    heapq.heapreplace(last, (-_turn(2 * out[q] - 1, weights[q]), -q))
                else:
                    heapq.heappop(last)
        return [b + n for b, n in zip(before, out, strict=True)]


class Windows:
    """The windows of a schedule: what each queue has given before a window and where its tokens stand in it."""

    def __init__(self, schedule: Schedule, window: int):
        self.schedule, self.window, self.known, self.before = schedule, window, {}, {}
        self.kept = max(64, KEPT_NUMBERS // (2 * max(1, len(schedule.tokens))))

    def given(self, w: int) -> np.ndarray:
        if (found := self.known.get(w)) is None:
            if len(self.known) > self.kept:
                self.known.clear()
                self.before.clear()
            found = self.known[w] = np.array(self.schedule.given(min(w * self.window, self.schedule.total)), np.int64)
        return found

    def ahead(self, w: int) -> np.ndarray:
        """What the queues before each one have given before a window."""
        if (found := self.before.get(w)) is None:
            found = self.before[w] = np.concatenate([[0], np.cumsum(self.given(w))])
        return found

    def pieces(self, queue: int, start: int, stop: int):
        """(window, place in it, tokens) of a queue's tokens [start, stop)."""
        low, high = 0, -(-self.schedule.total // self.window)
        guess = start * high // max(1, self.schedule.tokens[queue])
        for step in (4, 64):  # nearly always close to the even share
            if low < guess - step and self.given(guess - step)[queue] <= start:
                low = guess - step
            if guess + step < high and self.given(guess + step)[queue] > start:
                high = guess + step
            if high - low <= 2 * step:
                break
        while high - low > 1:
            mid = (low + high) // 2
            if self.given(mid)[queue] <= start:
                low = mid
            else:
                high = mid
        at = start
        while at < stop:
            here, following = int(self.given(low)[queue]), int(self.given(low + 1)[queue])
            n = min(stop, following) - at
            if n:
                yield low, int(self.ahead(low + 1)[queue]) - int(self.ahead(low)[queue]) + at - here, n
            at, low = at + n, low + 1


def tokens(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The ids of each document, written once: part and source say where, at is the place among the source's tokens of that part."""

    def run(batches):
        give_back()
        words, part, ends = word_ids(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], words.kind).tobytes()
        for batch in batches:
            for some in pieces(batch, batch.num_rows, TEXT_BYTES):
                keys, sources, texts = (some.column(some.schema.get_field_index(c)) for c in ("doc_id", "source", "text"))
                ids, at, n = [x + end for x in words.of(texts)], [], []
                for s, x in zip(sources.to_pylist(), ids, strict=True):
                    at.append(ends.get(s, 0))
                    n.append(len(x) // words.width)
                    ends[s] = at[-1] + n[-1]
                made = pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), sources.cast(pa.string()), keys, pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array([words.width] * len(n), pa.int32()), pa.array(ids, pa.binary())], ["part", "source", "doc_id", "at", "n", "width", "ids"])
                yield from pieces(made, ROWS_AT_ONCE, BYTES_AT_ONCE)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return written(plain.mapInArrow(run, "part int, source string, doc_id long, at long, n long, width int, ids binary"), "tokens")


def pack(stored: DataFrame, window: int = WINDOW, weights: dict[str | None, float] | None = None, max_queues: int = MAX_QUEUES) -> DataFrame:
    """The pieces of all documents of tokens(): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    weights: the share of each source named; the others come when all of these have run out.
    """
    held = stored.groupBy("part", "source").agg(F.sum("n").alias("held"))
    large = held.groupBy("source").agg(F.sum("held").alias("held")).orderBy(F.desc("held"), "source").limit(max_queues).select("source").collect()
    names = [*(weights or {}), *(r.source for r in large if r.source not in (weights or {}))]
    shared = F.lit(len(names)) + F.pmod(F.xxhash64("source"), F.lit(max_queues)).cast("int")
    own = held.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, own int")
    held = held.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("name")), "left")  # max_queues rows at most
    held = held.select("part", "source", "held", F.coalesce("own", shared).alias("queue"))
    held = written(held, "queues")
    totals = {r.queue: r.held for r in held.groupBy("queue").agg(F.sum("held").alias("held")).collect()}  # 2 * max_queues rows at most
    numbers = sorted(totals)
    wanted = None
    if weights:
        whole = sum(weights.values())
        wanted = [round(weights.get(names[q], 0) / whole * WEIGHT_PARTS) if q < len(names) else 0 for q in numbers]
    schedule = Schedule([totals[q] for q in numbers], wanted)
    slot = {q: k for k, q in enumerate(numbers)}
    before = F.sum("held").over(Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1))
    bases = held.select("part", F.col("source").alias("of"), "queue", F.coalesce(before, F.lit(0)).alias("base")).withColumnRenamed("part", "in")
    if held.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)

    def run(batches):
        windows = Windows(schedule, window)
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                out = [[] for _ in range(8)]
                for r in part.to_pylist():
                    ids = memoryview(np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4").tobytes())
                    first = r["base"] + r["at"]
                    at = 0
                    for w, offset, n in windows.pieces(slot[r["queue"]], first, first + r["n"]):
                        for column, value in zip(out, (r["doc_id"], at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), r["n"], w, offset, r["source"]), strict=True):
                            column.append(value)
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    joined = stored.join(bases, (F.col("part") == F.col("in")) & F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "at", "n", "width", "ids", "queue", "base")
    return joined.mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
