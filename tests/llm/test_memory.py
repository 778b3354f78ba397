"""Tasks of the pipeline's stages don't run beside what tasks of other stages left in their worker."""

import numpy as np
import pytest

from datagrove.llm import language, near_duplicates, packing, quality, word_ids

SF = "/root/testdata/sf0.001"
STAGES = {
    "quality": lambda docs: quality.score(docs, np.zeros((1 << quality.BITS) + 1, "<f4")),
    "language": lambda docs: language.likelihoods(docs.select("doc_id", "text"), [(np.zeros(1), *(np.zeros(0, k) for k in ("<u2", "u1", "<f4")))]),
    "signatures": lambda docs: near_duplicates.signed(docs, 5),
    "packing": lambda docs: packing.pack(docs.selectExpr("0 AS part", "source", "doc_id", "0L AS at", "1L AS n", "2 AS width", "X'0100' AS ids")),
}


@pytest.mark.parametrize("name", STAGES)
def test_tasks_drop_the_tokenizer(spark, monkeypatch, name):
    docs, tasks = spark.read.parquet(f"{SF}/documents.parquet").limit(20), []
    kind = type(docs)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, f=kind.mapInArrow, **b: tasks.append(run) or f(self, run, *a, **b))
    STAGES[name](docs)
    monkeypatch.setattr(word_ids, "_loaded", {"path": object()})
    assert tasks and list(tasks[-1](iter([]))) == []
    assert word_ids._loaded == {}


def test_freed_memory_is_given_back(monkeypatch):
    monkeypatch.setattr(word_ids, "_loaded", {})

    def held() -> int:
        with open("/proc/self/smaps_rollup") as file:
            return next(int(line.split()[1]) for line in file if line.startswith("Anonymous:")) >> 10

    def run(batches):
        some = [np.ones(1 << 13) for _ in range(4000)]  # 64 KB each
        batches.append(some[-1])  # a small array behind them stays
        yield held()

    before, kept = held(), []
    (most,) = word_ids.lean(run)(kept)
    assert most - before > 200 and held() - before < 60
