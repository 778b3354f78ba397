"""Classical baselines: themes of a text (one boosted-tree model per label) and classes of a pair."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(rows: DataFrame, key: str, seed: int = 42, percent: int = 20) -> DataFrame:
    """rows with held_out, decided by a hash of the key, so independent of partitions and order."""
    return rows.withColumn("held_out", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < percent)


def _weighted(rows: DataFrame, target) -> DataFrame:
    """rows with y and the weight that balances both classes."""
    marked = rows.withColumn("y", target.cast("double"))
    n, ones = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    return marked.withColumn("weight", F.when(F.col("y") == 1, n / max(1.0, 2 * ones)).otherwise(n / max(1.0, 2 * (n - ones))))


def theme_model(rows: DataFrame, text: str, labels: str, names: list[str], features: int = 10_000, trees: int = 20) -> tuple[PipelineModel, dict]:
    """A tf-idf model of the texts, and a model for each of the labels named."""
    words = Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False), StopWordsRemover(inputCol="_words", outputCol="_kept"), CountVectorizer(inputCol="_kept", outputCol="_counts", vocabSize=features), IDF(inputCol="_counts", outputCol="features")]).fit(rows)
    made = words.transform(rows)
    return words, {n: GBTClassifier(maxIter=trees, weightCol="weight", labelCol="y", seed=42).fit(_weighted(made, F.array_contains(labels, n))) for n in names}


def predict_themes(rows: DataFrame, words: PipelineModel, models: dict) -> DataFrame:
    """rows with themes, the labels whose model says yes."""
    out, own = words.transform(rows), rows.columns
    for k, (name, model) in enumerate(models.items()):
        out = model.setPredictionCol(f"_p{k}").setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_q{k}").transform(out)
    said = F.array_compact(F.array(*[F.when(F.col(f"_p{k}") == 1, F.lit(n)) for k, n in enumerate(models)]))
    return out.select(*own, said.alias("themes"))


def pair_model(pairs: DataFrame, features: str, target: str, classes: list[int], trees: int = 20) -> dict:
    """One model per class over arrays of numbers."""
    made = pairs.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    return {c: GBTClassifier(maxIter=trees, weightCol="weight", labelCol="y", seed=42).fit(_weighted(made, F.col(target) == c)) for c in classes}


def predict_pairs(pairs: DataFrame, features: str, models: dict) -> DataFrame:
    """pairs with class, the likeliest; the first of equals."""
    out, own = pairs.withColumn("features", array_to_vector(F.col(features).cast("array<double>"))), pairs.columns
    for k, model in enumerate(models.values()):
        out = model.setPredictionCol(f"_p{k}").setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_q{k}").transform(out)
    scores = F.array(*[vector_to_array(f"_q{k}")[1] for k in range(len(models))])
    return out.select(*own, F.element_at(F.array(*[F.lit(c) for c in models]), F.array_position(scores, F.array_max(scores)).cast("int")).alias("class"))
