"""Sinks: metric records as JSON, predictions as text blocks, indexes as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_name(setting: str, retrieval: str, model: str, dataset: str) -> str:
    return f"{setting}_{retrieval}_{model}_{dataset}"


def write_metrics(metrics: DataFrame, predictions: DataFrame, path: str, id_col: str, first: int = 20) -> None:
    """One JSON record: the metrics, and the first predictions by id (the limit is the feature)."""
    some = predictions.select(F.col(id_col).alias("i"), "prediction").orderBy("i").limit(first).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "prediction"))), lambda r: r["prediction"]).alias("predictions"))
    one = metrics.select(F.struct("*").alias("metrics"), F.lit(1).alias("_k")).join(some.withColumn("_k", F.lit(1)), "_k").drop("_k")
    one.coalesce(1).write.mode("overwrite").json(path)


def write_predictions(pairs: DataFrame, path: str) -> None:
    """SOURCE, PRED and REF blocks, each followed by an empty line."""
    texts = [F.coalesce(c, F.lit("")) for c in ("source", "prediction", "reference")]
    block = F.concat(F.lit("SOURCE: "), texts[0], F.lit("\nPRED: "), texts[1], F.lit("\nREF: "), texts[2], F.lit("\n"))
    pairs.select(block.alias("value")).write.mode("overwrite").text(path)


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """The sparse index, clustered so that a term's postings lie in one bucket."""
    postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """A sparse index of ``operators.retrieval.build_index``."""
    index.write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)
