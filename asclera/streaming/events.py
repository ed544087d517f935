"""Structured Streaming: the row operators work on streams as they are; windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclera.config import CATEGORIES
from asclera.operators.concepts import presence


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts and sums of (ts, event_type, value) in windows; events later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def presence_stream(texts: DataFrame, text_col: str) -> DataFrame:
    """texts with a boolean for each concept category."""
    return texts.withColumn("_p", presence(F.col(text_col))).select(*texts.columns, *[F.col(f"_p.{k}").alias(k.lower()) for k in CATEGORIES])


def faithfulness_counts(pairs: DataFrame, ts_col: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """tp, fp and fn of each category in windows of a stream of (source, prediction) pairs."""
    p = pairs.withWatermark(ts_col, late).withColumn("_s", presence(F.col("source"))).withColumn("_p", presence(F.col("prediction")))
    aggs = []
    for k in CATEGORIES:
        s, q = F.col(f"_s.{k}"), F.col(f"_p.{k}")
        aggs += [F.count_if(s & q).alias(f"tp_{k.lower()}"), F.count_if(~s & q).alias(f"fp_{k.lower()}"), F.count_if(s & ~q).alias(f"fn_{k.lower()}")]
    return p.groupBy(F.window(ts_col, window).alias("w")).agg(*aggs).select(F.col("w.start").alias("start"), *[f"{x}_{k.lower()}" for k in CATEGORIES for x in ("tp", "fp", "fn")])
