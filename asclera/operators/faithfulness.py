"""How faithfully predictions keep the concept categories of their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asclera.config import CATEGORIES, Lexicon
from asclera.operators.concepts import presence


def risk_label(chr_pct: Column) -> Column:
    return F.when(chr_pct >= 40.0, "High").when(chr_pct >= 30.0, "Moderate").otherwise("Low")


def with_presence(pairs: DataFrame, lexicon: Lexicon | None = None, source: str = "source", prediction: str = "prediction") -> DataFrame:
    """pairs with the columns ``in_source`` and ``in_prediction``, structs of booleans. Null texts have no concepts."""
    return pairs.withColumn("in_source", presence(F.col(source), lexicon)).withColumn("in_prediction", presence(F.col(prediction), lexicon))


def category_f1(flagged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each category (and each value of ``by``): tp, fp, fn, precision, recall, f1. Without rows, all zeros."""
    counts = []
    for k in CATEGORIES:
        s, p = F.col(f"in_source.{k}"), F.col(f"in_prediction.{k}")
        counts += [F.count_if(s & p).alias(f"tp_{k}"), F.count_if(~s & p).alias(f"fp_{k}"), F.count_if(s & ~p).alias(f"fn_{k}")]
    rows = F.array(*[F.struct(F.lit(k).alias("category"), *[F.col(f"{x}_{k}").cast("long").alias(x) for x in ("tp", "fp", "fn")]) for k in CATEGORIES])
    one = flagged.groupBy(*by).agg(*counts).select(*by, F.explode(rows).alias("c")).select(*by, "c.*")
    pr = one.withColumn("precision", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return pr.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def macro(per_category: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The macro mean of the categories' F1, the hallucination rate in per cent and its label."""
    m = per_category.groupBy(*by).agg(F.coalesce(F.sum("f1") / len(CATEGORIES), F.lit(0.0)).alias("macro_f1"))
    return m.withColumn("chr_pct", (1 - F.col("macro_f1")) * 100).withColumn("risk", risk_label(F.col("chr_pct")))


def single(flagged: DataFrame) -> DataFrame:
    """Of each pair: 1 for each category whose flags agree, their mean and the hallucination rate."""
    same = {k: (F.col(f"in_source.{k}") == F.col(f"in_prediction.{k}")).cast("double") for k in CATEGORIES}
    out = flagged.withColumns(same)
    mean = sum((F.col(k) for k in CATEGORIES), F.lit(0.0)) / len(CATEGORIES)
    return out.withColumn("score", mean).withColumn("chr_pct", (1 - F.col("score")) * 100)


def report(per_category: DataFrame, model_name: str = "", dataset: str = "") -> DataFrame:
    """(line_no, line): the text report of one set of pairs."""
    header = "Faithfulness F1 report" + (f": {model_name}" if model_name else "") + (f" on {dataset}" if dataset else "")
    f1 = F.map_from_entries(F.collect_list(F.struct("category", "f1")))
    m = per_category.agg(F.coalesce(F.sum("f1") / len(CATEGORIES), F.lit(0.0)).alias("m"), f1.alias("by"))
    rate = (1 - F.col("m")) * 100
    lines = [F.lit(header), F.lit("-" * len(header)), F.format_string("  F1          : %.4f", "m"), F.concat(F.format_string("  CHR%%        : %.2f%%  [", rate), risk_label(rate), F.lit("]"))]
    lines += [F.format_string(f"  F1 ({k:4s})  : %.4f", F.col("by")[k]) for k in CATEGORIES]
    return m.select(F.posexplode(F.array(*lines)).alias("line_no", "line")).select(F.col("line_no").cast("long").alias("line_no"), "line")


def aligned(sources: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Sources joined with predictions one to one by key; fails if either side has a key that the other lacks."""
    both = sources.withColumn("_s", F.lit(1)).join(predictions.withColumn("_p", F.lit(1)), key, "full")
    return both.withColumn("_ok", F.when(F.col("_s").isNull() | F.col("_p").isNull(), F.raise_error(F.lit(f"unpaired {key}"))).otherwise(F.lit(True))).where("_ok").drop("_s", "_p", "_ok")
