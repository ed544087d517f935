"""The queries of the operators in this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asclera.llm import confusables, leakage, neardup, packing, pairs, reading, splits, sql
from asclera.llm.languages import fit_languages
from asclera.runtime import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.near_duplicates(_table(spark, sf_dir, "pubmed_medlineplus_passages"), "passage_id", "passage_text")
    return neardup.duplicate_pairs(members, links).select(F.col("a").alias("passage_id_a"), F.col("b").alias("passage_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.near_duplicates(_table(spark, sf_dir, "pubmed_medlineplus_passages"), "passage_id", "passage_text")
    g = neardup.duplicate_groups(members, links)
    return g.select(F.col("id").alias("passage_id"), F.col("group").alias("group_id"), "copies", "links")


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _table(spark, sf_dir, "meqsum").select("pair_id", "chq", "summary")
    questions = m.groupBy("pair_id").agg(F.max("chq").alias("prompt"))
    runs = _table(spark, sf_dir, "run_eval").select("pred_id", "pair_id", "preds").join(questions, "pair_id", "left")
    own = m.select(F.lit("meqsum").alias("source"), F.col("pair_id").alias("id"), F.col("pair_id").alias("group"), F.col("chq").alias("prompt"), F.col("summary").alias("response"))
    given = own.unionByName(runs.select(F.lit("run_eval").alias("source"), F.col("pred_id").alias("id"), F.col("pair_id").alias("group"), "prompt", F.col("preds").alias("response")))
    given = materialize(given.distinct(), "pairs")
    return pairs.defective_pairs(given, fit_languages(_table(spark, sf_dir, "documents")), pairs.fit_endings(given), pairs.fit_refusals(given))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defects(spark, sf_dir).select(F.col("source").alias("table_name"), F.col("id").alias("record_id"), "defect")


def p2_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each table have each defect."""
    return _defects(spark, sf_dir).groupBy(F.col("source").alias("table_name"), "defect").agg(F.count("*").alias("n"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _table(spark, sf_dir, "meqsum")
    long = m.select(F.col("pair_id").alias("id"), F.explode(F.create_map(F.lit("chq"), "chq", F.lit("summary"), "summary")).alias("field", "text"))
    grades = _table(spark, sf_dir, "reading_grades").select(F.col("pair_id").alias("id"), F.col("field_name").alias("field"), "grade")
    models = reading.fit_levels(long, grades, ["id", "field"])
    return reading.reading_levels(long, models, fit_languages(_table(spark, sf_dir, "documents")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).where("grade >= 4.5").select(F.col("id").alias("pair_id"), F.col("field").alias("field_name")).distinct()


def p3_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _levels(spark, sf_dir).select(F.col("id").alias("pair_id"), F.col("field").alias("field_name"), "level", "grade", "median_bits", "p90_bits")
    return g.withColumns({c: F.round(c, 3) for c in ("grade", "median_bits", "p90_bits")})


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each field have each level."""
    return _levels(spark, sf_dir).groupBy(F.col("field").alias("field_name"), "level").agg(F.count("*").alias("n_texts"), F.round(F.avg("median_bits"), 3).alias("median_bits"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = splits.cross_split_overlaps(_table(spark, sf_dir, "meqsum"), "pair_id", "chq", "summary", "split_name")
    q = splits.cross_split_overlaps(_table(spark, sf_dir, "mqp"), "mqp_id", "question", "target", "split_name")
    return m.withColumn("table_name", F.lit("meqsum")).unionByName(q.withColumn("table_name", F.lit("mqp")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _overlaps(spark, sf_dir)
    return o.select("table_name", F.least("eval_id", "train_id").alias("record_id_a"), F.greatest("eval_id", "train_id").alias("record_id_b")).distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each table and evaluation split: pairs, and evaluation records that the training split has as well."""
    m = _table(spark, sf_dir, "meqsum").select(F.lit("meqsum").alias("table_name"), F.col("pair_id").alias("eval_id"), "split_name")
    names = m.unionByName(_table(spark, sf_dir, "mqp").select(F.lit("mqp").alias("table_name"), F.col("mqp_id").alias("eval_id"), "split_name"))
    names = names.withColumn("split_name", F.lower(F.trim("split_name"))).distinct()
    found = _overlaps(spark, sf_dir).join(names, ["table_name", "eval_id"])
    return found.groupBy("table_name", "split_name").agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_records"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.room(packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "item_text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every test item: the documents that carry it, and the largest share of it that one does."""
    n = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("share"))
    items = _table(spark, sf_dir, "eval_items").select("item_id", "dataset")
    return items.join(n, "item_id", "left").select("item_id", "dataset", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), F.round(F.coalesce("share", F.lit(0.0)), 4).alias("share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = confusables.lookalike_pairs(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.consistent_texts(_table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("form").alias("text_form"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
