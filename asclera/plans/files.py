"""Queries that write a table to files, read these and give what was read; with the SQL of what it should be."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asclera.operators import faithfulness as A
from asclera.operators import kg as K
from asclera.plans.data import table
from asclera.runtime import keep, shared_dir
from asclera.sources import sinks
from asclera.sources import tables as S
from asclera.streaming.events import windowed_counts


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/asclera/{name}-{uuid.uuid4().hex}"
    keep(spark, path)
    return path


def _csv(df: DataFrame, name: str) -> str:
    path = _path(df.sparkSession, name)
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path



def csv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a file whose columns are found by their names; texts may hold quotes and line breaks."""
    m = table(spark, sf_dir, "meqsum").select("pair_id", F.col("chq").alias("CHQ"), F.col("summary").alias("Summary"))
    return S.read_pairs(spark, _csv(m, "pairs"))


def csv_question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a file with two columns of questions."""
    m = table(spark, sf_dir, "mqp").select(F.col("question").alias("question_1"), F.col("target").alias("question_2"), "label")
    return S.read_pairs(spark, _csv(m, "questions"))


def csv_named_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of any two columns of a file."""
    return S.read_pairs(spark, _csv(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "named"), "source", "text")


def csv_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of a file with other names for its columns, cleaned."""
    t = table(spark, sf_dir, "umls_triples").select(F.col("head").alias("Subject"), F.col("relation").alias("Predicate"), F.col("tail").alias(" Object"))
    return K.load_triples(S.read_triples(spark, _csv(t, "triples"))).groupBy("head", "relation", "tail").agg(F.count("*").alias("n"))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a text file, a line each."""
    path = _path(spark, "corpus")
    table(spark, sf_dir, "pubmed_medlineplus_passages").select(F.regexp_replace(F.coalesce("passage_text", F.lit("")), r"[\r\n]+", " ").alias("value")).write.text(path)
    return S.read_corpus(spark, path).groupBy("text").agg(F.count("*").alias("n"))


def corpus_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a list of strings, as they are: the test items, of which there are always 400."""
    items = [r.item_text for r in table(spark, sf_dir, "eval_items").orderBy("item_id").collect()]
    return S.corpus_of(spark, items)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "meqsum").select("pair_id", F.col("chq").alias("source"), F.col("summary").alias("reference")).distinct()
    r = table(spark, sf_dir, "run_eval").select("pred_id", "pair_id", F.col("preds").alias("prediction")).distinct()
    return r.join(m, "pair_id").select("pred_id", "source", "prediction", "reference")


def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics record of a file, and the first twenty predictions that lie with it (the limit is the feature)."""
    path = _path(spark, "metrics")
    p = _answers(spark, sf_dir)
    sinks.write_metrics(p.agg(F.count("*").alias("n_samples")), p.where("prediction is not null"), path, "pred_id")
    return spark.read.json(path).select("metrics.n_samples", F.posexplode("predictions").alias("pos", "prediction")).withColumn("pos", F.col("pos").cast("long"))


def prediction_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the file of predictions, with how often each occurs."""
    path = _path(spark, "predictions")
    sinks.write_predictions(_answers(spark, sf_dir), path)
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def zipped_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of texts that are zipped by their ids: how many are the same, and how many there are."""
    p = _answers(spark, sf_dir)
    z = A.aligned(p.select("pred_id", "source"), p.select("pred_id", "prediction"), "pred_id")
    return z.agg(F.count("*").alias("n"), F.count_if(F.col("source") == F.col("prediction")).alias("same"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a stream of events in windows of a day, when it has seen all of them. The table of counts is as large as there
    are days and types."""
    schema = table(spark, sf_dir, "events").schema
    counts = windowed_counts(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp")))
    name = f"counts_{uuid.uuid4().hex}"
    query = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_" and k not in ("queries", "oracle_sql")}


def oracle_sql() -> dict[str, str]:
    ws = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    strip = lambda x: f"regexp_replace({x}, '^[{ws}]+|[{ws}]+$', '', 'g')"
    trim = lambda c: f"nullif(regexp_replace({c}, '^[ \\t]+|[ \\t]+$', '', 'g'), '')"
    both = lambda t, a, b: f"SELECT * FROM (SELECT {trim(a)} AS source, {trim(b)} AS target FROM {t}) WHERE source IS NOT NULL AND target IS NOT NULL"
    answers = "m AS (SELECT DISTINCT pair_id, chq AS source, summary AS reference FROM meqsum), r AS (SELECT DISTINCT pred_id, pair_id, preds AS prediction FROM run_eval), p AS (SELECT pred_id, source, prediction, reference FROM r JOIN m USING (pair_id))"
    lines = "'SOURCE: ' || coalesce(source, '') || chr(10) || 'PRED: ' || coalesce(prediction, '') || chr(10) || 'REF: ' || coalesce(reference, '') || chr(10)"
    cell = lambda c: strip(f"coalesce({c}, '')")
    return {
        "csv_pairs": both("meqsum", "chq", "summary"),
        "csv_question_pairs": both("mqp", "question", "target"),
        "csv_named_pairs": both("documents", "source", "text"),
        "csv_triples": f"SELECT head, CASE WHEN relation = '' THEN 'associated_with' ELSE relation END AS relation, tail, count(*) AS n FROM (SELECT {cell('head')} AS head, {cell('relation')} AS relation, {cell('tail')} AS tail FROM umls_triples) WHERE head <> '' AND tail <> '' GROUP BY ALL",
        "corpus_lines": f"SELECT text, count(*) AS n FROM (SELECT {strip('''regexp_replace(passage_text, '[' || chr(13) || chr(10) || ']+', ' ', 'g')''')} AS text FROM pubmed_medlineplus_passages) WHERE text <> '' GROUP BY text",
        "corpus_in_memory": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS passage_id, item_text AS text FROM eval_items",
        "metrics_json": f"WITH {answers}, f AS (SELECT prediction, row_number() OVER (ORDER BY pred_id) - 1 AS pos FROM p WHERE prediction IS NOT NULL) SELECT (SELECT count(*) FROM p) AS n_samples, pos, prediction FROM f WHERE pos < 20",
        "prediction_blocks": f"WITH {answers} SELECT line, count(*) AS n FROM (SELECT unnest(string_split({lines}, chr(10))) AS line FROM p) GROUP BY line",
        "zipped_faithfulness": f"WITH {answers} SELECT count(*) AS n, count(*) FILTER (source = prediction) AS same FROM p",
        "stream_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    }
