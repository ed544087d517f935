import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from asclera.sources import sinks, tables
from asclera.streaming.events import faithfulness_counts, presence_stream, windowed_counts


def test_pair_columns():
    assert tables.pair_columns(["CHQ", "x", " Summary "]) == ("CHQ", " Summary ")
    assert tables.pair_columns(["id", "question1", "question2"]) == ("question1", "question2")
    with pytest.raises(ValueError, match="no pair"):
        tables.pair_columns(["a", "question"])


def test_csv_corpus_and_triples(spark, tmp_path):
    (tmp_path / "p.csv").write_text('CHQ,Summary\n"a\nb","say ""x"""\n,none\n')
    assert [tuple(r) for r in tables.read_pairs(spark, str(tmp_path / "p.csv")).collect()] == [("a\nb", 'say "x"')]
    (tmp_path / "c.txt").write_text("  one \n\n　\ntwo\n")
    assert [r.text for r in tables.read_corpus(spark, str(tmp_path / "c.txt")).orderBy("passage_id").collect()] == ["one", "two"]
    (tmp_path / "t.csv").write_text('Subject , predicate,OBJECT\na,is_a,b\n"x, y",,z\nshort,row\nq,r,\n')
    assert [tuple(r)[1:] for r in tables.read_triples(spark, str(tmp_path / "t.csv")).orderBy("triple_id").collect()] == [("a", "is_a", "b"), ("x, y", "", "z"), ("q", "r", "")]
    assert tables.read_triples(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "empty.csv").write_text("")
    assert tables.read_triples(spark, str(tmp_path / "empty.csv")).count() == 0


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([(2, "s", "p2", "r"), (1, "s", "p1", None)], "id int, source string, prediction string, reference string").coalesce(1)
    sinks.write_metrics(spark.createDataFrame([(0.5,)], "macro_f1 double"), pairs, str(tmp_path / "m"), "id", 1)
    assert json.loads(next(Path(tmp_path / "m").glob("part*")).read_text()) == {"metrics": {"macro_f1": 0.5}, "predictions": ["p1"]}
    sinks.write_predictions(pairs, str(tmp_path / "t"))
    assert "SOURCE: s\nPRED: p2\nREF: r\n\n" in next(Path(tmp_path / "t").glob("part*")).read_text()
    sinks.write_postings(spark.createDataFrame([(1, "a", 0.5)], "id long, term string, weight double"), str(tmp_path / "i"), 4)
    assert tables.read_vectors(spark, str(tmp_path / "i")).count() == 1


def test_streams_give_what_a_batch_gives(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 01:00", "a", 1.0), ("2024-01-01 02:00", "a", 2.0), ("2024-01-03 00:00", "b", 5.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    e.write.parquet(str(tmp_path / "e"))
    s = windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.event_type, r.n, r.value) for r in spark.table("counts").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}
    p = spark.createDataFrame([("2024-01-01 01:00", "diabetes", "surgery")], "t string, source string, prediction string").select(F.to_timestamp("t").alias("ts"), "source", "prediction")
    r = faithfulness_counts(p, "ts").first()
    assert (r.fn_dx, r.fp_proc, r.tp_dx) == (1, 1, 0)
    assert presence_stream(p, "source").first().dx


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
