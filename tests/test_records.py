import csv
import io
import random
import re

import numpy as np
import pytest

from asclera.sources import records as R

REL = "relation string"


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        ("1,a,is_a,b,0.5,2020-02-29", None), ('1,"a, b",IS_A,"c ""d"" e",1,2020-01-01\r', None), ('"1", a ,,"x\ny"," 0.75 ",2020-01-01', None), ("1,a,is_a,b,.5,2020-01-01", None),
        ('1,"a" x,is_a,b,0.5,2020-01-01', "quoting"), ('1,a"b,is_a,c,0.5,2020-01-01', "quoting"), ('1,"a,is_a,b,0.5,2020-01-01', "quoting"), ('1,"a \\"b\\" c",is_a,b,0.5,2020-01-01', "quoting"), ('x"y', "quoting"),
        ("1,a,is_a,b,0.5", "column_count"), ("1,a,is_a,b,0.5,2020-01-01,", "column_count"), ("", "column_count"), (None, "column_count"), ("   ", "column_count"), ("1;a;is_a;b;0.5;2020-01-01", "column_count"),
        ("x1,a,is_a,b,0.5,2020-01-01", "invalid_value"), ("1.0,a,is_a,b,0.5,2020-01-01", "invalid_value"), ("99999999999999999999,a,is_a,b,0.5,2020-01-01", "invalid_value"), ("1, ,is_a,b,0.5,2020-01-01", "invalid_value"),
        ("1,a,nope,b,0.5,2020-01-01", "invalid_value"), ('1,a,is_a," ",0.5,2020-01-01', "invalid_value"), ("1,a,is_a,b,1.01,2020-01-01", "invalid_value"), ("1,a,is_a,b,NaN,2020-01-01", "invalid_value"), ("1,a,is_a,b,1e-1,2020-01-01", "invalid_value"),
        ("1,a,is_a,b,-0.1,2020-01-01", "invalid_value"), ("1,a,is_a,b,0.5,2021-02-29", "invalid_value"), ("1,a,is_a,b,0.5,2021-2-9", "invalid_value"), ("1,a,is_a,b,0.5,0000-01-01", "invalid_value"), ("1,a,is_a,b,,2020-01-01", "invalid_value"),
    ],
)
def test_reasons(spark, raw, reason):
    df = spark.createDataFrame([(7, raw)], "line_id long, raw_line string")
    got = R.parse_triples(df, spark.createDataFrame([("is_a",), ("Causes",)], REL)).first()
    assert (got.line_id, got.reason) == (7, reason)
    if reason != "quoting":
        assert got.offset == -1


def test_values_and_offsets(spark):
    df = spark.createDataFrame([(1, '5,"a ""q""",, t ,0.25,2020-01-02\r', "x"), (2, 'é,a"b', "y")], "line_id long, raw_line string, reason string")
    a, b = R.parse_triples(df, spark.createDataFrame([("is_a",)], REL)).orderBy("line_id").collect()
    assert (a.triple_id, a["head"], a.relation, a.tail, a.confidence, str(a.asserted_on), a.reason) == (5, 'a "q"', None, "t", 0.25, "2020-01-02", None)
    assert (b.reason, b.offset) == ("quoting", 4)
    empty = spark.createDataFrame([], "line_id long, raw_line string")
    assert R.parse_triples(empty, spark.createDataFrame([("is_a",)], REL)).count() == 0


def test_round_trip_of_written_records():
    rng = random.Random(1)
    rows = [["".join(rng.choices('ab,"\n é', k=rng.randrange(0, 8))).strip(" \t") for _ in range(rng.randrange(1, 7))] for _ in range(400)]
    rows.append(["long " * 400 + '"' * 501, "x"])
    out = []
    for r in rows:
        f = io.StringIO()
        csv.writer(f, lineterminator="", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow(r)
        out.append(f.getvalue())
    for (values, n, bad), row, raw in zip(R.tokenize(out), rows, out, strict=True):
        assert bad == -1 and n == len(row) and values == row, raw


def test_states_do_not_depend_on_chunks():
    rng = np.random.default_rng(4)
    classes = rng.choice(6, 5000, p=[0.5, 0.15, 0.15, 0.1, 0.05, 0.05]).astype(np.uint8)
    one = [R.START]
    for c in classes:
        one.append(R.NEXT[one[-1], c])
    for chunk in (1, 7, 256, 8192):
        assert R.states(classes, chunk).tolist() == [int(x) for x in one[:-1]]


def test_quoting_agrees_with_a_pattern():
    field = r'(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)'
    rng = random.Random(3)
    raws = ["".join(rng.choices('a,"" \n', k=rng.randrange(0, 14))) for _ in range(3000)]
    for (_, _, bad), raw in zip(R.tokenize(raws), raws, strict=True):
        assert (bad == -1) == bool(re.fullmatch(f"{field}(?:,{field})*", raw)), repr(raw)


def test_records_across_blocks_equal_the_csv_module(spark, tmp_path):
    import csv
    import io
    import random

    from asclera.sources.records import read_fields, read_records

    rng = random.Random(9)
    rows = [[rng.choice(["plain", 'has "quotes"', "two\nlines", "a,b", "", "x" * 90, "many\n" * 30]) + str(i), str(i)] for i in range(120)]
    want = sorted(map(tuple, rows))
    for name, part in (("a.csv", rows[:80]), ("b.csv", rows[80:])):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["text", "n"], *part])
        (tmp_path / name).write_text(out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "700", "150"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            header, got = read_fields(spark, str(tmp_path))
            assert header == ["text", "n"]
            assert sorted((r.v[0], r.v[1]) for r in got.collect()) == [(t.strip(" \t"), n) for t, n in want]
            ids = [r.record for r in read_records(spark, str(tmp_path)).collect()]
            assert len(ids) == len(set(ids)) == 122
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "c.csv").write_text('a,b\n1,2\n"never closed\n3,4\n')
    assert sorted(r.raw for r in read_records(spark, str(tmp_path / "open")).collect()) == ['"never closed\n3,4', "1,2", "a,b"]
