import pytest

from asclera.operators import faithfulness as A

PAIRS = "source string, prediction string"
ONE = ("What if nephrolithotomy and nephrostomy", "nephrolithotomy surgery")
TWO = ("I have diabetes and take metformin 500mg, when should I follow up", "diabetes and metformin")


def f1(spark, rows):
    per = A.category_f1(A.with_presence(spark.createDataFrame(rows, PAIRS)))
    return {r.category: (r.tp, r.fp, r.fn, r.f1) for r in per.collect()}, A.macro(per).first()


def test_two_pairs(spark):
    per, m = f1(spark, [ONE, TWO])
    assert {k: v[3] for k, v in per.items()} == {"Dx": 1.0, "Rx": 1.0, "Proc": 1.0, "Fup": 0.0}
    assert (m.macro_f1, m.chr_pct, m.risk) == (0.75, 25.0, "Low")


def test_contingency(spark):
    per, _ = f1(spark, [("diabetes", "diabetes"), ("diabetes", "x"), ("x", "diabetes")])
    assert per["Dx"] == (1, 1, 1, 0.5)


def test_empty_input_has_all_categories(spark):
    per, m = f1(spark, [])
    assert len(per) == 4 and all(v == (0, 0, 0, 0.0) for v in per.values())
    assert (m.macro_f1, m.chr_pct, m.risk) == (0.0, 100.0, "High")


def test_nulls_and_repeated_rows(spark):
    per, m = f1(spark, [(None, None), ONE, ONE])
    assert per["Proc"][:3] == (2, 0, 0) and 0 <= m.macro_f1 <= 1 and m.chr_pct == pytest.approx(100 * (1 - m.macro_f1))


def test_single(spark):
    r = A.single(A.with_presence(spark.createDataFrame([TWO], PAIRS))).first()
    assert (r.Dx, r.Rx, r.Proc, r.Fup, r.score, r.chr_pct) == (1, 1, 1, 0, 0.75, 25.0)


def test_risk_edges(spark):
    df = spark.createDataFrame([(x,) for x in (40.0, 39.99, 30.0, 29.99)], "c double")
    assert [r[0] for r in df.select(A.risk_label(df.c)).collect()] == ["High", "Moderate", "Moderate", "Low"]


def test_report(spark):
    lines = [r.line for r in A.report(A.category_f1(A.with_presence(spark.createDataFrame([ONE, TWO], PAIRS))), "m", "d").orderBy("line_no").collect()]
    assert lines[2:5] == ["  F1          : 0.7500", "  CHR%        : 25.00%  [Low]", "  F1 (Dx  )  : 1.0000"]


def test_unpaired_fails(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, source string"), spark.createDataFrame([(2, "y")], "id int, prediction string")
    with pytest.raises(Exception, match="unpaired"):
        A.aligned(a, b, "id").collect()
    assert A.aligned(a, a.withColumnRenamed("source", "prediction"), "id").count() == 1
