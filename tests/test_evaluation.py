import math
import random
from collections import Counter

import pytest

from asclera.operators import evaluation as E
from asclera.operators.inference import infer


def test_lcs_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randrange(0, 12)) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert E.lcs(a, b) == t[-1][-1]


def test_rouge(spark):
    df = spark.createDataFrame([("the cat sat", "The cat, sat!"), ("a b c d", "a x c"), (None, "a"), ("", "")], "prediction string, reference string")
    assert [r.rouge_l for r in E.rouge_l(df).collect()] == pytest.approx([1.0, 4 / 7, 0.0, 0.0])


def test_bleu_equals_row_version(spark):
    rng = random.Random(2)
    rows = [(k % 2, " ".join(rng.choices("abcde", k=rng.randrange(4, 15))), " ".join(rng.choices("abcde", k=rng.randrange(4, 15)))) for k in range(60)] + [(2, "x", "y"), (2, None, "z")]
    want = {}
    for key in (0, 1, 2):
        m, t, c, r = [0] * 4, [0] * 4, 0, 0
        for k, p, q in rows:
            if k == key:
                p, q = (p or "").split(), (q or "").split()
                c, r = c + len(p), r + len(q)
                for n in range(1, 5):
                    a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, q))
                    m[n - 1] += sum((a & b).values())
                    t[n - 1] += sum(a.values())
        want[key] = 0.0 if 0 in m else (1 if c >= r else math.exp(1 - r / c)) * math.exp(sum(math.log(x / y) for x, y in zip(m, t, strict=True)) / 4)
    df = spark.createDataFrame(rows, "k int, prediction string, reference string")
    assert {x.k: x.bleu for x in E.bleu(df, ("k",)).collect()} == pytest.approx(want)
    assert E.bleu(df.where("k = 0").drop("k")).first().bleu == pytest.approx(want[0])


@pytest.mark.parametrize(("test", "size"), [(7, 7), (0.2, 10), (0, 0), (500, 47), (1.0, 47)])
def test_split_is_exact_and_stable(spark, test, size):
    df = spark.createDataFrame([(i,) for i in range(47)], "id long")
    one, two = ({r.id for r in E.train_test_split(d, "id", test).where("is_test").collect()} for d in (df, df.repartition(5)))
    assert one == two and len(one) == size


def test_metrics(spark):
    df = spark.createDataFrame([("diabetes surgery", "diabetes surgery now ok", "diabetes surgery now ok")], "source string, prediction string, reference string")
    m = E.metrics(df).first()
    assert (m.n_samples, m.Dx, m.Proc, m.Rx, m.macro_f1, m.chr_pct, m.rouge_l, m.bleu) == (1, 1.0, 1.0, 0.0, 0.5, 50.0, 1.0, 1.0)


def test_infer_keeps_order_and_other_columns(spark):
    df = spark.createDataFrame([(i, "s", None if i == 3 else f"u{i}") for i in range(21)], "id int, system string, user string").coalesce(1)
    got = infer(df, lambda: lambda s, u: [f"{len(u)}:{a}{b}" for a, b in zip(s, u, strict=True)]).collect()
    assert [r.id for r in got] == list(range(21)) and got[0].output == "8:su0" and got[3].output == "8:s" and got[20].output == "5:su20"
    with pytest.raises(Exception, match="another number"):
        infer(df, lambda: lambda s, u: u[:-1]).collect()
