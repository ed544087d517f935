import random

import numpy as np

from asclera.llm import splits as S
from tests.llm.test_neardup import overlap

COLS = "pair_id long, chq string, summary string, split_name string, text string, train string, n int"


def test_equals_brute_force_also_in_blocks(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        base = rng.choices(vocab, k=rng.randrange(3, 30))
        rows.append((10 * i, " ".join(base), rng.choice([None, "", "tail of it"]), rng.choice(["train", "Train ", "test", "VALID", None])))
        for k in range(1, rng.randrange(1, 4)):
            new = list(base)
            for _ in range(rng.randrange(0, 4)):
                new[rng.randrange(len(new))] = rng.choice(vocab)
            rng.shuffle(new)
            rows.append((10 * i + k, ", ".join(new).upper(), rows[10 * i and -1][2], rng.choice(["train", "test"])))
    rows += [(9001, None, "w1 w2", "test"), (9002, "  ", "w1 w2", "train"), (9003, "...", "w1", "train"), (9004, "a " * 2000, None, "train"), (9005, "A\n" * 1999, "", "test")]
    rows += rows[:10] + [(8000 + i, "w1 w2 w3 w4", None, "train") for i in range(40)] + [(8100, "w4 w3 w2 w1", None, "test")]
    df = spark.createDataFrame([(*r, "x", "train", 1) for r in rows], COLS)
    ok = {i: (f"{q}\n{s or ''}", (p or "").strip().lower() == "train") for i, q, s, p in rows if q and any(c.isalnum() for c in q)}
    want = {(i, j) for i, (x, t) in ok.items() if not t for j, (y, u) in ok.items() if u and i != j and overlap(x, y) >= 0.8 - 1e-9}
    for hot, held in ((S.HOT, S.HELD), (10, S.HELD), (S.HOT, 20)):
        got = [(r.eval_id, r.train_id) for r in S.cross_split_overlaps(df, "pair_id", "chq", "summary", "split_name", hot=hot, held=held).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert (9005, 9004) in want and (8100, 8003) in want


def test_empty_table(spark):
    assert S.cross_split_overlaps(spark.createDataFrame([], COLS), "pair_id", "chq", "summary", "split_name").count() == 0


def test_banded_overlap_equals_sets():
    rng = np.random.default_rng(1)
    a = [np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(np.uint64) for _ in range(200)]
    b = [np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(np.uint64) for _ in range(200)]
    exact = np.array([len(np.intersect1d(x, y)) for x, y in zip(a, b, strict=True)])
    most = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    got = S.banded_overlap(a, b, 0.8)
    near = exact >= 0.8 * most
    assert (got <= exact).all() and (got[near] == exact[near]).all()
