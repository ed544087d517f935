import random

import numpy as np
import pytest

from asclera.llm import reading as R
from tests.llm.test_pairs import LANGS

WORDS = {1: "i am sad my dog ran to me it is hot the cup", 2: "the doctor gave me pills at night my job is all about", 3: "the label of the drug says once a day but my nurse", 4: "although the operation was described as successful i continue to have particularly", 5: "notwithstanding concomitant administration of immunosuppressive pharmacokinetic deterioration"}


def graded(rng, n=40):
    for g, w in WORDS.items():
        for _ in range(n):
            yield " ".join(rng.choices(w.split(), k=rng.randrange(8, 40))), float(min(5, max(1, g + rng.choice([0, 0, 0, 0, 0, 0, 0, -1, 1]))))


def test_isotonic_is_monotone_and_closest():
    x, y = R.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 5.0]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [1.0, 2.5, 2.5, 5.0]
    rng = np.random.default_rng(1)
    x, y = R.isotonic(rng.normal(size=200), rng.normal(size=200))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()


def test_held_out_accuracy():
    rng = random.Random(3)
    data = list(graded(rng))
    rng.shuffle(data)
    models = R.ReadingLevels(data)
    fresh = [(" ".join(rng.choices(WORDS[g].split(), k=20)), g) for g in WORDS for _ in range(20)]
    got = np.floor(models.grades([t for t, _ in fresh])[0] + 0.5)
    assert (got == [g for _, g in fresh]).mean() >= 0.95
    assert np.isnan(models.grades(["", "..."])[0]).all()


def test_surprisal_is_a_distribution():
    m = R.LevelModels([["a", "b", "a"], ["b", "b"]] * 3, [1, 5] * 3, known=1)
    rest = [[w] for w in m.vocab]
    bits, _ = m.surprisals(rest)
    assert (np.exp2(-bits).sum(0) <= 1 + 1e-9).all()


def test_levels(spark):
    rng = random.Random(5)
    data = list(graded(rng, 12))
    texts = spark.createDataFrame([(i, "chq", t) for i, (t, _) in enumerate(data)] + [(900, "chq", None), (901, "chq", ""), (902, "chq", "Quels sont les effets indésirables de ce médicament chez les personnes âgées")], "id long, field string, text string")
    grades = spark.createDataFrame([(i, "chq", int(g), "r") for i, (_, g) in enumerate(data)] + [(0, "chq", None, "s"), (1, "chq", 9, "s"), (777, "chq", 3, "none")], "id long, field string, grade int, text string")
    models = R.fit_levels(texts, grades.drop("text"), ["id", "field"])
    rows = R.reading_levels(texts.unionByName(texts), models, LANGS, margin=30.0).collect()
    assert len({(r.id, r.field) for r in rows}) == len(rows) and all(r.level is None if r.id in (901, 902) else 1 <= r.level <= 5 for r in rows)
    ids = {r.id for r in rows}
    assert 900 not in ids and {901, 902} <= ids
    assert [(r.id, r.level, r.grade, r.median_bits) for r in R.reading_levels(texts.where("id = 902"), models, LANGS).collect()] == [(902, None, None, None)]
    assert R.reading_levels(texts.where("false"), models, LANGS).count() == 0
    with pytest.raises(ValueError, match="no graded"):
        R.ReadingLevels([])
