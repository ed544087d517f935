"""Reading levels: interpolated n-gram models of each graded level, the surprisal of whole texts under them, and isotonic
regression from surprisal to grade.

For each level an interpolated trigram model of words is fitted to the texts that its raters put there (the rounded median
where there are several). A text's surprisal is taken token by token under every model; the expected grade under the
softmax of the mean surprisals is a score, and isotonic regression on cross-fitted scores maps it to a grade.

Defined results: null texts are left out; texts without a word, and those that are not in the wanted language, have a null level;
grades that are null or not from 1 to 5 are left out; repeated rows give one row; whole texts count, however long.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclera.llm.languages import Languages
from asclera.runtime import spread

LEVELS = (1, 2, 3, 4, 5)
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def tokens_of(text: str) -> list[str]:
    return ["#" if w[0].isdigit() else w for w in _TOKEN.findall(text.lower())]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the knots (x, y) of the non-decreasing step function closest to the points."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least x, greatest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, hi = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + m * w) / (last[1] + w)
            last[1] += w
            last[3] = hi
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    return at, np.array([v for b in blocks for v in (b[0], b[0])])


class LevelModels:
    """Interpolated trigrams of each level over one vocabulary: words of at least ``known`` texts; others are one class.

    An order is interpolated with the next lower one as if ``back`` more tokens had followed the context, drawn from that."""

    def __init__(self, texts: list[list[str]], grades: list[int], known: int = 3, back: float = 8.0):
        self.back = back
        df = Counter(w for t in texts for w in set(t))
        self.vocab = {w: i + 2 for i, w in enumerate(sorted(w for w, n in df.items() if n >= known))}
        self.size = len(self.vocab) + 2
        by: dict[int, list[list[int]]] = defaultdict(list)
        for t, g in zip(texts, grades, strict=True):
            by[g].append(self.ids(t))
        self.levels = [g for g in LEVELS if by[g]]
        self.prior = np.log2(np.array([len(by[g]) for g in self.levels]) / len(texts))
        n, v = len(self.levels), self.size
        uni, bi, tri, before1, before2 = np.zeros((v, n)), Counter(), Counter(), Counter(), Counter()
        for k, g in enumerate(self.levels):
            for ids in by[g]:
                a = np.array([0, 0, *ids], np.int64)
                np.add.at(uni, (a[2:], k), 1)
                bi.update(zip((a[1:-1] * v + a[2:]).tolist(), [k] * len(ids), strict=True))
                tri.update(zip(((a[:-2] * v + a[1:-1]) * v + a[2:]).tolist(), [k] * len(ids), strict=True))
                before1.update(zip(a[1:-1].tolist(), [k] * len(ids), strict=True))
                before2.update(zip((a[:-2] * v + a[1:-1]).tolist(), [k] * len(ids), strict=True))
        self.uni = (uni + 0.05) / (uni.sum(0) + 0.05 * v)
        self.bi, self.tri, self.before1, self.before2 = (self._by_level(c, n) for c in (bi, tri, before1, before2))

    @staticmethod
    def _by_level(counts: Counter, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes and, for each, its count by level."""
        codes = np.unique(np.fromiter((c for c, _ in counts), np.int64, len(counts)))
        out = np.zeros((len(codes) + 1, n))  # the last row: not seen
        for (c, k), m in counts.items():
            out[np.searchsorted(codes, c), k] = m
        return codes, out

    def ids(self, tokens: list[str]) -> list[int]:
        get = self.vocab.get
        return [get(w, 1) for w in tokens]

    def surprisals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of all tokens one after another, the surprisal in bits under each level; and the number of tokens of each text."""
        counts = np.array([len(t) for t in texts], np.int64)
        flat = np.full(int(counts.sum()) + 2 * len(texts), 0, np.int64)
        keep = np.ones(len(flat), bool)
        edges = np.cumsum(counts + 2) - (counts + 2)
        keep[edges] = keep[edges + 1] = False
        flat[keep] = [i for t in texts for i in self.ids(t)]
        at = np.flatnonzero(keep)
        w, p1, p2, v = flat[at], flat[at - 1], flat[at - 2], self.size
        prob = self.uni[w]
        for table, before, context in ((self.bi, self.before1, p1), (self.tri, self.before2, p2 * v + p1)):
            prob = (self._look(table, context * v + w) + self.back * prob) / (self._look(before, context) + self.back)
        return -np.log2(prob), counts

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
        known, rows = table
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return rows[np.where(known[at] == codes, at, len(known))]

    def scores(self, texts: list[list[str]], sharp: float = 6.0, enough: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected grades (texts of fewer than ``enough`` tokens say less, and the levels' shares more), and the median and the ninth decile of the surprisal under the best level; nan without tokens."""
        bits, counts = self.surprisals(texts)
        score, middle, high = (np.full(len(texts), np.nan) for _ in range(3))
        has = np.flatnonzero(counts)
        if not len(has):
            return score, middle, high
        starts = (np.cumsum(counts) - counts)[has]
        mean = np.add.reduceat(bits, starts, axis=0) / counts[has, None]
        bits_for = self.prior - sharp * np.minimum(1.0, counts[has, None] / enough) * mean
        p = np.exp2(bits_for - bits_for.max(1, keepdims=True))
        score[has] = (p * np.array(self.levels)).sum(1) / p.sum(1)
        best = mean.argmin(1)
        for i, s, n, b in zip(has.tolist(), starts.tolist(), counts[has].tolist(), best.tolist(), strict=True):
            x = np.sort(bits[s : s + n, b])
            middle[i], high[i] = x[n // 2], x[min(n - 1, 9 * n // 10)]
        return score, middle, high


class ReadingLevels:
    """Level models with the isotonic map from score to grade, fitted to scores of models that had not seen the text."""

    def __init__(self, graded: list[tuple[str, float]], folds: int = 5, doubt: float = 0.6):
        graded = [(t, g) for t, g in ((tokens_of(x), g) for x, g in graded) if t]
        if not graded:
            raise ValueError("no graded texts")
        texts, grades = [t for t, _ in graded], np.array([g for _, g in graded])
        labels = np.floor(grades + 0.5).astype(int)
        scores, knots = self._cross_fitted(texts, labels, grades, folds)
        self.held_out = scores, grades
        # Raters are sometimes a grade off: where models that hadn't seen a text are sure of another grade, theirs counts.
        own = np.interp(np.nan_to_num(scores, nan=3.0), *knots)
        labels = np.where((np.abs(own - grades) > doubt) & ~np.isnan(scores), np.floor(own + 0.5).astype(int), labels)
        _, self.knots = self._cross_fitted(texts, labels, labels.astype(float), folds)
        self.models = LevelModels(texts, labels.tolist())

    @staticmethod
    def _cross_fitted(texts: list[list[str]], labels: np.ndarray, grades: np.ndarray, folds: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Scores from models that hadn't seen the text, and the isotonic map from these to the grades."""
        fold, scores = np.arange(len(texts)) % folds, np.full(len(texts), np.nan)
        for f in range(folds):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inside) and len(outside):
                scores[outside] = LevelModels([texts[i] for i in inside], labels[inside].tolist()).scores([texts[i] for i in outside])[0]
        ok = ~np.isnan(scores)
        return scores, isotonic(scores[ok], grades[ok]) if ok.any() else (np.array(LEVELS, float), np.array(LEVELS, float))

    def grades(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score, middle, high = self.models.scores([tokens_of(t) for t in texts])
        return np.where(np.isnan(score), np.nan, np.interp(score, *self.knots)), middle, high


def fit_levels(texts: DataFrame, grades: DataFrame, keys: list[str], text_col: str = "text", grade_col: str = "grade", most: int = 6000) -> ReadingLevels:
    """Fitted to up to ``most`` graded texts (the bound of the sample; the least by a hash of their keys)."""
    g = grades.where(F.col(grade_col).between(1, 5)).groupBy(*keys).agg(F.percentile(F.col(grade_col), 0.5).alias("grade"))
    chosen = g.orderBy(F.xxhash64(*keys), *keys).limit(most)
    rows = texts.join(F.broadcast(chosen), keys).select(F.col(text_col).alias("text"), "grade", *keys).distinct().where("text is not null").collect()
    return ReadingLevels([(r["text"], r["grade"]) for r in sorted(rows, key=lambda r: (str([r[k] for k in keys]), r["text"]))])


def _leveled(models: ReadingLevels, languages: Languages, wanted: str, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = languages.tags.index(wanted)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            scores = languages.scores(texts)
            grade, middle, high = models.grades(texts)
            grade[scores.max(1) - scores[:, own] > margin] = np.nan
            none = np.isnan(grade)
            yield pa.record_batch(
                [b.column("id"), b.column("field"), *[pa.array(x, pa.float64(), mask=none) for x in (grade, middle, high)]],
                names=["id", "field", "grade", "median_bits", "p90_bits"],
            )

    return run


def reading_levels(texts: DataFrame, models: ReadingLevels, languages: Languages, wanted: str = "en", margin: float = 1.0) -> DataFrame:
    """(id, field, grade, level, median_bits, p90_bits) of the texts (id, field, text); null grades of those in other languages."""
    given = texts.select(F.col("id").cast("long").alias("id"), F.col("field").cast("string").alias("field"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = spread(given).mapInArrow(_leveled(models, languages, wanted, margin), "id long, field string, grade double, median_bits double, p90_bits double").distinct()
    return out.withColumn("level", F.when(F.col("grade").isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("grade") + 0.5)))).cast("int"))
