"""Languages of texts: naive Bayes over character n-grams, fitted on a bounded sample of labelled rows."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The three-letter tags of languages that have a two-letter one.
TAGS = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "rus": "ru", "ell": "el", "gre": "el", "gr": "el", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl"}
_WORD = re.compile(r"[^\W\d_]+")


def language_of_tag(tag: str | None) -> str | None:
    """The two-letter tag that a tag in any spelling stands for; None if it says nothing."""
    t = re.split(r"[-_]", (tag or "").strip().lower())[0]
    t = TAGS.get(t, t)
    return t if len(t) == 2 else None


def _grams(text: str, longest: int = 4) -> Counter:
    out: Counter = Counter()
    for w, k in Counter(_WORD.findall(unicodedata.normalize("NFC", text).lower())).items():
        w = f" {w} "
        for n in range(2, longest + 1):
            for i in range(len(w) - n + 1):
                out[w[i : i + n]] += k
    return out


class Languages:
    """Posteriors over the languages of the labelled texts. A word's n-grams are one draw together: their mean log
    likelihood times ``weight`` counts, as they overlap."""

    def __init__(self, labelled: list[tuple[str, str]], weight: float = 2.0, least: int = 2):
        counts: dict[str, Counter] = {}
        for tag, text in labelled:
            counts.setdefault(tag, Counter()).update(_grams(text))
        self.tags = sorted(counts)
        vocab = {g for c in counts.values() for g, k in c.items() if k >= least}
        totals = {t: sum(k for g, k in counts[t].items() if g in vocab) + len(vocab) * 0.1 for t in self.tags}
        self.table = {g: tuple(math.log((counts[t][g] + 0.1) / totals[t]) for t in self.tags) for g in vocab}
        self.weight = weight
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.tags)))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "words": {}, "rows": self.rows[:1024]}

    def _row(self, word: str) -> int:
        """The row of a word, worked out when it is met first."""
        k = self.words[word] = len(self.words)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        known = [row for g in _grams(word) if (row := self.table.get(g))]
        x = np.mean(known, axis=0) * self.weight * min(1.0, len(known) / 3) if known else np.zeros(len(self.tags))
        self.rows[k] = x - x.mean()
        return k

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log posteriors up to a constant: a row for each text, columns in the order of ``tags``."""
        if len(self.words) > 300_000:
            self._forget()
        get, at, counts = self.words.get, [], []
        for t in texts:
            words = _WORD.findall((t if t.isascii() else unicodedata.normalize("NFC", t)).lower())
            counts.append(len(words))
            at += [k if (k := get(w)) is not None else self._row(w) for w in words]
        out = np.zeros((len(texts), len(self.tags)))
        counts = np.array(counts, np.int64)
        if has := np.flatnonzero(counts).tolist():
            starts = (np.cumsum(counts) - counts)[has]
            out[has] = np.add.reduceat(self.rows[np.array(at)], starts, axis=0)
        return out

    def best(self, texts: list[str]) -> list[str]:
        return [self.tags[i] for i in self.scores(texts).argmax(1)]


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag_col: str = "lang", per_language: int = 250) -> Languages:
    """The classifier fitted on up to ``per_language`` labelled documents of each language (the bound of the sample; the
    least by a hash of their ids). Only ids and tags are ranked; the texts of the chosen are then fetched."""
    tags = docs.select(F.col(id_col).alias("id"), F.lower(F.split(F.trim(F.col(tag_col)), "[-_]")[0]).alias("tag")).where("tag is not null and length(tag) between 2 and 3 and tag != 'und'")
    known = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    tags = tags.withColumn("tag", F.coalesce(known[F.col("tag")], F.col("tag"))).where("length(tag) = 2")
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.xxhash64("id"), "id"))
    chosen = tags.distinct().withColumn("r", rank).where(F.col("r") <= per_language).select("id", "tag")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("tag", "text").distinct()
    return Languages([(r.tag, r.text) for r in texts.where("text is not null").collect()])
