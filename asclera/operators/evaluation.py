"""Splits, overlap and readability metrics, and the experiment grid."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asclera.config import Lexicon
from asclera.functions.stem import stem
from asclera.functions.text import fkgl, seeded
from asclera.operators.faithfulness import category_f1, macro, with_presence

_ROUGE = re.compile(r"[a-z0-9]+")


def train_test_split(df: DataFrame, id_col: str, test: int | float = 0.2, seed: int = 42) -> DataFrame:
    """df with ``is_test``: exactly that many rows (or that share, rounded up), those with the least seeded hashes of their ids.

    The bound is found by counting buckets of the hash, so that no window ever sorts all rows in one task.
    """
    h = df.withColumn("_h", seeded(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))))
    n = df.count()
    want = min(n, test if isinstance(test, int) else math.ceil(test * n))
    cells = {r["c"]: r["n"] for r in h.groupBy(F.shiftright("_h", 20).alias("c")).agg(F.count("*").alias("n")).collect()}
    edge, below = -1, 0
    for c in sorted(cells):
        if below + cells[c] > want:
            edge = c
            break
        below += cells[c]
    else:
        return h.withColumn("is_test", F.lit(True)).drop("_h")
    cell = F.shiftright("_h", 20)
    rank = F.row_number().over(Window.partitionBy(F.col("_edge")).orderBy("_h", id_col))
    at_edge = h.where(cell == edge).select(id_col, "_h").withColumn("_edge", F.lit(edge)).withColumn("_r", rank).where(F.col("_r") <= want - below).select(id_col, F.lit(True).alias("_in"))
    return h.join(at_edge, id_col, "left").withColumn("is_test", (cell < edge) | F.coalesce("_in", F.lit(False))).drop("_h", "_in")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel in one integer."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    all_, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & all_
    return len(a) - row.bit_count()


def _rouge(stemmed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(200_000)(stem)

        def words(text: str | None) -> list[str]:
            found = _ROUGE.findall((text or "").lower())
            return [known(w) if len(w) > 3 else w for w in found] if stemmed else found

        for b in batches:
            out = []
            for p, r in zip(b.column("prediction").to_pylist(), b.column("reference").to_pylist(), strict=True):
                p, r = words(p), words(r)
                n = lcs(p, r) if p and r else 0
                out.append(2 * n / (len(p) + len(r)) if n else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "rouge_l"])

    return run


def rouge_l(df: DataFrame, stemmed: bool = False) -> DataFrame:
    """df with ``rouge_l`` of the columns prediction and reference: F1 of the common subsequence of their words, or of the stems
    of those of more than three letters; 0 if either is empty."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(_rouge(stemmed), schema + ", rouge_l double")


def bert_score(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], batch_size: int = 32) -> DataFrame:
    """df with ``bert_p``, ``bert_r`` and ``bert_f1`` of the columns prediction and reference: each token is matched with the
    most similar one of the other text. The encoder, made once a task, gives a matrix of token vectors for each text. Texts
    without tokens score 0."""

    def unit(m: np.ndarray) -> np.ndarray:
        m = np.asarray(m, float).reshape(len(m), -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for b in batches:
            out = []
            texts = [[t or "" for t in b.column(c).to_pylist()] for c in ("prediction", "reference")]
            for at in range(0, b.num_rows, batch_size):
                for p, r in zip(*(encode(t[at : at + batch_size]) for t in texts), strict=True):
                    sim = unit(p) @ unit(r).T if len(p) and len(r) else np.zeros((1, 1))
                    precision, recall = float(sim.max(1).mean()), float(sim.max(0).mean())
                    out.append((precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([x[i] for x in out], pa.float64()) for i in range(3)]], names=[*b.schema.names, "bert_p", "bert_r", "bert_f1"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", bert_p double, bert_r double, bert_f1 double")


def bleu(df: DataFrame, by: tuple[str, ...] = (), order: int = 4, id_col: str | None = None) -> DataFrame:
    """Corpus BLEU of prediction against reference over words between white space: (by, bleu). Not smoothed. ``id_col`` tells the
    rows of one group apart; without it they get a number."""
    if not by:
        return bleu(df.withColumn("_k", F.lit(1)), ("_k",), order, id_col).drop("_k")
    t = df.select(*by, (F.col(id_col) if id_col else F.monotonically_increasing_id()).alias("_id"), *[F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"[ \t\n\r\f]+"), lambda x: x != "").alias(c) for c in ("prediction", "reference")])
    lengths = t.groupBy(*by).agg(F.sum(F.size("prediction")).alias("c"), F.sum(F.size("reference")).alias("r"), *[F.sum(F.greatest(F.size("prediction") - (n - 1), F.lit(0))).alias(f"t{n}") for n in range(1, order + 1)])

    def starts(c: str, n: int) -> Column:
        last = F.size(c) - (n - 1)
        return F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)

    def of_order(c: str, n: int) -> Column:
        side = [F.lit(int(c == k)).alias(k[0]) for k in ("prediction", "reference")]
        return F.transform(starts(c, n), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(F.col(c), i, n), " ").alias("g"), *side))

    # both sides of a row leave it together, so that a row's number is drawn once
    grams = F.concat(*[of_order(c, n) for c in ("prediction", "reference") for n in range(1, order + 1)])
    each = t.select(*by, "_id", F.explode(grams).alias("x")).select(*by, "_id", "x.n", "x.g", "x.p", "x.r")
    both = each.groupBy(*by, "_id", "n", "g").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    matched = both.groupBy(*by).agg(*[F.sum(F.when(F.col("n") == n, F.least("p", "r")).otherwise(0)).alias(f"m{n}") for n in range(1, order + 1)])
    j = lengths.join(matched, list(by), "left")
    logs = sum((F.log(F.coalesce(F.col(f"m{n}"), F.lit(0)) / F.col(f"t{n}")) for n in range(1, order + 1)), F.lit(0.0)) / order
    zero = F.lit(False)
    for n in range(1, order + 1):
        zero = zero | (F.coalesce(F.col(f"m{n}"), F.lit(0)) == 0)
    brevity = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    return j.select(*by, F.when(zero, 0.0).otherwise(brevity * F.exp(logs)).alias("bleu"))


def metrics(pairs: DataFrame, by: tuple[str, ...] = (), lexicon: Lexicon | None = None, stemmed: bool = False, make_encoder: Callable | None = None, id_col: str | None = None) -> DataFrame:
    """One record for each value of ``by`` over (source, prediction, reference): n_samples, F1 of each category, macro_f1,
    chr_pct, fkgl, rouge_l (of stems if ``stemmed``) and bleu, and with an encoder of tokens bert_f1, rounded for a report."""
    flags = with_presence(pairs, lexicon)
    per = category_f1(flags, by)
    wide = per.groupBy(*by).pivot("category", ["Dx", "Rx", "Proc", "Fup"]).agg(F.round(F.first("f1"), 4))
    m = macro(per, by).select(*by, F.round("macro_f1", 4).alias("macro_f1"), F.round("chr_pct", 2).alias("chr_pct"), "risk")
    scored = rouge_l(pairs.select(*by, "prediction", "reference"), stemmed)
    scored = bert_score(scored, make_encoder) if make_encoder else scored
    means = [F.round(F.avg(c), 4).alias(c) for c in ("rouge_l", *["bert_f1"] * bool(make_encoder))]
    simple = scored.groupBy(*by).agg(F.count("*").alias("n_samples"), F.round(F.avg(fkgl(F.col("prediction"))), 1).alias("fkgl"), *means)
    b = bleu(pairs, by, id_col=id_col).withColumn("bleu", F.round("bleu", 4))
    if not by:
        key = [F.lit(1).alias("_k")]
        wide, m, simple, b = (x.select(*key, "*") for x in (wide, m, simple, b))
    on = list(by) or ["_k"]
    out = simple.join(m, on).join(wide, on).join(b, on)
    return out.drop("_k")
