"""Concept spans of texts and their categories, driven by a lexicon. All of it is built-in expressions.

Defined results: a null text has no spans; spans come in order of their start, then their length, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asclera.config import CATEGORIES, Lexicon
from asclera.functions.text import clinical_tokens, let

MAX_CONCEPTS = 40


def candidate_spans(c: Column, lexicon: Lexicon | None = None) -> Column:
    """Distinct spans of one to three tokens that have a seed word or a dose, in lower case."""
    lex = lexicon or Lexicon()

    def spans(t: Column) -> Column:
        return let(F.transform(t, lambda x: x.isin(*lex.seeds) | x.rlike(lex.dose_seed)), lambda flags: around(t, flags))

    def around(t: Column, flags: Column) -> Column:
        def flag(i: Column) -> Column:
            return F.coalesce(F.get(flags, i - 1), F.lit(False))

        def at(i: Column) -> Column:
            one, two, three = flag(i), flag(i) | flag(i + 1), flag(i) | flag(i + 1) | flag(i + 2)
            lengths = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: (i + k - 1 <= F.size(t)) & F.when(k == 1, one).when(k == 2, two).otherwise(three))
            return F.transform(lengths, lambda k: F.array_join(F.slice(t, i, k), " "))

        near = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: flag(i) | flag(i + 1) | flag(i + 2))
        return F.filter(F.array_distinct(F.flatten(F.transform(near, at))), lambda s: F.length(s) >= 2)

    return let(F.transform(clinical_tokens(c), F.lower), spans)


def category(span: Column, lexicon: Lexicon | None = None) -> Column:
    """Fup, Proc, Rx, Dx or Other: the first whose words or pattern the span has."""
    lex = lexicon or Lexicon()

    def has(w: Column, name: str) -> Column:
        return F.exists(w, lambda x: x.isin(*lex.words[name]))

    def decide(s: Column) -> Column:
        w = F.split(s, " ")
        return (
            F.when(has(w, "Fup"), "Fup").when(has(w, "Proc") | s.rlike(lex.proc_suffix), "Proc").when(has(w, "Rx") | s.rlike(lex.dose), "Rx")
            .when(has(w, "Dx") | s.rlike(lex.dx_suffix), "Dx").otherwise("Other")
        )

    return let(F.lower(span), decide)


def concepts(c: Column, lexicon: Lexicon | None = None, most: int = MAX_CONCEPTS) -> Column:
    """array<struct<span, category>> of the first ``most`` spans that have a category."""
    pairs = F.transform(candidate_spans(c, lexicon), lambda s: F.struct(s.alias("span"), category(s, lexicon).alias("category")))
    return F.slice(F.filter(pairs, lambda p: p["category"] != "Other"), 1, most)


def buckets(c: Column, lexicon: Lexicon | None = None, most: int = MAX_CONCEPTS) -> Column:
    """struct of the spans of each category."""

    def spans_in(found: Column, name: str) -> Column:
        return F.transform(F.filter(found, lambda p: p["category"] == name), lambda p: p["span"]).alias(name)

    return let(concepts(c, lexicon, most), lambda found: F.struct(*[spans_in(found, k) for k in CATEGORIES]))


def presence(c: Column, lexicon: Lexicon | None = None, most: int = MAX_CONCEPTS) -> Column:
    """struct of a boolean for each category."""
    return let(F.transform(concepts(c, lexicon, most), lambda p: p["category"]), lambda found: F.struct(*[F.array_contains(found, k).alias(k) for k in CATEGORIES]))


def exploded_spans(df: DataFrame, id_col: str, text_col: str, lexicon: Lexicon | None = None) -> DataFrame:
    """(id, pos, span), one row for each span."""
    out = df.select(F.col(id_col), F.posexplode(candidate_spans(F.col(text_col), lexicon)).alias("pos", "span"))
    return out.select(id_col, F.col("pos").cast("long").alias("pos"), "span")
