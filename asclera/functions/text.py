"""Text functions: Column -> Column, in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from asclera.config import QUALIFIERS, SECTION_PRIORS

#: White space as Unicode has it, inside a character class.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once; a plain reference would be put into every lambda that uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clinical_tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits, hyphens and slashes."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(r"[A-Za-z0-9\-/]+"), 0)


def token_count(c: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text_or_empty(c), F.lit(f"[^{SPACE}]+"))


def sentences(c: Column) -> Column:
    """Pieces between runs of . ! ? that have anything but white space."""
    return F.regexp_count(text_or_empty(c), F.lit(f"[^.!?{SPACE}][^.!?]*"))


def words(c: Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(f"{WORD}+"))


def syllables(c: Column) -> Column:
    """Vowel runs of all words; a word without one counts as one."""
    low = F.lower(text_or_empty(c))
    dry = rf"(?<!{WORD})(?:(?![aeiouy]){WORD})+(?!{WORD})"
    return F.regexp_count(low, F.lit("[aeiouy]+")) + F.regexp_count(low, F.lit(dry))


def fkgl(c: Column) -> Column:
    """Flesch-Kincaid grade; 0 without sentences or words."""

    def grade(n: Column) -> Column:
        w = n["w"]
        return F.when((n["s"] == 0) | (w == 0), 0.0).otherwise(F.lit(0.39) * (w / n["s"]) + F.lit(11.8) * (n["y"] / w) - F.lit(15.59))

    return let(F.struct(sentences(c).cast("double").alias("s"), words(c).cast("double").alias("w"), syllables(c).cast("double").alias("y")), grade)


def qualifier(c: Column, name: str, patterns: Mapping[str, str] = QUALIFIERS) -> Column:
    """Whether the text has a whole word or phrase of the pattern, where letters and digits of any script make words."""
    p = patterns[name].replace(r"\s", f"[{SPACE}]")
    return text_or_empty(c).rlike(rf"(?i)(?<!{WORD})({p})(?!{WORD})")


def section_weight(c: Column, priors: Mapping[str, float] = SECTION_PRIORS) -> Column:
    """The highest prior of the headings at the start of a line; a heading has the priors of all labels that it contains."""
    escaped = "|".join(k.replace("-", r"\-") for k in priors)
    found = F.regexp_extract_all(text_or_empty(c), F.lit(rf"(?imd)^[{SPACE}]*({escaped})[{SPACE}]*[:\-]"), 1)
    best = {k: max(w for key, w in priors.items() if key in k) for k in priors}
    of = F.create_map(*[F.lit(x) for kv in best.items() for x in kv])
    return F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(found, lambda x: of[F.lower(x)])), F.lit(1.0)))


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of the text with a blank on either side."""
    return let(F.concat(F.lit(" "), c, F.lit(" ")), lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3)))))


def seeded(c: Column, modulus: int = 1 << 32) -> Column:
    """The first 32 bits of the md5 of c, as a number: a hash that other engines have as well."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % modulus
