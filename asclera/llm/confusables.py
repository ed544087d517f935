"""One consistent form for text that looks the same: a confusables skeleton, and groups of texts with equal skeletons.

A skeleton decomposes the text canonically, replaces every character by the prototype that it looks like, drops what is
invisible, and decomposes again. Accents, case, punctuation marks, raised digits, digits and units stay apart. Letters of
Greek or Cyrillic words are genuine as long as the whole word is of that script; in a word that also has letters of another
script they become the letters that they look like. A single space is a single space, however wide; other runs of white
space stay as they are.

The table of look-alike letters here has those of six scripts beside Latin ones. A larger one, such as the public list of Unicode TS 39, is a
parameter (``read_table``): letters of other scripts in it follow the same rule, all other characters that are not ASCII always
become their prototypes.

Defined results: a null text has a null skeleton and takes part in no group; an empty text has an empty one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclera.runtime import materialize, spread

# Letters of other scripts and the Latin letters that they look like, in the same order.
CYRILLIC = "АВСЕНІЈКМОРЅТХҮаԁсеһіјӏоԛрѕԝхуѵԌԚԜґ"
CYRILLIC_LATIN = "ABCEHIJKMOPSTXYadcehijloqpswxyvGQWr"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹαγικνορυχϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXCayikvopuxcj"
OTHER = "ıɑɡʏɩ⍺ᴄᴏꜱᴜᴠᴡᴢ"
OTHER_LATIN = "iagyiacosuvwz"
ARMENIAN = "ՕՏՍհոսօցԼ"
ARMENIAN_LATIN = "OSUhnuogL"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏙᏚᏞᏟᏢᏦᏴ"
CHEROKEE_LATIN = "DRTAJEWMHGZ4VSLCPKB"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_LATIN = "BPDTGKJCZFMNLSRVHWXYAEIOU"
COPTIC = "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ"
COPTIC_LATIN = "ABEHIKMNOPCTYXopc"
# Marks that look like plainer ones. A Greek mu looks like a micro sign, in a Greek word as well.
MARKS = {"‐": "-", "‑": "-", "․": ".", "∶": ":", "։": ":", "ǃ": "!", ";": ";", "μ": "µ"}
# Decompositions that change neither the meaning nor more than the width or the face of a character.
_KEPT = ("<wide>", "<narrow>", "<font>", "<noBreak>")
_LIGATURES = range(0xFB00, 0xFB07)


def _is_space(ch: str) -> bool:
    return unicodedata.category(ch) == "Zs"


def _is_invisible(ch: str) -> bool:
    cp = ord(ch)
    return unicodedata.category(ch) == "Cf" or ch == "͏" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5) or 0x180B <= cp <= 0x180F


class _Plain(dict):
    """character -> what it looks like, worked out from the character database once a character and process."""

    def __missing__(self, ch: str) -> str:
        if ch in MARKS:
            out = MARKS[ch]
        elif _is_space(ch):
            out = " "
        elif _is_invisible(ch):
            out = ""
        elif ord(ch) in _LIGATURES:
            out = unicodedata.normalize("NFKD", ch)
        elif (d := unicodedata.decomposition(ch)).startswith(_KEPT):
            out = "".join(self[chr(int(x, 16))] for x in d.split()[1:])
        else:
            out = OTHER_LOOK.get(ch, ch)
        self[ch] = out
        return out


OTHER_LOOK = dict(zip(OTHER, OTHER_LATIN, strict=True))
PLAIN = _Plain()
_LOOK = str.maketrans(CYRILLIC + GREEK + ARMENIAN + CHEROKEE + LISU + COPTIC, CYRILLIC_LATIN + GREEK_LATIN + ARMENIAN_LATIN + CHEROKEE_LATIN + LISU_LATIN + COPTIC_LATIN)
_L = "a-zA-Z\u00aa\u00ba-\u02af"
#: The letters of each other script: Greek, Cyrillic, Armenian, Cherokee, Lisu, Coptic.
_SCRIPTS = ("\u0370-\u03e1\u03f0-\u03ff\u1f00-\u1fff", "\u0400-\u052f", "\u0531-\u0587", "\u13a0-\u13ff\uab70-\uabbf", "\ua4d0-\ua4f7", "\u03e2-\u03ef\u2c80-\u2cf3")
#: Letters of another script, with their combining marks and the letters on either side that aren't of that script.
_FOREIGN = re.compile("|".join(f"[{x}](?:[{x}\u0300-\u036f])*" for x in _SCRIPTS))
_LETTER = re.compile(f"[{_L}{''.join(_SCRIPTS)}]")
_OF_SCRIPT = re.compile(f"[{''.join(_SCRIPTS)}]")
_WORD = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f])+")


def _in_mixed_word(text: str, start: int, end: int) -> bool:
    """Whether the run of one script stands beside a letter of another."""
    while start and "\u0300" <= text[start - 1] <= "\u036f":
        start -= 1
    return bool(start and _LETTER.match(text[start - 1]) or end < len(text) and _LETTER.match(text[end]))


def read_table(path: str) -> dict[str, str]:
    """Character -> prototype, from a file in the format of the public list of confusables: ``0430 ; 0061 ; MA # ...``. ASCII
    characters stay as they are, as digits, case and marks make a visible difference."""
    out = {}
    for line in Path(path).read_text("utf-8-sig").splitlines():
        cells = [c.strip() for c in line.partition("#")[0].split(";")]
        if len(cells) >= 2 and len(cells[0].split()) == 1 and (ch := chr(int(cells[0], 16))) > "\x7f":
            out[ch] = "".join(chr(int(x, 16)) for x in cells[1].split())
    return out


def skeleton(text: str | None, table: Mapping[str, str] | None = None) -> str | None:
    """The form by which two texts that look the same are equal."""
    if text is None or text.isascii():
        return text
    plain = unicodedata.normalize("NFD", text)
    for ch in set(plain):
        if ch > "\x7f":
            look = PLAIN[ch]
            if table and look == ch and not _OF_SCRIPT.match(ch):
                look = table.get(ch, ch)
            if look != ch:
                plain = plain.replace(ch, look)
    if not plain.isascii() and any(_in_mixed_word(plain, *m.span()) for m in _FOREIGN.finditer(plain)):
        looks = {**{ord(k): v for k, v in table.items() if _OF_SCRIPT.match(k)}, **_LOOK} if table else _LOOK
        plain = _WORD.sub(lambda m: w.translate(looks) if any(_in_mixed_word(w := m.group(), *x.span()) for x in _FOREIGN.finditer(m.group())) else m.group(), plain)
    return plain if plain.isascii() else unicodedata.normalize("NFD", plain)


def consistent(text: str | None, table: Mapping[str, str] | None = None) -> str | None:
    """The form in which to store the text: its skeleton, composed."""
    s = skeleton(text, table)
    return s if s is None or s.isascii() else unicodedata.normalize("NFC", s).replace("µ", "μ")


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def _hashes(table: Mapping[str, str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, look, stored = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t is not None:
                    s = skeleton(t, table)
                    ids.append(i)
                    look.append(xxhash.xxh3_128_digest(s))
                    stored.append(_hash(t))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(look, pa.binary()), pa.array(stored, pa.int64())], names=["id", "look", "stored"])

    return run


def _forms(table: Mapping[str, str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([consistent(t, table) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "form"])

    return run


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))


def consistent_texts(df: DataFrame, id_col: str, text_col: str, table: Mapping[str, str] | None = None) -> DataFrame:
    """(id, form) of every row of df."""
    return _texts(df, id_col, text_col).mapInArrow(_forms(table), "id long, form string")


def lookalike_classes(df: DataFrame, id_col: str, text_col: str, table: Mapping[str, str] | None = None) -> DataFrame:
    """(id, look, stored) of the rows whose look is also stored otherwise: 128 bits of the skeleton's hash, 64 of the stored
    text's. Only hashes are shuffled; whether a look is stored in more than one way is a partial aggregate."""
    h = _texts(df, id_col, text_col).mapInArrow(_hashes(table), "id long, look binary, stored long")
    various = h.groupBy("look").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo != hi").select("look")
    return h.join(various, "look", "left_semi").distinct()


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, table: Mapping[str, str] | None = None, hot: int = 1000) -> DataFrame:
    """(a, b), a < b: ids whose texts look the same but are stored differently. The ways to store a look are paired first, then
    their ids, so that copies meet only what they are paired with; ways with more than ``hot`` ids meet them in parts."""
    c = materialize(lookalike_classes(df, id_col, text_col, table), "looks")
    kinds = c.select("look", "stored").distinct()
    other = kinds.withColumnRenamed("stored", "stored_b")
    differ = kinds.join(other, "look").where("stored < stored_b")
    sizes = c.groupBy("look", "stored").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts"))
    one = c.join(sizes, ["look", "stored"]).select("look", "stored", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    two = c.select("look", F.col("stored").alias("stored_b"), F.col("id").alias("y"))
    in_parts = differ.join(sizes, ["look", "stored"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = in_parts.join(two, ["look", "stored_b"]).join(one, ["look", "stored", "part"])
    return pairs.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
