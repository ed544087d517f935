import unicodedata

import pytest

from asclera.llm import confusables as C


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("café", "café", True), ("ｆｕｌｌ １２", "full 12", True), ("a​b﻿c­", "abc", True), ("a b　c d", "a b c d", True), ("раin", "pain", True), ("Νausea", "Nausea", True), ("Ꮲain", "Pain", True), ("ꓑain", "Pain", True), ("Ⲣain", "Pain", True), ("ᴄold", "cold", True), ("ꓑꓮ", "PA", False), ("ᎪᎷ", "AM", False), ("ﬁne ﬂu", "fine flu", True),
        ("5 µg", "5 μg", True), ("a‑b‐c", "a-b-c", True), ("（12）， a", "(12), a", True), ("𝐛old", "bold", True), ("⁠x", "x", True),
        ("café", "cafe", False), ("Pain", "pain", False), ("pain.", "pain", False), ("3⁵", "35", False), ("5 mg", "5 µg", False), ("a  b", "a b", False), ("сор", "cop", False), ("ΑΒ", "AB", False), ("a\nb", "a b", False), ("0", "O", False), ("ß", "ss", False), ("½", "1/2", False),
    ],
)
def test_skeleton(a, b, same):
    assert (C.skeleton(a) == C.skeleton(b)) is same


def test_consistent_form_is_stable():
    for t in ("café раin ５ µg", "Можно ли принимать", "Μετά την επέμβαση", "plain", "", "é​"):
        form = C.consistent(t)
        assert C.consistent(form) == form == unicodedata.normalize("NFC", form) and C.skeleton(form) == C.skeleton(t)
    assert C.consistent("Μετά την") == "Μετά την" and C.consistent("Можно ли") == "Можно ли" and C.skeleton(None) is None and C.consistent(None) is None


def test_pairs(spark):
    rows = [(1, "pain"), (2, "раin"), (3, "pain"), (4, "pa​in"), (5, None), (6, ""), (7, "​"), (8, "Pain"), (2, "раin"), (9, "x" * 50_000), (10, "x" * 49_999 + "ｘ")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, look int")
    got = sorted(tuple(r) for r in C.lookalike_pairs(df, "doc_id", "text").collect())
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7), (9, 10)]
    forms = {r.id: r.form for r in C.consistent_texts(df, "doc_id", "text").collect()}
    assert forms[2] == forms[4] == "pain" and forms[5] is None and forms[7] == ""
    assert C.lookalike_pairs(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_a_third_of_the_rows_look_the_same(spark):
    rows = [(i, "hot text") for i in range(40)] + [(100, "hоt text")] + [(200 + i, f"other {i}") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, t string")
    assert C.lookalike_pairs(df, "id", "t").count() == C.lookalike_pairs(df, "id", "t", hot=7).count() == 40


def test_a_table_from_a_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("\ufeff# a comment\n\n13D2 ;\t0057 ;\tMA\t# W\n2CA6 ; 0054 ; MA\n0031 ; 006C ; MA # a digit stays\n2573 ; 0058 ; MA # box\n0430 ; 0061 ; MA\n0448 ; 006D 006D ; MA\n", "utf-8")
    table = C.read_table(str(tmp_path / "list.txt"))
    assert C.skeleton("a╳b", table) == "aXb" != C.skeleton("a╳b") and C.skeleton("Ꮢater", table) == "Water" and C.skeleton("шa 11", table) == "mma 11" and C.skeleton("шаш", table) == "шаш"
    df = spark.createDataFrame([(1, "a╳b"), (2, "aXb")], "id long, t string")
    assert C.lookalike_pairs(df, "id", "t").count() == 0 and C.lookalike_pairs(df, "id", "t", table).count() == 1
    assert {r.form for r in C.consistent_texts(df, "id", "t", table).collect()} == {"aXb"}
