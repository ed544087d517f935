import pytest

from asclera.operators import kg as K

ROWS = [(1, "Metformin", "treats", "Diabetes"), (2, "Diabetes", "is_a", "Disease"), (3, "Metformin", "sold_by", "Acme"), (4, "metformin", "treats", "diabetes"), (5, "Aspirin", "", "Pain"), (6, " ", "treats", "X"), (7, None, None, None)]


@pytest.fixture
def triples(spark):
    return K.load_triples(spark.createDataFrame(ROWS, "triple_id long, head string, relation string, tail string"))


def test_load(triples):
    got = {r.triple_id: r.relation for r in triples.collect()}
    assert got == {1: "treats", 2: "is_a", 3: "sold_by", 4: "treats", 5: "associated_with"}
    assert [r.node for r in K.nodes(triples).orderBy("node_id").collect()] == ["metformin", "diabetes", "disease", "acme", "aspirin", "pain"]


def test_subgraph(spark, triples):
    e = spark.createDataFrame([(1, "metformin"), (1, "diabetes"), (2, "qqqq"), (3, "aspirin")], "query_id long, entity string")
    got = {}
    for r in K.subgraph(e, triples).orderBy("query_id", "ord").collect():
        got.setdefault(r.query_id, []).append((r.head, r.relation, r.tail))
    assert got[1] == [("Metformin", "treats", "Diabetes"), ("metformin", "treats", "diabetes"), ("Diabetes", "is_a", "Disease")]
    assert got[2][0] == ("Metformin", "treats", "Diabetes") and len(got[2]) == 3  # nothing similar: the first three nodes
    assert got[3] == [("Aspirin", "associated_with", "Pain")]
    assert K.subgraph(e, triples, max_triples=0).count() == 0


def test_context(spark):
    s = spark.createDataFrame([(1, 2, "c", "treats", "d"), (1, 1, "a", "is_a", "b")], "query_id long, ord long, head string, relation string, tail string")
    assert K.kg_context(s).first().knowledge == "• (a) --[is_a]--> (b)\n• (c) --[treats]--> (d)"


def test_similar_pairs_equal_brute_force(spark):
    import math
    import random

    rng = random.Random(3)
    words = ["".join(rng.choices("abc ", k=rng.randrange(1, 9))).strip() or "a" for _ in range(150)]

    def grams(s):
        s = f" {s} "
        return {s[i : i + 3] for i in range(len(s) - 2)}

    a, b = sorted(set(words[:70])), sorted(set(words[70:]))
    want = {(x, y) for x in a for y in b if round(len(grams(x) & grams(y)) / math.sqrt(len(grams(x)) * len(grams(y))), 6) >= 0.7}
    left, right = (spark.createDataFrame([(x,) for x in s], "s string") for s in (a, b))
    assert {(r.a, r.b) for r in K.similar_pairs(left, right, 0.7).collect()} == want


def test_aliases(spark):
    df = spark.createDataFrame([("Lasix", "Rx"), ("Lasix", "Dx"), ("Diabetes", "Dx"), ("diabetes", "Fup"), (None, "Rx")], "s string, c string")
    assert [r[0] for r in df.select(K.normalised(df.s, df.c)).collect()] == ["furosemide (rxnorm:4603)", "Lasix", "diabetes mellitus (disorder)", "diabetes", None]
