import random

import numpy as np
import pytest

from asclera.llm import leakage as L


def brute(item, doc):
    """Matches of the best affine-gap alignment, cell by cell; of equal scores the one with more matches."""
    neg = (-(10**9), 0)
    h = [[(0, 0)] * (len(doc) + 1) for _ in range(len(item) + 1)]
    e = [[neg] * (len(doc) + 1) for _ in range(len(item) + 1)]
    f = [[neg] * (len(doc) + 1) for _ in range(len(item) + 1)]
    best = (0, 0)
    add = lambda x, s, m=0: (x[0] + s, x[1] + m)
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            e[i][j] = max(add(e[i - 1][j], -L.EXTEND), add(h[i - 1][j], -L.OPEN))
            f[i][j] = max(add(f[i][j - 1], -L.EXTEND), add(h[i][j - 1], -L.OPEN))
            s = add(h[i - 1][j - 1], L.MATCH, 1) if item[i - 1] == doc[j - 1] else add(h[i - 1][j - 1], L.MISMATCH)
            h[i][j] = max((0, 0), s, e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best[1]


def test_alignment_equals_cell_by_cell():
    rng = random.Random(1)
    items, docs = [], []
    for _ in range(120):
        item = rng.choices(range(6), k=rng.randrange(1, 14))
        doc = rng.choices(range(6), k=rng.randrange(0, 6)) + item[: rng.randrange(len(item) + 1)] + rng.choices(range(6), k=rng.randrange(0, 5)) + item[rng.randrange(len(item)) :]
        items.append(item)
        docs.append(doc)
    a = np.full((120, 14), -1)
    b = np.full((120, max(map(len, docs))), -2)
    for k in range(120):
        a[k, : len(items[k])], b[k, : len(docs[k])] = items[k], docs[k]
    assert L.align(a, b).tolist() == [brute(i, d) for i, d in zip(items, docs, strict=True)]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(4000)]
    items = {100 + k: rng.choices(words, k=60) for k in range(6)}
    noise = lambda n: rng.choices(words, k=n)
    edited = [w for w in items[101] if rng.random() > 0.08]
    docs = {
        1: " ".join(noise(200) + items[100] + noise(100)), 2: " ".join(noise(50) + edited + noise(50)), 3: " ".join(noise(50) + items[102][:30] + noise(50)),
        4: " ".join(noise(50) + items[102][:12] + noise(50)), 5: " ".join(noise(20) + sorted(items[103]) + noise(20)), 6: " ".join(items[104][:30] + noise(15) + items[104][30:]),
        7: ",\n".join(w.upper() for w in items[105]), 8: " ".join(items[100]).replace("o", "о"), 9: None, 10: "", 11: "word1 word2", 12: " ".join(noise(30_000) + items[103]),
        13: " ".join(items[100][:15] + noise(400) + items[100][15:24]),
    }
    rows = [(k, v, "x") for k, v in docs.items()] + [(1, docs[1], "again")] + [(500 + i, " ".join(items[104]), "hot") for i in range(8)]
    it = [(k, " ".join(v), "y") for k, v in items.items()] + [(100, " ".join(items[100]), "again"), (900, " ".join(items[100]), "same"), (901, None, ""), (902, "", ""), (903, "two words", ""), (904, "Word2,", ""), (905, "word2 word1", "")]
    d, i = spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(it, "item_id long, item_text string, doc_id string")
    return d, i, [{(r.doc_id, r.item_id) for r in L.find_leaks(d, i, "doc_id", "text", "item_id", "item_text", p).collect()} for p in (None, L.Leakage(block=2), L.Leakage(block_chars=500))]


def test_leaks(found):
    want = {(1, 100), (1, 900), (2, 101), (3, 102), (6, 104), (7, 105), (8, 100), (8, 900), (12, 103), (11, 904)} | {(500 + i, 104) for i in range(8)}
    for got in found[2]:
        assert {(d, i) for d, i in got if i != 904 or d == 11} == want
        assert all(d in (1, 2, 3, 4, 5, 6, 7, 8, 12, 13) or d >= 500 for d, i in got if i == 904 and d != 11)


def test_short_items_whole_and_recall_by_rate_of_edits(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(4000)]
    items = [rng.choices(words, k=60) for _ in range(120)]
    docs = [(1000 * r + k, " ".join(rng.choices(words, k=40) + [rng.choice(words) if rng.random() * 100 < r else w for w in item] + rng.choices(words, k=40))) for r in (5, 10, 15, 20) for k, item in enumerate(items)]
    got = L.find_leaks(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "i long, t string"), "d", "t", "i", "t")
    rates = {r: 0 for r in (5, 10, 15, 20)}
    for d, i, _ in got.collect():
        assert d % 1000 == i
        rates[d // 1000] += 1
    assert rates[5] == rates[10] == 120 and rates[15] >= 114 and rates[20] >= 102


def test_empty_tables(found):
    d, i, _ = found
    for docs, items in ((d.where("false"), i), (d, i.where("false"))):
        assert L.find_leaks(docs, items, "doc_id", "text", "item_id", "item_text").count() == 0


def test_finds_items_in_many_copies_and_versions_and_short_ones(spark):
    base = [f"word{i}" for i in range(50)]
    versions = [[*base[:k], f"other{k}", *base[k + 1 :]] for k in (5, 20, 35, 45)]
    short = "seven short words make one little item plus".split()
    items = [(i, " ".join(base)) for i in range(5)] + [(10 + i, " ".join(v)) for i, v in enumerate(versions)] + [(20, " ".join(short))]
    docs = [(1, "before " + " ".join(base) + " after"), (2, "x " + " ".join(base[22:44]) + " y"), (3, "nothing of it"), (4, "z " + " ".join(short[2:6]) + " z")]
    got = L.find_leaks(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string"), "d", "t", "i", "t")
    want = {(d, i) for d in (1, 2) for i in [*range(5), *range(10, 14)]} | {(4, 20)}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
