import numpy as np
import pytest
from pyspark.sql import functions as F

from asclera.operators import prompts as P
from asclera.operators import retrieval as R

M = [(1.0, (1, 0)), (0.9, (1, 0)), (0.5, (0, 1)), (0.1, (0.6, 0.8))]


def chosen(spark, cases):
    """The places that mmr_select takes of each case (relevances, tokens, vectors), in order."""
    rows = [(q, i, float(r), i + 1, n, [float(x) for x in v]) for q, (rel, tokens, vectors) in enumerate(cases) for i, (r, n, v) in enumerate(zip(rel, tokens, vectors, strict=True))]
    return spark.createDataFrame(rows, "query_id long, passage_id long, score double, rank long, n_tokens int, vector array<double>")


def places(df, cases):
    got = {q: [] for q in range(cases)}
    for r in df.orderBy("query_id", "ord").collect():
        assert r.ord == len(got[r.query_id]) + 1
        got[r.query_id].append(r.passage_id)
    return [got[q] for q in range(cases)]


@pytest.mark.parametrize(
    ("tokens", "lam", "budget", "want"),
    [((1, 1, 1, 1), 0.7, 512, [0, 1, 2, 3]), ((1, 1, 1, 1), 0.5, 512, [0, 2, 1, 3]), ((4, 5, 3, 2), 0.7, 8, [0, 2]), ((4, 5, 3, 2), 0.7, 3, [0])],
)
def test_mmr(spark, tokens, lam, budget, want):
    df = chosen(spark, [([r for r, _ in M], tokens, [v for _, v in M])])
    assert places(R.mmr_select(df, budget, lam), 1) == [want]


def test_mmr_falls_back_to_relevance_and_equals_a_plain_loop(spark):
    v = [(1, 0), (0, 1), (1, 0), (0, 1)]
    assert places(R.mmr_select(chosen(spark, [([1.0, 0.9, 0.5, 0.4], [4, 9, 2, 2], v)]), 8, 0.5), 1) == [[0, 2, 3]]
    rng = np.random.default_rng(1)
    cases = [(np.sort(rng.integers(0, 9, n))[::-1], rng.integers(1, 9, n).tolist(), rng.normal(size=(n, 3))) for n in rng.integers(1, 11, 40)]

    def loop(rel, tokens, vectors, budget, lam):
        rel = np.array(rel, float)
        rel = (rel - rel.min()) / (rel.max() - rel.min()) if rel.max() > rel.min() else rel
        unit = np.array([x / (np.sqrt(x @ x) + 1e-9) for x in np.asarray(vectors, float)])
        free, out, used = set(range(len(rel))), [], 0
        while free and used < budget:
            value = {i: rel[i] if not out else round(lam * rel[i] - (1 - lam) * max(unit[i] @ unit[j] for j in out), 9) for i in free}
            top = min(free, key=lambda i: (-value[i], i))
            if out and used + tokens[top] > budget:
                free -= {top}
                small = [i for i in free if used + tokens[i] <= budget]
                if not small:
                    break
                top = min(small, key=lambda i: (-rel[i], i))
            free -= {top}
            out += [top]
            used += tokens[top]
        return out

    for budget, lam in ((15, 0.7), (10**6, 1.0), (6, 0.2)):
        assert places(R.mmr_select(chosen(spark, cases), budget, lam), len(cases)) == [loop(*c, budget, lam) for c in cases]
    assert R.mmr_select(chosen(spark, cases).where("false")).count() == 0


def test_rerank_golden(spark):
    c = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (1, 3, 0.0), (2, 1, 5.0), (2, 2, 5.0)], "query_id long, passage_id long, score double")
    q = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id long, vector array<double>")
    p = spark.createDataFrame([(1, [0.1]), (2, [0.9]), (3, [0.5])], "id long, vector array<double>")
    got = [(r.query_id, r.passage_id, r.score) for r in R.rerank(c, q, p).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 0.7), (1, 1, 0.55), (1, 3, 0.25), (2, 2, 0.95), (2, 1, 0.55)]


def test_sparse_top_k_pads_breaks_ties_and_ignores_blanks(spark):
    p = spark.createDataFrame([(5, "heart pain"), (2, "heart pain"), (9, "lungs"), (9, "lungs"), (1, None), (3, "  "), (7, "Indications: heart")], "passage_id long, text string")
    q = spark.createDataFrame([(1, "Heart"), (2, None), (3, " ")], "query_id long, question string")
    got = [(r.query_id, r.passage_id, r.score) for r in R.sparse_top_k(q, p, 4).orderBy("query_id", "rank").collect()]
    a = round(np.log(2) ** 2, 6)
    assert got == [(1, 7, round(1.5 * np.log(2) ** 2, 6)), (1, 2, a), (1, 5, a), (1, 9, 0.0)]


def test_index_is_written_read_and_gives_what_brute_force_gives(spark, tmp_path):
    import math
    import random
    from collections import Counter

    from asclera.sources.sinks import write_index
    from asclera.sources.tables import load_index

    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 30))) for _ in range(300)]
    p = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    write_index(R.build_index(p, prior=None), str(tmp_path / "index"))
    index = load_index(spark, str(tmp_path / "index"))
    q = p.where("id < 12")
    w = [{t: math.log1p(n) for t, n in Counter(x.split()).items()} for x in texts]
    for block in (1000, 5):
        got = {}
        for r in R.retrieve(q, index, 7, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.passage_id, r.score))
        for i in range(12):
            scores = [(round(sum(x * w[j].get(t, 0) for t, x in w[i].items()), 6), -j) for j in range(300)]
            want = sorted(scores, reverse=True)[:7]
            assert [j for j, _ in got[i]] == [-j for _, j in want] and np.allclose([s for _, s in got[i]], [s for s, _ in want], atol=2e-6)


def test_model_encoders_and_pooling(spark):
    vocabulary = ["pain", "heart", "lung"]

    def make():
        def model(texts):
            return [R.pooled_terms(np.array([[3.0 if v == t else -1.0 for v in vocabulary] for t in x.split()]), vocabulary) for x in texts]

        return model

    p = spark.createDataFrame([(1, "heart pain"), (2, "lung"), (3, "arm")], "id long, text string")
    got = [(r.passage_id, r.score) for r in R.sparse_top_k(p.where("id = 1"), p, 3, R.ModelEncoder(make, 2), None).orderBy("rank").collect()]
    assert got == [(1, round(2 * np.log1p(3) ** 2, 6)), (2, 0.0), (3, 0.0)]
    logits = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", -2.0), (2, "a", None)], "id long, term string, logit double")
    assert [tuple(r) for r in R.term_pooling(logits).collect()] == [(1, "a", np.log1p(3))]

    def fails():
        raise OSError("no model")

    assert R.first_that_works(fails, lambda: R.WORDS) is R.WORDS
    for makers, only in (((fails, lambda: R.WORDS), True), ((fails, fails), False)):
        with pytest.raises(RuntimeError, match="no model"):
            R.first_that_works(*makers, only_first=only)


def test_blocks_of_queries_give_the_same(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "id long, vector array<double>")
    one, many = (sorted(map(tuple, R.dense_top_k(v, v, 5, block=b).collect())) for b in (1000, 7))
    assert one == many and len(one) == 300


def test_passes_and_runs_give_the_same(spark, monkeypatch):
    rng, words = np.random.default_rng(3), [f"w{i}" for i in range(30)]
    p, q = (spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(n)], "id long, text string") for n in (300, 25))
    index = R.build_index(p)
    one, many = (sorted(map(tuple, R.retrieve(q, index, 4, block=b, each=e).collect())) for b, e in ((1000, 8), (3, 2)))
    assert one == many and len(one) == 100
    heaviest, rows = R._heaviest_first, []
    monkeypatch.setattr(R, "_heaviest_first", lambda batches, vocabulary, each: (rows.append(b.num_rows) or b for b in heaviest(batches, vocabulary, each, 1)))
    asked = R.build_index(q, R.WORDS, None).collect()
    batches = index.toArrow().combine_chunks().to_batches(max_chunksize=70)
    found = R._merged([spark.createDataFrame(b.to_pandas(), R.RANKED) for b in R._sparse(asked, 4)(iter(batches))], 4)
    assert sorted(map(tuple, found.collect())) == one and rows == [70, 70, 70, 70, 20]


def test_empty_tables(spark):
    p, q = spark.createDataFrame([], "passage_id long, text string"), spark.createDataFrame([], "query_id long, question string")
    assert R.sparse_top_k(q, p).count() == 0


def test_evidence_block(spark):
    df = spark.createDataFrame([(["a\nb ", "c"],), ([],), ([str(i) for i in range(7)],)], "p array<string>")
    got = [r[0] for r in df.select(P.evidence_block(F.col("p"))).collect()]
    assert got == ["[E1] a b\n[E2] c", "(no evidence retrieved)", "\n".join(f"[E{i + 1}] {i}" for i in range(5))]


def test_fill_keeps_braces_and_percent(spark):
    df = spark.createDataFrame([("100% {x}", None)], "q string, e string")
    assert df.select(P.fill("a {q} b {e}!", q=F.col("q"), e=F.col("e"))).first()[0] == "a 100% {x} b !"


@pytest.mark.parametrize(("least", "words"), [(0, 40), (-3, 40), (0, 4000)])
def test_few_pairs_are_scored_twice_and_none_is_lost(monkeypatch, least, words):
    """Ties, ids given more than once, rows without terms, weights below 0; terms that all have, and terms that few have."""
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, m, k = 6000, 60, 5
    terms = [rng.choice(words, rng.integers(0, 12), replace=False) * 1_000_003 - 10**7 for _ in range(n + m)]
    weights = [rng.integers(least, 4, len(t)) / 7 for t in terms]
    ids, prior = rng.integers(0, 5500, n), rng.choice([1.0, 1.2], n)
    both = [pa.array([x.tolist() for x in v[:n]], pa.list_(t)) for v, t in ((terms, pa.int64()), (weights, pa.float64()))]
    index = pa.record_batch([pa.array(ids), pa.array(prior), *both], names=["id", "prior", "terms", "weights"])
    queries = [SimpleNamespace(id=100 + i, terms=terms[n + i].tolist(), weights=weights[n + i].tolist()) for i in range(m)]
    twice, exact = [], R._Search.exact
    monkeypatch.setattr(R._Search, "exact", lambda self, c, query, row: twice.append(len(query)) or exact(self, c, query, row))
    got = {q.id: [] for q in queries}
    for b in R._sparse(queries, k, block=17, each=500)(iter([index.slice(0, 2500), index.slice(2500)])):
        for q, i, s in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            got[q].append((-s, i))
    of = [dict(zip(t.tolist(), w.tolist(), strict=True)) for t, w in zip(terms, weights, strict=True)]
    for j, q in enumerate(queries):
        best = {}
        for i in range(n):
            s = round(sum(of[n + j].get(t, 0) * w for t, w in of[i].items()) * prior[i], 6)
            best[ids[i]] = max(best.get(ids[i], -np.inf), s)
        want = sorted((-s, i) for i, s in best.items())[:k]
        mine = sorted(got[q.id])
        assert [i for _, i in mine] == [i for _, i in want] and np.allclose([s for s, _ in mine], [s for s, _ in want], atol=2e-6)
    assert least < 0 or sum(twice) < 0.05 * n * m
