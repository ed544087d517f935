import re

import numpy as np
import pytest

from asclera.functions.stem import stem
from asclera.operators import evaluation as E
from asclera.operators import grounding as G
from asclera.operators import prompts as P

PASSAGES = ["Indications: metformin for diabetes care", "aspirin for pain in the heart", "diabetes is a disease of sugar", "nothing of the kind"]
TRIPLES = "Subject,Predicate,Object\nmetformin,treats,diabetes\ndiabetes,is_a,disease\naspirin,,pain\nshort,row\n"


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(1, "Does metformin help with diabetes?"), (2, "xyz"), (3, None)], "query_id long, question string")


@pytest.fixture
def grounding(spark, tmp_path):
    (tmp_path / "t.csv").write_text(TRIPLES)
    (tmp_path / "c.txt").write_text("\n".join(["  ", *PASSAGES]))
    return G.Grounding.from_sources(spark, corpus_path=str(tmp_path / "c.txt"), triples_path=str(tmp_path / "t.csv"))


def model():
    return lambda system, user: [re.search(r"Input Question: (.*)", u).group(1).upper() for u in user]


def test_prompts(spark, questions, grounding):
    got = {r.query_id: r for r in grounding.prompts(questions).collect()}
    assert set(got) == {1, 2, 3} and all(r.system == P.SYSTEM for r in got.values())
    assert "[E1] Indications: metformin for diabetes care" in got[1].user and "• (metformin) --[treats]--> (diabetes)" in got[1].user
    assert P.NO_CONCEPTS in got[2].user and "[E1]" in got[2].user and P.NO_EVIDENCE in got[3].user
    off = {r.query_id: r.user for r in G.Grounding(**{**grounding.__dict__, "use_evidence": False, "use_kg": False}).prompts(questions).collect()}
    assert all(P.EVIDENCE_OFF in u and P.KNOWLEDGE_OFF in u for u in off.values())
    none = {r.query_id: r.knowledge for r in G.Grounding(**{**grounding.__dict__, "triples": None}).knowledge(questions).collect()}
    assert none == {1: P.NO_KNOWLEDGE, 2: P.NO_CONCEPTS, 3: P.NO_CONCEPTS}


def test_first_candidates_stand_in(questions, grounding):
    chosen, _ = G.Grounding(**{**grounding.__dict__, "k_dense": 0}).selected(questions)
    assert sorted(r.ord for r in chosen.where("query_id = 1").collect()) == [1, 2, 3, 4]


def test_reformulate(questions, grounding):
    assert {r.query_id: r.output for r in grounding.reformulate(questions.where("query_id < 3"), model, 1).collect()} == {1: "DOES METFORMIN HELP WITH DIABETES?", 2: "XYZ"}


def test_evaluation_prompts(spark, questions, grounding):
    shots = spark.createDataFrame([("examples",)], "prefix string")
    base = {r.query_id: r.user for r in G.evaluation_prompts(questions.where("query_id = 1"), shots=shots).collect()}
    assert base[1].startswith("examples\n\nConvert the following")
    rag = G.evaluation_prompts(questions.where("query_id = 1"), G.PASSAGES, None, grounding).first().user
    assert P.KNOWLEDGE_OFF in rag and "[E1]" in rag
    for wrong, g in (("other", grounding), (G.PASSAGES, None)):
        with pytest.raises(ValueError, match="retrieval"):
            G.evaluation_prompts(questions, wrong, None, g)
    with pytest.raises(ValueError, match="corpus"):
        G.Grounding.from_sources(spark)


def test_evidence_at_hand_is_not_searched_again(monkeypatch, questions, grounding):
    modes = (G.PASSAGES, G.GRAPH)
    want = [sorted(map(tuple, G.evaluation_prompts(questions, m, None, grounding).collect())) for m in modes]
    evidence = grounding.evidence(questions)
    monkeypatch.setattr(G.Grounding, "candidates", lambda *_: pytest.fail("searched again"))
    assert [sorted(map(tuple, G.evaluation_prompts(questions, m, None, grounding, evidence).collect())) for m in modes] == want


def test_config_prompts_search_once(spark, monkeypatch, tmp_path):
    from asclera.plans import reference

    tables = {
        "meqsum": ([(i, f"question {i} on diabetes", f"short {i}") for i in range(101)], "pair_id long, chq string, summary string"),
        "pubmed_medlineplus_passages": (list(enumerate(PASSAGES)), "passage_id long, passage_text string"),
        "umls_triples": ([(1, "metformin", "treats", "diabetes")], "triple_id long, head string, relation string, tail string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    searches, candidates = [], G.Grounding.candidates
    monkeypatch.setattr(G.Grounding, "candidates", lambda self, q: searches.append(1) or candidates(self, q))
    got = reference.config_prompts(spark, str(tmp_path)).groupBy("setting", "retrieval").count().collect()
    assert len(got) == 6 and {r["count"] for r in got} == {3} and len(searches) == 1


def test_config_prompts_of_all_questions(spark, tmp_path):
    """Whatever their ids; none without an id or a text; as the SQL has them."""
    import duckdb

    import __spark_entry__ as entry

    asked = [(i, f"Could metformin help with diabetes and {w}?", f"short {i}") for i, w in ((1, "eyes"), (2, "sugar"), (50, "feet"), (77, "sleep"), (77, "sleep"))]
    tables = {
        "meqsum": ([*asked, (3, " ", "blank"), (4, None, "none"), (None, "diabetes without an id", None)], "pair_id long, chq string, summary string"),
        "pubmed_medlineplus_passages": (list(enumerate(PASSAGES)), "passage_id long, passage_text string"),
        "umls_triples": ([(1, "metformin", "treats", "diabetes")], "triple_id long, head string, relation string, tail string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(rows, schema).write.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    got = sorted(map(tuple, entry.queries()["config_prompts"](spark, str(tmp_path)).select("setting", "retrieval", "query_id", "user").collect()))
    assert {r[2] for r in got} == {1, 2, 50, 77} and len(got) == 24
    assert got == sorted(con.execute(f"SELECT setting, retrieval, query_id, user FROM ({entry.oracle_sql()['config_prompts']})").fetchall())


def test_evaluate(spark, grounding):
    pairs = spark.createDataFrame([(i, f"question {i} on diabetes", f"QUESTION {i} ON DIABETES") for i in range(10)], "id long, source string, target string")
    configs = [{"setting": s, "retrieval": r} for s in ("zero_shot", "few_shot") for r in (G.NONE, G.GRAPH)]
    metrics, done = G.evaluate(pairs, model, configs, grounding)
    got = metrics.collect()
    assert {(r.setting, r.retrieval) for r in got} == {(c["setting"], c["retrieval"]) for c in configs}
    assert all(r.n_samples == 2 and r.rouge_l == 1.0 and r.Dx == 1.0 for r in got) and done.count() == 8


def test_bert_score_stems_and_bleu_ids(spark):
    def encoder():
        return lambda texts: [np.array([[float(c == w[0]) for c in "abc"] for w in t.split()]) for t in texts]

    df = spark.createDataFrame([("a b", "a"), ("", "a"), (None, None), ("a", "a")], "prediction string, reference string")
    assert [(r.bert_p, r.bert_r, round(r.bert_f1, 4)) for r in E.bert_score(df, encoder).collect()] == [(0.5, 1, 0.6667), (0, 0, 0), (0, 0, 0), (1, 1, 1)]
    assert [stem(w) for w in ("relational", "caresses", "hopping", "filing", "sky", "happy", "adjustment", "controll")] == ["relat", "caress", "hop", "file", "sky", "happi", "adjust", "control"]
    s = spark.createDataFrame([("treating allergies", "treated allergy")], "prediction string, reference string")
    assert E.rouge_l(s).first().rouge_l == 0 and E.rouge_l(s, stemmed=True).first().rouge_l == 1
    rows = spark.createDataFrame([(i, "w1 w2 w3 w4 w5", "w1 w2 w3 w4 w5" if i % 2 else "w5 w4 w3 w2 w1") for i in range(50)], "i long, prediction string, reference string")
    assert E.bleu(rows, id_col="i").first().bleu == E.bleu(rows.repartition(7)).first().bleu
    m = E.metrics(rows.withColumn("source", rows.prediction), stemmed=True, make_encoder=encoder).first()
    assert m.n_samples == 50 and "bert_f1" in m.asDict()
