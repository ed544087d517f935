"""The engine's queries over the test tables, whole tables and whole texts.

Searches take as queries every question whose id is divisible by 50, against all passages, nodes or vectors; ``config_prompts``
takes every question.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asclera.functions import text as T
from asclera.operators import concepts as C
from asclera.operators import evaluation as E
from asclera.operators import faithfulness as A
from asclera.operators import grounding as G
from asclera.operators import kg as K
from asclera.operators import prompts as P
from asclera.operators import retrieval as R
from asclera.operators.inference import infer
from asclera.plans.data import table
from asclera.runtime import keep, materialize, shared_dir
from asclera.sources.sinks import write_index
from asclera.sources.tables import load_index, text_pairs


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, target): pairs of question and reference, each once, without those that lack either."""
    return text_pairs(table(spark, sf_dir, "meqsum"), "pair_id")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pred_id, run_id, source, prediction, reference) of all predictions."""
    m = table(spark, sf_dir, "meqsum").select("pair_id", F.col("chq").alias("source"), F.col("summary").alias("reference")).distinct()
    r = table(spark, sf_dir, "run_eval").select("pred_id", "pair_id", "run_id", F.col("preds").alias("prediction")).distinct()
    return r.join(m, "pair_id").select("pred_id", "run_id", "source", "prediction", "reference")


def _asked(spark: SparkSession, sf_dir: str, which: str = "pair_id is not null") -> DataFrame:
    """(query_id, question), each once: all that have an id and a text, or fewer."""
    return table(spark, sf_dir, "meqsum").where(which).select(F.col("pair_id").alias("query_id"), F.col("chq").alias("question")).where("trim(question) != ''").distinct()


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, "pair_id % 50 = 0")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pubmed_medlineplus_passages").select("passage_id", F.col("passage_text").alias("text"))


def pair_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir)


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _passages(spark, sf_dir).select("passage_id", T.strip(F.col("text")).alias("text")).where("text != ''")
    return p.distinct()


def clinical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.clinical_tokens(F.col("text"))).alias("pos", "token"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


def candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded_spans(_documents(spark, sf_dir), "doc_id", "text")


def span_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = candidate_spans(spark, sf_dir).groupBy("span").agg(F.count("*").alias("n_docs"))
    return s.withColumn("category", C.category(F.col("span")))


def concept_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _documents(spark, sf_dir).select("doc_id", C.buckets(F.col("text")).alias("b"))
    return b.select("doc_id", *[F.array_join(f"b.{k}", "; ").alias(k.lower()) for k in C.CATEGORIES])


def category_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", C.presence(F.col("text")).alias("p"))
    return d.select("doc_id", *[F.col(f"p.{k}").alias(k.lower()) for k in C.CATEGORIES])


def qualifier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", *[T.qualifier(F.col("text"), q).alias(q) for q in ("negation", "uncertainty", "laterality")])


def faithfulness_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each category, and one for their macro mean."""
    per = A.category_f1(A.with_presence(_pairs(spark, sf_dir)))
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    none = F.lit(None)
    whole = A.macro(per).select(F.lit("macro").alias("category"), *[none.cast("long").alias(c) for c in ("tp", "fp", "fn")], none.cast("double").alias("precision"), none.cast("double").alias("recall"), F.round("macro_f1", 6).alias("f1"))
    return per.select("category", "tp", "fp", "fn", *rounded).unionByName(whole)


def faithfulness_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.single(A.with_presence(_pairs(spark, sf_dir)))
    return s.select("pred_id", *[F.col(k).alias(k.lower()) for k in C.CATEGORIES], "score", F.round("chr_pct", 6).alias("chr_pct"), A.risk_label(F.col("chr_pct")).alias("risk"))


def faithfulness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.report(A.category_f1(A.with_presence(_pairs(spark, sf_dir))), "all runs", "meqsum")


def faithfulness_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = A.category_f1(A.with_presence(_pairs(spark, sf_dir)), ("run_id",))
    return A.macro(per, ("run_id",)).select("run_id", F.round("macro_f1", 6).alias("macro_f1"), F.round("chr_pct", 4).alias("chr_pct"), "risk")


def section_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).distinct().select("passage_id", T.section_weight(F.col("text")).alias("section_weight"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).cast("long").alias("n_tokens"))


def fkgl_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lower(F.coalesce("lang", F.lit("none"))).alias("lang"), T.fkgl(F.col("text")).alias("g"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg("g"), 6).alias("fkgl"))


def fkgl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.round(T.fkgl(F.col("text")), 6).alias("fkgl"))


def postings_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.postings(_passages(spark, sf_dir).distinct(), "passage_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("n_passages"), F.round(F.sum("weight"), 6).alias("weight"))


def _written(index: DataFrame, name: str) -> str:
    """The path of a table that is written for a query, in the folder for such."""
    path = f"{shared_dir(index.sparkSession)}/asclera/{name}-{uuid.uuid4().hex}"
    keep(index.sparkSession, path)
    return path


def _grounding(spark: SparkSession, sf_dir: str, graph: bool = False, **options) -> G.Grounding:
    """The pipeline over all passages, from an index that is written and read again, and with ``graph`` all triples."""
    p = _passages(spark, sf_dir)
    index = R.build_index(p)
    path = _written(index, "index")
    write_index(index, path)
    return G.Grounding(p.withColumnRenamed("id", "passage_id"), load_index(spark, path), materialize(_triples(spark, sf_dir), "triples") if graph else None, **options)


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grounding(spark, sf_dir)
    return R.retrieve(_queries(spark, sf_dir), g.index)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return R.dense_top_k(e.where("vec_id % 50 = 0"), e).select("query_id", F.col("passage_id").alias("vec_id"), "score", "rank")


def rerank_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounding(spark, sf_dir).reranked(_queries(spark, sf_dir))[0]


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounding(spark, sf_dir).selected(_queries(spark, sf_dir))[0]


def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in when re-ranking keeps nothing: the first five candidates."""
    return _grounding(spark, sf_dir, k_dense=0).selected(_queries(spark, sf_dir))[0]


def evidence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, _, texts = _grounding(spark, sf_dir).reranked(_queries(spark, sf_dir))
    return G.evidence_blocks(ranked, texts, order="rank")


def term_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors are taken for the logits of a text's ten tokens over a vocabulary of their dimensions."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("id"), F.posexplode("embedding").alias("pos", "logit"))
    t = R.term_pooling(e.select("id", F.format_string("t%03d", "pos").alias("term"), "logit"))
    return t.select("id", "term", F.round("weight", 6).alias("weight"))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.load_triples(table(spark, sf_dir, "umls_triples"))


def kg_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir)


def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir)
    return K.nodes(t).join(K.node_triples(t).groupBy("node").agg(F.count("*").alias("n_triples")), "node")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded_spans(_queries(spark, sf_dir), "query_id", "question").select("query_id", F.col("span").alias("entity"))


def _subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.subgraph(_entities(spark, sf_dir), materialize(_triples(spark, sf_dir), "triples"))


def kg_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subgraph(spark, sf_dir)


def kg_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kg_context(_subgraph(spark, sf_dir))


def normalise_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of the documents, and the spans that have a preferred name, in each category."""
    known = spark.createDataFrame([(s, c) for v in K.ALIASES.values() for s in v for c in C.CATEGORIES], "span string, category string").coalesce(1)
    spans = span_categories(spark, sf_dir).select("span", "category")
    return spans.unionByName(known).distinct().withColumn("preferred", K.normalised(F.col("span"), F.col("category")))


def grounded_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounding(spark, sf_dir, graph=True).prompts(_queries(spark, sf_dir))


def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.evaluation_prompts(_queries(spark, sf_dir), G.PASSAGES, None, _grounding(spark, sf_dir))


def switched_off_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounding(spark, sf_dir, use_evidence=False, use_kg=False).prompts(_queries(spark, sf_dir))


def config_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of every setting and retrieval mode, of all questions."""
    s = materialize(E.train_test_split(_questions(spark, sf_dir), "id"), "split")
    shots, g, out = P.few_shot_prefix(s.where("not is_test")), _grounding(spark, sf_dir, graph=True), None
    q = materialize(_asked(spark, sf_dir), "queries")
    evidence = materialize(g.evidence(q), "evidence")
    for retrieval in (G.NONE, G.PASSAGES, G.GRAPH):
        p = materialize(G.evaluation_prompts(q, retrieval, None, g, evidence), "prompts")
        first = F.concat("prefix", F.lit("\n\n"), "user")
        both = [p.select(F.lit("zero_shot").alias("setting"), "query_id", "user"), p.crossJoin(F.broadcast(shots)).select(F.lit("few_shot").alias("setting"), "query_id", first.alias("user"))]
        for x in both:
            x = x.withColumn("retrieval", F.lit(retrieval))
            out = x if out is None else out.unionByName(x)
    return out


def _first_sentence_of_question():
    import re

    return lambda system, user: [re.match(r"[^.?!]*", u.rsplit("Input Question: ", 1)[1].rsplit("\n\nReformulated Question:", 1)[0]).group() for u in user]


def reformulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stub model that reads the question out of the grounded prompt and gives back its first sentence."""
    return _grounding(spark, sf_dir, graph=True).reformulate(_queries(spark, sf_dir), _first_sentence_of_question)


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, prompts, generation by a stub model and metrics of both settings without retrieval."""
    m, _ = G.evaluate(_questions(spark, sf_dir), _first_sentence_of_question, [{"setting": s, "retrieval": G.NONE} for s in ("zero_shot", "few_shot")])
    return m.select("setting", "retrieval", "n_samples", *[F.col(k).alias(k.lower()) for k in C.CATEGORIES], "macro_f1", "chr_pct", "risk", "fkgl", "rouge_l", "bleu")


def base_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.base(F.col("source"))
    return _questions(spark, sf_dir).select("id", p["system"].alias("system"), p["user"].alias("user"))


def training_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("id", P.training(F.col("source")).alias("user"), F.col("target"))


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.train_test_split(_questions(spark, sf_dir), "id").select("id", "is_test")


def few_shot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = materialize(E.train_test_split(_questions(spark, sf_dir), "id"), "split")
    prefix = P.few_shot_prefix(s.where("not is_test")).withColumn("_k", F.lit(1))
    p = P.base(F.col("source"))["user"]
    return s.where("is_test").withColumn("_k", F.lit(1)).join(F.broadcast(prefix), "_k").select("id", F.concat("prefix", F.lit("\n\n"), p).alias("user"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rouge_l(_pairs(spark, sf_dir).select("pred_id", "prediction", "reference")).select("pred_id", F.round("rouge_l", 6).alias("rouge_l"))


def rouge_l_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rouge_l(_pairs(spark, sf_dir).select("pred_id", "prediction", "reference"), stemmed=True).select("pred_id", F.round("rouge_l", 6).alias("rouge_l"))


def _word_buckets():
    """A stub encoder: a word is the unit vector of one of 64 buckets."""
    import hashlib
    import re

    import numpy as np

    eye = np.eye(64)
    return lambda texts: [eye[[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64 for w in re.findall(r"[a-z0-9]+", t.lower())]] for t in texts]


def bert_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.bert_score(_pairs(spark, sf_dir).select("pred_id", "prediction", "reference"), _word_buckets)
    return b.select("pred_id", *[F.round(c, 6).alias(c) for c in ("bert_p", "bert_r", "bert_f1")])


def bleu4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bleu(_pairs(spark, sf_dir), ("run_id",), id_col="pred_id").select("run_id", F.round("bleu", 6).alias("bleu"))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics(materialize(_pairs(spark, sf_dir), "pairs"), id_col="pred_id")


def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration with the metrics of its run; those without a run have nulls."""
    runs = table(spark, sf_dir, "eval_runs")
    m = E.metrics(materialize(_pairs(spark, sf_dir), "pairs"), ("run_id",), id_col="pred_id")
    return runs.join(m, "run_id", "left").select("run_id", "model_name", "setting", "retrieval", "n_samples", *[F.col(k).alias(k.lower()) for k in C.CATEGORIES], "macro_f1", "chr_pct", "risk", "fkgl", "rouge_l", "bleu")


def _first_sentences():
    import re

    return lambda system, user: [re.match(r"[^.?!]*", u).group() for u in user]


def batch_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stub model that gives back the first sentence of the question."""
    q = _questions(spark, sf_dir).select("id", F.lit(P.SYSTEM).alias("system"), F.col("source").alias("user"))
    return infer(q, _first_sentences).select("id", "output")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the streaming query of ``asclera.streaming`` gives when it has seen all events, in one batch."""
    e = table(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "value")


def top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three runs with the best macro F1 of each retrieval mode (a top-k report)."""
    g = faithfulness_by_run(spark, sf_dir).join(table(spark, sf_dir, "eval_runs"), "run_id")
    r = F.row_number().over(Window.partitionBy("retrieval").orderBy(F.desc("macro_f1"), "run_id"))
    return g.withColumn("rank", r.cast("long")).where("rank <= 3").select("retrieval", "rank", "run_id", "model_name", "macro_f1")


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_" and k != "queries"}
