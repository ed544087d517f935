"""The grounding pipeline over tables of questions: evidence, knowledge, prompts and reformulations, and its evaluation.

A ``Grounding`` holds what it draws on and its limits. Each step is a table with a row for each question, so that thousands of
questions are one plan. Switched-off and empty blocks are replaced by their placeholders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asclera.config import Lexicon
from asclera.functions.text import token_count
from asclera.operators import concepts as C
from asclera.operators import evaluation as E
from asclera.operators import kg as K
from asclera.operators import prompts as P
from asclera.operators import retrieval as R
from asclera.operators.inference import infer
from asclera.runtime import materialize, small
from asclera.sources import tables as S

#: Where evidence and knowledge come from: nothing, passages, or passages and the graph.
NONE, PASSAGES, GRAPH = "none", "rag", "ekg_rag"


@dataclass(frozen=True)
class Grounding:
    """passages: (passage_id, text). index: of these, made with ``encoder``. triples: (triple_id, head, relation, tail) or None.
    vectors: (table, id, text) -> (id, vector), the dense encoder. Questions are tables (query_id, question)."""

    passages: DataFrame
    index: DataFrame
    triples: DataFrame | None = None
    encoder: R.Encoder = R.WORDS
    vectors: Callable[[DataFrame, str, str], DataFrame] = R.hashed_vectors
    lexicon: Lexicon | None = None
    k_sparse: int = 20
    k_dense: int = 10
    alpha: float = 0.5
    token_budget: int = 512
    lambda_mmr: float = 0.7
    max_triples: int = 15
    tau: float = 0.70
    use_evidence: bool = True
    use_kg: bool = True
    max_passages: int = 5

    @classmethod
    def from_sources(cls, spark: SparkSession, corpus_path: str | None = None, passages: list[str] | None = None, triples_path: str | None = None, index_path: str | None = None, **options) -> Grounding:
        """From a text file of passages (a line each) or a list; triples from a CSV file, if it is there; an index that was written."""
        if corpus_path is None and passages is None:
            raise ValueError("either a corpus file or a list of passages is needed")
        p = S.corpus_of(spark, passages) if passages is not None else materialize(S.read_corpus(spark, corpus_path), "passages")
        index = S.load_index(spark, index_path) if index_path else R.build_index(p, options.get("encoder", R.WORDS))
        raw = S.read_triples(spark, triples_path) if triples_path else None
        return cls(p, index, K.load_triples(raw) if raw is not None else None, **options)

    def candidates(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, passage_id, score, rank) by the sparse index, and the texts of these passages."""
        q = questions.select("query_id", "question").where("trim(question) != ''").distinct()
        found = materialize(R.retrieve(q, self.index, self.k_sparse, self.encoder), "candidates")
        wanted = small(found.select("passage_id").distinct())
        texts = self.passages.select("passage_id", "text").join(wanted, "passage_id", "left_semi").dropDuplicates(["passage_id"])
        return found, materialize(texts, "texts")

    def reranked(self, questions: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The best by sparse and dense similarity, the passages' vectors with their numbers of tokens, and their texts. ``keep``:
        what of the second goes with the first."""
        found, texts = self.candidates(questions)
        vectors = self.vectors(texts, "passage_id", "text").join(texts.select(F.col("passage_id").alias("id"), token_count(F.col("text")).alias("n_tokens")), "id")
        own = questions.select("query_id", "question").distinct()
        return R.rerank(found, self.vectors(own, "query_id", "question"), vectors, self.k_dense, self.alpha, keep), vectors, texts

    def selected(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, ord, passage_id): diverse passages within the token budget; and the texts. Where re-ranking keeps none,
        the first five candidates stand in."""
        if self.k_dense < 1:
            found, texts = self.candidates(questions)
            return found.where(F.col("rank") <= 5).select("query_id", F.col("rank").alias("ord"), "passage_id"), texts
        ranked, _, texts = self.reranked(questions, ("vector", "n_tokens"))
        return R.mmr_select(ranked, self.token_budget, self.lambda_mmr), texts

    def evidence(self, questions: DataFrame) -> DataFrame:
        """(query_id, evidence) of every question."""
        ids = questions.select("query_id").distinct()
        if not self.use_evidence:
            return ids.withColumn("evidence", F.lit(P.EVIDENCE_OFF))
        chosen, texts = self.selected(questions)
        return ids.join(evidence_blocks(chosen, texts, self.max_passages), "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(P.NO_EVIDENCE)))

    def entities(self, questions: DataFrame) -> DataFrame:
        return C.exploded_spans(questions.select("query_id", "question").distinct(), "query_id", "question", self.lexicon).select("query_id", F.col("span").alias("entity"))

    def knowledge(self, questions: DataFrame) -> DataFrame:
        """(query_id, knowledge) of every question."""
        ids = questions.select("query_id").distinct()
        if not self.use_kg:
            return ids.withColumn("knowledge", F.lit(P.KNOWLEDGE_OFF))
        entities = materialize(self.entities(questions), "entities")
        triples = self.triples if self.triples is not None else ids.sparkSession.createDataFrame([], "triple_id long, head string, relation string, tail string")
        known = K.kg_context(K.subgraph(entities, triples, self.max_triples, self.tau))
        has = entities.select("query_id").distinct().withColumn("has", F.lit(True))
        text = F.when(F.col("has").isNull(), P.NO_CONCEPTS).otherwise(F.coalesce("knowledge", F.lit(P.NO_KNOWLEDGE)))
        return ids.join(has, "query_id", "left").join(known, "query_id", "left").select("query_id", text.alias("knowledge"))

    def prompts(self, questions: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
        """(query_id, system, user): the grounded prompt of every question. ``evidence``: of ``self.evidence``, where it is at hand."""
        evidence = self.evidence(questions) if evidence is None else evidence
        q = questions.select("query_id", "question").distinct().join(evidence, "query_id").join(self.knowledge(questions), "query_id")
        p = P.grounded(F.col("question"), F.col("evidence"), F.col("knowledge"))
        return q.select("query_id", p["system"].alias("system"), p["user"].alias("user"))

    def reformulate(self, questions: DataFrame, make_model: Callable, batch_size: int = 8) -> DataFrame:
        """(query_id, output): what a model, made once a task, writes for the prompts, in batches."""
        return infer(self.prompts(questions), make_model, batch_size=batch_size).select("query_id", "output")


def evidence_blocks(chosen: DataFrame, texts: DataFrame, most: int = 5, order: str = "ord") -> DataFrame:
    """(query_id, evidence) of those that have passages."""
    c = chosen.join(texts, "passage_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("l"))
    return c.select("query_id", P.evidence_block(F.transform("l", lambda x: x["text"]), most).alias("evidence"))


def evaluation_prompts(questions: DataFrame, retrieval: str = NONE, shots: DataFrame | None = None, grounding: Grounding | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """(query_id, system, user) for an experiment: the plain prompt, or a grounded one with passages or with passages and the
    graph; ``shots``, one row (prefix), go before it. ``evidence`` as for ``Grounding.prompts``: both ways of grounding have the same."""
    if retrieval == NONE:
        p = P.base(F.col("question"))
        out = questions.select("query_id", "question").distinct().select("query_id", p["system"].alias("system"), p["user"].alias("user"))
    elif retrieval not in (PASSAGES, GRAPH):
        raise ValueError(f"retrieval is {NONE}, {PASSAGES} or {GRAPH}, not {retrieval}")
    elif grounding is None:
        raise ValueError("retrieval takes a corpus")
    else:
        g = grounding if retrieval == GRAPH else Grounding(**{**grounding.__dict__, "use_kg": False})
        out = g.prompts(questions, evidence)
    if shots is None:
        return out
    first = shots.select("prefix").first()  # one row: a few examples, whatever the size of the tables
    return out.withColumn("user", F.concat(F.lit(first.prefix + "\n\n"), "user"))


def evaluate(pairs: DataFrame, make_model: Callable, configs: list[dict], grounding: Grounding | None = None, test: int | float = 0.2, seed: int = 42, n_shots: int = 3, batch_size: int = 8, lexicon: Lexicon | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics and predictions of every configuration (setting: zero_shot or few_shot, retrieval: none, rag or ekg_rag) over the
    test part of pairs (id, source, target). Few-shot examples come from the training part of the same split."""
    s = materialize(E.train_test_split(pairs, "id", test, seed), "split")
    asked = s.where("is_test").select(F.col("id").alias("query_id"), F.col("source").alias("question"))
    shots = P.few_shot_prefix(s.where("not is_test"), n_shots, seed)
    out = None
    for c in configs:
        p = evaluation_prompts(asked, c["retrieval"], shots if c["setting"] == "few_shot" else None, grounding)
        one = infer(p, make_model, batch_size=batch_size).select(F.lit(c["setting"]).alias("setting"), F.lit(c["retrieval"]).alias("retrieval"), F.col("query_id").alias("id"), F.col("output").alias("prediction"))
        out = one if out is None else out.unionByName(one)
    done = materialize(out.join(s.select("id", "source", F.col("target").alias("reference")), "id"), "predictions")
    return E.metrics(done, ("setting", "retrieval"), lexicon), done


