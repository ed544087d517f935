"""Prompts: evidence and knowledge blocks, templates and few-shot prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asclera.functions.text import seeded, strip

# What stands in for a block that is empty or switched off.
NO_EVIDENCE, NO_KNOWLEDGE, NO_CONCEPTS = "(no evidence retrieved)", "(no knowledge graph context)", "(no clinical concepts extracted)"
EVIDENCE_OFF, KNOWLEDGE_OFF = "(retrieval disabled)", "(knowledge grounding disabled)"

# The prompts.
SYSTEM = "You are a medical question reformulation specialist."
GROUNDED = """Objective: Convert the verbose consumer health question below into a concise professional medical question.

Clinical Requirements:
- Preserve all symptoms, conditions, diagnoses, medications, procedures, negation markers, uncertainty expressions, and follow-up intent.
- Do not introduce claims not present in the original question or evidence.
- Be concise but clinically complete.

Evidence Context:
«BEGIN»
{evidence}
«END»

Knowledge Context:
{knowledge}

Input Question: {question}

Reformulated Question:"""
BASE = (
    "Convert the following consumer health question into a concise professional medical question. Preserve all diagnoses, medications, procedures, and follow-up intent.\n\n"
    "Input Question: {question}\n\nReformulated Question:"
)
TRAINING = (
    "Convert the following consumer health question into a concise professional medical question. Preserve all diagnoses, medications, procedures, and follow-up intent. "
    "Do not add unsupported information.\n\nEvidence Context:\n«BEGIN»\n{evidence}\n«END»\n\nKnowledge Context:\n{knowledge}\n\nInput Question: {question}\n\nReformulated Question:"
)
FEW_SHOT = "Here are examples of consumer health question reformulation:\n"


def fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced by columns; null values become empty."""
    parts, rest = [], template
    while rest:
        cut = min(((rest.index("{" + k + "}"), k) for k in values if "{" + k + "}" in rest), default=None)
        if cut is None:
            parts.append(F.lit(rest))
            break
        at, name = cut
        parts += [F.lit(rest[:at]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def evidence_block(passages: Column, most: int = 5) -> Column:
    """[E1] ... lines of an array of passages."""
    lines = F.transform(F.slice(passages, 1, most), lambda p, i: F.concat(F.lit("[E"), (i + 1).cast("string"), F.lit("] "), F.replace(strip(p), F.lit("\n"), F.lit(" "))))
    return F.when(F.size(passages) > 0, F.array_join(lines, "\n")).otherwise(NO_EVIDENCE)


def grounded(question: Column, evidence: Column, knowledge: Column) -> Column:
    return F.struct(F.lit(SYSTEM).alias("system"), fill(GROUNDED, evidence=evidence, knowledge=knowledge, question=question).alias("user"))


def base(question: Column) -> Column:
    return F.struct(F.lit(SYSTEM).alias("system"), fill(BASE, question=question).alias("user"))


def training(question: Column, evidence: Column | None = None, knowledge: Column | None = None) -> Column:
    return fill(TRAINING, evidence=evidence if evidence is not None else F.lit("(no evidence)"), knowledge=knowledge if knowledge is not None else F.lit("(no knowledge context)"), question=question)


def few_shot_prefix(train: DataFrame, n_shots: int = 3, seed: int = 42, id_col: str = "id") -> DataFrame:
    """One row (prefix): ``n_shots`` pairs (source, target) drawn by a seeded hash of their ids. The limit is the feature."""
    drawn = train.select(id_col, "source", "target").withColumn("h", seeded(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))).orderBy("h", id_col).limit(n_shots)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("h", id_col, "source", "target"))), lambda r: F.concat(F.lit("Input: "), r["source"], F.lit("\nReformulated: "), r["target"], F.lit("\n")))
    return drawn.agg(F.array_join(F.concat(F.array(F.lit(FEW_SHOT)), blocks), "\n").alias("prefix"))
