"""Knowledge graph: cleaned triples, the nodes' adjacency, and the one-hop subgraph around the entities of a query.

Entities and nodes are compared as unit vectors over their character trigrams. Pairs at or above the threshold come from an
equi-join on the rarest trigrams of each (a string that shares tau^2 of its trigrams with another has one of them among its
|a| - ceil(tau^2 |a|) + 1 rarest), then an exact check. Only queries without any such pair fall back to their nearest nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asclera.config import ALIASES, SALIENT_RELATIONS, VOCABULARY_OF
from asclera.functions.text import strip, trigrams
from asclera.operators.retrieval import TRIGRAMS, sparse_top_k
from asclera.runtime import materialize, small

DEFAULT_RELATION = "associated_with"


def load_triples(df: DataFrame, id_col: str = "triple_id") -> DataFrame:
    """(triple_id, head, relation, tail): stripped cells, a default for blank relations, rows without head or tail left out."""
    cell = {c: strip(F.coalesce(F.col(c), F.lit(""))) for c in ("head", "relation", "tail")}
    out = df.select(F.col(id_col).cast("long").alias("triple_id"), *[v.alias(k) for k, v in cell.items()]).where("head != '' and tail != ''")
    return out.withColumn("relation", F.when(F.col("relation") == "", DEFAULT_RELATION).otherwise(F.col("relation"))).distinct()


def node_triples(triples: DataFrame) -> DataFrame:
    """(node, triple_id): both ends of each triple in lower case; a loop once."""
    return triples.select(F.explode(F.array_distinct(F.array(F.lower("head"), F.lower("tail")))).alias("node"), "triple_id")


def nodes(triples: DataFrame) -> DataFrame:
    """(node, node_id): ids in the order of first appearance, heads before tails."""
    ends = triples.select(F.explode(F.array(F.struct(F.lower("head").alias("node"), (F.col("triple_id") * 2).alias("o")), F.struct(F.lower("tail").alias("node"), (F.col("triple_id") * 2 + 1).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.min("e.o").alias("node_id"))


def similar_pairs(left: DataFrame, right: DataFrame, tau: float) -> DataFrame:
    """(a, b, sim) of the distinct strings of two one-column tables whose trigram cosine is at least tau."""
    a = materialize(left.select(F.col(left.columns[0]).alias("s")).where("s != ''").distinct().withColumn("g", trigrams(F.col("s"))), "left")
    b = materialize(right.select(F.col(right.columns[0]).alias("s")).where("s != ''").distinct().withColumn("g", trigrams(F.col("s"))), "right")
    rare = b.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    rare = small(materialize(rare, "df"))

    def prefix(x: DataFrame, name: str) -> DataFrame:
        n = F.size("g")
        most = (n - F.ceil(F.lit(tau * tau) * n - 1e-9) + 1).cast("int")
        each = x.select("s", F.explode("g").alias("t"), n.alias("n"), most.alias("most")).join(rare, "t", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        r = F.row_number().over(Window.partitionBy("s").orderBy("df", "t"))
        return each.withColumn("r", r).where("r <= most").select("t", F.col("s").alias(name), *[F.col(c).alias(name + c) for c in "nr"])

    # Where two strings meet first, they can have no more in common than what is left of each from there.
    left_over = F.least(F.col("an") - F.col("ar"), F.col("bn") - F.col("br")) + 1
    met = prefix(a, "a").join(prefix(b, "b"), "t").where(left_over >= (tau - 1e-6) * F.sqrt(F.col("an") * F.col("bn"))).select("a", "b").distinct()
    met = met.join(a.select(F.col("s").alias("a"), F.col("g").alias("ga")), "a").join(b.select(F.col("s").alias("b"), F.col("g").alias("gb")), "b")
    sim = F.round(F.size(F.array_intersect("ga", "gb")) / F.sqrt(F.size("ga") * F.size("gb")), 6)
    return met.select("a", "b", sim.alias("sim")).where(F.col("sim") >= tau)


def subgraph(entities: DataFrame, triples: DataFrame, max_triples: int = 15, tau: float = 0.70, fallback: int = 3, salient: tuple[str, ...] = SALIENT_RELATIONS) -> DataFrame:
    """(query_id, ord, head, relation, tail) for the entities (query_id, entity): triples of the most similar nodes first."""
    ents = entities.select("query_id", F.col("entity")).where("entity != ''").distinct()
    own = materialize(nodes(triples), "nodes")
    near = materialize(similar_pairs(ents.select("entity"), own.select("node"), tau), "similar")
    hits = ents.join(near.select(F.col("a").alias("entity"), F.col("b").alias("node"), "sim"), "entity").select("query_id", "entity", "node", "sim")
    without = ents.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    wanted = materialize(without.select("entity").distinct().withColumn("id", F.xxhash64("entity")), "wanted")
    ranked = sparse_top_k(wanted.select("id", "entity"), own.select("node_id", "node"), fallback, TRIGRAMS, None)
    ranked = ranked.join(wanted, F.col("id") == F.col("query_id")).join(own, F.col("node_id") == F.col("passage_id")).select("entity", "node", F.col("score").alias("sim"))
    hits = hits.unionByName(without.join(ranked, "entity").select("query_id", "entity", "node", "sim"))
    best = hits.groupBy("query_id", "node").agg(F.max("sim").alias("sim")).join(own, "node")
    kept = triples.where(F.col("relation").isin(*salient))
    got = best.join(node_triples(kept), "node").join(kept, "triple_id")
    first = got.groupBy("query_id", "head", "relation", "tail").agg(F.min(F.struct((-F.col("sim")).alias("s"), "node_id", "triple_id")).alias("o"))
    ord_ = F.row_number().over(Window.partitionBy("query_id").orderBy("o"))
    return first.withColumn("ord", ord_.cast("long")).where(F.col("ord") <= max_triples).select("query_id", "ord", "head", "relation", "tail")


def kg_context(sub: DataFrame) -> DataFrame:
    """(query_id, knowledge): a line for each triple in order."""
    line = F.format_string("• (%s) --[%s]--> (%s)", "head", "relation", "tail")
    lines = sub.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return lines.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("knowledge"))


def normalised(span: Column, category: Column, aliases: dict[str, dict[str, str]] = ALIASES) -> Column:
    """The preferred name of a span in its category's vocabulary, or the span as it is."""
    out = F.when(F.lit(False), span)
    for cat, vocabulary in VOCABULARY_OF.items():
        names = F.create_map(*[F.lit(x) for kv in aliases[vocabulary].items() for x in kv])
        out = out.when(category == cat, F.coalesce(names[F.lower(span)], span))
    return out.otherwise(span)
