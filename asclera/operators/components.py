"""Connected components of a graph given as a table of edges: each partition unites its edges, so that it passes on no more than
one a node, then alternating large-star and small-star steps unite the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclera.runtime import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each node's neighbours (large: the greater ones; else the lesser ones and itself) to its least neighbour.

    The least neighbour is a partial aggregate and joined back, so that no neighbourhood is ever collected in one row.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges -> a star (u, v) for each component that they have among them, by union-find with the least node as root."""
    own: dict = {}
    kind = None

    def find(x):
        while own.setdefault(x, x) != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    for b in batches:
        kind = b.column(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                own[max(u, v)] = min(u, v)
    if own:
        nodes = list(own)
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.record_batch([pa.array(part, kind), pa.array([find(x) for x in part], kind)], names=["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 100, edges_each: int = 300_000) -> DataFrame:
    """(node, component) for the nodes of the first two columns of ``edges``; component is the least node of each.

    Partitions of about ``edges_each`` edges are united first, whatever the size of the graph; the steps then go on until
    nothing changes. Any orderable type serves as node. Edges with a null end are ignored; loops and repeated edges do no harm;
    a node that occurs only in a loop is a component of its own. No edges give no rows. The number of rounds grows with the
    logarithm of the number of nodes.
    """
    a, b = edges.columns[:2]
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    given = materialize(given, "edges")
    kind = given.schema["u"].dataType.simpleString()
    parts = max(1, -(-given.count() // max(1, edges_each)))
    # a lone partition has no need to be spread; each node stays in the table, in an edge to itself at least
    united = (given.coalesce(1) if parts == 1 else given.repartition(parts)).mapInArrow(_united, f"u {kind}, v {kind}")
    united = materialize(united, "united")
    now, before = united.where("u != v"), None
    nodes = united.select(F.col("u").alias("node")).distinct()
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        now = materialize(_star(_star(now, True), False), "star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
