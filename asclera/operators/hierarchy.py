"""Parent-child links of unknown depth: path, depth, root and descendants of each node, and the cycles.

Connected components are found first and each is brought to one task, where an iterative depth-first traversal from child to
parent colours its nodes: white before, grey during and black after their visit; nodes that are grey together form a cycle, a
link to a grey node is a back edge. A component of more than ``most`` nodes would not fit a task: its paths come from pointer
doubling, a join per doubling of the depth, with the same result.

Defined results: links with a null or blank end are ignored; repeated links count once; a node that links to itself is a
cycle of one. A node may have several parents: cycles and what lies below them are found over all links, descendants follow
all links (at their least distance), root, depth and path follow the least parent; a component of more than ``most`` nodes in
which one has several parents is an error. No links give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asclera.operators.components import connected_components
from asclera.runtime import materialize, partitions_for

ROW = "node string, parent string, root_node string, depth long, path array<string>, state string, loop array<string>, back array<string>, above array<struct<node: string, distance: long>>"
#: state of a node: in a tree, on a cycle, closing a cycle (a link to a parent is a back edge), or below one. Back edges are
#: named by a walk up from the least node of the cycle.
TREE, ON_CYCLE, BACK_EDGE, BELOW = "tree", "cycle", "back_edge", "below_cycle"


def normal(c: Column) -> Column:
    """Lower case without outer white space."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def hierarchical_links(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """(child, parent) from (head, relation, tail) and (relation, hierarchical, parent_side: head or tail)."""
    t = triples.select(normal(F.col("head")).alias("head"), normal(F.col("relation")).alias("relation"), normal(F.col("tail")).alias("tail"))
    r = relations.where("hierarchical").select(normal(F.col("relation")).alias("relation"), normal(F.col("parent_side")).alias("side"))
    t = t.where("head != '' and tail != ''").join(r.where("side in ('head', 'tail')").distinct(), "relation")
    up = F.col("side") == "tail"
    return t.select(F.when(up, F.col("head")).otherwise(F.col("tail")).alias("child"), F.when(up, F.col("tail")).otherwise(F.col("head")).alias("parent")).distinct()


def _strong(up: dict[str, list[str]]) -> Iterator[list[str]]:
    """Nodes that lead up to one another, ancestors first: depth-first, without recursion."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    grey: dict[str, None] = {}  # on the walk, or in a cycle with a node on it
    for start in sorted(up):
        if start in order:
            continue
        order[start] = low[start] = len(order)
        grey[start] = None
        walk = [(start, iter(up[start]))]
        while walk:
            node, rest = walk[-1]
            for p in rest:
                if p not in order:
                    order[p] = low[p] = len(order)
                    grey[p] = None
                    walk.append((p, iter(up[p])))
                    break
                if p in grey:
                    low[node] = min(low[node], order[p])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == order[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(grey.popitem()[0])
                    yield own


def _back_edges(nodes: set[str], up: dict[str, list[str]]) -> dict[str, list[str]]:
    """Links to nodes that are on the walk, of a walk over a cycle's nodes from the least one."""
    out: dict[str, list[str]] = {}
    grey, black, start = set(), set(), min(nodes)
    walk = [(start, iter(up[start]))]
    grey.add(start)
    while walk:
        node, rest = walk[-1]
        for p in rest:
            if p in grey:
                out.setdefault(node, []).append(p)
            elif p in nodes and p not in black:
                grey.add(p)
                walk.append((p, iter(up[p])))
                break
        else:
            walk.pop()
            grey.discard(node)
            black.add(node)
    return out


def traverse(links: list[tuple[str, str]], paths: bool = True) -> list[tuple]:
    """Rows of one component: node, least parent, root_node, depth, path, state, the parents on its cycle, those over back edges,
    and all ancestors where some have several parents (else null)."""
    up: dict[str, list[str]] = {}
    for child, parent in links:
        up.setdefault(child, []).append(parent)
        up.setdefault(parent, [])
    for ps in up.values():
        ps.sort()
    out: dict[str, tuple] = {}
    above: dict[str, dict[str, int] | None] = {}
    for own in _strong(up):
        node = own[0]
        least = up[node][0] if up[node] else None
        if len(own) > 1 or node in up[node]:
            nodes = set(own)
            back = _back_edges(nodes, up)
            for n in own:
                out[n] = (n, up[n][0], "", -1, [], BACK_EDGE if n in back else ON_CYCLE, [p for p in up[n] if p in nodes], back.get(n, []), None)
        elif any(out[p][5] != TREE for p in up[node]):
            out[node] = (node, least, "", -1, [], BELOW, [], [], None)
        elif least is None:
            above[node] = None
            out[node] = (node, None, node, 0, [node] if paths else [], TREE, [], [], None)
        else:
            first, all_ = out[least], None
            if paths and (len(up[node]) > 1 or above[least] is not None):
                all_ = {}
                for p in up[node]:
                    of_p = above[p] if above[p] is not None else {a: out[p][3] - d for d, a in enumerate(out[p][4][:-1])}
                    for a, d in ((p, 0), *of_p.items()):
                        all_[a] = min(d + 1, all_.get(a, d + 1))
            above[node] = all_
            out[node] = (node, least, first[2], first[3] + 1, [*first[4], node] if paths else [], TREE, [], [], None if all_ is None else [{"node": a, "distance": d} for a, d in all_.items()])
    return list(out.values())


_SCHEMA = pa.schema(
    [("node", pa.string()), ("parent", pa.string()), ("root_node", pa.string()), ("depth", pa.int64()), ("path", pa.list_(pa.string())), ("state", pa.string()), ("loop", pa.list_(pa.string())), ("back", pa.list_(pa.string()))]
    + [("above", pa.list_(pa.struct([("node", pa.string()), ("distance", pa.int64())])))]
)


def _bucket(paths: bool):
    def run(t: pa.Table) -> pa.Table:
        """The links of the components of one bucket -> the rows of these components, one component after the other."""
        held: dict[str, list[tuple[str, str]]] = {}
        for component, child, parent in zip(*(t.column(c).to_pylist() for c in ("component", "child", "parent")), strict=True):
            held.setdefault(component, []).append((child, parent))
        rows = [r for links in held.values() for r in traverse(links, paths)]
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def _rounds(start: DataFrame, paths: bool, max_rounds: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Doubles how far each node sees until it sees its root: (rested, never resting) of (node, parent, above, steps[, seen]),
    where ``above`` is the furthest ancestor seen, so many ``steps`` up, and ``seen`` the nodes from just below it down to the
    node."""
    own = ["node", "parent", "above", "steps", *["seen"] * paths]

    def begin(rows: DataFrame, above: str, steps: int, seen: Column) -> DataFrame:
        return rows.select("node", "parent", F.col(above).alias("above"), F.lit(steps).cast("long").alias("steps"), *[seen.alias("seen")] * paths)

    rested = materialize(begin(start.where("parent is null"), "node", 0, F.array().cast("array<string>")), "rested")
    moving = materialize(begin(start.where("parent is not null"), "parent", 1, F.array("node")), "moving")
    for r in range(max_rounds):
        if moving.isEmpty() or 2**r > most:
            break
        beyond = rested.withColumn("rest", F.lit(True)).unionByName(moving.withColumn("rest", F.lit(False)))
        beyond = beyond.select(F.col("node").alias("above"), F.col("above").alias("above2"), F.col("steps").alias("steps2"), *[F.col("seen").alias("seen2")] * paths, "rest")
        step = moving.join(beyond, "above").select("node", "parent", F.col("above2").alias("above"), (F.col("steps") + F.col("steps2")).alias("steps"), *[F.concat("seen2", "seen").alias("seen")] * paths, "rest")
        step = materialize(step, "step")
        rested = materialize(rested.unionByName(step.where("rest").select(*own)), "rested")
        moving = step.where("not rest").select(*own)
    return rested, moving


def _least_of_loops(loop: DataFrame, max_rounds: int) -> DataFrame:
    """(node, least) of the nodes (node, parent) of loops: the least of the nodes within a doubling number of steps up, until
    it is the whole loop's for every node."""
    most = loop.count()
    seen = materialize(loop.select("node", F.col("parent").alias("above"), F.col("node").alias("least")), "loops")
    for r in range(max_rounds):
        if 2**r >= most:
            break
        beyond = seen.select(F.col("node").alias("above"), F.col("above").alias("above2"), F.col("least").alias("least2"))
        seen = materialize(seen.join(beyond, "above").select("node", F.col("above2").alias("above"), F.least("least", "least2").alias("least")), "loops")
    return seen.select("node", "least")


def _doubled(links: DataFrame, max_rounds: int, paths: bool) -> DataFrame:
    """The rows of components too large for a task, by pointer doubling: first which nodes ever see a root, without paths;
    then the paths of those, so that none is kept for a node on or below a cycle."""
    nodes = links.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    own = links.groupBy("child").agg(F.min("parent").alias("parent"), F.count("*").alias("n"))
    if not own.where("n > 1").isEmpty():
        raise ValueError("a node with several parents in a component that is too large for a task; raise `most` if its links fit one")
    start = materialize(nodes.join(own.select(F.col("child").alias("node"), "parent"), "node", "left"), "start")
    most = start.count()
    rested, endless = _rounds(start, False, max_rounds, most)
    endless = materialize(endless, "endless")
    if paths:
        rested, _ = _rounds(start.join(endless.select("node"), "node", "left_anti"), True, max_rounds, most)
    none = F.array().cast("array<string>")
    path = F.concat(F.array("above"), "seen") if paths else none
    all_ = F.lit(None).cast("array<struct<node: string, distance: long>>").alias("above")
    tree = rested.select("node", "parent", F.col("above").alias("root_node"), F.col("steps").alias("depth"), path.alias("path"), F.lit(TREE).alias("state"), none.alias("loop"), none.alias("back"), all_)
    on = endless.select(F.col("above").alias("node")).distinct()  # after so many steps each is on a cycle
    least = _least_of_loops(endless.join(on, "node", "left_semi").select("node", "parent"), max_rounds)
    closes, has = F.col("least") == F.col("parent"), F.col("least").isNotNull()
    state = F.when(closes, BACK_EDGE).when(has, ON_CYCLE).otherwise(BELOW)
    link = F.array("parent")
    loop = endless.join(least, "node", "left").select(
        "node", "parent", F.lit("").alias("root_node"), F.lit(-1).cast("long").alias("depth"), none.alias("path"), state.alias("state"),
        F.when(has, link).otherwise(none).alias("loop"), F.when(closes, link).otherwise(none).alias("back"), all_,
    )
    return tree.unionByName(loop)


def hierarchy(links: DataFrame, most: int = 200_000, max_rounds: int = 60, edges_each: int = 300_000, paths: bool = True) -> DataFrame:
    """One row for each node of (child, parent) links: node, parent, parents, root_node, depth, path, state, loop, back, above.

    path runs from the root to the node; without ``paths`` it is empty, so that a long chain costs no more than its nodes. On
    or below a cycle root_node is empty, depth -1 and path empty. loop: parents on the node's cycle, back: those over back
    edges. above: all ancestors, where path doesn't have them all.
    """
    links = links.select(F.col(links.columns[0]).cast("string").alias("child"), F.col(links.columns[1]).cast("string").alias("parent"))
    links = materialize(links.where("trim(child) != '' and trim(parent) != ''").distinct(), "links")
    comp = connected_components(links, edges_each=edges_each)
    placed = materialize(links.join(comp.withColumnRenamed("node", "child"), "child"), "placed")
    sizes = placed.groupBy("component").agg((F.count("*") + 1).alias("n"))
    large = sizes.where(F.col("n") > most).select("component")
    fits = sizes.where(F.col("n") <= most).select("component")
    here = placed.join(fits, "component", "left_semi").select("component", "child", "parent")
    # a group, not a repartition: what comes after a repartition may be planned without it
    buckets = partitions_for(links.sparkSession, placed.count(), most)
    out = here.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).groupBy("bucket").applyInArrow(_bucket(paths), ROW)
    if not large.isEmpty():
        out = out.unionByName(_doubled(placed.join(large, "component", "left_semi").select("child", "parent"), max_rounds, paths))
    parents = links.groupBy("child").agg(F.count("*").alias("parents")).withColumnRenamed("child", "node")
    return out.join(parents, "node", "left").select("node", "parent", F.coalesce("parents", F.lit(0)).cast("long").alias("parents"), "root_node", "depth", "path", "state", "loop", "back", "above")


def descendants(nodes: DataFrame) -> DataFrame:
    """(node, descendant, distance) for every node in a tree and every node below it, read off the paths without a join; over
    several ways the least distance."""
    t = nodes.where(F.col("state") == TREE).select("path", F.col("node").alias("descendant"), "depth", "above")
    on_path = F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda p, i: F.struct(p.alias("node"), (F.col("depth") - i).cast("long").alias("distance")))
    return t.select(F.explode(F.coalesce("above", on_path)).alias("a"), "descendant").select("a.node", "descendant", "a.distance")


def cycles(nodes: DataFrame) -> DataFrame:
    """(node, parent, back_edge) of the links between the nodes of a cycle."""
    t = nodes.where(F.col("state").isin(ON_CYCLE, BACK_EDGE)).select("node", F.explode("loop").alias("parent"), "back")
    return t.select("node", "parent", F.array_contains("back", F.col("parent")).alias("back_edge"))
