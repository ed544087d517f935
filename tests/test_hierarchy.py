import random

import pytest

from asclera.operators import hierarchy as H
from asclera.operators.components import connected_components

LINKS = "child string, parent string"


def brute(links):
    parent = {}
    for c, p in links:
        parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in {x for l in links for x in l}:
        path, seen, x = [n], {n}, n
        while x in parent and parent[x] not in seen:
            x = parent[x]
            seen.add(x)
            path.append(x)
        out[n] = ("", -1, ()) if x in parent else (x, len(path) - 1, tuple(reversed(path)))
    return out


def rows(df):
    return {r.node: (r.root_node, r.depth, tuple(r.path)) for r in df.collect()}


@pytest.mark.parametrize(("most", "one_task"), [(200_000, 300_000), (3, 5)])
def test_equals_brute_force_in_one_task_and_by_doubling(spark, most, one_task):
    rng = random.Random(5)
    nodes = [f"n{i}" for i in range(60)]
    links = [(n, rng.choice(nodes)) for n in nodes[:50]]
    links += [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("self", "self"), ("below", "self")]
    links += [(f"deep{i}", f"deep{i + 1}") for i in range(40)] + [(f"leaf{i}", "hub") for i in range(30)]
    assert rows(H.hierarchy(spark.createDataFrame(links + links[:9], LINKS), most=most, edges_each=one_task)) == brute(links)


def test_states(spark):
    h = H.hierarchy(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("x", "y")], LINKS))
    assert {r.node: r.state for r in h.collect()} == {"a": "cycle", "b": "back_edge", "c": "below_cycle", "x": "tree", "y": "tree"}
    assert {(r.node, r.back_edge) for r in H.cycles(h).collect()} == {("a", False), ("b", True)}


def test_states_are_the_same_by_doubling(spark):
    rng = random.Random(6)
    links = [(f"n{i}", f"n{rng.randrange(40)}") for i in range(40)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("self", "self"), ("below", "self")]
    ring = [f"r{i}" for i in rng.sample(range(100), 37)]
    links += list(zip(ring, ring[1:] + ring[:1], strict=True)) + [(f"x{i}", r) for i, r in enumerate(ring[:5])]
    df = spark.createDataFrame(links, LINKS)
    one, doubled = ({r.node: r.state for r in H.hierarchy(df, most=m, edges_each=t).collect()} for m, t in ((200_000, 300_000), (1, 7)))
    assert one == doubled and doubled["c"] == doubled["self"] == "back_edge" and sum(doubled[r] == "back_edge" for r in ring) == 1


def test_descendants(spark):
    h = H.hierarchy(spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], LINKS))
    assert {tuple(r) for r in H.descendants(h).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}


def test_several_parents_and_cycles_over_any_of_them(spark):
    links = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("x", "z"), ("z", "x"), ("w", "x"), ("w", "a")]  # a diamond; a second parent that closes a cycle
    h = H.hierarchy(spark.createDataFrame(links, LINKS))
    got = {r.node: (r.parent, r.parents, r.root_node, r.depth, r.state) for r in h.collect()}
    assert got["d"] == ("b", 2, "a", 2, "tree") and got["e"] == ("d", 1, "a", 3, "tree") and got["x"] == ("y", 2, "", -1, "cycle") and got["z"] == ("x", 1, "", -1, "back_edge") and got["w"] == ("a", 2, "", -1, "below_cycle")
    below = {tuple(r) for r in H.descendants(h).collect()}
    assert below == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "d", 1), ("c", "d", 1), ("a", "e", 3), ("b", "e", 2), ("c", "e", 2), ("d", "e", 1)}
    assert {tuple(r) for r in H.cycles(h).collect()} == {("x", "z", False), ("z", "x", True)}
    with pytest.raises(ValueError, match="several parents"):
        H.hierarchy(spark.createDataFrame(links, LINKS), most=2).count()


def test_several_parents_equal_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(2, 14)
        links = list({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randrange(1, 2 * n))})
        reach = {x: set() for l in links for x in l}
        for _ in range(n + 1):
            for c, p in links:
                reach[c] |= {p} | reach[p]
        rows = {r[0]: r for r in H.traverse(links)}
        assert set(rows) == set(reach)
        for x, up in reach.items():
            on = x in up
            assert (rows[x][5] in (H.ON_CYCLE, H.BACK_EDGE)) == on and (rows[x][5] == H.BELOW) == (not on and any(y in reach[y] for y in up))
            if rows[x][5] == H.TREE:
                seen = {d["node"] for d in rows[x][8]} if rows[x][8] is not None else set(rows[x][4][:-1])
                assert seen == up
        kept = [(c, p) for c, p in links if p not in rows[c][7]]  # without the back edges there is no cycle
        for _ in range(len(links) + 1):
            tops = {p for _, p in kept} | {c for c, _ in kept}
            tops -= {c for c, _ in kept}
            kept = [(c, p) for c, p in kept if p not in tops]
        assert not kept


def test_a_chain_of_200_000_without_paths():
    n = 200_000
    rows = H.traverse([(f"{i:06}", f"{i + 1:06}") for i in range(n)], paths=False)
    assert len(rows) == n + 1 and {(r[3], r[2]) for r in rows if r[0] in ("000000", f"{n:06}")} == {(n, f"{n:06}"), (0, f"{n:06}")}


def test_nulls_blanks_and_clashing_columns(spark):
    links = spark.createDataFrame([("a", None, 1), (None, "b", 2), (" ", "c", 3), ("x", "z", 4)], LINKS + ", component int")
    assert {r.node: (r.parent, r.parents, r.depth) for r in H.hierarchy(links).collect()} == {"x": ("z", 1, 1), "z": (None, 0, 0)}


def test_empty(spark):
    assert H.hierarchy(spark.createDataFrame([], LINKS)).count() == 0


def test_hierarchical_links(spark):
    t = spark.createDataFrame([(" A", "IS_A ", "b"), ("b", "has_sub", "a"), ("x", "causes", "y"), (None, "is_a", "q"), ("q", "is_a", "  ")], "head string, relation string, tail string")
    r = spark.createDataFrame([("is_a", True, "tail"), ("has_sub", True, "head"), ("causes", False, None)], "relation string, hierarchical boolean, parent_side string")
    assert [tuple(x) for x in H.hierarchical_links(t, r).collect()] == [("a", "b")]


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100, 100), (None, 4), (i := 200, i + 1)]
    own = {}

    def find(x):
        while own.setdefault(x, x) != x:
            x = own[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = sorted((find(a), find(b)))
            own[rb] = ra
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (1, 9, 1000):
        assert {r.node: r.component for r in connected_components(df, edges_each=most).collect()} == {x: find(x) for x in own}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_stay_together_when_joins_are_replanned(spark):
    """A join that turns into a broadcast at run time must not tear components apart."""
    links = [(f"c{c}n{i}", f"c{c}n{i + 1}") for c in range(60) for i in range(9)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = H.hierarchy(spark.createDataFrame(links, LINKS).repartition(7)).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == 600 and {r.node: r.depth for r in got} == {f"c{c}n{i}": 9 - i for c in range(60) for i in range(10)}
