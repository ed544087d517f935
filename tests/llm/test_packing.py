import numpy as np
import pytest

from asclera.llm import packing as P


@pytest.mark.parametrize("seed", range(4))
def test_bins_hold_everything_and_nothing_overflows(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(5.5, 1.1, 3000).astype(int), 1, 2048)
    bins = P.best_two_fit(sizes, 2048)
    assert sorted(s for b in bins for s in b) == sorted(sizes.tolist()) and max(map(sum, bins)) <= 2048
    assert len(bins) <= -(-sizes.sum() // 2048) + 2


def test_edge_sizes():
    assert P.best_two_fit(np.array([], int), 10) == []
    assert sorted(map(sorted, P.best_two_fit(np.array([10, 10, 6, 6, 4, 4]), 10))) == [[4, 6], [4, 6], [10], [10]]
    # greedy takes 6 and 3; the 3 then gives way to 2 and 2, which fill the bin
    assert sorted(map(sum, P.best_two_fit(np.array([6, 3, 2, 2]), 10)))[-1] == 10


def test_pairs_of_equal_sizes_need_two():
    s = P._Sizes(np.array([3, 5]), 10)
    assert s.two(5, 6) is None and s.two(5, 8) == (5, 3) and s.largest(4) == 3 and s.largest(2) == 0


def test_pack(spark):
    texts = ["hello world"] * 30 + ["word " * 5000, None, "", "x"] + [f"document number {i} " * (i % 40) for i in range(200)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int")
    for docs in (100_000, 50):
        rows = P.pack(df, "doc_id", "text", 256, docs).collect()
        used, seen = {}, {}
        for r in rows:
            used.setdefault(r.sequence, []).append((r.position, r.n_tokens))
            seen.setdefault(r.id, []).append((r.piece, r.token_from, r.n_tokens))
        assert set(seen) == set(range(len(texts))) and all(sum(n for _, n in v) <= 256 and sorted(p for p, _ in v) == list(range(len(v))) for v in used.values())
        count = P.TokenCounter()
        for i, pieces in seen.items():
            n, at = count(texts[i]), 0
            assert (len(pieces) > 1) == (n > 256)
            for k, (piece, start, size) in enumerate(sorted(pieces)):
                assert (piece, start) == (k, at)
                at += size
            assert at == n
    nameless = spark.createDataFrame([(None, "one two three"), (None, "word " * 600), (7, "x")], "doc_id long, text string")
    got = sorted((r.id is None, r.n_tokens) for r in P.pack(nameless, "doc_id", "text", 256).collect())
    assert sum(n for none, n in got if none) == sum(map(count, ("one two three", "word " * 600))) and (False, 1) in got
    room = P.room(P.pack(df, "doc_id", "text", 256), 256).first()
    assert room.sequences * 256 - room.tokens == room.unused and room.sequences <= room.least_sequences + 1
    assert P.pack(df.where("false"), "doc_id", "text").count() == 0
