import random
import re
from collections import Counter

from asclera.llm import neardup as N

COLS = "passage_id long, passage_text string, cls long, key string"


def overlap(a, b):
    a, b = (Counter(re.findall(r"[^\W_]+", t.lower())) for t in (a, b))
    return sum((a & b).values()) / max(a.total(), b.total(), 1)


def texts(rng):
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(40):
        base = rng.choices(vocab, k=rng.randrange(20, 60))
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            new = list(base)
            for _ in range(rng.randrange(0, 6)):
                new[rng.randrange(len(new))] = rng.choice(vocab)
            rng.shuffle(new)
            out.append(" ".join(new).upper() if rng.random() < 0.3 else ", ".join(new))
    return out


def pairs_of(rows, t=0.8):
    ok = [(i, x) for i, x in rows if x and re.search(r"[^\W_]", x)]
    return {(min(i, j), max(i, j)) for k, (i, x) in enumerate(ok) for j, y in ok[:k] if i != j and overlap(x, y) >= t - 1e-9}


def test_equals_brute_force_also_with_hot_buckets(spark):
    rng = random.Random(1)
    t = texts(rng)
    rows = [(i * 3, x) for i, x in enumerate(t)] + [(1000, None), (1001, ""), (1002, " ., "), (1003, "one"), (1004, "ONE!"), (1005, "a " * 3000), (1006, "a " * 2999)]
    rows += rows[:8] + [(2000 + i, t[0]) for i in range(len(t) // 3)]  # repeated rows; a third of all rows are one text
    df = spark.createDataFrame([(i, x, 5, "k") for i, x in rows], COLS)
    want = pairs_of(list(dict.fromkeys(rows)))
    close = N.Banding(repetitions=8, left=6, right=6, rows=2, apart=99.0)  # so wide that nothing is left to chance
    for banding in (close, N.Banding(**{**close.__dict__, "hot": 3}), N.Banding(**{**close.__dict__, "hot": 3, "sampled": 10**6})):
        members, links = N.near_duplicates(df, "passage_id", "passage_text", banding)
        for hot in (1000, 2):
            got = [tuple(r) for r in N.duplicate_pairs(members, links, hot).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    groups = {r.id: (r.group, r.copies, r.links) for r in N.duplicate_groups(members, links).collect()}
    assert set(groups) == {i for i, x in rows if x and re.search(r"[^\W_]", x)}
    for a, b in want:
        assert groups[a][0] == groups[b][0]
    assert groups[1003] == (1003, 2, 0) and groups[2000][1] >= len(t) // 3 + 1


def test_production_recall_from_the_threshold_on(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(5000)]
    rows, want = [], {}
    for i in range(2200):
        base = rng.choices(vocab, k=100)
        changed = i % 22  # overlaps from about 1.00 down to 0.79
        new = list(base)
        for at in rng.sample(range(100), changed):
            new[at] = rng.choice(vocab)
        rng.shuffle(new)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(new))]
        if (o := overlap(rows[-2][1], rows[-1][1])) >= 0.8:
            want[2 * i, 2 * i + 1] = o
    members, links = N.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    got = {tuple(r) for r in N.duplicate_pairs(members, links).collect()}
    assert got <= set(want)
    for low, high, least in ((0.80, 0.83, 0.98), (0.83, 0.86, 0.99), (0.86, 1.01, 0.998)):
        band = [p for p, o in want.items() if low <= o < high]
        assert len(band) > 150 and sum(p in got for p in band) >= least * len(band)
    assert N.Banding().recall(0.8) > 0.99 and N.Banding().recall(0.85) > 0.999
    assert N.Banding.tuned(0.99, 5).recall(0.8) >= 0.99


def test_hot_halves_found_before_the_shuffle_and_split_in_blocks(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.sample(base, 80)[:79] + [f"own{i}"])) for i in range(90)] + [(1000 + i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t string")
    banding = N.Banding(hot=8)
    texts = df.select("id", "t").toDF("id", "text")
    assert len(N._hot_halves(texts, len(rows), banding)) > 0
    got = {tuple(r) for r in N.duplicate_pairs(*N.near_duplicates(df, "id", "t", banding)).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90)}


def test_classes_that_share_a_label_are_compared(spark, monkeypatch):
    t = texts(random.Random(4))
    df = spark.createDataFrame(list(enumerate(t)), "id long, t string")
    monkeypatch.setattr(N, "_labels", lambda cls, mins: cls[:, 0] & N.np.uint64(3))
    b = N.Banding(repetitions=8, left=6, right=6, rows=2, apart=99.0)
    assert {tuple(r) for r in N.duplicate_pairs(*N.near_duplicates(df, "id", "t", b)).collect()} == pairs_of(list(enumerate(t)))


def test_empty_table(spark):
    members, links = N.near_duplicates(spark.createDataFrame([], COLS), "passage_id", "passage_text")
    assert N.duplicate_pairs(members, links).count() == 0 and N.duplicate_groups(members, links).count() == 0
