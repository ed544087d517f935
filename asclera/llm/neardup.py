"""Near-duplicate texts by tensored minhash banding, then exact verification of the multiset word overlap.

A text is the multiset of its words. Texts with equal multisets form one *class*; everything after the first pass works on
classes, so that copies cost nothing however many there are. A class is named by 128 bits of an order-free hash.

Candidates: a repetition has a left and a right collection of *halves*, each the combination of ``rows`` minhashes, and its
table keys are all pairs of a left and a right half. 3 repetitions of 8 x 14 halves of 4 minhashes are 336 keys of 8 minhashes
each from 264 minhashes, where independent keys would take 2,688. A class is shuffled once a left half, with the right halves
of the repetition in the same row, so that 24 rows stand for its 336 keys. Two texts of one length and overlap 0.80 meet with
probability 0.991, at 0.85 with 0.9997 (``Banding.recall``). In tables of very many classes longer keys make fewer chance
meetings; ``Banding.tuned`` gives the repetitions that they take.

Classes that meet are compared by their lengths and by one bit of each of 120 minhashes; what is left is verified exactly.

Hot halves: a bounded sample of the texts tells, before the shuffle, which left halves very many classes will have. Their
rows go under their whole keys instead, and keys that are still hot are split into blocks, a task for each pair of blocks. So
do left halves that turn out hot only where they meet; they are streamed past, never held.

Defined results: null texts and texts without a word take part in nothing; a text id that occurs more than once with the
same text counts once; other columns of the input are ignored, whatever their names; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclera.llm.words import WordHashes, mix, multiset_features
from asclera.operators.components import connected_components
from asclera.runtime import materialize, partitions_for, release, small, spread

#: Sketch bits in the label of a class, in the key of a row beside the number of words (or LONGEST), and in all.
_LABEL_BITS, _KEY_BITS, _BITS, _LONGEST = 44, 12, 120, 4095
_ROW = "key long, label long, r0 long, r1 long, sketch long"
_NAMES = ["key", "label", "r0", "r1", "sketch"]
_FOUND = f"a long, b long, {_ROW}, cls binary"


@dataclass(frozen=True)
class Banding:
    """threshold: least word overlap. apart: by so many standard deviations the sketches of two classes may agree in less than
    the threshold lets expect (of the pairs at the threshold one in 700 does at 3). hot: classes of one key that are compared in one task;
    more are compared in blocks. sampled: texts, about, that hot halves are looked for in before the shuffle."""

    threshold: float = 0.8
    repetitions: int = 3
    left: int = 8
    right: int = 14
    rows: int = 4
    apart: float = 3.0
    hot: int = 16_384
    sampled: int = 5_000
    seed: int = 7

    def __post_init__(self):
        if not 1 <= self.right <= 14 or self.hashes < _BITS:
            raise ValueError(f"1 to 14 right halves, and {_BITS} minhashes at least")

    @property
    def hashes(self) -> int:
        return self.repetitions * (self.left + self.right) * self.rows

    def recall(self, overlap: float, ratio: float = 1.0) -> float:
        """The probability that two texts of this overlap, the shorter ``ratio`` times as long, meet in a key."""
        half = (overlap / (1 + ratio - overlap)) ** self.rows
        return 1 - (1 - (1 - (1 - half) ** self.left) * (1 - (1 - half) ** self.right)) ** self.repetitions

    @classmethod
    def tuned(cls, recall: float, rows: int, **others) -> Banding:
        """With keys of 2 ``rows`` minhashes and as many repetitions as reach the recall at the threshold."""
        n = next(n for n in range(1, 10_000) if n * rows * 22 >= _BITS and cls(**{**others, "rows": rows, "repetitions": n}).recall(others.get("threshold", cls.threshold)) >= recall)
        return cls(**{**others, "rows": rows, "repetitions": n})


def _minhashes(features: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = (features >> np.uint64(32)).astype(np.uint32)
    out, h = np.empty((n, len(starts)), np.uint32), np.empty_like(x)
    for i, (a, b) in enumerate(rng.integers(0, 1 << 32, (n, 2), dtype=np.uint64).astype(np.uint32)):
        np.multiply(x, a | np.uint32(1), out=h)
        np.bitwise_xor(h, b, out=h)
        np.minimum.reduceat(h, starts, out=out[i])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _texts(batch: pa.RecordBatch, hashes: WordHashes, each: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, features, first feature of each text and number of features, of the texts that have a word, some at a time."""
    for at in range(0, batch.num_rows, each):
        part = batch.slice(at, each)
        features, counts = multiset_features([t or "" for t in part.column(1).to_pylist()], hashes)
        has = counts > 0
        if has.any():
            counts = counts[has]
            yield np.asarray(part.column(0).to_numpy(zero_copy_only=False))[has], features, np.cumsum(counts) - counts, counts


def _classes(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits of an order-free hash of each multiset, as two columns."""
    one, two = np.add.reduceat(features, starts), np.add.reduceat(mix(features ^ np.uint64(0xD6E8FEB86659FD93)), starts)
    return np.stack([mix(one), mix(two)], 1)


def _binary(cls: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(cls), [None, pa.py_buffer(np.ascontiguousarray(cls).tobytes())]).cast(pa.binary())


def _sketches(mins: np.ndarray, first: int, n: int) -> np.ndarray:
    """One bit of each of n minhashes."""
    out = np.zeros(mins.shape[1], np.uint64)
    for i in range(n):
        out |= ((mins[first + i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)) << np.uint64(i)
    return out


def _labels(cls: np.ndarray, mins: np.ndarray) -> np.ndarray:
    """A short name for a class: bits of its hash and its sketch. Classes that share one are compared with each other."""
    return ((cls[:, 0] >> np.uint64(_LABEL_BITS)) << np.uint64(_LABEL_BITS)) | _sketches(mins, 0, _LABEL_BITS)


def _folded(halves: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit hash of the minhashes (rows of ``halves``)."""
    out = np.full(halves.shape[1], salt + 1, np.uint64)
    for h in halves:
        out = out * np.uint64(0x9E3779B97F4A7C15) + h
    return mix(out)


def _rows_of(b: Banding, hot: np.ndarray, wanted: bool, members: bool = False):
    """(id, text) -> a row for each class and left half; only those whose left half is in ``hot`` (or only those it isn't in).
    key: 40 bits of the left half, the number of words, bits of the sketch; r0, r1: 9 bits of each right half.

    ``members``: with a row for each text as well, that has its class, its id in place of the sketch, and no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), {}
        for batch in batches:
            for ids, features, starts, counts in _texts(batch, hashes):
                cls = _classes(features, starts)
                names = list(map(tuple, cls.tolist()))
                # copies within a task are left out before the shuffle; the labels are forgotten, not kept without bound
                if len(seen) > 300_000:
                    seen.clear()
                new = np.zeros(len(cls), bool)
                new[[i for i, c in enumerate(names) if c not in seen and seen.setdefault(c, 0) == 0]] = True
                new_at = np.flatnonzero(new)
                features, counts = features[np.repeat(new, counts)], counts[new]
                mins = _minhashes(features, np.cumsum(counts) - counts, b.hashes, b.seed) if len(new_at) else np.empty((b.hashes, 0), np.uint32)
                label = _labels(cls[new], mins)
                seen.update(zip((names[i] for i in new_at.tolist()), label.tolist(), strict=True))
                if members:
                    of = np.fromiter((seen[c] for c in names), np.uint64, len(names))
                    none = np.zeros(len(of), np.uint64)
                    yield pa.record_batch([*map(_signed, (cls[:, 0] >> np.uint64(24) << np.uint64(24), of, none, none, ids.astype(np.int64))), _binary(cls)], names=[*_NAMES, "cls"])
                if not len(new_at):
                    continue
                low = (np.minimum(counts, _LONGEST).astype(np.uint64) << np.uint64(_KEY_BITS)) | _sketches(mins, _LABEL_BITS, _KEY_BITS)
                sketch = _sketches(mins, _LABEL_BITS + _KEY_BITS, 64)
                halves = mins.reshape(b.repetitions, b.left + b.right, b.rows, -1)
                keys, rights = [], []
                for rep in range(b.repetitions):
                    own = np.zeros((2, len(label)), np.uint64)
                    for j in range(b.right):
                        own[j // 7] |= (_folded(halves[rep, b.left + j], 0) >> np.uint64(55)) << np.uint64(9 * (j % 7))
                    for i in range(b.left):
                        keys.append((_folded(halves[rep, i], rep * b.left + i) >> np.uint64(24) << np.uint64(24)) | low)
                        rights.append(own)
                rows = [np.concatenate(keys), np.tile(label, len(keys)), *np.concatenate(rights, 1), np.tile(sketch, len(keys))]
                if len(hot):
                    at = np.isin(rows[0] >> np.uint64(24), hot) == wanted
                    rows = [r[at] for r in rows]
                if len(rows[0]):
                    yield pa.record_batch([*map(_signed, rows), pa.nulls(len(rows[0]), pa.binary())], names=[*_NAMES, "cls"])

    return run


def _hot_halves(texts: DataFrame, n: int, b: Banding) -> np.ndarray:
    """Left halves that, by a sample, very many classes have. This decides where rows meet, not whether."""
    every = max(1, n // b.sampled)
    some = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0) if every > 1 else texts
    rows = some.mapInArrow(_rows_of(b, np.empty(0, np.uint64), False), f"{_ROW}, cls binary").select(F.shiftrightunsigned("key", 24).alias("half"), "label").distinct()
    found = rows.groupBy("half").count().where(F.col("count") >= max(20, b.hot // every)).select("half").collect()
    return np.array(sorted(r.half for r in found), np.uint64)


def _least_agreement(n: np.ndarray, m: np.ndarray, b: Banding) -> np.ndarray:
    """How many of the sketch bits must agree in texts of n and m words, whose lengths may be unknown."""
    most = np.maximum(n, m).astype(float)
    shared = b.threshold * most
    known = most < _LONGEST
    j = np.where(known, shared / np.maximum(n + m - shared, 1e-9), b.threshold / (2 - b.threshold))
    p = (1 + np.minimum(j, 1)) / 2
    return _BITS * p - b.apart * np.sqrt(_BITS * p * (1 - p))


def _near(rows: list[np.ndarray], x: np.ndarray, y: np.ndarray, b: Banding) -> np.ndarray:
    """Which of the pairs (x, y) of rows (key, label, ..., sketch) may reach the threshold."""
    words = ((rows[0] >> np.uint64(_KEY_BITS)) & np.uint64(_LONGEST)).astype(np.int32)
    n, m = words[x], words[y]
    most = np.maximum(n, m)
    ok = np.flatnonzero((np.minimum(n, m) >= b.threshold * most - 1e-6) | (most == _LONGEST))
    x, y, n, m = x[ok], y[ok], n[ok], m[ok]
    differ = np.bitwise_count(rows[-1][x] ^ rows[-1][y]) + np.bitwise_count((rows[1][x] ^ rows[1][y]) & np.uint64((1 << _LABEL_BITS) - 1))
    least = float(_least_agreement(np.array([_LONGEST]), np.array([_LONGEST]), b)[0])  # other lengths ask for more
    some = np.flatnonzero(differ <= _BITS - least)
    ok, x, y, n, m, differ = (v[some] for v in (ok, x, y, n, m, differ))
    differ = differ + np.bitwise_count((rows[0][x] ^ rows[0][y]) & np.uint64((1 << _KEY_BITS) - 1))
    return ok[_BITS - differ.astype(np.int64) >= _least_agreement(n, m, b)]


def _meetings(rows: list[np.ndarray], run: np.ndarray, b: Banding) -> Iterator[np.ndarray]:
    """The pairs of labels within each run (rows of one number in ``run``, which is sorted); shift by shift, so that no loop
    goes over single pairs."""
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(run)))
    shift = 1
    while True:
        keep = size > shift
        first, size = first[keep], size[keep]
        if not len(first):
            return
        n = size - shift
        x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        for at in range(0, len(x), 4_000_000):
            p = x[at : at + 4_000_000]
            ok = _near(rows, p, p + shift, b)
            yield np.stack([rows[1][p[ok]], rows[1][p[ok] + shift]])
        shift += 1


def _pairs_of(held: list[np.ndarray]) -> np.ndarray:
    p = np.concatenate([np.empty((2, 0), np.uint64), *held], 1).view(np.int64)
    p = np.sort(p[:, p[0] != p[1]], axis=0)
    return np.unique(p, axis=1) if p.shape[1] else p


def _met(b: Banding, whole: bool, chunk: int = 1_000_000):
    """Rows in the order of their keys -> candidate pairs (a, b); rows of hot keys and members as they are, with nulls as a and b.

    Rows of one left half meet if they agree in a right half as well; all rows of one key do if it is ``whole``."""

    def hot_rows(rows: list[np.ndarray]) -> pa.RecordBatch:
        none = pa.nulls(len(rows[0]), pa.int64())
        return pa.record_batch([none, none, *map(_signed, rows), pa.nulls(len(rows[0]), pa.binary())], names=["a", "b", *_NAMES, "cls"])

    def pairs(p: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(p.shape[1], pa.int64())
        return pa.record_batch([pa.array(p[0]), pa.array(p[1]), *[none] * len(_NAMES), pa.nulls(p.shape[1], pa.binary())], names=["a", "b", *_NAMES, "cls"])

    def compared(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [r[new] for r in rows]
        half = rows[0] >> np.uint64(24)
        first = np.flatnonzero(np.concatenate(([True], half[1:] != half[:-1]))) if len(half) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(half)))
        many = np.repeat(size > b.hot, size)
        if many.any():
            yield hot_rows([r[many] for r in rows])
        keep = ~many & np.repeat(size > 1, size)
        number = np.repeat(np.arange(len(size), dtype=np.uint64), size)[keep]
        rows = [r[keep] for r in rows]
        held, n = [], 0
        for j in range(1 if whole else b.right):
            # run, right half and place of a row in one number, so that a plain sort does
            by = (number << np.uint64(33)) | np.arange(len(number), dtype=np.uint64)
            if not whole:
                by = np.sort(by | (((rows[2 + j // 7] >> np.uint64(9 * (j % 7))) & np.uint64(511)) << np.uint64(24)))
            run = by >> np.uint64(24)
            met = np.zeros(len(run), bool)
            met[1:] = run[1:] == run[:-1]
            met[:-1] |= met[1:]
            by, run = (by[met] & np.uint64((1 << 24) - 1)).astype(np.int64), run[met]
            for p in _meetings([r[by] for r in rows], run, b):
                held.append(p)
                n += p.shape[1]
                if n > 2_000_000:
                    held, n = [_pairs_of(held).view(np.uint64)], 0
        yield pairs(_pairs_of(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n, streamed = 0, None
        for batch in batches:
            if batch.column("cls").null_count < batch.num_rows:
                own = batch.filter(batch.column("cls").is_valid())
                none = pa.nulls(own.num_rows, pa.int64())
                yield pa.record_batch([none, none, *(own.column(c) for c in [*_NAMES, "cls"])], names=["a", "b", *_NAMES, "cls"])
                batch = batch.filter(batch.column("cls").is_null())
            rows = [batch.column(c).to_numpy().view(np.uint64) for c in _NAMES]
            if streamed is not None:  # the rest of a half that is hot goes on as it comes
                same = (rows[0] >> np.uint64(24)) == streamed
                yield hot_rows([r[same] for r in rows])
                if same.all():
                    continue
                rows, streamed = [r[~same] for r in rows], None
            held.append(rows)
            n += len(rows[0])
            if n >= chunk:
                all_ = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = all_[0][-1] >> np.uint64(24)
                cut = int(np.flatnonzero((all_[0] >> np.uint64(24)) == last)[0])
                if cut:
                    yield from compared([c[:cut] for c in all_])
                rest = [c[cut:] for c in all_]
                _, one = np.unique(rest[1], return_index=True)
                rest = [c[one] for c in rest]
                if len(one) > b.hot:
                    yield hot_rows(rest)
                    streamed, rest = last, [c[:0] for c in rest]
                held, n = [rest], len(rest[0])
        if n:
            yield from compared([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _of_hot(rows: DataFrame, b: Banding) -> DataFrame:
    """Candidate pairs (a, b) of the rows of hot halves: by their whole keys, and where these are hot too, in blocks."""
    spark = rows.sparkSession
    right = [F.shiftrightunsigned(f"r{j // 7}", 9 * (j % 7)).bitwiseAND(F.lit(511)) for j in range(b.right)]
    half = F.xxhash64(F.shiftrightunsigned("key", 24), F.col("j"), F.col("right")).bitwiseAND(F.lit(-1 << 24))
    each = rows.select("key", "label", "sketch", F.posexplode(F.array(*right)).alias("j", "right"))
    zero = F.lit(0).cast("long")
    each = each.select(half.bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 24) - 1))).alias("key"), "label", zero.alias("r0"), zero.alias("r1"), "sketch")
    each = each.withColumn("cls", F.lit(None).cast("binary")).repartition(partitions_for(spark, rows.count() * b.right), F.shiftright("key", 24)).sortWithinPartitions("key", "label")
    found = materialize(each.mapInArrow(_met(b, True), _FOUND), "hot")
    candidates, hot = found.where("a is not null").select("a", "b"), found.where("a is null").select(F.shiftright("key", 24).alias("half"), "key", "label", "sketch")
    if hot.isEmpty():
        return candidates
    hot = hot.distinct()
    sizes = hot.groupBy("half").agg(F.ceil(F.count("*") / b.hot).cast("int").alias("blocks"))
    cells = (
        hot.join(sizes, "half").withColumn("own", F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("half", "key", "label", "sketch", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def cell(_: tuple, t: pa.Table) -> pa.Table:
        own = t.column("own").to_numpy()
        rows = [t.column(c).to_numpy().view(np.uint64) for c in ("key", "label", "sketch")]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        x, y, held = np.flatnonzero(own == i), np.flatnonzero(own == j), []
        step = max(1, 4_000_000 // max(1, len(y)))
        for at in range(0, len(x), step):
            p, q = (v.reshape(-1) for v in np.meshgrid(x[at : at + step], y, indexing="ij"))
            ok = _near(rows, p, q, b)
            held.append(np.stack([rows[1][p[ok]], rows[1][q[ok]]]))
        p = _pairs_of(held)
        return pa.table({"a": p[0], "b": p[1]})

    return candidates.unionByName(cells.groupBy("half", "i", "j").applyInArrow(cell, "a long, b long"))


def _overlapping(threshold: float):
    """Pairs of feature lists (one word's n-th occurrence each) -> the pairs whose overlap reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lists = [np.frombuffer(v, np.uint32) for c in ("fa", "fb") for v in x.column(c).to_pylist()]
            n = x.num_rows
            if not n:
                continue
            counts = np.array([len(v) for v in lists])
            pair = np.repeat(np.concatenate([np.arange(n), np.arange(n)]).astype(np.uint64), counts)
            f = np.sort((pair << np.uint64(32)) | np.concatenate(lists))
            both = (f[1:][f[1:] == f[:-1]] >> np.uint64(32)).astype(np.int64)
            overlap = np.bincount(both, minlength=n) / np.maximum(counts[:n], counts[n:])
            ok = pa.array(overlap >= threshold - 1e-9)
            yield pa.record_batch([x.column("a").filter(ok), x.column("b").filter(ok), pa.array(overlap).filter(ok)], names=["a", "b", "overlap"])

    return run


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for _, features, starts, counts in _texts(batch, hashes):
            low, ends = (features & np.uint64(0xFFFFFFFF)).astype(np.uint32), starts + counts
            yield pa.record_batch([_binary(_classes(features, starts)), pa.array([low[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())], names=["cls", "features"])


def near_duplicates(df: DataFrame, id_col: str, text_col: str, banding: Banding | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership (id, cls), one row for each id and class, and links (a, b, overlap), a < b, one for each pair of classes
    whose word overlap reaches the threshold. Ids whose cls is the same have the same words. Both are written tables.
    """
    b = banding or Banding()
    spark = df.sparkSession
    texts = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()))
    n = df.count()
    hot_halves = _hot_halves(texts, n, b)
    rows = texts.mapInArrow(_rows_of(b, hot_halves, False, True), f"{_ROW}, cls binary")
    rows = rows.repartition(partitions_for(spark, n * b.repetitions * b.left), F.shiftright("key", 24)).sortWithinPartitions("key", "label")
    found = materialize(rows.mapInArrow(_met(b, False), _FOUND), "buckets")
    del rows
    release(spark)
    candidates, hot = found.where("a is not null").select("a", "b"), found.where("a is null and cls is null").drop("a", "b", "cls")
    if len(hot_halves):
        hot = hot.unionByName(texts.mapInArrow(_rows_of(b, hot_halves, True), f"{_ROW}, cls binary").drop("cls"))
    if not hot.isEmpty():
        candidates = candidates.unionByName(_of_hot(hot.distinct(), b))

    parts = partitions_for(spark, n)
    named = materialize(found.where("cls is not null").select(F.col("sketch").alias("id"), "cls", "label").distinct(), "members")
    members = named.select("id", "cls")
    same = named.groupBy("label").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select(F.col("label").alias("a"), F.col("label").alias("b"))
    candidates = materialize(candidates.repartition(parts, "a", "b").distinct().unionByName(same), "candidates")
    release(spark, found)
    needed = materialize(candidates.select(F.explode(F.array("a", "b")).alias("label")).distinct(), "needed")
    first = materialize(named.join(small(needed), "label", "left_semi").groupBy("label", "cls").agg(F.min("id").alias("id")), "representatives")
    features = texts.join(small(first.select("id")), "id", "left_semi").mapInArrow(_features_of, "cls binary, features binary").dropDuplicates(["cls"])
    features = materialize(first.select("label", "cls").join(features, "cls"), "features")
    release(spark, first)
    left, right = (features.select(F.col("label").alias(x), F.col("cls").alias(f"c{x}"), F.col("features").alias(f"f{x}")) for x in "ab")
    pairs = candidates.join(left, "a").join(right, "b").where("a != b or ca < cb")
    swap = F.col("ca") > F.col("cb")
    pairs = pairs.select(F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("a"), F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("b"), "fa", "fb")
    links = materialize(pairs.mapInArrow(_overlapping(b.threshold), "a binary, b binary, overlap double"), "links")
    release(spark, candidates, features, needed)
    return members, links


def duplicate_pairs(members: DataFrame, links: DataFrame, hot: int = 1000) -> DataFrame:
    """All pairs of ids (a < b) that are in linked classes or in one class. A class of more than ``hot`` ids meets its partners
    in parts, as the result is as large as the product of the two."""
    m = members.repartition("cls")
    sizes = m.groupBy("cls").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts"), F.count("*").alias("n"))
    linked = links.select(F.explode(F.array("a", "b")).alias("cls")).distinct().withColumn("linked", F.lit(True))
    m = materialize(m.join(sizes, "cls").join(linked, "cls", "left").where("n > 1 or linked"), "partners")
    m = small(m)
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    one = m.where("linked").select(F.col("cls").alias("a"), F.col("id").alias("x"), part)
    of_a = m.where("linked").select(F.col("cls").alias("a"), "parts").distinct().select("a", every_part)
    of_b = m.where("linked").select(F.col("cls").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(of_a, "a").join(of_b, "b").join(one, ["a", "part"]).select("x", "y")
    again = m.where("n > 1").select("cls", F.col("id").alias("y"), every_part)
    within = m.where("n > 1").select("cls", F.col("id").alias("x"), part).join(again, ["cls", "part"]).where("x < y").select("x", "y")
    return across.unionByName(within).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, group (the least id of its group), copies (ids with exactly its words, itself included) and links (linked classes)."""
    comp = connected_components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    of_class = members.groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    of_class = of_class.join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    of_class = of_class.join(degree, "cls", "left")
    group = of_class.groupBy("component").agg(F.min("least").alias("group"))
    return (
        members.join(of_class.drop("least"), "cls").join(group, "component")
        .select("id", "group", F.col("copies").cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )
