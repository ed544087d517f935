"""Records of evaluation splits that the training split has as well, exactly or nearly: a segment join.

A record is the string of its words, rarest first (all records in the same order, so that word order in the texts makes no
difference). If two records share at least ``threshold`` of the words of the larger one, no more than k = (1 - threshold) n
of a record's n words are edited away. Cut into k + 1 segments from its rare end, one word each, an evaluation record keeps
at least one of them intact, and the training record has it among its own first k + 1 words, which are the allowed
positions. Records that meet in a segment are compared by an upper bound of their overlap: 256 parities of their words differ
in no more places than the words do. What is left is verified by banded dynamic programming over the whole strings.

Rows of a segment come to a task in order and are worked off as they come. Segments with more than ``HOT`` pairs, or more rows
than a task holds, are streamed past and split into blocks.

Which words are rare comes from counts over all records, in a table of fixed size (words that share a slot share a count,
which costs time but no pair). Records with equal words are one class from the start, so copies cost nothing however many.

Defined results: records without a question text do not take part; a null second text counts as empty; a null split is not
the training split; repeated rows give one row; a record is never paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclera.llm.words import WordHashes, mix, multiset_features
from asclera.runtime import materialize, partitions_for, small, spread

SLOTS = 1 << 18
_PARTS = "key long, cls long, train boolean, n int, s0 long, s1 long, s2 long, s3 long"
#: Pairs of one segment that are compared in one task; more are compared in blocks. Rows that a task holds.
HOT, HELD = 1 << 27, 1_000_000


def _slot(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(46)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, counts = WordHashes(), np.zeros(SLOTS, np.int64)
    for b in batches:
        features, _ = multiset_features(b.column("text").to_pylist(), hashes)
        counts += np.bincount(_slot(features), minlength=SLOTS)
    at = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["slot", "n"])


def _classes(features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each multiset that has words, and which texts these are."""
    has = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[has]
    return (mix(np.add.reduceat(features, starts)) if len(has) else np.empty(0, np.uint64)), has


def _segments(often: np.ndarray, threshold: float):
    """(id, text, train) -> a row for each segment of a record, and one with its id as key and no words for the record itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            train = b.column("train").to_numpy(zero_copy_only=False)
            features, counts = multiset_features(b.column("text").to_pylist(), hashes)
            cls, has = _classes(features, counts)
            if not len(has):
                continue
            if len(seen) > 200_000:
                seen.clear()
            new = np.array([(key := (c, t)) not in seen and not seen.add(key) for c, t in zip(cls.tolist(), train[has].tolist(), strict=True)])
            text = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((features, often[_slot(features)], text))
            place = np.arange(len(features)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = np.floor((1 - threshold) * counts + 1e-9).astype(np.int64) + 1
            take = np.zeros(len(counts), bool)
            take[has[new]] = True
            keep = (place < first[text]) & take[text]
            owner = text[keep]
            place_of, one = (features >> np.uint64(6)) & np.uint64(3), np.uint64(1) << (features & np.uint64(63))
            bits = np.zeros((len(counts), 4), np.uint64)
            starts = (np.cumsum(counts) - counts)[has]
            for i in range(4):
                bits[has, i] = np.bitwise_xor.reduceat(np.where(place_of == i, one, np.uint64(0)), starts)
            own = np.zeros(len(counts), np.uint64)
            own[has] = cls
            none = pa.array(np.zeros(len(has), np.int64))
            yield pa.record_batch([b.column("id").take(pa.array(has)), pa.array(cls.view(np.int64)), pa.array(train[has]), none.cast(pa.int32()), none, none, none, none], names=["key", "cls", "train", "n", "s0", "s1", "s2", "s3"])
            yield pa.record_batch(
                [pa.array(features[order][keep].view(np.int64)), pa.array(own[owner].view(np.int64)), pa.array(train[owner]), pa.array(counts[owner].astype(np.int32))] + [pa.array(np.ascontiguousarray(bits[owner, i]).view(np.int64)) for i in range(4)],
                names=["key", "cls", "train", "n", "s0", "s1", "s2", "s3"],
            )

    return run


def _near(e: np.ndarray, t: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Evaluation rows x training rows (cls, n, s0..s3), both by rising n -> the pairs whose overlap can reach the threshold."""
    if not len(e) or not len(t):
        return
    need = np.ceil(threshold * np.arange(max(e["n"][-1], t["n"][-1]) + 1) - 1e-9).astype(np.int32)
    es, ts = (np.ascontiguousarray([x[f"s{i}"] for i in range(4)]) for x in (e, t))
    en, tn = e["n"].astype(np.int32), t["n"].astype(np.int32)
    for at in range(0, len(e), 32):
        x = slice(at, at + 32)
        low, high = np.searchsorted(tn, need[en[at]]), np.searchsorted(tn, int(en[x][-1] / threshold + 1e-6), "right")
        for begin in range(low, high, 4096):
            y = slice(begin, min(begin + 4096, high))
            differ = np.bitwise_count(es[0, x, None] ^ ts[0, y]).astype(np.int16)
            for i in range(1, 4):
                differ += np.bitwise_count(es[i, x, None] ^ ts[i, y])
            i, j = np.nonzero(differ <= en[x, None] + tn[y] - 2 * need[np.maximum(en[x, None], tn[y])])
            n, m = en[x][i], tn[y][j]
            ok = np.minimum(n, m) >= need[np.maximum(n, m)]
            yield e["cls"][x][i[ok]], t["cls"][y][j[ok]]


_ROW = np.dtype([("key", np.int64), ("cls", np.int64), ("train", bool), ("n", np.int64)] + [(f"s{i}", np.uint64) for i in range(4)])


def _rows(tables: list) -> np.ndarray:
    out = np.empty(sum(t.num_rows for t in tables), _ROW)
    at = 0
    for t in tables:
        for f in _ROW.names:
            x = t.column(f).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(f).to_numpy()
            out[f][at : at + t.num_rows] = x.view(np.uint64) if f[0] == "s" else x
        at += t.num_rows
    return out


def _in_order(rows: np.ndarray) -> np.ndarray:
    """By segment, evaluation rows first, by rising length; a class once."""
    rows = rows[np.lexsort((rows["cls"], rows["n"], rows["train"], rows["key"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["train"][1:] != rows["train"][:-1]) | (rows["cls"][1:] != rows["cls"][:-1])
    return rows[new]


def _met(threshold: float, hot: int, held: int = HELD):
    """Rows in the order of their segments -> candidate pairs (key, cls, other); rows of hot segments and of whole records as they
    are, with other null."""

    def as_they_are(rows: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(rows[f]).view(np.int64) if f[0] == "s" else rows[f].astype(np.int32) if f == "n" else rows[f]) for f in _ROW.names]
        return pa.record_batch([*columns, pa.nulls(len(rows), pa.int64())], names=[*_ROW.names, "other"])

    def compared(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = _in_order(rows)
        edge = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1]))) if len(rows) else np.empty(0, np.int64)
        ends = np.append(edge, len(rows))
        trained = np.add.reduceat(rows["train"].astype(np.int64), edge) if len(edge) else edge
        size = np.diff(ends)
        found, n = [], 0
        for k in np.flatnonzero((trained > 0) & (trained < size)).tolist():
            own, cut = rows[ends[k] : ends[k + 1]], int(size[k] - trained[k])
            if cut * int(trained[k]) > hot:
                yield as_they_are(own)
                continue
            for p in _near(own[:cut], own[cut:], threshold):
                if len(p[0]):
                    found.append(np.stack(p))
                    n += len(p[0])
            if n > 1_000_000:
                found, n = [np.unique(np.concatenate(found, 1), axis=1)], 0
        if found:
            a, b = np.unique(np.concatenate(found, 1), axis=1)
            none = pa.nulls(len(a), pa.int64())
            yield pa.record_batch([none, pa.array(a), pa.nulls(len(a), pa.bool_()), pa.nulls(len(a), pa.int32()), none, none, none, none, pa.array(b)], names=[*_ROW.names, "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, streamed = [], 0, None
        for batch in batches:
            rows = _rows([batch])
            if not rows["n"].all():
                yield as_they_are(rows[rows["n"] == 0])
                rows = rows[rows["n"] > 0]
            if streamed is not None:  # the rest of a segment that no task holds goes on as it comes
                same = rows["key"] == streamed
                yield as_they_are(rows[same])
                if same.all():
                    continue
                rows, streamed = rows[~same], None
            parts.append(rows)
            n += len(rows)
            if n >= held:
                all_ = np.concatenate(parts)
                cut = int(np.flatnonzero(all_["key"] == all_["key"][-1])[0])
                yield from compared(all_[:cut])
                rest = _in_order(all_[cut:])
                if len(rest) >= held // 2:
                    yield as_they_are(rest)
                    streamed, rest = rest["key"][0], rest[:0]
                parts, n = [rest], len(rest)
        if n:
            yield from compared(np.concatenate(parts))

    return run


def _in_blocks(rows: DataFrame, threshold: float, each: int = 8192) -> DataFrame:
    """The candidate pairs of hot segments: every block of evaluation rows with every block of training rows, a group each."""
    sizes = rows.groupBy("key", "train").agg(F.ceil(F.count("*") / each).cast("int").alias("blocks"))
    e = sizes.where("not train").select("key", F.col("blocks").alias("eb"))
    t = sizes.where("train").select("key", F.col("blocks").alias("tb"))
    r = rows.join(e, "key").join(t, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.when(F.col("train"), F.col("tb")).otherwise(F.col("eb"))).cast("int"))
    r = r.withColumn("other_block", F.explode(F.sequence(F.lit(0), F.when(F.col("train"), F.col("eb")).otherwise(F.col("tb")) - 1)))
    cells = r.select("key", "cls", "train", "n", "s0", "s1", "s2", "s3", F.when(F.col("train"), F.col("other_block")).otherwise(F.col("own")).alias("i"), F.when(F.col("train"), F.col("own")).otherwise(F.col("other_block")).alias("j"))

    def cell(_: tuple, table: pa.Table) -> pa.Table:
        own = _in_order(_rows([table]))
        found = [np.stack(p) for p in _near(own[~own["train"]], own[own["train"]], threshold)]
        a, b = np.concatenate([np.empty((2, 0), np.int64), *found], 1)
        return pa.table({"a": a, "b": b})

    return cells.groupBy("key", "i", "j").applyInArrow(cell, "a long, b long")


def banded_overlap(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Common words of each pair of strings in one order, by dynamic programming in a band as wide as the edits allow."""
    n = len(a)
    if not n:
        return np.empty(0, np.int64)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    band = int(np.floor((1 - threshold) * np.maximum(la, lb).max() + 1e-9)) + 1
    width, rows = 2 * band + 1, int(la.max())
    left = np.zeros((n, rows), np.uint64)
    right = np.zeros((n, rows + 2 * band), np.uint64)
    valid = np.zeros(right.shape, bool)
    for k in range(n):
        left[k, : la[k]] = a[k]
        m = min(lb[k], rows + band)
        right[k, band : band + m] = b[k][:m]
        valid[k, band : band + m] = True
    # cell d of row i is column i + d - band; the row before has the same diagonal in the same cell
    now, best = np.zeros((n, width), np.int64), np.zeros(n, np.int64)
    for i in range(rows):
        inside = np.s_[:, i : i + width]
        same = (right[inside] == left[:, i, None]) & valid[inside] & (i < la)[:, None]
        above = np.concatenate([now[:, 1:], np.zeros((n, 1), np.int64)], 1)
        now = np.maximum.accumulate(np.maximum(now + same, above), axis=1)
        best = np.maximum(best, now[:, -1])
    return best


def _verified(threshold: float, cells: int = 4_000_000):
    """Pairs of strings, as many at a time as make about ``cells`` cells of a band, those of like lengths together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = ([np.frombuffer(v, np.uint64) for v in x.column(c).to_pylist()] for c in ("fa", "fb"))
            longest = np.array([max(len(p), len(q)) for p, q in zip(a, b, strict=True)], np.int64)
            order = np.argsort(-longest, kind="stable")
            overlap = np.zeros(x.num_rows)
            while len(order):
                n = int(longest[order[0]])
                own, order = np.split(order, [max(1, cells // (n + 2 * (int((1 - threshold) * n) + 1)))])
                overlap[own] = banded_overlap([a[i] for i in own], [b[i] for i in own], threshold) / longest[own]
            ok = pa.array(overlap >= threshold - 1e-9)
            yield pa.record_batch([x.column("a").filter(ok), x.column("b").filter(ok), pa.array(overlap).filter(ok)], names=["a", "b", "overlap"])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        features, counts = multiset_features(b.column("text").to_pylist(), hashes)
        cls, has = _classes(features, counts)
        ends = np.cumsum(counts)
        yield pa.record_batch([pa.array(cls.view(np.int64)), pa.array([np.sort(features[ends[i] - counts[i] : ends[i]]).tobytes() for i in has.tolist()], pa.binary())], names=["cls", "features"])


def cross_split_overlaps(df: DataFrame, id_col: str, question_col: str, other_col: str, split_col: str, threshold: float = 0.8, hot: int = HOT, held: int = HELD) -> DataFrame:
    """(eval_id, train_id, overlap): the pairs of a record outside and one inside the training split that overlap enough."""
    spark = df.sparkSession
    given = df.select(
        F.col(id_col).cast("long").alias("id"), F.lower(F.trim(F.coalesce(F.col(split_col), F.lit("")))).eqNullSafe("train").alias("train"),
        F.concat(F.col(question_col), F.lit("\n"), F.coalesce(F.col(other_col), F.lit(""))).alias("text"), F.col(question_col).alias("question"),
    ).where(F.col("question").rlike(r"[\p{L}\p{N}]")).drop("question")
    given = spread(given)
    slots = given.select("text").mapInArrow(_count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(SLOTS, np.int64)
    often[slots["slot"]] = slots["n"]

    rows = given.mapInArrow(_segments(often, threshold), _PARTS)
    rows = rows.repartition(partitions_for(spark, df.count() * 25), "key").sortWithinPartitions("key")
    found = materialize(rows.mapInArrow(_met(threshold, hot, held), _PARTS + ", other long"), "segments")
    candidates = found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))
    heavy = found.where("other is null and n > 0").drop("other")
    if not heavy.isEmpty():
        candidates = candidates.unionByName(_in_blocks(heavy, threshold))
    candidates = materialize(candidates.distinct(), "candidates")

    needed = small(materialize(candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "needed"))
    members = materialize(found.where("n = 0").select(F.col("key").alias("id"), "cls", "train").join(needed, "cls", "left_semi").distinct(), "members")
    first = materialize(members.groupBy("cls").agg(F.min("id").alias("id")), "representatives")
    features = given.join(small(first.select("id").distinct()), "id", "left_semi").mapInArrow(_features, "cls long, features binary").dropDuplicates(["cls"])
    features = materialize(features, "features")
    pairs = candidates.join(features.select(F.col("cls").alias("a"), F.col("features").alias("fa")), "a").join(features.select(F.col("cls").alias("b"), F.col("features").alias("fb")), "b")
    links = pairs.select("a", "b", "fa", "fb").mapInArrow(_verified(threshold), "a long, b long, overlap double")
    e = members.where("not train").select(F.col("cls").alias("a"), F.col("id").alias("eval_id"))
    t = members.where("train").select(F.col("cls").alias("b"), F.col("id").alias("train_id"))
    return links.join(e, "a").join(t, "b").where("eval_id != train_id").select("eval_id", "train_id", "overlap").distinct()
