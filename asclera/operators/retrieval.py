"""Retrieval: sparse and dense scoring of a stated query set against a whole corpus, hybrid re-ranking, budgeted diversity.

A sparse index is a table with a row for each passage: its terms as hashes, their weights and the passage's prior. It can be
written and read again; a search never sees the texts. Queries are the stated side: they go to the tasks in blocks, as the
postings of their few terms. A task takes the rows of its index in runs of some MB, the longest vectors first,
as then the bound of the best k is soon high. It scores a batch against a block at once: in single precision, by a product of
matrices for the terms that many have and by postings for the others. What may be among the best k of its query, with the error
that such a score can have, is scored again in double precision. A task keeps its best k of every query until it ends, so that k
rows a query and task are shuffled and nothing else. Passages that share no term fill up the ranks with 0.

Defined results: blank and null passages and queries are not scored; ties go to the lesser id; an id given more than once
counts once, with its highest score.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asclera.functions.text import let, section_weight, trigrams
from asclera.runtime import materialize, release, spread

_WORD = re.compile(r"[^\W_]+")
RANKED = "query_id long, passage_id long, score double"
INDEX = "id long, prior double, terms array<long>, weights array<double>"


def word_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


@dataclass(frozen=True)
class TermEncoder:
    """Terms by an expression, with their occurrences as weights: log(1 + n), or n in a vector of unit length."""

    terms: Callable[[Column], Column]
    unit: bool = False


@dataclass(frozen=True)
class ModelEncoder:
    """Weights of terms by a model that is made once a task and takes texts in batches."""

    make: Callable[[], Callable[[list[str]], list[dict[str, float]]]]
    batch_size: int = 32


Encoder = TermEncoder | ModelEncoder
WORDS, TRIGRAMS = TermEncoder(word_terms), TermEncoder(trigrams, unit=True)


def first_that_works(*makers: Callable[[], Encoder], only_first: bool = False) -> Encoder:
    """The encoder of the first maker that doesn't fail; RuntimeError if none is left (or allowed)."""
    failures = []
    for make in makers[:1] if only_first else makers:
        try:
            return make()
        except Exception as e:  # whatever a model's loading raises
            failures.append(f"{type(e).__name__}: {e}")
    raise RuntimeError("no encoder could be made: " + "; ".join(failures))


def pooled_terms(logits: np.ndarray, vocabulary: list[str]) -> dict[str, float]:
    """Weights of a text's terms from the logits of its tokens: the greatest log(1 + max(0, logit)) of each that has one."""
    w = np.log1p(np.maximum(logits, 0)).max(0) if len(logits) else np.zeros(len(vocabulary))
    return {vocabulary[i]: float(w[i]) for i in np.flatnonzero(w)}


def term_pooling(logits: DataFrame) -> DataFrame:
    """(id, term, weight) from (id, term, logit), a row for each token of a text: as ``pooled_terms``, for tables of logits."""
    w = logits.groupBy("id", "term").agg(F.max(F.log1p(F.greatest(F.col("logit").cast("double"), F.lit(0.0)))).alias("weight"))
    return w.where("weight > 0")


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, weight): the words of each text with their weights, a row each."""
    terms = df.select(F.col(id_col).alias("id"), F.explode(word_terms(F.col(text_col))).alias("term"))
    return terms.groupBy("id", "term").agg(F.log1p(F.count("*")).alias("weight"))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def _counted(unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, counts = b.column("terms").flatten().to_numpy(), np.diff(b.column("terms").offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), counts)
            known = pa.array(flat).dictionary_encode()
            terms = np.sort(known.dictionary.to_numpy())
            place = np.searchsorted(terms, known.dictionary.to_numpy())[known.indices.to_numpy()]
            key = np.sort(row * len(terms) + place)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
            n = np.diff(np.append(first, len(key))).astype(float)
            row, place = np.divmod(key[first], max(len(terms), 1))
            flat = terms[place]
            w = n / np.sqrt(np.bincount(row, n * n, b.num_rows))[row] if unit else np.log1p(n)
            each = np.bincount(row, minlength=b.num_rows)
            yield pa.record_batch([b.column("id"), b.column("prior"), _lists(pa.array(flat), each), _lists(pa.array(w), each)], names=["id", "prior", "terms", "weights"])

    return run


def _hash(term: str) -> int:
    h = xxhash.xxh64_intdigest(term, 42)
    return h - (1 << 64) if h >> 63 else h


def _modelled(encoder: ModelEncoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder.make()
        for b in batches:
            texts, got = b.column("text").to_pylist(), []
            for at in range(0, len(texts), encoder.batch_size):
                got += model(texts[at : at + encoder.batch_size])
            terms = [{_hash(t): w for t, w in g.items() if w} for g in got]
            yield pa.record_batch(
                [b.column("id"), b.column("prior"), pa.array([list(t) for t in terms], pa.list_(pa.int64())), pa.array([list(t.values()) for t in terms], pa.list_(pa.float64()))],
                names=["id", "prior", "terms", "weights"],
            )

    return run


def build_index(passages: DataFrame, encoder: Encoder = WORDS, prior: Callable[[Column], Column] | None = section_weight) -> DataFrame:
    """The sparse index (id, prior, terms, weights) of (id, text)."""
    p = passages.select(F.col(passages.columns[0]).cast("long").alias("id"), F.col(passages.columns[1]).alias("text")).where("trim(text) != ''")
    p = spread(p).withColumn("prior", prior(F.col("text")).cast("double") if prior else F.lit(1.0))
    if isinstance(encoder, ModelEncoder):
        return p.mapInArrow(_modelled(encoder), INDEX)
    return p.select("id", "prior", F.transform(encoder.terms(F.col("text")), lambda t: F.xxhash64(t)).alias("terms")).mapInArrow(_counted(encoder.unit), INDEX)


class _Best:
    """The best k ids of each query so far: by rounded score, then by lesser id; an id once."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids, self.scores = np.empty((0, queries), np.int64), np.empty((0, queries))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores: a row for each id, a column for each query."""
        if not len(ids) or not self.k:
            return
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], np.round(scores[order], 6)
        new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        if len(new) < len(ids):
            ids, scores = ids[new], np.maximum.reduceat(scores, new, axis=0)
        every = np.broadcast_to(ids[:, None], scores.shape)
        if len(ids) > self.k:
            key = np.round(scores * 1e6).astype(np.int64) * len(ids) - np.arange(len(ids))[:, None]
            rows = np.argpartition(-key, self.k - 1, axis=0)[: self.k]
            every, scores = np.take_along_axis(every, rows, 0), np.take_along_axis(scores, rows, 0)
        every, scores = np.concatenate([self.ids, every]), np.concatenate([self.scores, scores])
        by = np.lexsort((-scores, every), axis=0)  # an id that was there before is equal to its neighbour, the lower score behind
        every, scores = np.take_along_axis(every, by, 0), np.take_along_axis(scores, by, 0)
        scores[1:][every[1:] == every[:-1]] = -np.inf
        by = np.lexsort((every, -scores), axis=0)[: self.k]
        self.ids, self.scores = np.take_along_axis(every, by, 0), np.take_along_axis(scores, by, 0)

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        query = np.broadcast_to(query_ids, self.ids.shape)[kept := np.isfinite(self.scores)]
        return pa.record_batch([pa.array(query), pa.array(self.ids[kept]), pa.array(self.scores[kept])], names=["query_id", "passage_id", "score"])


class _Postings:
    """The postings of a block of queries over the terms of all blocks: of term t those from first[t] on, many[t] of them, by query."""

    def __init__(self, own: np.ndarray, term: np.ndarray, of: np.ndarray, weight: np.ndarray, terms: int):
        self.own, self.n = own, len(own)
        self.key, back = np.unique(term * self.n + of, return_inverse=True)
        self.weight = np.bincount(back, weight, len(self.key))
        self.term, self.of = np.divmod(self.key, max(self.n, 1))
        self.many = np.bincount(self.term, minlength=terms)
        self.first = np.cumsum(self.many) - self.many
        self.norm = np.sqrt(np.bincount(self.of, self.weight * self.weight, self.n))
        self.longest = np.bincount(self.of, minlength=1).max()
        self.positive = bool((self.weight >= 0).all())


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1 and so on, n[i] of them, one i after the other."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


class _Chunk:
    """Placed rows of an index. Of their terms the dense ones are a matrix, the rest lists by row.
    dense: of each term its column, or -1. distinct: a row of each id, by id."""

    def __init__(self, b: pa.RecordBatch):
        self.ids, self.prior = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "prior"))
        self.at, self.weight = (b.column(c).flatten().to_numpy() for c in ("terms", "weights"))
        self.rows, self.distinct = len(self.ids), np.unique(self.ids, return_index=True)[1]
        self.row = np.repeat(np.arange(self.rows), np.diff(b.column("terms").offsets.to_numpy()))

    def split(self, dense: np.ndarray) -> None:
        column, n = dense[self.at], dense.max(initial=-1) + 1
        w = self.weight * self.prior[self.row]
        self.norm, self.longest = np.sqrt(np.bincount(self.row, w * w).max(initial=0)), np.bincount(self.row).max(initial=0)
        self.positive = bool((w >= 0).all())
        d, rest = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        self.dense = np.bincount(self.row[d] * n + column[d], self.weight[d], self.rows * n).reshape(self.rows, n)
        self.single = (self.dense * self.prior[:, None]).astype(np.float32)
        self.at, self.row, self.weight, self.whole = self.at[rest], self.row[rest], self.weight[rest], w[rest]
        self.many = np.bincount(self.row, minlength=self.rows)
        self.first = np.cumsum(self.many) - self.many


class _Search:
    """The best k of a block of queries, by rounded score, then by lesser id, an id once. All scores come in single precision;
    those that may be among the best, with the error that they can have at most, are worked out again in double precision."""

    def __init__(self, p: _Postings, k: int, dense: np.ndarray):
        self.p, self.k = p, k
        self.ids, self.scores, self.floor = np.empty((p.n, 0), np.int64), np.empty((p.n, 0)), np.full(p.n, -np.inf)
        self.dense = np.zeros((p.n, dense.max(initial=-1) + 1))
        at = np.flatnonzero(dense[p.term] >= 0)
        self.dense[p.of[at], dense[p.term[at]]] = p.weight[at]
        self.single, self.met, self.waiting = self.dense.astype(np.float32), [], 0

    def add(self, c: _Chunk) -> None:
        p = self.p
        s = self.single @ c.single.T
        n = p.many[c.at]
        which = _places(p.first[c.at], n)
        np.add.at(s.reshape(-1), p.of[which] * c.rows + np.repeat(c.row, n), (np.repeat(c.whole, n) * p.weight[which]).astype(np.float32))
        error = (min(p.longest, c.longest) + 8) * 2.0**-23 * p.norm * c.norm + 2e-6
        if np.isneginf(self.floor).any() and len(c.distinct) >= self.k:
            kth = len(c.distinct) - self.k
            self.floor = np.maximum(self.floor, np.partition(s[:, c.distinct], kth, axis=1)[:, kth] - error)
        floor = np.nextafter((self.floor - error).astype(np.float32), np.float32(-np.inf))
        if p.positive and c.positive and len(low := np.flatnonzero(floor <= 0)):
            # Of those that have nothing in common with the query, the first k ids are enough.
            none = s[low][:, c.distinct] == 0
            query, row = np.nonzero(none & (none.cumsum(axis=1) <= self.k))
            self.meet(c, low[query], c.distinct[row])
            floor = np.maximum(floor, np.finfo(np.float32).smallest_subnormal)
        some = np.flatnonzero(s.max(axis=1) >= floor)
        query, row = np.divmod(np.flatnonzero(s[some] >= floor[some, None]), c.rows)
        self.meet(c, some[query], row)

    def meet(self, c: _Chunk, query: np.ndarray, row: np.ndarray) -> None:
        step = 250_000 // max(100, c.longest, c.dense.shape[1])
        for i in range(0, len(query), step):
            q, r = query[i : i + step], row[i : i + step]
            self.met.append((q, c.ids[r], self.exact(c, q, r)))
            self.waiting += len(q)
            if self.waiting >= self.k * self.p.n:
                self.settle()

    def exact(self, c: _Chunk, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        n = c.many[row]
        which, pair = _places(c.first[row], n), np.repeat(np.arange(len(row)), n)
        key = c.at[which] * self.p.n + query[pair]
        found = np.minimum(np.searchsorted(self.p.key, key), len(self.p.key) - 1)
        hit = np.flatnonzero(self.p.key[found] == key) if len(self.p.key) else found[:0]
        rest = np.bincount(pair[hit], c.weight[which[hit]] * self.p.weight[found[hit]], len(row))
        return np.round((np.einsum("ij,ij->i", self.dense[query], c.dense[row]) + rest) * c.prior[row], 6)

    def settle(self) -> None:
        if not self.met:
            return
        kept = np.isfinite(self.scores)
        query, ids, scores = (np.concatenate(x) for x in zip(*self.met, (np.nonzero(kept)[0], self.ids[kept], self.scores[kept]), strict=True))
        by = np.lexsort((-scores, ids, query))
        query, ids, scores = query[by], ids[by], scores[by]
        once = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (query[1:] != query[:-1])))[: len(ids)])
        query, ids, scores = query[once], ids[once], scores[once]
        by = np.lexsort((ids, -scores, query))
        query, ids, scores = query[by], ids[by], scores[by]
        each = np.bincount(query, minlength=self.p.n)
        rank = np.arange(len(query)) - np.repeat(np.cumsum(each) - each, each)
        best = np.flatnonzero(rank < self.k)
        self.ids, self.scores = np.zeros((self.p.n, self.k), np.int64), np.full((self.p.n, self.k), -np.inf)
        self.ids[query[best], rank[best]], self.scores[query[best], rank[best]] = ids[best], scores[best]
        self.floor = np.maximum(self.floor, self.scores[:, -1])
        self.met, self.waiting = [], 0

    def batch(self) -> pa.RecordBatch:
        self.settle()
        query, rank = np.nonzero(np.isfinite(self.scores))
        return pa.record_batch([pa.array(self.p.own[query]), pa.array(self.ids[query, rank]), pa.array(self.scores[query, rank])], names=["query_id", "passage_id", "score"])


#: A term is multiplied densely where this share of all pairs of a query and a passage have it in common: what a column of a matrix costs.
_DENSE, _MOST_DENSE = 0.002, 1024


def _placed(b: pa.RecordBatch, vocabulary: pa.Array) -> pa.RecordBatch:
    """Rows of an index with places in the vocabulary for terms, and without those that it lacks."""
    counts = np.diff(b.column("terms").offsets.to_numpy())
    at = pc.index_in(b.column("terms").flatten(), value_set=vocabulary)
    known = at.is_valid()
    each = np.bincount(np.repeat(np.arange(b.num_rows), counts)[known.to_numpy(zero_copy_only=False)], minlength=b.num_rows)
    return pa.record_batch([b.column("id"), b.column("prior"), _lists(at.filter(known), each), _lists(b.column("weights").flatten().filter(known), each)], names=["id", "prior", "terms", "weights"])


def _heaviest_first(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, each: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The placed rows of an index, ``each`` at a time, in runs of about ``most`` bytes, each by falling length of its vectors times their priors."""
    run, norms, known = [], [], pa.array(vocabulary)

    def ordered() -> Iterator[pa.RecordBatch]:
        rows, order = pa.Table.from_batches(run).combine_chunks(), np.argsort(-np.concatenate(norms), kind="stable")
        run.clear()
        norms.clear()
        pa.default_memory_pool().release_unused()
        for i in range(0, len(order), each):
            yield from rows.take(pa.array(order[i : i + each])).combine_chunks().to_batches()

    for b in batches:
        run.append(b := _placed(b, known))
        w, row = b.column("weights").flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(b.column("weights").offsets.to_numpy()))
        norms.append(np.sqrt(np.bincount(row, w * w, b.num_rows)) * b.column("prior").to_numpy(zero_copy_only=False))
        if sum(x.nbytes for x in run) >= most:
            yield from ordered()
    if run:
        yield from ordered()


def _sparse(queries: list, k: int, block: int = 1000, each: int = 1000):
    """queries: rows (id, terms, weights), searched for in blocks while the index is read once."""
    vocabulary, term = np.unique(np.array([t for q in queries for t in q.terms], np.int64), return_inverse=True)
    of = np.repeat(np.arange(len(queries)), [len(q.terms) for q in queries]).astype(np.int64)
    weight = np.array([w for q in queries for w in q.weights], float)
    own = np.array([q.id for q in queries], np.int64)
    cuts = [(i, np.searchsorted(of, [i, i + block])) for i in range(0, len(own), block)]
    asked = np.bincount(term, minlength=len(vocabulary)) / max(1, len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: list[_Search] = []
        for b in _heaviest_first(batches, vocabulary, each) if k else ():
            c = _Chunk(b)
            if not searches:
                share = np.bincount(c.at, minlength=len(vocabulary)) / c.rows * asked
                many = np.argsort(-share)[:_MOST_DENSE]
                many = many[share[many] > _DENSE]
                dense = np.full(len(vocabulary), -1)
                dense[many] = np.arange(len(many))
                searches = [_Search(_Postings(own[i : i + block], term[x:y], of[x:y] - i, weight[x:y], len(vocabulary)), k, dense) for i, (x, y) in cuts]
            c.split(dense)
            for s in searches:
                s.add(c)
        for s in searches:
            yield s.batch()

    return run


def _dense(query_ids: list[int], queries: np.ndarray, k: int, each: int = 2000):
    own, left = np.array(query_ids, np.int64), np.ascontiguousarray(queries.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(own), k)
        for whole in batches:
            for start in range(0, whole.num_rows, each):
                b = whole.slice(start, each)
                vectors = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                best.add(b.column("id").to_numpy(zero_copy_only=False), vectors @ left)
        yield best.batch(own)

    return run


def _merged(parts: list[DataFrame], k: int) -> DataFrame:
    """The best k of each query, with ranks from 1."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("query_id", "passage_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _blocks(queries: DataFrame, block: int) -> Iterator[list]:
    """The queries, collected block by block; a block is bounded whatever the number of queries."""
    n = max(1, -(-queries.count() // block))
    for i in range(n):
        yield queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).orderBy("id").collect()


def retrieve(queries: DataFrame, index: DataFrame, k: int = 20, encoder: Encoder = WORDS, block: int = 1000, each: int = 8) -> DataFrame:
    """(query_id, passage_id, score, rank): the best k passages of each query (id, text) by the product of the sparse vectors
    times the prior. ``index`` as ``build_index`` made it with the same encoder; it is read once for each ``each`` blocks, and
    where these are not all, what they found is written, so that the driver holds so many queries at once and no more."""
    q = queries.select(F.col(queries.columns[0]).cast("long").alias("id"), F.col(queries.columns[1]).alias("text")).dropDuplicates(["id"])
    q = materialize(build_index(q, encoder, None).select("id", "terms", "weights"), "asked")
    index = index.coalesce(index.sparkSession.sparkContext.defaultParallelism)  # a task that sees more rows has a higher bound for most of them
    out, many = None, q.count() > block * each
    for b in _blocks(q, block * each):
        found = _merged([index.mapInArrow(_sparse(b, k, block), RANKED)], k)
        if many:
            found = materialize(found, "found")
            release(index.sparkSession)
        out = found if out is None else out.unionByName(found)
    return out


def sparse_top_k(queries: DataFrame, passages: DataFrame, k: int = 20, encoder: Encoder = WORDS, prior: Callable[[Column], Column] | None = section_weight, block: int = 1000) -> DataFrame:
    """``retrieve`` from an index that is made on the way."""
    return retrieve(queries, build_index(passages, encoder, prior), k, encoder, block)


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, block: int = 2000) -> DataFrame:
    """(query_id, passage_id, score, rank) from (id, vector) and (id, vector): dot products in double precision."""
    q = queries.select(F.col(queries.columns[0]).cast("long").alias("id"), F.col(queries.columns[1]).alias("vector")).where("vector is not null").dropDuplicates(["id"])
    c = corpus.select(F.col(corpus.columns[0]).cast("long").alias("id"), F.col(corpus.columns[1]).alias("vector")).where("vector is not null")
    c = spread(c)
    parts = []
    for b in _blocks(q, block):
        vectors = np.array([r.vector for r in b], np.float64).reshape(len(b), -1)
        parts.append(c.mapInArrow(_dense([r.id for r in b], vectors, k), RANKED) if len(b) else c.sparkSession.createDataFrame([], RANKED))
    return _merged(parts, k)


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, vector): the built-in dense encoder. Words are counted in ``dim`` buckets by the first 32 bits of their md5, and
    the vector is divided by its length + 1e-9."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: dict[str, int] = {}
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                v = np.zeros(dim)
                for w in _WORD.findall((t or "").lower()):
                    if w not in bucket:
                        if len(bucket) > 1_000_000:
                            bucket.clear()
                        bucket[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
                    v[bucket[w]] += 1
                out.append((v / (np.sqrt(v @ v) + 1e-9)).tolist())
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "vector"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, vector array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rerank(candidates: DataFrame, query_vectors: DataFrame, passage_vectors: DataFrame, k: int = 10, alpha: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """The best k of each query by alpha * dense + (1 - alpha) * sparse, where sparse is scaled to 0..1 within the query (all
    equal: 1). Candidates: (query_id, passage_id, score); vectors: (id, vector). ``keep``: columns of the passages' to go with the
    result; they are moved to their queries once."""
    q = query_vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("qv"))
    p = passage_vectors.select(F.col("id").alias("passage_id"), F.col("vector").alias("pv"), *keep)
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    c = candidates.select("query_id", "passage_id", "score").withColumn("sparse", F.when(hi - lo > 0, (F.col("score") - lo) / (hi - lo)).otherwise(1.0))
    c = c.join(p, "passage_id").join(q, "query_id").withColumn("dense", dot(F.col("qv"), F.col("pv")))
    c = c.select("query_id", "passage_id", F.round(alpha * F.col("dense") + (1 - alpha) * F.col("sparse"), 6).alias("score"), *keep)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id"))
    return c.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def mmr_select(ranked: DataFrame, budget: int = 512, lam: float = 0.7) -> DataFrame:
    """(query_id, ord, passage_id) from (query_id, passage_id, score, rank, n_tokens, vector), a bounded list a query: greedy
    choice of what is relevant and unlike what is chosen, within a budget of tokens.

    One expression folds over the list. Its state: the places that are chosen, those that are left, the tokens used, and
    whether it has ended. A step takes the best place; the first is the most relevant, whatever its size. If another goes over
    the budget, it is dropped for good, and the most relevant one that fits takes its place; without any, or with the budget
    used up, the fold has ended.
    """
    q = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage_id", F.col("score").cast("double").alias("score"), F.col("n_tokens").cast("long").alias("n_tokens"), "vector"))).alias("l"))
    lo, hi = F.array_min(F.transform("l", lambda x: x["score"])), F.array_max(F.transform("l", lambda x: x["score"]))
    norm = lambda v: F.sqrt(dot(v, v)) + F.lit(1e-9)
    q = q.select(
        "query_id", F.transform("l", lambda x: x["passage_id"]).alias("ids"), F.transform("l", lambda x: x["n_tokens"]).alias("size"),
        F.transform("l", lambda x: F.when(hi > lo, (x["score"] - lo) / (hi - lo)).otherwise(x["score"])).alias("rel"),
        F.transform("l", lambda x: let(norm(x["vector"]), lambda n: F.transform(x["vector"], lambda v: v.cast("double") / n))).alias("unit"),
    )
    q = q.withColumn("sim", F.transform("unit", lambda a: F.transform("unit", lambda b: dot(a, b))))
    at = lambda c, i: F.element_at(c, i)
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("chosen"), F.sequence(F.lit(1), F.size("ids")).alias("left"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("ended"))

    def first_of(places: Column, score: Callable[[Column], Column]) -> Column:
        """The place with the highest score, of equals the first; null without any."""
        return -F.array_max(F.transform(places, lambda i: F.struct(score(i).alias("s"), (-i).alias("i"))))["i"]

    def marginal(s: Column, i: Column) -> Column:
        like = F.array_max(F.transform(s["chosen"], lambda j: at(at(F.col("sim"), i), j)))
        return F.when(F.size(s["chosen"]) == 0, at(F.col("rel"), i)).otherwise(F.round(lam * at(F.col("rel"), i) - (1 - lam) * like, 9))

    def taken(s: Column, place: Column, left: Column) -> Column:
        used = s["used"] + at(F.col("size"), place)
        go_on = F.struct(F.concat(s["chosen"], F.array(place)).alias("chosen"), F.array_remove(left, place).alias("left"), used.alias("used"), (used >= budget).alias("ended"))
        return F.when(place.isNotNull(), go_on).otherwise(F.struct(s["chosen"].alias("chosen"), none.alias("left"), s["used"].alias("used"), F.lit(True).alias("ended")))

    def step(s: Column, _: Column) -> Column:
        fits = lambda i: s["used"] + at(F.col("size"), i) <= budget

        def with_best(best: Column) -> Column:
            instead = let(first_of(F.filter(s["left"], lambda i: (i != best) & fits(i)), lambda i: at(F.col("rel"), i)), lambda i: taken(s, i, F.array_remove(s["left"], best)))
            return F.when((F.size(s["chosen"]) == 0) | fits(best), taken(s, best, s["left"])).otherwise(instead)

        return F.when(s["ended"] | (F.size(s["left"]) == 0), s).otherwise(let(first_of(s["left"], lambda i: marginal(s, i)), with_best))

    chosen = F.aggregate("ids", start, step, lambda s: s["chosen"])
    picked = q.select("query_id", "ids", F.posexplode(chosen).alias("pos", "place"))
    return picked.select("query_id", (F.col("pos") + 1).cast("long").alias("ord"), at(F.col("ids"), F.col("place")).alias("passage_id"))
