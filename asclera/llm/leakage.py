"""Test items that leak into training documents: n-gram seeds, then Smith-Waterman alignment of words.

Words are compared in the consistent form of ``confusables`` and in lower case, so that case, punctuation, spacing, line
layout and look-alike characters make no difference. Every n-gram of an item is a seed, however many
items have it. A document is aligned to an item near every place where at least ``seeds`` seeds of the item lie on nearly one
diagonal (fewer if ``share`` of a short item has fewer n-grams, but one at least), unless the longest common subsequence of
item and place, which no alignment can exceed, is too short; the alignment decides. Gaps have an opening and a small
extension cost, so that a sentence put between two copied ones does not end it.

Items are the stated query set: they go to every task in blocks of at most ``block`` items and ``block_chars`` characters
(about), one pass over the documents a block. Defined results: null or empty items and documents give no rows; repeated
rows give one row; several items with the same text are each reported; an item of fewer words than an n-gram is reported
where all of it occurs in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclera.llm.confusables import skeleton
from asclera.llm.words import WORD
from asclera.runtime import spread

#: Scores of the alignment in quarters: match, mismatch, opening and extending a gap.
MATCH, MISMATCH, OPEN, EXTEND = 8, -12, 12, 1
_COUNT = 1 << 20  # the number of matches rides in the low bits of the score


@dataclass(frozen=True)
class Leakage:
    """share: least part of the item's words in the alignment. n: words in a seed. band: diagonals between seeds that count
    as one. block, block_chars: items, and their characters, in a pass."""

    share: float = 0.4
    n: int = 3
    seeds: int = 3
    band: int = 6
    block: int = 20_000
    block_chars: int = 16_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(skeleton(text).lower()) if text else []


def align(items: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Matches in the best local alignment of each row of items (padded with -1) with the same row of docs (padded with -2)."""
    n, width = docs.shape
    up = np.zeros((n, width + 1), np.int64)
    gap = np.full((n, width + 1), -(1 << 50), np.int64)
    slope = EXTEND * _COUNT * np.arange(width + 1, dtype=np.int64)
    best = np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        gap = np.maximum(gap - EXTEND * _COUNT, up - OPEN * _COUNT)
        now = np.zeros_like(up)
        step = np.where(docs == items[:, i, None], MATCH * _COUNT + 1, MISMATCH * _COUNT)
        np.maximum(up[:, :-1] + step, gap[:, 1:], out=now[:, 1:])
        np.maximum(now, 0, out=now)
        across = np.maximum.accumulate(now + slope, axis=1)
        now[:, 1:] = np.maximum(now[:, 1:], across[:, :-1] - slope[:-1] - OPEN * _COUNT)
        best = np.maximum(best, now.max(1))
        up = now
    return best % _COUNT


class _Index:
    """The items' words and seeds, in a form quick to look up."""

    def __init__(self, items: list[tuple[int, list[str]]], p: Leakage):
        self.p = p
        same: dict[tuple[str, ...], list[int]] = {}
        for i, ws in items:
            same.setdefault(tuple(ws), []).append(i)
        items = [(ids, ws) for ws, ids in same.items()]
        self.ids = [ids for ids, _ in items]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64) for _, ws in items]
        self.base = len(self.vocab) + 1
        if self.base**p.n >= 1 << 63:
            raise ValueError("more words than a seed's code can hold; use smaller blocks")
        codes, item, place = [], [], []
        for k, w in enumerate(self.words):
            c = self.codes(w)
            codes.append(c)
            item.append(np.full(len(c), k))
            place.append(np.arange(len(c)))
        code, item, place = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (codes, item, place))
        self.asked = np.array([max(1, min(p.seeds, int(np.ceil(p.share * len(w) - 1e-9)) - p.n + 1)) for w in self.words], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.place = code[order], item[order], place[order]
        self.unique, self.first = np.unique(self.code, return_index=True)
        self.many = np.diff(np.append(self.first, len(self.code)))
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.short = {n: dict(zip((int(self.codes(self.words[k], n)[0]) for k in own), own, strict=True)) for n in range(1, p.n) if (own := np.flatnonzero(self.length == n).tolist())}
        self.bits: list[dict[int, int] | None] = [None] * len(self.words)

    def codes(self, w: np.ndarray, n: int | None = None) -> np.ndarray:
        """A code of each n-gram."""
        n = n or self.p.n
        if len(w) < n:
            return np.empty(0, np.int64)
        c = np.zeros(len(w) - n + 1, np.int64)
        for k in range(n):
            c = c * self.base + w[k : len(w) - n + 1 + k]
        return c

    def can_reach(self, item: int, words: list[int]) -> bool:
        """Whether the longest common subsequence with the item is long enough: bit-parallel, in one integer."""
        bits = self.bits[item]
        if bits is None:
            bits = self.bits[item] = {}
            for k, w in enumerate(self.words[item].tolist()):
                bits[w] = bits.get(w, 0) | 1 << k
        n = len(self.words[item])
        every = row = (1 << n) - 1
        for b in filter(None, map(bits.get, words)):
            hit = row & b
            row = ((row + hit) | (row - hit)) & every
        return n - row.bit_count() >= self.p.share * n - 1e-9

    def whole_short_items(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(document, item, 1.0) where all words of an item shorter than an n-gram stand in one place."""
        start = np.cumsum(counts) - counts
        for n, own in self.short.items():
            code = self.codes(ids, n)
            at = np.flatnonzero(np.isin(code, list(own)))
            doc = np.searchsorted(start, at, "right") - 1
            at, doc = (x[at + n <= start[doc] + counts[doc]] for x in (at, doc))
            yield from {(d, own[c], 1.0) for d, c in zip(doc.tolist(), code[at].tolist(), strict=True)}

    def candidates(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, from, to): windows of documents, given as the word ids of all of them one after another."""
        p = self.p
        if len(ids) < p.n or not len(self.unique):
            return
        start = np.cumsum(counts) - counts
        known = ids > 0
        ok = known[: len(ids) - p.n + 1].copy()
        for k in range(1, p.n):
            ok &= known[k : len(ids) - p.n + 1 + k]
        at = np.flatnonzero(ok)
        code = np.zeros(len(at), np.int64)
        for k in range(p.n):
            code = code * self.base + ids[at + k]
        found = np.searchsorted(self.unique, code)
        found[found == len(self.unique)] = 0
        hit = self.unique[found] == code
        at, found = at[hit], found[hit]
        doc = np.searchsorted(start, at, "right") - 1
        inside = at + p.n <= start[doc] + counts[doc]
        at, found, doc = at[inside], found[inside], doc[inside]
        many = self.many[found]
        which = np.repeat(self.first[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, doc = np.repeat(at, many), np.repeat(doc, many)
        item, place = self.item[which], self.place[which]
        diagonal = at - place
        order = np.lexsort((diagonal, item, doc))
        at, doc, item, diagonal = at[order], doc[order], item[order], diagonal[order]
        # at least as many hits of the item as asked for within `band` diagonals
        if not len(at):
            return
        to = np.arange(len(at)) + self.asked[item] - 1
        end = np.minimum(to, len(at) - 1)
        w = np.flatnonzero((to == end) & (doc[end] == doc) & (item[end] == item) & (diagonal[end] - diagonal <= p.band))
        if not len(w):
            return
        lo = diagonal[w] - p.band - self.length[item[w]]
        hi = diagonal[w] + p.band + 2 * self.length[item[w]]
        lo, hi = np.maximum(lo, start[doc[w]]), np.minimum(hi, start[doc[w]] + counts[doc[w]])
        last = None
        for d, i, a, b in zip(doc[w].tolist(), item[w].tolist(), lo.tolist(), hi.tolist(), strict=True):
            if last and last[:2] == (d, i) and a <= last[3] and max(b, last[3]) - min(a, last[2]) <= 4 * len(self.words[i]) + 4 * p.band:
                last = (d, i, min(a, last[2]), max(b, last[3]))
            else:
                if last:
                    yield last
                last = (d, i, a, b)
        yield last

    def leaks(self, ids: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float]]:
        """(document, item, share of the item's words) of those that reach the threshold."""
        out: dict[tuple[int, int], float] = {(d, i): s for d, i, s in self.whole_short_items(ids, counts)} if self.short else {}
        words = ids.tolist()
        near = [c for c in self.candidates(ids, counts) if self.can_reach(c[1], words[c[2] : c[3]])]
        todo = sorted(near, key=lambda c: (len(self.words[c[1]]), c[3] - c[2]))
        while todo:
            part, cells = [], 0
            while todo and len(part) < 512 and (not part or cells < 200_000):
                part.append(todo.pop())
                cells += part[-1][3] - part[-1][2]
            a = np.full((len(part), max(len(self.words[i]) for _, i, _, _ in part)), -1, np.int64)
            b = np.full((len(part), max(hi - lo for _, _, lo, hi in part)), -2, np.int64)
            for r, (_, i, lo, hi) in enumerate(part):
                a[r, : len(self.words[i])] = self.words[i]
                b[r, : hi - lo] = ids[lo:hi]
            for (d, i, _, _), m in zip(part, align(a, b).tolist(), strict=True):
                share = m / len(self.words[i])
                if share >= self.p.share - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), share)
        return [(d, i, s) for (d, i), s in out.items()]


def _search(index: _Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.vocab.get
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words, counts = [], []
                for t in part.column(1).to_pylist():
                    w = words_of(t)
                    words += w
                    counts.append(len(w))
                ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
                got = [(d, i, s) for d, k, s in index.leaks(ids, np.array(counts, np.int64)) for i in index.ids[k]]
                doc = part.column(0).to_pylist()
                yield pa.record_batch(
                    [pa.array([doc[d] for d, _, _ in got], pa.int64()), pa.array([i for _, i, _ in got], pa.int64()), pa.array([s for _, _, s in got], pa.float64())],
                    names=["doc_id", "item_id", "share"],
                )

    return run


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, params: Leakage | None = None) -> DataFrame:
    """(doc_id, item_id, share): the documents that carry at least ``share`` of an item's words in its order and close together."""
    p = params or Leakage()
    given = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    texts = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).cast("string").alias("text")).where("text is not null"))
    size = given.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // p.block), -(-size.chars // p.block_chars))
    out = None
    for k in range(blocks):
        block = given.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        index = _Index([(r.i, w) for r in block.collect() if (w := words_of(r.t))], p)
        found = texts.mapInArrow(_search(index), "doc_id long, item_id long, share double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
