"""Packing documents into training sequences of fixed capacity by best-two-fit.

Sizes are tokens of a public tokenizer, counted over whole texts. Documents are spread over blocks of about ``block_docs``
by a hash of their id, and a block is packed in one task from the sizes alone: a sequence is filled greedily with the
largest documents that fit, then, as long as that leaves less room, its smallest document is replaced by the two unpacked
ones whose sum fits its expanded gap most tightly. Only a block's last sequences can be left poorly filled.

Defined results: a document longer than the capacity is cut into pieces of the capacity and a rest, which is packed as any
other document; no other is cut. Null and empty texts have no tokens and join a sequence of their block without taking
room. Rows that repeat an id are packed as often as they are given; rows without an id are packed as any other and given out
with a null id. No documents give no rows. The vocabulary file is read by the driver and sent to the executors.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclera.runtime import spread

#: The vocabulary that sizes are counted in; a parameter of every function that counts.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind cut a text into pieces before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OUT = "sequence long, position int, id long, piece int, token_from long, n_tokens int"


class TokenCounter:
    """Tokens of a text. Strings of special tokens are ordinary text."""

    def __init__(self, ranks: str | bytes = RANKS):
        """ranks: the path of a vocabulary file, or what it holds."""
        import tiktoken

        if isinstance(ranks, str):
            ranks = Path(ranks).read_bytes()
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0


def _counts(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(ranks)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["id", "n"])

    return run


def token_counts(df: DataFrame, id_col: str, text_col: str, ranks: str = RANKS) -> DataFrame:
    """(id, n): the tokens of each text."""
    texts = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return texts.mapInArrow(_counts(Path(ranks).read_bytes()), "id long, n long")


class _Sizes:
    """A multiset of sizes from 1 to ``capacity``, with what is largest up to a bound and which two have a sum, in bit sets."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.capacity = capacity
        self.count = np.bincount(sizes, minlength=capacity + 1).tolist()
        self.bits = sum(1 << s for s, c in enumerate(self.count) if c and s)
        self.mirror = sum(1 << (capacity - s) for s, c in enumerate(self.count) if c and s)

    def take(self, s: int) -> int:
        self.count[s] -= 1
        if not self.count[s]:
            self.bits ^= 1 << s
            self.mirror ^= 1 << (self.capacity - s)
        return s

    def put(self, s: int) -> None:
        if not self.count[s]:
            self.bits |= 1 << s
            self.mirror |= 1 << (self.capacity - s)
        self.count[s] += 1

    def largest(self, most: int) -> int:
        """The largest size up to ``most``, 0 if there is none."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if self.bits & ((2 << most) - 1) else 0

    def two(self, more_than: int, most: int) -> tuple[int, int] | None:
        """Two sizes with the largest sum above ``more_than`` and up to ``most``."""
        for t in range(most, more_than, -1):
            both = self.bits & (self.mirror >> (self.capacity - t))
            while both:
                a = both.bit_length() - 1
                if 2 * a != t or self.count[a] > 1:
                    return a, t - a
                both ^= 1 << a
        return None


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of sizes (each from 1 to capacity) whose sums are at most ``capacity``."""
    left, bins = _Sizes(sizes, capacity), []
    for _ in range(len(sizes)):
        if not left.bits:
            break
        one = [left.take(left.largest(capacity))]
        gap = capacity - one[0]
        while True:
            while gap and (s := left.largest(gap)):
                one.append(left.take(s))
                gap -= s
            if not gap or len(one) < 2:
                break
            smallest = one[-1]
            pair = left.two(smallest, smallest + gap)
            if not pair:
                break
            one.pop()
            gap += smallest
            for s in pair:
                one.append(left.take(s))
                gap -= s
            left.put(smallest)
            one.sort(reverse=True)
        bins.append(one)
    return bins


def pack_block(ids: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (bin, position, id, piece, token_from, n_tokens) of one block."""
    order = np.lexsort((ids, counts))
    rows, n_bins, waiting = [], 0, {}
    for i, n in zip(ids[order].tolist(), counts[order].tolist(), strict=True):
        piece = 0
        for piece in range((n - 1) // capacity if n > capacity else 0):
            rows.append((n_bins, 0, i, piece, piece * capacity, capacity))
            n_bins += 1
        cut = (n - 1) // capacity if n > capacity else 0
        waiting.setdefault(n - cut * capacity, []).append((i, cut, cut * capacity))
    nothing = waiting.pop(0, [])
    sizes = np.array([s for s, x in waiting.items() for _ in x], np.int64)
    first = n_bins
    for one in best_two_fit(sizes, capacity):
        for position, s in enumerate(one):
            i, piece, start = waiting[s].pop()
            rows.append((n_bins, position, i, piece, start, s))
        n_bins += 1
    at = sum(b == first for b, *_ in rows)
    rows += [(first, at + k, i, piece, start, 0) for k, (i, piece, start) in enumerate(nothing)]
    return rows


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, block_docs: int = 100_000, ranks: str = RANKS) -> DataFrame:
    """One row for each document or piece: sequence, position, id, piece, token_from, n_tokens."""
    blocks = max(1, -(-df.count() // block_docs))
    sizes = token_counts(df, id_col, text_col, ranks).withColumn("block", F.pmod(F.xxhash64(F.coalesce("id", "n")), F.lit(blocks)).cast("int"))

    def block(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        rows = pack_block(np.arange(t.num_rows), t.column("n").to_numpy(), capacity)
        own = key[0].as_py()
        c = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.table(
            {
                "sequence": pa.array([b * blocks + own for b in c[0]], pa.int64()), "position": pa.array(c[1], pa.int32()), "id": t.column("id").take(pa.array(c[2], pa.int64())),
                "piece": pa.array(c[3], pa.int32()), "token_from": pa.array(c[4], pa.int64()), "n_tokens": pa.array(c[5], pa.int32()),
            }
        )

    return sizes.groupBy("block").applyInArrow(block, OUT)


def room(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, tokens, unused tokens, and the fullest bound: sequences that any packing needs at least."""
    s = packed.groupBy("sequence").agg(F.sum("n_tokens").alias("used"))
    t = s.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"))
    return t.select("sequences", "tokens", (F.col("sequences") * capacity - F.col("tokens")).alias("unused"), F.ceil(F.col("tokens") / capacity).alias("least_sequences"))
