"""Raw delimited records: typed rows of those that load, and a reason with its place for those that do not.

A batch of records is one byte array. It is cut into chunks of equal length whatever the records' borders; what a chunk
does to each possible state of the quote-aware automaton is worked out for all chunks at once, these transitions are
composed from chunk to chunk, and a second sweep, now from known states, gives the state at every byte.

Defined results: a null or empty record has one field; offsets count bytes of the record in UTF-8; records of any length
are read whole; no records give no rows. Other columns of the input are kept or ignored as the caller selects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asclera.operators.hierarchy import normal
from asclera.runtime import BROADCAST_ROWS, materialize, small

_OTHER, _COMMA, _QUOTE, _BLANK, _BREAK, _END = range(6)
START, PLAIN, QUOTED, QUOTE_SEEN, CLOSED, BROKEN = range(6)
#: state, class of the byte -> next state; the end of a record leads to the start of the next.
NEXT = np.array(
    [
        [PLAIN, START, QUOTED, START, PLAIN, START],
        [PLAIN, START, BROKEN, PLAIN, PLAIN, START],
        [QUOTED, QUOTED, QUOTE_SEEN, QUOTED, QUOTED, START],
        [BROKEN, START, QUOTED, CLOSED, BROKEN, START],
        [BROKEN, START, BROKEN, CLOSED, BROKEN, START],
        [BROKEN, BROKEN, BROKEN, BROKEN, BROKEN, START],
    ],
    np.uint8,
)
_CLASS = np.zeros(256, np.uint8)
for _bytes, _c in ((b",", _COMMA), (b'"', _QUOTE), (b" \t", _BLANK), (b"\r\n", _BREAK), (b"\xff", _END)):
    _CLASS[list(_bytes)] = _c


def states(classes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """The automaton's state before each byte."""
    n = -(-len(classes) // chunk)
    cells = np.full(n * chunk, _OTHER, np.uint8)
    cells[: len(classes)] = classes
    cells = np.ascontiguousarray(cells.reshape(n, chunk).T)
    effect = np.tile(np.arange(6, dtype=np.uint8), (n, 1))
    for c in cells:
        effect = NEXT[effect, c[:, None]]
    shift = 1  # compose effects over 1, 2, 4, ... chunks: effect[i] becomes that of all chunks up to i
    while shift < n:
        effect[shift:] = np.take_along_axis(effect[shift:], effect[:-shift], 1)
        shift *= 2
    now = np.full(n, START, np.uint8)
    now[1:] = effect[:-1, START]
    out = np.empty((chunk, n), np.uint8)
    for i, c in enumerate(cells):
        out[i] = now
        now = NEXT[now, c]
    return out.T.reshape(-1)[: len(classes)]


def tokenize(records: list[str | None]) -> list[tuple[list[str] | None, int, int]]:
    """Of each record: its values, or None if its quoting is broken; the number of fields; the offset of the first bad quote or -1."""
    raw = [(r or "").removesuffix("\r").encode("utf-8", "surrogatepass") for r in records]
    data = b"\xff".join(raw) + b"\xff"
    classes = _CLASS[np.frombuffer(data, np.uint8)]
    state = states(classes)
    ends = np.flatnonzero(classes == _END)
    starts = np.concatenate(([0], ends[:-1] + 1))
    after = NEXT[state, classes]
    bad = np.flatnonzero(((after == BROKEN) & (state != BROKEN)) | ((classes == _END) & (state == QUOTED)))
    commas = np.flatnonzero((classes == _COMMA) & (state != QUOTED) & (state != BROKEN))
    first_bad = np.full(len(raw), -1, np.int64)
    where, at = np.unique(np.searchsorted(ends, bad), return_index=True)
    first_bad[where] = bad[at] - starts[where]
    cut = np.searchsorted(commas, np.concatenate((starts, [len(data)])))
    out = []
    for i, r in enumerate(raw):
        own = (commas[cut[i] : cut[i + 1]] - starts[i]).tolist()
        if first_bad[i] >= 0:
            out.append((None, len(own) + 1, int(first_bad[i])))
            continue
        edges, values = [-1, *own, len(r)], []
        for a, b in zip(edges, edges[1:], strict=False):
            v = r[a + 1 : b].decode("utf-8", "surrogatepass").strip(" \t")
            values.append(v[1:-1].replace('""', '"').strip(" \t") if v[:1] == '"' else v)
        out.append((values, len(values), -1))
    return out


_PIECE = "file string, block long, line long, kind int, raw string"
#: What a piece of a block of a file is: a whole record, the end of one, a part without either end, the start of one.
_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, line, value, odd), block after block -> pieces of records. odd: whether the block begins inside
    quotes. A line ends a record if as many quotes as not have been seen."""
    at, inside, inherited, held, first = None, False, False, [], 0

    def left() -> list[tuple]:
        return [(*at, first, _MIDDLE if inherited else _TAIL, "\n".join(held))] if held else []

    for b in batches:
        files, blocks, lines, odd = (b.column(c).to_pylist() for c in ("file", "block", "line", "odd"))
        values, quotes = b.column("value"), pc.count_substring(b.column("value"), '"').to_numpy(zero_copy_only=False)
        if not (quotes & 1).any() and not held and not any(odd):  # as in nearly all batches: each line is a record
            at = (files[-1], blocks[-1])
            inside = False
            yield pa.record_batch([b.column("file"), b.column("block"), b.column("line"), pa.array(np.full(b.num_rows, _WHOLE, np.int32)), values], names=["file", "block", "line", "kind", "raw"])
            continue
        out: list[tuple] = []
        for f, k, i, o, v, q in zip(files, blocks, lines, odd, values.to_pylist(), quotes.tolist(), strict=True):
            if (f, k) != at:
                out += left()
                at, inside, inherited, held = (f, k), o, o, []
            if not held:
                first = i
            held.append(v)
            inside ^= bool(q & 1)
            if not inside:
                out.append((f, k, first, _HEAD if inherited else _WHOLE, "\n".join(held)))
                held, inherited = [], False
        yield _piece_batch(out)
    if held:
        yield _piece_batch(left())


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "block", "line", "kind", "raw"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, raw): the records of text files, where a line break inside double quotes doesn't end one. Every block of a file
    is read by itself: first the parities of its quotes are counted, and composed from block to block; then each is cut into
    records, and those that lie across blocks are put together from their pieces. ``record`` tells them apart. In a file with
    a quote too many the rest is one record."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )
    blocks = lines.groupBy("file", "block").agg(F.sum(F.regexp_count("value", F.lit('"'))).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = materialize(blocks.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd")), "blocks")
    if odd.count() > BROADCAST_ROWS:
        raise ValueError("too many blocks of files in one read")
    pieces = materialize(lines.join(F.broadcast(odd), ["file", "block"]).mapInArrow(_pieces, _PIECE), "pieces")
    whole = pieces.where(F.col("kind") == _WHOLE).select(F.col("line").alias("record"), "raw")
    order = Window.partitionBy("file").orderBy("block", "kind")
    cut = pieces.where(F.col("kind") != _WHOLE).withColumn("n", F.sum((F.col("kind") == _TAIL).cast("int")).over(order))
    parts = cut.groupBy("file", "n").agg(F.min("line").alias("record"), F.array_sort(F.collect_list(F.struct("block", "kind", "raw"))).alias("l"))
    return whole.unionByName(parts.select("record", F.array_join(F.transform("l", lambda x: x["raw"]), "\n").alias("raw")))


def read_fields(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header (of the first record), and (record, v, fields, bad) of all other records, with all their values. A record that
    is the header again, as in a second file, is left out."""
    records = materialize(read_records(spark, path), "records")
    first = records.orderBy("record").limit(1).collect()
    header = (tokenize([first[0].raw])[0][0] or []) if first else []
    rest = records.where(F.col("raw") != first[0].raw) if first else records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = tokenize(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([v for v, _, _ in got], pa.list_(pa.string())), pa.array([n for _, n, _ in got], pa.int32()), pa.array([o for _, _, o in got], pa.int64())], names=["record", "v", "fields", "bad"])

    return header, rest.mapInArrow(run, "record long, v array<string>, fields int, bad long")


def _tokenized(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = tokenize(b.column(1).to_pylist())
            values = [v if v is not None and len(v) == width else None for v, _, _ in got]
            yield pa.record_batch([b.column(0), pa.array(values, pa.list_(pa.string())), pa.array([n for _, n, _ in got], pa.int32()), pa.array([o for _, _, o in got], pa.int64())], names=["id", "v", "fields", "bad"])

    return run


def split_records(df: DataFrame, id_col: str, raw_col: str, width: int) -> DataFrame:
    """(id, v, fields, bad): the values where there are ``width`` of them, the number of fields, the offset of a bad quote or -1."""
    raw = df.select(F.col(id_col).alias("id"), F.col(raw_col).cast("string").alias("raw"))
    return raw.mapInArrow(_tokenized(width), f"id {dict(raw.dtypes)['id']}, v array<string>, fields int, bad long")


def is_date(c: Column) -> Column:
    """Whether c is a real date written YYYY-MM-DD."""
    return c.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & c.try_cast("date").isNotNull()


def is_share(c: Column) -> Column:
    """Whether c is a plain decimal number from 0 to 1."""
    return c.rlike(r"^(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\z") & c.try_cast("double").between(0, 1)


def parse_triples(df: DataFrame, relations: DataFrame, id_col: str = "line_id", raw_col: str = "raw_line") -> DataFrame:
    """Typed columns of every record (null where a value isn't valid) and, where it does not load, its reason, the offset of a bad quote (else -1) and the first
    field at fault. Records: triple_id, head, relation, tail, confidence, asserted_on. Blank relations load as nulls."""
    known = small(relations.select(normal(F.col("relation")).alias("known")).where("known != ''").distinct())
    s = split_records(df, id_col, raw_col, 6)
    v = [F.col("v")[i] for i in range(6)]
    s = s.withColumn("given", normal(v[2])).join(known, F.col("given") == F.col("known"), "left")
    is_id = v[0].rlike(r"^[0-9]+\z") & v[0].try_cast("long").isNotNull()
    bad_field = (
        F.when(~is_id, "triple_id").when(normal(v[1]) == "", "head").when((F.col("given") != "") & F.col("known").isNull(), "relation")
        .when(normal(v[3]) == "", "tail").when(~is_share(v[4]), "confidence").when(~is_date(v[5]), "asserted_on")
    )
    reason = F.when(F.col("bad") >= 0, "quoting").when(F.col("fields") != 6, "column_count").when(bad_field.isNotNull(), "invalid_value")
    return s.select(
        F.col("id").alias(id_col), v[0].try_cast("long").alias("triple_id"), v[1].alias("head"), F.nullif(v[2], F.lit("")).alias("relation"), v[3].alias("tail"),
        F.when(is_share(v[4]), v[4].try_cast("double")).alias("confidence"), F.when(is_date(v[5]), v[5].try_cast("date")).alias("asserted_on"), reason.alias("reason"), F.col("bad").alias("offset"),
        F.when(reason == "invalid_value", bad_field).alias("field"),
    )
