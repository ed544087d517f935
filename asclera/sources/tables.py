"""Text sources: pairs, corpora, triples and vectors from files; columns are found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asclera.functions.text import strip

# The names under which tables carry the same column.
SOURCE_NAMES, TARGET_NAMES = ("question", "chq", "source"), ("target", "summary", "reference")
TRIPLE_NAMES = {"head": ("head", "subject"), "relation": ("relation", "predicate"), "tail": ("tail", "object")}


def resolve(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first column that has one of the names, without regard to case and outer blanks."""
    by = {c.strip().lower(): c for c in reversed(columns)}
    return next((by[n] for n in names if n in by), None)


def pair_columns(columns: list[str]) -> tuple[str, str]:
    """The source and the target column: by name, else the first two with ``question`` or ``query`` in their names."""
    s, t = resolve(columns, SOURCE_NAMES), resolve(columns, TARGET_NAMES)
    if s and t:
        return s, t
    like = [c for c in columns if "question" in c.lower() or "query" in c.lower()]
    if len(like) < 2:
        raise ValueError(f"no pair of texts among {columns}")
    return like[0], like[1]


def text_pairs(df: DataFrame, id_col: str) -> DataFrame:
    """(id, source, target): each pair once, without those that lack either text."""
    s, t = pair_columns(df.columns)
    return df.select(F.col(id_col).alias("id"), F.col(s).alias("source"), F.col(t).alias("target")).dropna(subset=["source", "target"]).distinct()


def read_pairs(spark: SparkSession, path: str, source: str | None = None, target: str | None = None) -> DataFrame:
    """(source, target) of a CSV file with a header; quoted fields may hold line breaks. The columns are those named, or found
    by ``pair_columns``. Rows that lack either text, or don't have as many fields as the header, are left out."""
    from asclera.sources.records import read_fields

    header, rows = read_fields(spark, path)
    s, t = (header.index(c) for c in ((source, target) if source and target else pair_columns(header)))
    rows = rows.where(F.col("fields") == len(header))
    return rows.select(F.nullif(F.col("v")[s], F.lit("")).alias("source"), F.nullif(F.col("v")[t], F.lit("")).alias("target")).dropna()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(passage_id, text): a passage for each line that isn't blank, stripped. Ids follow the order of files and lines, with gaps."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("passage_id"), strip(F.col("value")).alias("text"))
    return lines.where("text != ''")


def corpus_of(spark: SparkSession, passages: list[str]) -> DataFrame:
    """(passage_id, text) of passages in memory, as they are."""
    return spark.createDataFrame(list(enumerate(passages)), "passage_id long, text string")


def read_triples(spark: SparkSession, path: str) -> DataFrame | None:
    """(triple_id, head, relation, tail) of a CSV file with a header, None if it doesn't exist. Rows with fewer than three
    fields are skipped; the tokenizer of ``records`` tells them from rows with an empty last field."""
    from asclera.sources.records import read_fields

    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    header, rows = read_fields(spark, path)
    names_of = [h.strip().lower() for h in header]
    at = {k: next((names_of.index(n) for n in names if n in names_of), None) for k, names in TRIPLE_NAMES.items()}
    if None in at.values():
        at = {"head": 0, "relation": 1, "tail": 2}
    rows = rows.where((F.col("fields") >= 3) & (F.col("fields") > max(at.values())) & F.col("v").isNotNull())
    return rows.select(F.col("record").alias("triple_id"), *[F.col("v")[i].alias(k) for k, i in at.items()])


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """A sparse index as ``sinks.write_index`` wrote it, to search in without its texts."""
    from asclera.operators.retrieval import INDEX

    return spark.read.schema(INDEX).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Written vectors (id, vector)."""
    return spark.read.parquet(path)
