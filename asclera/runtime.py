"""What operators need from the session: a place to cut lineage, partition counts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; of up to 64 bytes each, that is 64 MB.
BROADCAST_ROWS = 1_000_000

#: Path -> session of the tables that exist.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="asclera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage of df: write it as a table to the shared folder and read that. The table goes when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/asclera/{name}-{uuid.uuid4().hex}"
    keep(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def keep(spark: SparkSession, path: str) -> None:
    """Count a path as a table of ``materialize``: it is deleted in the end."""
    if not _written:
        atexit.register(release_all)
    _written[path] = spark


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, and let Spark remove the shuffle files of plans that are out of use;
    it does so when the driver collects its garbage."""
    for t in tables:
        _delete(t._written_at)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(path: str) -> None:
    spark = _written.pop(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_all() -> None:
    """Delete every table that is left: at the end of Python, or of a session's last query."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session is gone, and with it the way to its files
            _written.pop(path, None)


def partitions_for(spark: SparkSession, rows: int, rows_each: int = 2_000_000) -> int:
    """Partitions so that none has more than about rows_each rows; at least spark.sql.shuffle.partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def spread(df: DataFrame) -> DataFrame:
    """df, a scan or a projection of one, in at least as many partitions as there are cores: a table of a few small files
    would keep one core busy. Scans of many splits stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than ``most`` rows, else as it is, so that the join shuffles."""
    n = df.limit(most + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


__all__ = ["BROADCAST_ROWS", "keep", "materialize", "partitions_for", "release", "release_all", "shared_dir", "small", "spread"]
