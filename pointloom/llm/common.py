"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than space and \t \n \v \f \r.
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent and the master is local (as in tests) a local folder
    takes its place; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"pointloom-{os.getpid()}")
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_path = path
    return out


def folder(spark: SparkSession, path: str):
    """(file system, path) of a folder in whatever store it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    path = getattr(df, "_materialized_path", None)
    if path:
        files, target = folder(df.sparkSession, path)
        files.delete(target, True)


def sweep(spark: SparkSession, hours: float = 24.0) -> int:
    """Delete materialized tables that were written longer than so many hours ago; how many there were.

    Results read them for as long as they live, so call it when no result of that age is in use.
    """
    files, top = folder(spark, f"{shared_dir(spark)}/tables")
    if not files.exists(top):
        return 0
    limit = spark._jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
    old = [x.getPath() for x in files.listStatus(top) if x.getModificationTime() <= limit]
    for path in old:
        files.delete(path, True)
    return len(old)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has no more than so many rows, else as it is. Counts df."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_parts(spark: SparkSession) -> int:
    """Number of groups to deal work into: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def col(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def byte_texts(arr) -> list[bytes]:
    """UTF-8 bytes of an Arrow string array, nulls as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(arr.type) else pa.binary()
    return [x or b"" for x in arr.cast(kind).to_pylist()]


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
