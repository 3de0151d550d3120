"""Helpers that every operator of this subpackage shares: the shared folder, cut lineage, words, file access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that end a word; everything else belongs to words.
SPACES = " \t\n\x0b\f\r"
#: Words as a Java / DuckDB regular expression.
WORD = r"[^\x20\x09-\x0D]+"


#: Texts go to Python workers in batches of about so many bytes, unless the session says otherwise: documents differ too much in length for a number of rows.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession, size: str = BATCH_BYTES) -> None:
    """Batches of ``size`` where the session leaves it unset, or has what operators set by themselves."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, BATCH_BYTES):
        spark.conf.set(key, size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on a single machine one of our own where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="guidewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    bounded_batches(spark)
    return f"{shared_dir(spark)}/guidewell/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote, once nothing reads it any more."""
    path = getattr(df, "cut_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Tables of one long a row are broadcast up to so many rows (about 24 MB where they are held); larger ones are joined by exchange.
BROADCAST_IDS = 500_000


def near_or_exchanged(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if it has been counted to be small; a join with it is right either way."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def opaque(column: str):
    """The same long under an expression that hides its partitioning: a join on it gets its own exchange, which AQE can split when a key is hot."""
    return F.expr(f"`{column}` ^ 0L")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` ends words at exactly the six characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def file_system(uri: str):
    """A pyarrow file system and the path in it, for file:, hdfs:, s3:, gs: and plain paths."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def release() -> None:
    """Give memory that former tasks have freed back to the system: Python workers go on from stage to stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: What a Python worker keeps from task to task, by owner.
WORKER_CACHES: dict[str, dict] = {}


def forget(owner: str) -> None:
    """Let go of what tasks of other owners have kept in this worker."""
    others = [cache for name, cache in WORKER_CACHES.items() if name != owner and cache]
    for cache in others:
        cache.clear()
    if others:
        release()


def thrifty(of, owner: str = ""):
    """A function over batches that first lets go of what other stages' tasks have kept in the worker, and in the end gives memory back."""

    def run(batches):
        forget(owner)
        try:
            yield from of(batches)
        finally:
            release()

    return run


def make_dirs(spark: SparkSession, uri: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(uri)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def crc_fold(column: str, n: int):
    """crc32 of a key's decimal text, modulo ``n``; null for a null key."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
