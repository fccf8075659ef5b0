"""Helpers shared by the operators: shared tables, word patterns, table access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of whole texts, and bytes of them, that a task takes at a time; a longer text is a batch of its own.
BATCH = 256
BATCH_BYTES = 1 << 20
#: Bytes of a row group in tables of long arrays: a reader takes a column of a whole group at once, on the heap and again in a direct buffer.
GROUP_BYTES = 4 << 20
#: Everything that is not part of a word, before A-Z is lower-cased.
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one where none is named, on a cluster a RuntimeError then."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="basewise-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_scopes: list[list[str]] = []


def stash(df: DataFrame, name: str, kept: bool = False, wide: bool = False) -> DataFrame:
    """Write df to a new table in the shared folder and read it back; this cuts its lineage.  kept: it outlives the scope of scratch(); wide: in row groups of GROUP_BYTES."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scopes and not kept:
        _scopes[-1].append(path)
    df.write.options(**{"parquet.block.size": GROUP_BYTES} if wide else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end the tables stashed in it are deleted, those of inner scopes and kept ones excepted; its result is a kept one."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if not _scopes:
            released(spark)


def freed() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(spark: SparkSession) -> None:
    """Let the session drop what nothing refers to any more: Spark removes the shuffle files and broadcasts of plans only once both garbage collectors have met them."""
    gc.collect()
    spark._jvm.System.gc()
    freed()


def _size(value: str) -> int:
    """A number, or a size as Spark writes it (64m, 67108864b)."""
    digits = value.strip().lower().removesuffix("b")
    power = "kmgtp".find(digits[-1:]) + 1
    return int(digits[:-1] if power else digits) << 10 * power


def in_batches(df: DataFrame) -> DataFrame:
    """df, once the session's Arrow batches are bounded to BATCH rows and BATCH_BYTES, since texts may be long; smaller settings stay."""
    conf = df.sparkSession.conf
    for what, most in (("Records", BATCH), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{what}PerBatch"
        if not 0 < _size(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which freed memory goes back to the system: workers outlive tasks, and an executor keeps several."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        freed()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(c: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def utf8(c: str) -> Column:
    """The bytes of a text column; null is empty."""
    return F.coalesce(F.col(c).cast("binary"), F.lit(b""))
