"""What the operators share: words, letter case, reading, and workers that can import this package."""

from __future__ import annotations

import ctypes
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes, with A-Z in lower case.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes of one Arrow batch to Python workers, where the session does not say: texts are long, and a batch is held by the JVM and the worker.
ARROW_BYTES = 4_000_000


#: Spark's setting by which the shuffle files of an execution go when it ends, and not when the driver's garbage collector finds them.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver was started, bounds the batches that reach them, and frees the disk of finished steps."""
    if not spark.sparkContext.getConf().contains(SHUFFLES_GO):
        spark.conf.set(SHUFFLES_GO, "true")
    if not spark.sparkContext.getConf().contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_words(text: str | None) -> list[bytes]:
    """Words as UTF-8 with A-Z in lower case; bytes.split() splits at exactly the ASCII white space that WORD excludes."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


_KEPT: dict = {}


def give_back() -> None:
    """Hands freed memory back to the system, as workers idle on beside later stages. malloc_trim is glibc's alone."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def kept(name, make):
    """What a worker keeps from task to task: one thing at a time, so that stages do not pile up in reused workers."""
    if name not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def drop() -> None:
    """Frees what earlier stages kept in this worker."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that extra ones, whatever their names, stay out of the way."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
