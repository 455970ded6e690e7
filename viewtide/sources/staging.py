"""Tables written to the shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_seen = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (one machine, as in tests) a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='viewtide-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    _made.append((spark, own))
    return own


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    if (paths := getattr(_seen, "paths", None)) is not None:
        paths.append(path)
    return path


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder, and read back."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def recording() -> Iterator[list[str]]:
    """The folders that this thread makes meanwhile."""
    before, _seen.paths = getattr(_seen, "paths", None), []
    try:
        yield _seen.paths
    finally:
        _seen.paths = before


def free(spark: SparkSession, paths: list[str], df: DataFrame) -> list[str]:
    """Removes these staged folders, but for those that df reads, which are returned."""
    read = {part for f in df.inputFiles() for part in f.split("/")} if paths else set()
    held = [p for p in paths if p.rsplit("/", 1)[-1] in read]
    for p in set(paths) - set(held):
        remove(spark, p)
        _made[:] = [x for x in _made if x[1] != p]
    return held


@atexit.register
def _remove_all() -> None:
    for spark, path in reversed(_made):
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001, S112 - the session may have ended before
            continue
