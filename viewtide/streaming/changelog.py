"""Change logs as streams: a directory of JSON or Parquet change files drives an engine."""

from __future__ import annotations

import json
from dataclasses import replace
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.engine import AdvanceResult, ViewEngine
from viewtide.errors import QueryError
from viewtide.sources.snapshot import Layers


def log_schema(spec) -> T.StructType:
    return T.StructType([T.StructField("__seq", T.LongType()), T.StructField("__op", T.IntegerType()), *spec.schema.fields])


def read_log(spark: SparkSession, path: str, spec, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of one table's changes, from files of the log's schema."""
    reader = spark.readStream.format(fmt).schema(log_schema(spec))
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


class State:
    """An engine's tables in a folder, with the last batch that they hold: bases are written when they change, layers with each batch.

    The record of a batch is written after its layers, so that a crash in between leaves the state before it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.bases = spark, folder.rstrip("/"), {}

    def load(self, engine: ViewEngine) -> int:
        """Puts the tables of the last recorded batch in the place of the engine's; -1 where there is none."""
        try:
            last = self.spark.read.parquet(f"{self.folder}/record").orderBy(F.desc("batch_id")).limit(1).collect()
        except AnalysisException:
            return -1
        snapshot = engine.snapshot
        for table, (base, layer) in json.loads(last[0]["tables"]).items():
            spec = snapshot.specs[table]
            frame = self.spark.read.schema(spec.schema).parquet(base)
            staged = self.spark.read.schema(T.StructType([T.StructField("__op", T.IntegerType()), *spec.schema.fields])).parquet(layer)
            snapshot = replace(snapshot, layers={**snapshot.layers, table: Layers(frame, staged, staged.count())})
            self.bases[table] = (frame, base)
        engine.snapshot = snapshot
        for reg in engine.queries.values():
            reg.windows.clear()
        return last[0]["batch_id"]

    def save(self, engine: ViewEngine, batch_id: int) -> None:
        tables = {}
        for table, x in engine.snapshot.layers.items():
            spec = engine.snapshot.specs[table]
            held, path = self.bases.get(table, (None, ""))
            if held is not x.base:
                path = f"{self.folder}/base-{batch_id}-{table}"
                x.base.write.mode("overwrite").parquet(path)
                self.bases[table] = (x.base, path)
            layer = f"{self.folder}/layer-{batch_id}-{table}"
            x.layer(spec, self.spark).write.mode("overwrite").parquet(layer)
            tables[table] = (path, layer)
        self.spark.createDataFrame([(batch_id, json.dumps(tables))], "batch_id long, tables string").write.mode("append").parquet(f"{self.folder}/record")


def drive(engine: ViewEngine, table: str, log: DataFrame, sink: Callable[[AdvanceResult, int], None], checkpoint: str, available_now: bool = True, state: State | None = None):
    """Starts a query that advances the engine by each micro-batch and hands the changes to sink.

    The engine remembers the last batch of a checkpoint and its changes: a batch that is replayed because the sink failed goes to the sink again, and
    one that the sink took is skipped. With a state the tables outlive the driver: a new engine (with its tables registered) takes up where the record
    stands, and the batch after it is replayed. A sink has to take a batch twice without harm, as append_sink does. Without a state a checkpoint that has gone on beyond
    the engine is an error.
    """
    if checkpoint not in engine.streams:
        engine.streams[checkpoint] = {"batch": state.load(engine) if state else -1, "result": None}

    def step(batch: DataFrame, batch_id: int) -> None:
        seen = engine.streams[checkpoint]
        if batch_id < seen["batch"] or (batch_id == seen["batch"] and seen["result"] is None):
            return
        if batch_id > seen["batch"] + 1:
            raise QueryError(f"batches {seen['batch'] + 1} to {batch_id - 1} of {checkpoint} are not in this engine")
        if batch_id > seen["batch"]:
            result = engine.advance({table: batch})
            if result.drift:
                raise result.drift
            seen.update(batch=batch_id, result=result)
        sink(seen["result"], batch_id)
        if state:
            state.save(engine, batch_id)
        seen["result"] = None

    writer = log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_sink(path: str) -> Callable[[AdvanceResult, int], None]:
    """Row changes as Parquet, one folder for each batch, overwritten on replay."""
    def sink(result: AdvanceResult, batch_id: int) -> None:
        result.changes.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sink
