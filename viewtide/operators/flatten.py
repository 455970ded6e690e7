"""Occurrences as flat row changes, as nested rows, and in chunks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewtide.functions.predicates import sort_columns
from viewtide.plans.compiler import PathResult
from viewtide.sources.staging import stage

ADD, REMOVE, EDIT = 0, 1, 2
CHANGE_SCHEMA = "type int, query_id string, table string, path string, occ string, row_key string, row string"
CHUNK_ROWS = 10_000


def union_all(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def hydrate(paths: list[PathResult], query_id: str, spark: SparkSession) -> DataFrame:
    """Every occurrence as an added row; row is the whole row as JSON, its nulls included."""
    return union_all([_changes(p, query_id, p.df.withColumn("type", F.lit(ADD))) for p in paths], spark, CHANGE_SCHEMA)


def _changes(p: PathResult, query_id: str, df: DataFrame) -> DataFrame:
    row = F.when(F.col("type") != REMOVE, F.to_json("row", {"ignoreNullFields": "false"}))
    return df.select(F.col("type").cast("int").alias("type"), F.lit(query_id).alias("query_id"), F.lit(p.table).alias("table"), F.lit(p.name).alias("path"), "occ", "row_key", row.alias("row"))


def changes_of(p: PathResult, query_id: str, delta: DataFrame) -> DataFrame:
    return _changes(p, query_id, delta)


def nested(paths: list[PathResult]) -> DataFrame:
    """Root rows with one array of child structs for each edge, ordered as the edge orders them; rows without children keep empty arrays."""
    def fold(p: PathResult) -> DataFrame:
        df = p.df
        for c in [x for x in paths if x.path[:-1] == p.path]:
            w = Window.partitionBy("parent_occ").orderBy(*sort_columns([(f"{k}", way) for k, way in c.order]))
            inner = fold(c)
            names = [x for x in inner.columns if x not in ("occ", "parent_occ", "row_key", "row")]
            ranked = inner.select("parent_occ", "row.*", F.col("row").alias("__row"), *(F.col(f"`{x}`").alias(f"__rel_{x}") for x in names))
            ranked = ranked.withColumn("__rank", F.row_number().over(w))
            item = F.struct("__rank", F.col("__row").alias("row"), *(F.col(f"`__rel_{x}`").alias(x) for x in names))
            lists = ranked.groupBy("parent_occ").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("__rank")).alias("__list"))
            kind = lists.schema["__list"].dataType.simpleString()
            lists = lists.select(F.col("parent_occ").alias("occ"), F.col("__list").alias(c.path[-1]))
            df = df.join(lists, "occ", "left").withColumn(c.path[-1], F.coalesce(F.col(f"`{c.path[-1]}`"), F.array().cast(kind)))
        return df

    out = fold(paths[0])
    return out.select("row", *(f"`{x}`" for x in out.columns if x not in ("occ", "parent_occ", "row_key", "row")))


def signature(changes: DataFrame) -> DataFrame:
    """One number for the set of rows that adds minus removals leave, whatever their order."""
    return changes.filter(F.col("type") != EDIT).agg(F.coalesce(F.bit_xor(F.xxhash64("table", "row_key")), F.lit(0)).alias("signature"))


@dataclass
class Chunk:
    """A piece of a result: exactly one chunk of each result is final, and only that has the time."""

    query_id: str
    changes: list
    chunk_index: int
    final: bool
    timing_ms: float | None = None
    drift: Exception | None = None


def chunks(df: DataFrame, query_id: str, size: int = CHUNK_ROWS) -> Iterator[Chunk]:
    """Chunks of size rows; a result that fills its last chunk ends with an empty final one. Rows are fetched partition by partition."""
    held, index = [], 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield Chunk(query_id, held, index, False)
            held, index = [], index + 1
    yield Chunk(query_id, held, index, True)


def chunk_numbers(df: DataFrame, order: list[str], size: int = CHUNK_ROWS) -> DataFrame:
    """The chunk of each row of a result in the given order, without a global window: ranks come from counts of range partitions.

    The numbered rows are staged, as both sides of the join have to see the same partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__pos", F.monotonically_increasing_id())
    ranged = stage(ranged, "chunks")
    first = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__pos").alias("__first"))
    before = first.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    out = ranged.join(F.broadcast(before), "__part")  # one row for each partition
    return out.withColumn("chunk_index", F.floor((F.col("__pos") - F.col("__first") + F.col("__before")) / size).cast("long")).drop("__part", "__pos", "__first", "__before")
