"""Immutable table versions, change classification, drift checks and applying changes.

A version of a table is a base, a staged layer of the last states of changed keys above it, and a small layer of Python rows above that.
A batch touches the layers alone, so that the plan of the hundredth version is that of the first; a layer that has grown is merged
into the one below it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cache, partial, reduce
from typing import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from viewtide.errors import DriftError
from viewtide.sources.catalog import TableSpec
from viewtide.sources.staging import stage

#: Rows of the Python layer; share of the base, in rows, that the staged layer may have before both are written as a new base.
SMALL_ROWS, FOLD = 5000, 1.0
#: Keys that a filter lists; more are joined.
LISTED = 500
OPS = {0: "add", 1: "remove", 2: "edit"}


def to_source_changes(change: dict, spec: TableSpec) -> list[tuple[int, dict]]:
    """One external change {table, prevValues, nextValue} -> (op, row) in order: removals first; a previous row with the next row's key makes an edit."""
    after = change.get("nextValue")
    after = spec.normalize_row(after) if after is not None else None
    key = (lambda r: tuple(r[c] for c in spec.primary_key))
    out, edit = [], False
    for row in change.get("prevValues") or ():
        row = spec.normalize_row(row)
        if after is not None and key(row) == key(after) and None not in key(row):
            edit = True
        else:
            out.append((1, row))
    if after is not None:
        out.append((2 if edit else 0, after))
    return out


@dataclass(frozen=True)
class Change:
    """The changed rows of a table, before and after, when they are asked for; how many there are, and rows of the table if known."""

    rows: Callable[[], DataFrame]
    n: int
    of: int | None


def local_frame(spark: SparkSession, schema: T.StructType, rows: list[tuple]) -> DataFrame:
    """Python rows as a frame whose size the optimizer knows."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    try:
        kinds = to_arrow_schema(schema)
        table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, kinds)], schema=kinds)
        return spark.createDataFrame(table, schema)
    except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError):  # values that only Spark's own conversion takes
        return spark.createDataFrame(rows, schema)


@dataclass(frozen=True)
class Keys:
    """Primary keys: listed as Python tuples where they are few, else a frame."""

    columns: tuple[str, ...]
    schema: T.StructType
    listed: tuple[tuple, ...] | None
    frame: DataFrame | None = None

    def df(self, spark: SparkSession) -> DataFrame:
        return self.frame if self.listed is None else local_frame(spark, self.schema, list(self.listed))

    def restrict(self, df: DataFrame) -> DataFrame:
        """The rows with these keys; few keys of one column become a filter that a scan can use."""
        if self.listed is not None and len(self.columns) == 1 and len(self.listed) <= LISTED:
            c = F.col(f"`{self.columns[0]}`")
            return df.filter(c.isin([F.lit(k).cast(self.schema[0].dataType) for (k,) in self.listed]) if self.listed else F.lit(False))
        return df.join(self.df(df.sparkSession), list(self.columns), "left_semi")


def keys_of(spec: TableSpec, df: DataFrame, most: int = SMALL_ROWS) -> Keys:
    """The distinct keys of a frame: fetched where there are few."""
    schema = T.StructType([spec.schema[c] for c in spec.primary_key])
    df = df.select(*spec.primary_key).distinct()
    found = df.limit(most + 1).collect()
    if len(found) <= most:
        return Keys(spec.primary_key, schema, tuple(map(tuple, found)))
    return Keys(spec.primary_key, schema, None, stage(df, f"keys-{spec.name}"))


@dataclass(frozen=True)
class Layers:
    """A table: base, staged layer (its rows have __op), its number of rows, the Python layer (key -> op and row), and the base's number of rows if known."""

    base: DataFrame
    staged: DataFrame | None = None
    n_staged: int = 0
    small: dict = field(default_factory=dict)
    n_base: int | None = None

    def below(self, spec: TableSpec) -> DataFrame:
        return self.base if self.staged is None else over(spec, self.base, self.staged)

    def frame(self, spec: TableSpec, spark: SparkSession) -> DataFrame:
        return over(spec, self.below(spec), self.top(spec, spark)) if self.small else self.below(spec)

    def layer(self, spec: TableSpec, spark: SparkSession) -> DataFrame:
        """Both layers as one."""
        top = self.top(spec, spark)
        return top if self.staged is None else _last(spec, self.staged, top) if self.small else self.staged

    def top(self, spec: TableSpec, spark: SparkSession) -> DataFrame:
        """The Python layer as a frame."""
        schema = T.StructType([T.StructField("__op", T.IntegerType()), *spec.schema.fields])
        return local_frame(spark, schema, [(op, *(row[c] for c in spec.columns)) for op, row in self.small.values()])


def over(spec: TableSpec, df: DataFrame, layer: DataFrame) -> DataFrame:
    """df with the rows of a layer in place of those with the same keys."""
    key = list(spec.primary_key)
    return df.join(layer.select(*key), key, "left_anti").select(*spec.columns).unionByName(layer.filter("__op <> 1").select(*spec.columns))


@dataclass(frozen=True)
class Snapshot:
    """A version of all tables."""

    specs: dict
    layers: dict
    version: int = 0

    @property
    def frames(self) -> dict[str, DataFrame]:
        return {t: x.frame(self.specs[t], x.base.sparkSession) for t, x in self.layers.items()}

    def with_table(self, spec: TableSpec, df: DataFrame) -> "Snapshot":
        return replace(self, specs={**self.specs, spec.name: spec}, layers={**self.layers, spec.name: Layers(df)})

    # -- changes as Python rows ------------------------------------------------------

    def rows_of(self, table: str, keys: list[tuple]) -> dict[tuple, dict]:
        """The rows with some keys, by key."""
        spec, x = self.specs[table], self.layers[table]
        out = {k: x.small[k][1] for k in keys if k in x.small and x.small[k][0] != 1}
        if rest := tuple(k for k in dict.fromkeys(keys) if k not in x.small and None not in k):
            schema = T.StructType([spec.schema[c] for c in spec.primary_key])
            for r in Keys(spec.primary_key, schema, rest).restrict(x.below(spec)).select(*spec.columns).collect():
                out[tuple(r[c] for c in spec.primary_key)] = {c: r[c] for c in spec.columns}
        return out

    def apply_rows(self, batch: dict[str, list[tuple[int, dict]]], check: bool) -> tuple["Snapshot", dict[str, Change]]:
        """(op, row) in order by table -> the next version, and the rows of changed keys before and after. DriftError for the first change that contradicts the state before it."""
        layers, changed = dict(self.layers), {}
        for table, steps in batch.items():
            spec, x = self.specs[table], self.layers[table]
            spark = x.base.sparkSession
            key_of = (lambda r: tuple(r[c] for c in spec.primary_key))  # noqa: B023
            before = self.rows_of(table, [key_of(r) for _, r in steps])
            now = dict(before)
            for op, row in steps:
                k = key_of(row)
                if check and (k in now) != (op != 0):
                    raise DriftError(table, OPS[op], dict(zip(spec.primary_key, k)))
                if op == 1:
                    now.pop(k, None)
                else:
                    now[k] = row
            small = {**x.small, **{k: (0, now[k]) if k in now else (1, row) for _, row in steps for k in [key_of(row)]}}
            rows = [tuple(r[c] for c in spec.columns) for r in (*before.values(), *now.values())]
            changed[table] = Change(cache(partial(local_frame, spark, spec.schema, rows)), len(rows), x.n_base)
            layers[table] = x = replace(x, small=small)
            if len(small) > SMALL_ROWS:
                layers[table] = self._merged(spec, replace(x, small={}), x.top(spec, spark))
        return replace(self, layers=layers, version=self.version + 1), changed

    # -- changes as frames -----------------------------------------------------------

    def net(self, table: str, log: DataFrame) -> DataFrame:
        """The last change of each key in a log with __seq and __op. Rows are dealt out by key before they are sorted: else each task of the scan, as large as a file's row group, is sorted too."""
        key = self.specs[table].primary_key
        w = Window.partitionBy(*key).orderBy(F.desc("__seq"))
        return log.repartition(*key).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")

    def check(self, table: str, log: DataFrame) -> None:
        """Raises DriftError for the first change that the state before it contradicts: each key is followed through the batch."""
        spec = self.specs[table]
        key = list(spec.primary_key)
        w = Window.partitionBy(*key).orderBy("__seq")
        known = self.frames[table].select(*key).join(log.select(*key).distinct(), key, "left_semi").withColumn("__base", F.lit(True))
        state = log.withColumn("__prev", F.lag("__op").over(w)).join(known, key, "left")
        there = F.when(F.col("__prev").isNotNull(), F.col("__prev") != 1).otherwise(F.coalesce("__base", F.lit(False)))
        bad = state.filter(F.when(F.col("__op") == 0, there).otherwise(~there)).orderBy("__seq").limit(1).collect()
        if bad:
            raise DriftError(table, OPS[bad[0]["__op"]], {c: bad[0][c] for c in key})

    def apply(self, logs: dict[str, DataFrame]) -> tuple["Snapshot", dict[str, Change]]:
        """The next version, and the rows of changed keys before and after. Logs are read often: they have to be staged."""
        layers, changed = dict(self.layers), {}
        for table, log in logs.items():
            spec, x = self.specs[table], self.layers[table]
            last = self.net(table, log).select("__op", *spec.columns)
            layers[table] = merged = self._merged(spec, replace(x, small={}), reduce(lambda a, b: _last(spec, a, b), [x.top(spec, log.sparkSession), last] if x.small else [last]))
            changed[table] = Change(cache(partial(self._changed, table, log, merged)), log.count(), merged.n_base)
        return replace(self, layers=layers, version=self.version + 1), changed

    def _changed(self, table: str, log: DataFrame, after: Layers) -> DataFrame:
        spec = self.specs[table]
        keys = log.select(*spec.primary_key).distinct()
        before, now = (y.join(keys, list(spec.primary_key), "left_semi").select(*spec.columns) for y in (self.frames[table], after.frame(spec, log.sparkSession)))
        return stage(before.unionByName(now), f"changed-{table}")

    def _merged(self, spec: TableSpec, x: Layers, layer: DataFrame) -> Layers:
        """x with a layer put above its staged one; both go into a new base when they have grown to a share of it."""
        n_base = x.base.count() if x.n_base is None else x.n_base
        path = f"v{self.version + 1}-{spec.name}"
        staged = stage(layer if x.staged is None else _last(spec, x.staged, layer), path)
        n = staged.count()
        if n > max(FOLD * n_base, SMALL_ROWS):
            base = stage(over(spec, x.base, staged), f"{path}-base")
            return Layers(base, n_base=base.count())
        return Layers(x.base, staged, n, {}, n_base)


def _last(spec: TableSpec, below: DataFrame, above: DataFrame) -> DataFrame:
    """One layer of two."""
    key = list(spec.primary_key)
    return below.join(above.select(*key), key, "left_anti").select("__op", *spec.columns).unionByName(above.select("__op", *spec.columns))
