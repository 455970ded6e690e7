"""Table declarations and value normalisation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.errors import QueryError

#: Declared type names and the Spark types that hold them.
SPARK_TYPES = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "json": T.StringType(), "null": T.StringType()}


@dataclass(frozen=True)
class TableSpec:
    """A table: name, Spark schema, primary key, further unique keys, and the columns that hold JSON text."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    unique_keys: tuple[tuple[str, ...], ...] = ()
    json_columns: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        if not self.primary_key:
            raise QueryError(f"table {self.name} needs a primary key")
        for c in self.primary_key:
            self.type_of(c)

    @staticmethod
    def declared(name: str, columns: dict, primary_key, unique_keys=()) -> "TableSpec":
        """columns: name -> {"type": ...} or a type name."""
        kinds = {c: (x["type"] if isinstance(x, dict) else x) for c, x in columns.items()}
        if bad := {k for k in kinds.values()} - set(SPARK_TYPES):
            raise QueryError(f"unknown column types {sorted(bad)}")
        schema = T.StructType([T.StructField(c, SPARK_TYPES[k]) for c, k in kinds.items()])
        return TableSpec(name, schema, tuple(primary_key), tuple(map(tuple, unique_keys)), frozenset(c for c, k in kinds.items() if k == "json"))

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def type_of(self, column: str) -> T.DataType:
        if column not in self.schema.fieldNames():
            raise QueryError(f"table {self.name} has no column {column!r}")
        return self.schema[column].dataType

    @property
    def all_unique_keys(self) -> tuple[tuple[str, ...], ...]:
        return (self.primary_key, *self.unique_keys)

    # -- values that come as Python objects ------------------------------------

    def normalize_value(self, column: str, value):
        """A Python value as its column holds it: numbers as floats, truthy texts as booleans, and so on."""
        if value is None:
            return None
        kind = self.type_of(column)
        if column in self.json_columns:
            return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), sort_keys=True)
        if isinstance(kind, T.BooleanType):
            if isinstance(value, str):
                return value in ("1", "1.0", "true") or bool(_number(value) or 0)
            return bool(value)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return _number(value)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            number = value if isinstance(value, int) else _number(value)
            return None if number is None else int(number)
        if isinstance(kind, T.StringType) and not isinstance(value, str):
            if isinstance(value, bytes):
                return value.decode("utf-8", "replace")
            if isinstance(value, bool):
                return "true" if value else "false"
            if isinstance(value, float):
                return str(int(value)) if value.is_integer() else repr(value)
            return str(value)
        return value

    def normalize_row(self, row: dict) -> dict:
        """Every column of the table; absent ones are null, unknown ones are left out."""
        return {c: self.normalize_value(c, row.get(c)) for c in self.columns}

    def rows_to_df(self, spark: SparkSession, rows: list[dict]) -> DataFrame:
        return spark.createDataFrame([tuple(self.normalize_row(r)[c] for c in self.columns) for r in rows], self.schema)

    # -- DataFrames --------------------------------------------------------------

    def normalize(self, df: DataFrame) -> DataFrame:
        """df with the declared columns and types; the same rules as normalize_value, inside the JVM."""
        have = {f.name: f.dataType for f in df.schema.fields}
        return df.select(*(_normal(F.col(f"`{c}`"), have[c], self.type_of(c)).alias(c) if c in have else F.lit(None).cast(self.type_of(c)).alias(c) for c in self.columns))


def _number(value):
    if isinstance(value, bool):
        return 1.0 if value else 0.0
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _normal(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return c
    if isinstance(want, T.BooleanType):
        if isinstance(have, T.StringType):
            return F.when(c.isNotNull(), c.isin("1", "1.0", "true") | F.coalesce(c.try_cast("double") != 0, F.lit(False)))
        return c.cast("double") != 0
    if isinstance(have, T.BooleanType) and isinstance(want, T.NumericType):
        return c.cast("int").cast(want)
    return c.try_cast(want)


def read_tables(spark: SparkSession, root: str, keys: dict[str, tuple[str, ...]]) -> dict[str, tuple[TableSpec, DataFrame]]:
    """Parquet tables root/<name>.parquet as (spec, frame), with the given primary keys."""
    out = {}
    for name, key in keys.items():
        df = spark.read.parquet(f"{root}/{name}.parquet")
        out[name] = (TableSpec(name, df.schema, tuple(key)), df)
    return out


#: Primary keys of the benchmark tables.
TEST_TABLE_KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}
