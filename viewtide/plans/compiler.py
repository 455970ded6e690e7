"""Query tree -> one DataFrame of occurrences for each position in the tree.

An occurrence is a row reached through one chain of ancestors. Its frame holds
occ (the chain's identity), parent_occ, row_key (the primary key as JSON) and row (the
whole row as a struct). occ contains the values of the row's correlation columns, so that
editing one of them replaces the occurrence, and any other edit keeps it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewtide.errors import QueryError
from viewtide.functions import predicates as P
from viewtide.plans import rewrite as R
from viewtide.plans.ast import Bool, Edge, Exists, Query


@dataclass(frozen=True)
class PathResult:
    """Occurrences of one position: path of names, table, frame, and its edge's ordering."""

    path: tuple[str, ...]
    table: str
    df: DataFrame
    order: tuple[tuple[str, str], ...]

    @property
    def name(self) -> str:
        return "/".join(self.path)

    def rows(self, *more: str) -> DataFrame:
        """The plain rows, one per occurrence."""
        return self.df.select("row.*", *more)


class Compiler:
    """Compiles queries over one snapshot: a dict of frames and a dict of specs."""

    def __init__(self, frames: dict[str, DataFrame], specs: dict, passthrough_flip: bool = False):
        self.frames, self.specs, self.passthrough_flip = frames, specs, passthrough_flip

    def spec(self, table: str):
        if table not in self.specs:
            raise QueryError(f"unknown table {table!r}")
        return self.specs[table]

    # -- rows of one table that pass its own conditions --------------------------

    def filtered(self, query: Query, base: DataFrame | None = None) -> DataFrame:
        """Rows of the query's table that pass cursor and condition, without limit."""
        spec = self.spec(query.table)
        df = self.frames[query.table] if base is None else base
        every = R.conjuncts(query.where)
        plain = [x for x in every if not R.exists_of(x)]
        if plain:
            df = df.filter(P.condition(Bool("and", tuple(plain)), spec))
        if query.start:
            df = df.filter(P.after_cursor(query.start, R.complete_order(query, spec), spec))
        for cond in every:
            if isinstance(cond, Exists):
                df = df.join(self._keys(cond.edge), _on(df, cond.edge), "left_anti" if cond.negated else "left_semi")
        for cond in every:
            if isinstance(cond, Bool) and R.exists_of(cond):
                df = self._with_flags(df, cond, spec)
        return df

    def _keys(self, edge: Edge) -> DataFrame:
        """The child's key columns as __k0, __k1, ..., without nulls."""
        child = self.filtered(edge.query)
        for f in edge.child_fields:
            self.spec(edge.query.table).type_of(f)
        keys = child.select(*(F.col(f"`{f}`").alias(f"__k{i}") for i, f in enumerate(edge.child_fields)))
        return keys.dropna()

    def _with_flags(self, df: DataFrame, cond, spec) -> DataFrame:
        """Rows that pass a condition with EXISTS under OR: each EXISTS is a left join with the distinct keys and a mark."""
        columns, flags = df.columns, {}
        for i, x in enumerate(R.exists_of(cond)):
            keys = self._keys(x.edge).distinct().withColumn(f"__hit{i}", F.lit(True))
            df = df.join(keys, _on(df, x.edge), "left").drop(*(f"__k{j}" for j in range(len(x.edge.child_fields))))
            hit = F.coalesce(F.col(f"__hit{i}"), F.lit(False))
            flags[x.uid] = ~hit if x.negated else hit
        return df.filter(P.condition(cond, spec, flags)).select(*(f"`{c}`" for c in columns))

    # -- occurrences ---------------------------------------------------------------

    def compile(self, query: Query, roots=None, inside: bool = False) -> list[PathResult]:
        """All emitted positions of the query, parents first. roots (Keys) limits the work to root rows with those primary keys; it changes no window of the root.
        inside says that the keys are known to be in the root's result."""
        return self._compile(R.label_exists(query, self.passthrough_flip), roots, inside)

    def root_window(self, query: Query) -> DataFrame:
        spec = self.spec(query.table)
        df = self.filtered(query)
        if query.limit is not None:
            df = df.orderBy(*P.sort_columns(R.complete_order(query, spec))).limit(query.limit)
        return df

    def _compile(self, query: Query, roots, inside: bool) -> list[PathResult]:
        spec, name = self.spec(query.table), query.alias or query.table
        if roots is None:
            base = self.root_window(query)
        elif inside:
            base = roots.restrict(self.frames[query.table])
        elif query.limit is None:
            base = self.filtered(query, roots.restrict(self.frames[query.table]))
        else:
            base = roots.restrict(self.root_window(query))
        own = base.select(_occ(F.lit(name), spec, R.split_keys(query)).alias("occ"), F.lit(None).cast("string").alias("parent_occ"), _key(spec).alias("row_key"), _row(spec).alias("row"))
        narrow = roots is not None or bool(query.where or query.start) or query.limit is not None
        return [PathResult((name,), query.table, own, R.complete_order(query, spec)), *self._children(query, (name,), own, narrow)]

    def _children(self, query: Query, path, parent: DataFrame, narrow: bool) -> list[PathResult]:
        edges = [(x.uid, replace(x.edge, query=replace(x.edge.query, limit=R.EXISTS_ROWS))) for x in R.exists_of(query.where)]
        edges += [(e.query.alias or e.query.table, e) for e in query.related]
        taken: set[str] = set()
        out = []
        for name, edge in edges:
            while name in taken:
                name += "'"
            taken.add(name)
            if edge.system != "permissions":
                out += self._child(edge, (*path, name), parent, self.spec(query.table), narrow)
        return out

    def _child(self, edge: Edge, path, parent: DataFrame, parent_spec, narrow: bool) -> list[PathResult]:
        query, spec = edge.query, self.spec(edge.query.table)
        for f in edge.parent_fields:
            parent_spec.type_of(f)
        keys = parent.select(F.col("occ").alias("parent_occ"), *(F.col(f"row.`{f}`").alias(f"__k{i}") for i, f in enumerate(edge.parent_fields)))
        child = self.filtered(query).dropna(subset=list(edge.child_fields))
        if query.limit is not None:
            if narrow:  # only the windows of the parents at hand are ranked
                child = child.join(keys, _on(child, edge, swap=True), "left_semi")
            w = Window.partitionBy(*(f"`{f}`" for f in edge.child_fields)).orderBy(*P.sort_columns(R.complete_order(query, spec)))
            child = child.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= query.limit).drop("__rank")
        rows = child.select(_row(spec).alias("row"), *(F.col(f"`{f}`").alias(f"__c{i}") for i, f in enumerate(edge.child_fields)))
        on = reduce(lambda a, b: a & b, (F.col(f"__c{i}") == F.col(f"__k{i}") for i in range(len(edge.child_fields))))
        joined = rows.join(keys, on, "inner")
        split = R.split_keys(query, edge.child_fields)
        flat = joined.select("parent_occ", "row")
        own = flat.select(
            F.concat("parent_occ", F.lit("/"), _occ(F.lit(path[-1]), spec, split, "row.")).alias("occ"), "parent_occ", _key(spec, "row.").alias("row_key"), "row"
        )
        return [PathResult(path, query.table, own, R.complete_order(query, spec)), *self._children(query, path, own, narrow or bool(query.where) or query.limit is not None)]


def _on(df: DataFrame, edge: Edge, swap: bool = False) -> Column:
    fields = edge.child_fields if swap else edge.parent_fields
    return reduce(lambda a, b: a & b, (df[f"`{f}`"] == F.col(f"__k{i}") for i, f in enumerate(fields)))


def _row(spec) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in spec.columns))


def _key(spec, prefix: str = "") -> Column:
    return F.to_json(F.struct(*(F.col(f"{prefix}`{c}`").alias(c) for c in spec.primary_key)))


def _occ(name: Column, spec, split, prefix: str = "") -> Column:
    columns = dict.fromkeys((*spec.primary_key, *split))
    return F.concat(name, F.lit(":"), F.to_json(F.struct(*(F.col(f"{prefix}`{c}`").alias(c) for c in columns))))
