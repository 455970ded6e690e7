"""Differences between a view of two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.operators.flatten import ADD, EDIT, REMOVE
from viewtide.plans import rewrite as R
from viewtide.plans.ast import Query
from viewtide.plans.compiler import Compiler, PathResult
from viewtide.sources.snapshot import Change, Keys, keys_of, local_frame


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Occurrences of two snapshots -> type, occ, row_key, row: only new ones are added, only old ones removed, others edited where the row differs."""
    a = old.select("occ", F.col("row_key").alias("__k0"), F.col("row").alias("__r0"), F.lit(True).alias("__in0"))
    b = new.select(F.col("occ"), F.col("row_key").alias("__k1"), F.col("row").alias("__r1"), F.lit(True).alias("__in1"))
    both = a.join(b, "occ", "full_outer")
    kind = F.when(F.col("__in0").isNull(), ADD).when(F.col("__in1").isNull(), REMOVE).when(~F.col("__r0").eqNullSafe(F.col("__r1")), EDIT)
    return both.select(kind.alias("type"), "occ", F.coalesce("__k1", "__k0").alias("row_key"), F.when(kind == REMOVE, F.col("__r0")).otherwise(F.col("__r1")).alias("row")).filter(F.col("type").isNotNull())


def diff_paths(old: list[PathResult], new: list[PathResult]) -> list[tuple[PathResult, DataFrame]]:
    """The difference at each position; positions that one side lacks are all removed or all added."""
    a, b = {p.path: p for p in old}, {p.path: p for p in new}
    out = []
    for path in dict.fromkeys([*b, *a]):
        p = b.get(path) or a[path]
        none = p.df.limit(0)
        out.append((p, diff(a[path].df if path in a else none, b[path].df if path in b else none)))
    return out


def affected_roots(query: Query, new: Compiler, changed: dict[str, Change]) -> DataFrame | None:
    """Primary keys of root rows whose subtree, membership or window a change can touch.

    Changed rows (before and after) are walked up the correlations by semi-joins, so that the cost follows the changes and not the tables. Changed rows
    of a table are all taken, and a row that did not change is the same in both versions, so the later one is all that is walked through.
    """
    def reach(x: Query) -> DataFrame | None:
        """Rows of x's table, of either version, that a change at or below x can touch."""
        columns = new.spec(x.table).columns
        found = [changed[x.table].rows().select(*columns)] if x.table in changed else []
        for e in [c.edge for c in R.exists_of(x.where)] + list(x.related):
            below = reach(e.query)
            if below is None:
                continue
            keys = below.select(*(F.col(f"`{f}`").alias(f"__k{i}") for i, f in enumerate(e.child_fields))).dropna().distinct()
            every = new.frames[x.table]
            on = reduce(lambda a, b: a & b, (every[f"`{f}`"] == keys[f"__k{i}"] for i, f in enumerate(e.parent_fields)))
            found.append(every.join(keys, on, "left_semi").select(*columns))
        return reduce(DataFrame.unionByName, found) if found else None

    rows = reach(query)
    return None if rows is None else rows.select(*new.spec(query.table).primary_key).distinct()


#: Root windows of so many rows at most are fetched and remembered as keys.
WINDOW_ROWS = 5000
#: A batch that changes this share of a table is large: finding its roots would cost more than comparing whole views.
WHOLE = 0.1


def window_keys(query: Query, compiler: Compiler) -> Keys:
    spec = compiler.spec(query.table)
    return keys_of(spec, compiler.root_window(R.label_exists(query, compiler.passthrough_flip)), WINDOW_ROWS)


def view_delta(query: Query, old: Compiler, new: Compiler, changed: dict[str, Change] | None = None, windows: dict | None = None) -> list[tuple[PathResult, DataFrame]]:
    """The view's difference; with changed rows at hand only affected roots are recomputed.

    windows: the query's remembered window, read and replaced. Under a root limit the later window is
    computed (a top-n), and subtrees only of roots that are affected or that enter or leave it.
    """
    limited = query.limit is not None and query.limit <= WINDOW_ROWS
    large = changed is not None and any(x.of and x.n >= WHOLE * x.of for t, x in changed.items() if t in R.tables_of(query))
    if changed is None or (query.limit is not None and not limited) or (large and not limited):
        return diff_paths(old.compile(query), new.compile(query))
    spec = new.spec(query.table)
    roots = None
    if not large:
        found = affected_roots(query, new, changed)
        if found is None:
            return []
        roots = keys_of(spec, found)
        if not limited:
            return diff_paths(old.compile(query, roots), new.compile(query, roots))
    windows = {} if windows is None else windows
    a = windows.get("keys") or window_keys(query, old)
    b = window_keys(query, new) if query.table in changed or R.exists_of(query.where) else a
    windows["keys"] = b
    either = set(a.listed) | set(b.listed)
    if roots is None:
        touched = either
    elif roots.listed is not None:
        touched = (set(a.listed) ^ set(b.listed)) | (set(roots.listed) & either)
    else:
        both = local_frame(roots.frame.sparkSession, roots.schema, list(either))
        touched = (set(a.listed) ^ set(b.listed)) | set(map(tuple, both.join(roots.frame, list(spec.primary_key), "left_semi").collect()))
    if not touched:
        return []
    part = lambda x: Keys(x.columns, x.schema, tuple(k for k in x.listed if k in touched))
    return diff_paths(old.compile(query, part(a), True), new.compile(query, part(b), True))
