"""ViewEngine: registered tables, registered queries, hydration and incremental advance."""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Iterator

from pyspark.sql import DataFrame, SparkSession

from viewtide.errors import DriftError, EngineClosedError, EpochError, QueryError
from viewtide.operators import flatten
from viewtide.operators.delta import diff_paths, view_delta
from viewtide.plans import rewrite as R
from viewtide.plans.ast import Builder, Query, parse_query
from viewtide.plans.compiler import Compiler, PathResult
from viewtide.sources.catalog import TableSpec
from viewtide.sources.snapshot import OPS, Snapshot, to_source_changes
from viewtide.sources.staging import stage

VERSION = "0.1.0"


@dataclass
class AdvanceResult:
    """Row changes of all queries; for each (table, op) the number of changes and the milliseconds that classifying them (of a log: checking it) took; the drift that stopped the batch, if any."""

    changes: DataFrame
    timings: list[dict]
    drift: DriftError | None = None


@dataclass
class _Registered:
    query: Query
    resolved: Query = None
    companions: list = field(default_factory=list)
    #: The root window's keys in the current version, once they were needed.
    windows: dict = field(default_factory=dict)


@dataclass
class Metrics:
    """Durations of the last ten seconds, by operation."""

    window_s: float = 10.0
    seen: dict = field(default_factory=dict)

    def add(self, what: str, ms: float) -> None:
        held = self.seen.setdefault(what, deque())
        held.append((time.monotonic(), ms))

    def summary(self) -> dict:
        out, now = {}, time.monotonic()
        for what, held in self.seen.items():
            while held and held[0][0] < now - self.window_s:
                held.popleft()
            if ms := sorted(x for _, x in held):
                out[what] = {"count": len(ms), "p50_ms": ms[len(ms) // 2], "p95_ms": ms[min(len(ms) - 1, int(len(ms) * 0.95))], "max_ms": ms[-1]}
        return out


class ViewEngine:
    """Tables are Spark frames in immutable versions; a query's rows are compiled from a version, and its changes are the difference of two versions."""

    def __init__(self, spark: SparkSession, passthrough_flip: bool = False, check_drift: bool = True):
        self.spark, self.passthrough_flip, self.check_drift = spark, passthrough_flip, check_drift
        self.snapshot = Snapshot({}, {})
        self.queries: dict[str, _Registered] = {}
        self.unique_keys: dict[str, tuple] = {}
        self.metrics = Metrics()
        #: Last batch of each stream that drives the engine, by checkpoint.
        self.streams: dict[str, dict] = {}
        self.closed = False
        self._lock = threading.RLock()

    # -- tables ---------------------------------------------------------------------

    def register_table(self, spec: TableSpec, df: DataFrame | None = None, rows: list[dict] | None = None, check_unique: bool = False) -> None:
        """A table with its first rows, as a frame or as Python rows."""
        self._open()
        df = spec.rows_to_df(self.spark, rows or []) if df is None else spec.normalize(df)
        if check_unique and df.groupBy(*spec.primary_key).count().filter("count > 1").limit(1).count():
            raise QueryError(f"{spec.name}: the primary key is not unique")
        with self._lock:
            self.snapshot = self.snapshot.with_table(spec, df)
            self.unique_keys[spec.name] = spec.all_unique_keys

    def set_unique_keys(self, table: str, keys) -> None:
        self.unique_keys[table] = tuple(map(tuple, keys))

    def load_rows(self, table: str, rows: list[dict] | DataFrame) -> None:
        """Appends rows to a table without telling any query."""
        self._open()
        with self._lock:
            spec = self.snapshot.specs[table]
            more = spec.normalize(rows) if isinstance(rows, DataFrame) else spec.rows_to_df(self.spark, rows)
            self.snapshot = self.snapshot.with_table(spec, self.snapshot.frames[table].unionByName(more))
            for reg in self.queries.values():
                reg.windows.clear()

    # -- queries ----------------------------------------------------------------------

    def paths(self, query_id: str) -> list[PathResult]:
        """The occurrences of a registered query in the current version, companions included."""
        with self._lock:
            found = self.queries[query_id]
            return self._paths(found.resolved, found.companions, self.snapshot)

    def nested(self, query_id: str) -> DataFrame:
        return flatten.nested([p for p in self.paths(query_id) if not p.path[0].startswith("companion")])

    def add_query(self, query_id: str, query, static: dict | None = None) -> DataFrame:
        """Registers a query (replacing one with the same id) and returns its rows as added changes."""
        self._open()
        began = time.monotonic()
        with self._lock:
            self.queries[query_id] = self._resolve(self._tree(query, static), self.snapshot)
            found = flatten.hydrate(self.paths(query_id), query_id, self.spark)
        self.metrics.add("hydrate", (time.monotonic() - began) * 1000)
        return found

    def add_queries(self, queries: dict[str, Any]) -> dict[str, DataFrame]:
        """Registers queries in order, runs them at once and stages their rows: frames by id, in order. No rows come to the driver."""
        frames = {k: self.add_query(k, v) for k, v in queries.items()}
        with ThreadPoolExecutor(max(1, min(8, len(frames)))) as pool:
            return dict(zip(frames, pool.map(lambda x: stage(x[1], f"rows-{x[0]}"), enumerate(frames.values()))))

    def add_queries_stream(self, queries: dict[str, Any], chunk_rows: int = flatten.CHUNK_ROWS) -> Iterator[flatten.Chunk]:
        """Chunks of each query's rows. A closed engine raises at the first chunk asked for."""
        self._open()
        for query_id, query in queries.items():
            began = time.monotonic()
            for c in flatten.chunks(self.add_query(query_id, query), query_id, chunk_rows):
                if c.final:
                    c.timing_ms = (time.monotonic() - began) * 1000
                yield c

    def remove_query(self, query_id: str) -> None:
        self.queries.pop(query_id, None)

    # -- changes ------------------------------------------------------------------------

    def advance(self, changes, mode: str = "net", prune: bool = True) -> AdvanceResult:
        """Applies changes and returns what they change in each query.

        changes: a list of {table, prevValues, nextValue}, or a dict table -> frame with __seq, __op
        (0 add, 1 remove, 2 edit) and the table's columns. Changes of unregistered tables are skipped.
        A batch with drift changes nothing. mode "net" compares the version before with the one after;
        "sequential" goes change by change. prune=False compares whole views.
        """
        self._open()
        if mode == "sequential":
            return self._sequential(changes, prune)
        began = time.monotonic()
        with self._lock:
            timings, before = [], self.snapshot
            try:
                if isinstance(changes, dict):
                    logs = {t: stage(df.select("__seq", "__op", *before.specs[t].columns), f"log-{t}") for t, df in changes.items() if t in before.specs}
                    for table, log in logs.items():
                        step = time.monotonic()
                        if self.check_drift:
                            before.check(table, log)
                        timings.append({"table": table, "type": "batch", "changes": None, "ms": (time.monotonic() - step) * 1000})
                    after, changed = before.apply(logs)
                else:
                    after, changed = before.apply_rows(self._steps(changes, timings), self.check_drift)
            except DriftError as drift:
                return AdvanceResult(self._none(), [], drift)
            out = self._differences(before, after, changed, prune) if changed else self._none()
            self.snapshot = after
        self.metrics.add("advance", (time.monotonic() - began) * 1000)
        return AdvanceResult(out, timings)

    def advance_stream(self, changes, chunk_rows: int = flatten.CHUNK_ROWS, mode: str = "net") -> Iterator[flatten.Chunk]:
        """Chunks of advance()'s changes; always one final chunk, which carries drift, if any."""
        self._open()
        began = time.monotonic()
        result = self.advance(changes, mode)
        for c in flatten.chunks(result.changes, "", chunk_rows):
            if c.final:
                c.timing_ms, c.drift = (time.monotonic() - began) * 1000, result.drift
            yield c

    def close(self) -> None:
        self.closed = True
        self.queries.clear()

    # -- inside ---------------------------------------------------------------------------

    def _open(self) -> None:
        if self.closed:
            raise EngineClosedError("the engine is closed")

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], flatten.CHANGE_SCHEMA)

    @staticmethod
    def _tree(query, static: dict | None) -> Query:
        query = parse_query(query) if isinstance(query, dict) else query.query if isinstance(query, Builder) else query
        return R.bind_static(query, static) if static is not None else query

    def _compiler(self, snapshot: Snapshot) -> Compiler:
        return Compiler(snapshot.frames, snapshot.specs, self.passthrough_flip)

    def _resolve(self, query: Query, snapshot: Snapshot) -> _Registered:
        def fetch(sub: Query, column: str):
            spec = snapshot.specs[sub.table]
            compiler = self._compiler(snapshot)
            row = compiler.filtered(R.label_exists(sub)).orderBy(*(f"`{c}`" for c in spec.primary_key)).select(f"`{column}`").limit(1).collect()
            return (row[0][0], True) if row else (None, False)

        resolved, companions = R.resolve_scalars(query, lambda t: self.unique_keys.get(t, ()), fetch)
        return _Registered(query, resolved, companions)

    def _paths(self, resolved: Query, companions, snapshot: Snapshot, only=None) -> list[PathResult]:
        compiler = self._compiler(snapshot)
        out = compiler.compile(resolved)
        for i, c in enumerate(companions):
            out += [PathResult((f"companion{i}", *p.path), p.table, p.df, p.order) for p in compiler.compile(c.query)]
        return out

    def _steps(self, changes, timings: list) -> dict[str, list]:
        """(op, row) by table; timings gets, for each table and op, the number of changes and the time that classifying them took."""
        specs, out, spent = self.snapshot.specs, {}, {}
        for c in changes:
            if c["table"] in specs:
                began = time.monotonic()
                for op, row in to_source_changes(c, specs[c["table"]]):
                    out.setdefault(c["table"], []).append((op, row))
                    n, ms = spent.get((c["table"], OPS[op]), (0, 0.0))
                    spent[c["table"], OPS[op]] = n + 1, ms + (time.monotonic() - began) * 1000
                    began = time.monotonic()
        timings += [{"table": t, "type": op, "changes": n, "ms": ms} for (t, op), (n, ms) in spent.items()]
        return out

    def _differences(self, before: Snapshot, after: Snapshot, changed: dict, prune: bool) -> DataFrame:
        old, new = self._compiler(before), self._compiler(after)
        found = []
        for query_id, reg in self.queries.items():
            if not any(t in changed for t in R.tables_of(reg.query)):
                continue
            if reg.companions:  # the value may have changed: the views of both versions are compared whole
                again = self._resolve(reg.query, after)
                parts = diff_paths(self._paths(reg.resolved, reg.companions, before), self._paths(again.resolved, again.companions, after))
                reg.resolved, reg.companions = again.resolved, again.companions
            elif prune:
                parts = view_delta(reg.resolved, old, new, changed, reg.windows)
            else:
                reg.windows.clear()
                parts = view_delta(reg.resolved, old, new)
            found += [flatten.changes_of(p, query_id, d) for p, d in parts]
        return reduce(DataFrame.unionByName, found) if found else self._none()

    def _sequential(self, changes, prune: bool) -> AdvanceResult:
        if isinstance(changes, dict):
            raise QueryError("sequential mode takes a list of changes")
        held, queries = self.snapshot, {k: _Registered(v.query, v.resolved, v.companions, dict(v.windows)) for k, v in self.queries.items()}
        out, timings = [], []
        for c in changes:
            specs = self.snapshot.specs
            steps = to_source_changes(c, specs[c["table"]]) if c["table"] in specs else []
            for op, row in steps:
                one = {"table": c["table"], "prevValues": [] if op == 0 else [row], "nextValue": None if op == 1 else row}
                step = self.advance([one], prune=prune)
                if step.drift:
                    self.snapshot, self.queries = held, queries
                    return AdvanceResult(self._none(), [], step.drift)
                out.append(step.changes)
                timings += step.timings
        return AdvanceResult(reduce(DataFrame.unionByName, out) if out else self._none(), timings)


class EngineRegistry:
    """Engines by client group, with init epochs, and the request methods of a server: handle({"method", "params"})."""

    IDLE_S = 30 * 60

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._groups: dict[str, dict] = {}
        self._lock = threading.Lock()

    def engine(self, group: str, epoch: int | None = None) -> ViewEngine:
        with self._lock:
            if group not in self._groups:
                raise QueryError(f"group {group!r} has no engine; call init first")
            found = self._groups[group]
            if epoch is not None and epoch != found["epoch"]:
                raise EpochError(f"epoch {epoch} is not the current {found['epoch']}")
            found["used"] = time.monotonic()
            return found["engine"]

    def init(self, group: str, tables: dict) -> int:
        """A fresh engine; returns its epoch. tables: name -> {columns, primaryKey, uniqueKeys?, rows?}."""
        engine = ViewEngine(self.spark)
        for name, t in tables.items():
            engine.register_table(TableSpec.declared(name, t["columns"], t["primaryKey"], t.get("uniqueKeys") or ()), rows=t.get("rows") or [])
        with self._lock:
            before = self._groups.get(group)
            if before:
                before["engine"].close()
            epoch = before["epoch"] + 1 if before else 1
            self._groups[group] = {"engine": engine, "epoch": epoch, "used": time.monotonic()}
        return epoch

    def destroy(self, group: str) -> None:
        with self._lock:
            found = self._groups.pop(group, None)
        if found:
            found["engine"].close()

    def reap(self, idle_s: float = IDLE_S) -> list[str]:
        """Ends the engines of groups that nobody used for so long."""
        now = time.monotonic()
        idle = [g for g, x in self._groups.items() if now - x["used"] > idle_s]
        for g in idle:
            self.destroy(g)
        return idle

    def handle(self, request: dict) -> dict:
        """A JSON-RPC request -> its response."""
        try:
            return {"id": request.get("id"), "result": self._call(request["method"], request.get("params") or {})}
        except (DriftError, EpochError) as e:
            return {"id": request.get("id"), "error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # noqa: BLE001 - a server answers every request
            return {"id": request.get("id"), "error": {"code": -32000, "message": str(e)}}

    def handle_line(self, line: str) -> str:
        return json.dumps(self.handle(json.loads(line)), default=str)

    def _call(self, method: str, p: dict):
        group = p.get("clientGroupID", "")
        if method == "ping":
            return "pong"
        if method == "version":
            return VERSION
        if method == "init":
            return {"epoch": self.init(group, p["tables"])}
        if method == "destroy":
            return self.destroy(group)
        if method not in ("loadRows", "addQuery", "addQueries", "addQueriesStream", "removeQuery", "advance", "advanceStream"):
            raise QueryError(f"unknown method {method!r}")
        engine = self.engine(group, p.get("initEpoch"))
        rows = lambda found: [r.asDict() for r in found]
        if method == "loadRows":
            return engine.load_rows(p["table"], p["rows"])
        if method == "addQuery":
            return rows(engine.add_query(p["queryID"], p["ast"]).collect())
        if method == "removeQuery":
            return engine.remove_query(p["queryID"])
        if method == "addQueries":
            return {k: rows(v.toLocalIterator()) for k, v in engine.add_queries({x["queryID"]: x["ast"] for x in p["queries"]}).items()}
        if method == "addQueriesStream":
            return [{**vars(c), "changes": rows(c.changes)} for c in engine.add_queries_stream({x["queryID"]: x["ast"] for x in p["queries"]})]
        if method == "advanceStream":
            return [{**vars(c), "changes": rows(c.changes)} for c in engine.advance_stream(p["changes"])]
        result = engine.advance(p["changes"])
        if result.drift:
            raise result.drift
        return {"changes": rows(result.changes.collect()), "timings": result.timings}
