"""Streams that drive an engine: failing sinks, restarts, JSON logs; sustained edits and random trees against brute force."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_engine import BASE, CHANNELS, MEMBERS, TALKS, add, edit, engine, flat, gone

from viewtide import TableSpec, ViewEngine, q
from viewtide.plans.ast import cmp, exists, not_exists, or_
from viewtide.queries import QUERIES
from viewtide.sources.staging import recording
from viewtide.streaming.changelog import State, append_sink, drive, read_log


def write_log(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text("\n".join(json.dumps({"__seq": i, "__op": op, **row}) for i, (op, row) in enumerate(rows)))


def test_failing_sink_and_restart(spark, tmp_path):
    log, seen = tmp_path / "log", []
    write_log(log, 1, [(0, {"id": "c", "name": "C"})])
    e = engine(spark, **BASE)
    e.add_query("x", q("channels"))
    state = State(spark, str(tmp_path / "state"))
    fails = [True]

    def sink(result, batch):
        if fails.pop() if fails else False:
            raise RuntimeError("sink")
        seen.append((batch, flat(result.changes)))
        append_sink(str(tmp_path / "out"))(result, batch)

    go = lambda x, s: drive(x, "channels", read_log(spark, str(log), CHANNELS, "json", 1), sink, str(tmp_path / "cp"), state=s).awaitTermination()
    with pytest.raises(Exception, match="sink"):
        go(e, state)
    go(e, state)  # the replayed batch goes to the sink, not to the tables again
    assert seen == [(0, [(0, "channels", '{"id":"c"}')])]
    write_log(log, 2, [(1, {"id": "a", "name": "A"})])
    again = engine(spark, **BASE)  # as after a restart of the driver
    again.add_query("x", q("channels"))
    go(again, State(spark, str(tmp_path / "state")))
    assert seen[1:] == [(1, [(1, "channels", '{"id":"a"}')])]
    assert sorted(r["id"] for r in again.paths("x")[0].rows().collect()) == ["b", "c"]
    write_log(log, 3, [(1, {"id": "b", "name": "B"})])
    with pytest.raises(Exception, match="not in this engine"):
        go(engine(spark, **BASE), None)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_event_log_keeps_its_files(spark, sf_dir, tmp_path):
    """The log of events is written by as many tasks as read them, and still is two batches: all added, then a quarter removed."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(6).collect()
    for i in range(6):
        spark.createDataFrame(rows[i::6], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    with recording() as made:
        got = QUERIES["stream_foreach_batch_final_state"](spark, str(tmp_path)).collect()
    want = sorted((r["event_id"], r["event_type"]) for r in rows if r["event_id"] % 4 != 3 and r["event_type"] in ("purchase", "signup"))[:200]
    assert sorted(map(tuple, got)) == want
    log, stream = (next(p for p in made if f"/{kind}-" in p) for kind in ("log", "stream"))
    files = spark.read.parquet(log).groupBy("__op", F.input_file_name()).count().collect()
    assert Counter(r["__op"] for r in files) == {0: 6, 1: 6} and max(r["count"] for r in files) < len(rows) / 5
    assert sorted(p for p in os.listdir(f"{stream.removeprefix('file://')}/commits") if p.isdigit()) == ["0", "1"]


def test_add_queries_and_sequential(spark):
    e = engine(spark, **BASE)
    found = e.add_queries({"a": q("channels"), "b": q("talks").order("-at").limit(1)})
    assert list(found) == ["a", "b"] and [len(flat(x)) for x in found.values()] == [2, 1]
    changes = [add("talks", id="c9", channel="a", at=900), gone("talks", id="c9", channel="a", at=900)]
    assert Counter(r["type"] for r in e.advance(changes, mode="sequential").changes.collect()) == {0: 2, 1: 2}
    assert e.advance(changes).changes.count() == 0


def test_passthrough_flip(spark):
    e = ViewEngine(spark, passthrough_flip=True)
    for spec in (CHANNELS, MEMBERS):
        e.register_table(spec, rows=BASE[spec.name])
    assert len(flat(e.add_query("x", q("channels").exists(q("members").where(cmp("user", "=", "nobody")), ("id", "channel"), flip=True)))) == 2


def test_values_are_normalised(spark):
    spec = TableSpec.declared("t", {"id": "string", "n": "number", "b": "boolean", "j": "json"}, ["id"])
    cases = [("n", "1.5", 1.5), ("n", 3, 3.0), ("n", True, 1.0), ("n", None, None), ("b", "true", True), ("b", "0", False), ("b", 2, True), ("b", "no", False), ("id", 5.0, "5"), ("id", True, "true"), ("id", b"x", "x"), ("j", {"b": 1, "a": [2]}, '{"a":[2],"b":1}'), ("j", "[1]", "[1]")]
    for column, value, want in cases:
        assert spec.normalize_value(column, value) == want
    raw = spark.createDataFrame([("1", "2.5", "1", 7), ("2", "x", "no", None)], "id string, n string, b string, extra int")
    assert [tuple(r) for r in spec.normalize(raw).orderBy("id").collect()] == [("1", 2.5, True, None), ("2", None, False, None)]


def test_window_of_many_edits(spark):
    """A window under a hundred edits of the sort key, in batches of one and of many, is the sorted head after each."""
    rng = random.Random(5)
    rows = {f"c{i:02}": {"id": f"c{i:02}", "channel": "a", "at": float(i)} for i in range(20)}
    e = engine(spark, talks=list(rows.values()))
    held = {r["row_key"] for r in e.add_query("x", q("talks").order("-at").limit(15)).collect()}
    for size in (1, 1, 1, 40, 1, 56):
        changes = []
        for _ in range(size):
            k = rng.choice(sorted(rows))
            new = {**rows[k], "at": float(rng.randrange(40))}
            changes.append(edit("talks", rows[k], new))
            rows[k] = new
        for r in e.advance(changes).changes.collect():
            (held.discard if r["type"] == 1 else held.add)(r["row_key"])
        assert held == {json.dumps({"id": k}, separators=(",", ":")) for k in sorted(rows, key=lambda k: (-rows[k]["at"], k))[:15]}


WORDS = ["alpha", "beta", "gamma", "delta"]


def random_row(rng, table, i):
    row = {"id": f"{table[0]}{i}", "name": rng.choice([*WORDS, None]), "n": rng.choice([None, *range(6)]), "ref": f"{rng.choice('ui')}{rng.randrange(5)}"}
    return row


def random_query(rng, depth=0):
    table = rng.choice(["users", "items"])
    b = q(table)
    for _ in range(rng.randrange(3)):
        simple = rng.choice([cmp("n", rng.choice([">", "<", ">=", "<=", "=", "!="]), rng.randrange(6)), cmp("name", rng.choice(["=", "!=", "IS", "IS NOT"]), rng.choice(WORDS)), cmp("name", "LIKE", rng.choice(["a%", "%ta", "%e%", "_eta"])), cmp("n", "IN", [1, 2, None]), cmp("n", "NOT IN", [3]), cmp("name", "IS", None)])
        sub = rng.choice([exists, not_exists])(q(rng.choice(["users", "items"])).where(cmp("n", ">", rng.randrange(4))).query, rng.choice([("ref", "id"), ("id", "ref")]))
        b = b.where(rng.choice([simple, sub, or_(simple, sub)]))
    if rng.random() < 0.5:
        b = b.order(rng.choice(["n", "-n", "name"]))
    if rng.random() < 0.5:
        b = b.limit(rng.randrange(1, 5))
    if depth < 1 and rng.random() < 0.6:
        b = b.related(random_query(rng, depth + 1), rng.choice([("ref", "id"), ("id", "ref"), ("name", "name")]), alias="child")
    return b


@pytest.mark.parametrize("seed", range(int(os.environ.get("FUZZ_SEEDS", "2"))))
def test_random_trees(spark, seed):
    """Random queries over random tables: hydrated rows with all changes applied are the rows of a fresh engine, after batches of one and of many."""
    rng = random.Random(seed)
    specs = [TableSpec.declared(t, {"id": "string", "name": "string", "n": "number", "ref": "string"}, ["id"]) for t in ("users", "items")]
    tables = {s.name: {r["id"]: r for i in range(6) for r in [random_row(rng, s.name, i)]} for s in specs}

    def fresh():
        out = ViewEngine(spark)
        for s in specs:
            out.register_table(s, rows=list(tables[s.name].values()))
        return out

    queries = {f"q{i}": random_query(rng) for i in range(6)}

    def rows(e):
        got = e.add_queries(queries)
        return {(r["query_id"], r["occ"]): r["row"] for df in got.values() for r in df.collect()}

    e = fresh()
    held = rows(e)
    for size in (1, 6):
        changes = []
        for _ in range(size):
            t = rng.choice(list(tables))
            k = f"{t[0]}{rng.randrange(8)}"
            old = tables[t].get(k)
            if old and rng.random() < 0.3:
                changes.append(gone(t, **tables[t].pop(k)))
            else:
                new = {**random_row(rng, t, 0), "id": k}
                changes.append(edit(t, old, new) if old else add(t, **new))
                tables[t][k] = new
        result = e.advance(changes)
        assert result.drift is None
        for r in sorted(result.changes.collect(), key=lambda r: -r["type"] % 3):
            key = (r["query_id"], r["occ"])
            assert (key in held) == (r["type"] != 0)
            held.pop(key, None)
            if r["type"] != 1:
                held[key] = r["row"]
    assert held == rows(fresh())


assert TALKS.primary_key == ("id",)
