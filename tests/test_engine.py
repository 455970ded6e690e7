"""The engine's contract: golden scenarios, drift, chunks, groups, and deltas that add up."""

import random
from collections import Counter

import pytest

from viewtide import EngineRegistry, TableSpec, ViewEngine, parse_query, q
from viewtide.errors import DriftError, EngineClosedError, QueryError
from viewtide.functions.predicates import like_regex
from viewtide.plans.ast import cmp, exists, lit, or_, to_json
from viewtide.plans.rewrite import bind_static

CHANNELS = TableSpec.declared("channels", {"id": "string", "name": "string"}, ["id"])
MEMBERS = TableSpec.declared("members", {"id": "string", "channel": "string", "user": "string"}, ["id"])
TALKS = TableSpec.declared("talks", {"id": "string", "channel": "string", "at": "number"}, ["id"])


def add(table, **row):
    return {"table": table, "prevValues": [], "nextValue": row}


def edit(table, before, after):
    return {"table": table, "prevValues": [before], "nextValue": after}


def gone(table, **row):
    return {"table": table, "prevValues": [row], "nextValue": None}


def engine(spark, **rows):
    out = ViewEngine(spark)
    for spec in (CHANNELS, MEMBERS, TALKS):
        out.register_table(spec, rows=rows.get(spec.name, []))
    return out


def flat(df):
    return sorted((r["type"], r["path"], r["row_key"]) for r in df.collect())


BASE = {
    "channels": [{"id": "a", "name": "A"}, {"id": "b", "name": "B"}],
    "members": [{"id": "m1", "channel": "a", "user": "u1"}],
    "talks": [{"id": f"c{i}", "channel": "a", "at": 100 * i} for i in (1, 2, 3)],
}
WINDOW = q("talks").where(cmp("channel", "=", "a")).order("-at").limit(2).related(q("channels").related(q("members"), ("id", "channel")), ("channel", "id"))


def test_displacement_moves_whole_subtrees(spark):
    e = engine(spark, **BASE)
    assert len(flat(e.add_query("x", WINDOW))) == 6  # the shared channel and member once for each talk
    found = flat(e.advance([add("talks", id="c4", channel="a", at=400)]).changes)
    assert found == [(t, p, k) for t in (0, 1) for p, k in (("talks", '{"id":"c4"}' if t == 0 else '{"id":"c2"}'), ("talks/channels", '{"id":"a"}'), ("talks/channels/members", '{"id":"m1"}'))]
    assert flat(e.advance([add("talks", id="c0", channel="a", at=1)]).changes) == []


def test_edits_keep_or_replace(spark):
    e = engine(spark, **BASE)
    e.add_query("x", q("talks").where(cmp("at", ">", 150)).related(q("channels"), ("channel", "id")))
    row = BASE["talks"]
    assert flat(e.advance([edit("talks", row[1], {**row[1], "at": 250})]).changes) == [(2, "talks", '{"id":"c2"}')]
    assert [x[0] for x in flat(e.advance([edit("talks", row[0], {**row[0], "at": 200})]).changes)] == [0, 0]
    moved = flat(e.advance([edit("talks", {**row[1], "at": 250}, {**row[1], "at": 250, "channel": "b"})]).changes)
    assert Counter(x[0] for x in moved) == {0: 2, 1: 2}


def test_exists_flips_and_permissions(spark):
    e = engine(spark, **BASE)
    has = q("members").where(cmp("user", "=", "u1"))
    e.add_query("open", q("channels").exists(has, ("id", "channel")))
    e.add_query("hidden", q("channels").exists(has, ("id", "channel"), system="permissions"))
    e.add_query("none", q("channels").not_exists(has, ("id", "channel")))
    found = e.advance([add("members", id="m2", channel="b", user="u1")]).changes.collect()
    by = {k: sorted((r["type"], r["path"]) for r in found if r["query_id"] == k) for k in ("open", "hidden", "none")}
    assert by == {"open": [(0, "channels"), (0, "channels/members_0")], "hidden": [(0, "channels")], "none": [(1, "channels")]}


def test_scalar_value_moves(spark):
    e = engine(spark, **BASE)
    e.add_query("x", q("talks").exists(q("channels").where(cmp("id", "=", "a")), ("channel", "id"), scalar=True))
    found = flat(e.advance([edit("channels", BASE["channels"][0], {"id": "a", "name": "AA"})]).changes)
    assert found == [(2, "companion0/channels", '{"id":"a"}')]
    found = flat(e.advance([gone("channels", id="a", name="AA")]).changes)
    assert Counter(x[1] for x in found) == {"talks": 3, "companion0/channels": 1} and {x[0] for x in found} == {1}


def test_drift_changes_nothing(spark):
    e = engine(spark, **BASE)
    e.add_query("x", q("channels"))
    for change, op in ((add("channels", id="a", name="Z"), "add"), (gone("channels", id="zz", name=""), "remove"), (edit("channels", {"id": "zz", "name": ""}, {"id": "zz", "name": "y"}), "edit")):
        r = e.advance([add("channels", id="new", name="N"), change])
        assert (r.drift.table, r.drift.op) == ("channels", op) and r.changes.count() == 0 and e.snapshot.version == 0
    r = e.advance([add("channels", id="new", name="N"), edit("channels", {"id": "new", "name": "N"}, {"id": "new", "name": "M"}), gone("channels", id="new", name="M")])
    assert r.drift is None and r.changes.count() == 0
    assert e.advance([{"table": "unknown", "prevValues": [], "nextValue": {"id": 1}}]).changes.count() == 0


def test_chunks(spark):
    for n, sizes in ((0, [0]), (5, [5]), (10, [10, 0]), (11, [10, 1])):
        e = engine(spark, channels=[{"id": f"{i:03}", "name": ""} for i in range(n)])
        found = list(e.add_queries_stream({"x": q("channels")}, chunk_rows=10))
        assert [len(c.changes) for c in found] == sizes and [c.chunk_index for c in found] == list(range(len(sizes)))
        assert [c.final for c in found] == [False] * (len(sizes) - 1) + [True]
        assert [c.timing_ms is not None for c in found] == [c.final for c in found]
    last = list(e.advance_stream([gone("channels", id="nope", name="")]))
    assert len(last) == 1 and isinstance(last[0].drift, DriftError) and not last[0].changes
    e.close()
    with pytest.raises(EngineClosedError):
        list(e.advance_stream([]))


def test_registry(spark):
    r = EngineRegistry(spark)
    tables = {"channels": {"columns": {"id": {"type": "string"}, "name": {"type": "string"}}, "primaryKey": ["id"], "rows": [{"id": "a", "name": "A"}]}}
    call = lambda method, **p: r.handle({"id": 1, "method": method, "params": {"clientGroupID": "g", **p}})
    assert call("ping")["result"] == "pong" and call("init", tables=tables)["result"] == {"epoch": 1}
    assert call("loadRows", initEpoch=1, table="channels", rows=[{"id": "b", "name": "B"}])["result"] is None
    assert len(call("addQuery", initEpoch=1, queryID="q", ast={"table": "channels"})["result"]) == 2
    assert len(call("advance", initEpoch=1, changes=[gone("channels", id="a", name="A")])["result"]["changes"]) == 1
    assert call("advance", initEpoch=1, changes=[gone("channels", id="a", name="A")])["error"]["code"] == -32100
    assert call("init", tables=tables)["result"] == {"epoch": 2} and call("addQuery", initEpoch=1, queryID="q", ast={"table": "channels"})["error"]["code"] == -32101
    assert call("removeQuery", initEpoch=2, queryID="nope")["result"] is None
    assert r.reap(idle_s=-1) == ["g"] and call("addQuery", queryID="q", ast={"table": "channels"})["error"]["code"] == -32000


def test_deltas_add_up(spark):
    """Rows at first plus all changes are the rows at the end; net batches equal single steps."""
    rng = random.Random(7)
    talks = {f"c{i}": {"id": f"c{i}", "channel": rng.choice(["a", "b", None]), "at": rng.choice([1, 2, 3, None])} for i in range(12)}
    base = {**BASE, "talks": list(talks.values())}
    queries = {
        "window": WINDOW,
        "either": q("channels").where(or_(cmp("name", "=", "A"), exists(q("talks").where(cmp("at", ">=", 2)).query, ("id", "channel")))).related(q("talks").order("-at").limit(2), ("id", "channel")),
        "without": q("channels").not_exists(q("talks").where(cmp("at", "=", 3)), ("id", "channel")),
    }
    one, net = engine(spark, **base), engine(spark, **base)
    state = Counter()
    for k, v in queries.items():
        net.add_query(k, v)
        state.update((r["query_id"], r["occ"], r["row"]) for r in one.add_query(k, v).collect())
    first = {(x[0], x[1]): x[2] for x in state}
    changes = []
    for _ in range(5):
        i = rng.choice(list(talks))
        if rng.random() < 0.3:
            changes.append(gone("talks", **talks.pop(i)))
        else:
            new = {**talks[i], "channel": rng.choice(["a", "b", None]), "at": rng.choice([1, 2, 3, None])}
            changes.append(edit("talks", talks[i], new))
            talks[i] = new

    def applied(held, found):
        for r in sorted(found, key=lambda r: -r["type"] % 3):  # removals, edits, additions
            k = (r["query_id"], r["occ"])
            assert (k in held) == (r["type"] != 0)
            held.pop(k, None)
            if r["type"] != 1:
                held[k] = r["row"]
        return held

    now = dict(first)
    for c in changes:
        now = applied(now, one.advance([c]).changes.collect())
    batch = applied(dict(first), net.advance(changes, prune=False).changes.collect())
    fresh = engine(spark, **{**BASE, "talks": list(talks.values())})
    want = {(r["query_id"], r["occ"]): r["row"] for k, v in queries.items() for r in fresh.add_query(k, v).collect()}
    assert now == want and batch == want


def test_tree_round_trip_and_errors():
    doc = to_json(WINDOW.exists(q("members"), ("channel", "channel")).start({"at": 5}, True).query)
    assert to_json(parse_query(doc)) == doc
    bound = bind_static(parse_query({"table": "t", "where": {"type": "simple", "op": "=", "left": {"type": "column", "name": "a"}, "right": {"type": "static", "anchor": "authData", "field": ["x", "y"]}}}), {"authData": {"x": {"y": 3}}})
    assert bound.where.right == lit(3)
    for bad in ({"table": "t", "limit": -1}, {"table": "t", "where": {"type": "what"}}):
        with pytest.raises(QueryError):
            parse_query(bad)
    assert like_regex("a%_\\.") == r"(?s)^a.*.\\\.$"


def test_unknown_names(spark):
    e = engine(spark)
    for bad in (q("channels").where(cmp("nope", "=", 1)), q("channels").where(cmp("name", "<", 1)), q("channels").where(cmp("name", "~", "x")), q("nope")):
        with pytest.raises(QueryError):
            e.add_query("x", bad)
