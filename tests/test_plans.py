"""What the plans look like: predicates reach the scans, child windows are ranked for the parents at hand."""

import re

import pytest

from viewtide import q
from viewtide.plans.ast import cmp
from viewtide.plans.compiler import Compiler
from viewtide.queries import QUERIES, tables
from viewtide.sources.snapshot import Snapshot


def text_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pushed(df):
    return [x for x in re.findall(r"PushedFilters: \[(.*?)(?:\](?:,|$)|\.\.\.)", text_of(df), re.M) if x]


@pytest.mark.parametrize("name, want", [
    ("filter_eq", "EqualTo(o_orderstatus,F)"), ("filter_ne", "Not(EqualTo(o_orderstatus,F))"), ("filter_le", "LessThanOrEqual(o_orderkey,100)"), ("filter_gt", "GreaterThan(o_totalprice,400000.0)"),
    ("filter_in_number", "In(o_orderkey, [1,5,9])"), ("filter_date", "GreaterThanOrEqual(o_orderdate,"), ("filter_like", "StringStartsWith(p_name,red)"), ("filter_not_like", "Not(StringEndsWith(p_name,widget))"),
    ("filter_num_eq_string", "EqualTo(o_orderkey,37)"), ("filter_literal_left", "LessThan(o_orderkey,100)"), ("filter_and_or_nested", "GreaterThan(o_totalprice,1000.0)"),
    ("limit_topn", "EqualTo(o_orderstatus,F)"), ("start_inclusive", "GreaterThanOrEqual(c_mktsegment,FURNITURE)"), ("start_limit_page2", "LessThanOrEqual(o_orderdate,"), ("exists_semi", "GreaterThan(o_totalprice,490000.0)"),
])
def test_predicates_reach_the_scan(spark, sf_dir, name, want):
    found = pushed(QUERIES[name](spark, sf_dir))
    assert any(want in x for x in found), found


def test_columns_are_pruned(spark, sf_dir):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", text_of(QUERIES["exists_semi"](spark, sf_dir)))
    assert any("o_custkey" in x and "o_orderpriority" not in x for x in schemas)


def test_child_windows_are_narrowed(spark, sf_dir):
    frames, specs = tables(spark, sf_dir, ["customer", "orders"])
    child = q("orders").order("-o_totalprice").limit(3)
    on = ("c_custkey", "o_custkey")
    limited = Compiler(frames, specs).compile(q("customer").order("-c_acctbal").limit(20).related(child, on).query)[1].df
    filtered = Compiler(frames, specs).compile(q("customer").where(cmp("c_mktsegment", "=", "BUILDING")).related(child, on).query)[1].df
    whole = Compiler(frames, specs).compile(q("customer").related(child, on).query)[1].df
    assert "LeftSemi" in text_of(limited) and "LeftSemi" in text_of(filtered) and "LeftSemi" not in text_of(whole)


def test_a_log_is_sorted_by_key_only(spark, sf_dir):
    """The tasks that scan a log, one of which may have all of it, sort nothing."""
    frames, specs = tables(spark, sf_dir, ["orders"])
    log = frames["orders"].selectExpr("o_orderkey AS __seq", "0 AS __op", "*")
    above, below = text_of(Snapshot(specs, {}).net("orders", log)).rsplit("Exchange", 1)
    assert "Sort" in above and "Sort" not in below and "WindowGroupLimit" not in below
