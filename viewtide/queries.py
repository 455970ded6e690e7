"""The query catalogue: each entry runs a feature of the view engine over the test tables, with the SQL that says the same."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.engine import ViewEngine
from viewtide.operators import flatten
from viewtide.plans.ast import Bool, Simple, and_, cmp, col, exists, lit, not_exists, or_, q
from viewtide.plans.compiler import Compiler
from viewtide.plans.rewrite import resolve_scalars
from viewtide.sources.catalog import TEST_TABLE_KEYS, TableSpec, read_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Test data without nulls: these tables are derived with some, in the same way for both engines.
NULLED = {
    "orders_n": ("orders", "o_orderkey", {"o_custkey": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END", "o_orderpriority": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END"}),
    "customer_n": ("customer", "c_custkey", {"c_acctbal": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END", "c_mktsegment": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END"}),
}
#: SQL of the changed orders: version 0, version 1.
V0 = "SELECT * FROM orders WHERE o_orderkey % 10 <> 0"
V1 = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN (o_custkey + 1) % 100 ELSE o_custkey END AS o_custkey, o_orderstatus,
 CASE WHEN o_orderkey % 10 = 2 THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 1"""


def nulled_sql(name: str) -> str:
    base, _, new = NULLED[name]
    return f"SELECT * REPLACE ({', '.join(f'{x} AS {c}' for c, x in new.items())}) FROM {base}"


def tables(spark: SparkSession, sf_dir: str, names) -> tuple[dict, dict]:
    """Frames and specs of the named tables."""
    plain = {NULLED[n][0] if n in NULLED else n for n in names}
    found = read_tables(spark, sf_dir, {n: TEST_TABLE_KEYS[n] for n in plain})
    frames, specs = {n: df for n, (_, df) in found.items()}, {n: s for n, (s, _) in found.items()}
    for n in names:
        if n in NULLED:
            base, key, new = NULLED[n]
            frames[n] = frames[base].withColumns({c: F.expr(x) for c, x in new.items()})
            specs[n] = TableSpec(n, frames[n].schema, (key,))
    return frames, specs


def entry(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


def view(name: str, builder, columns: dict[str, str] | list[str], sql: str, path: int = 0, names=None) -> None:
    """Registers the rows at one position (by number) of a query. columns: output names, or name -> expression over the row."""
    named = columns if isinstance(columns, dict) else {c: c for c in columns}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from viewtide.plans.rewrite import tables_of

        frames, specs = tables(spark, sf_dir, names or tables_of(builder.query))
        found = Compiler(frames, specs).compile(builder.query)[path]
        return found.rows().select(*(F.expr(x).alias(c) for c, x in named.items()))

    entry(name, sql)(run)


def every_path(name: str, builder, keys: dict[str, str], sql: str) -> None:
    """Registers all positions of a query: path, and key as text by the expression that keys has for the path's table."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from viewtide.plans.rewrite import tables_of

        frames, specs = tables(spark, sf_dir, tables_of(builder.query))
        found = Compiler(frames, specs).compile(builder.query)
        parts = [p.rows().select(F.lit(p.name).alias("path"), F.expr(keys[p.table]).alias("key")) for p in found]
        return flatten.union_all(parts, spark, "path string, key string")

    entry(name, sql)(run)


# --- predicates -------------------------------------------------------------------


def _filter(name: str, table: str, cond, columns: list[str], where: str) -> None:
    source = f"({nulled_sql(table)})" if table in NULLED else table
    view(name, q(table).where(cond), columns, f"SELECT {', '.join(columns)} FROM {source} t WHERE {where}")


_O, _C = ["o_orderkey", "o_totalprice"], ["c_custkey", "c_mktsegment"]
_filter("filter_eq", "orders", cmp("o_orderstatus", "=", "F"), _O, "o_orderstatus = 'F'")
_filter("filter_ne", "orders", cmp("o_orderstatus", "!=", "F"), _O, "o_orderstatus <> 'F'")
_filter("filter_ne_null", "customer_n", cmp("c_mktsegment", "!=", "BUILDING"), _C, "c_mktsegment <> 'BUILDING'")
_filter("filter_lt", "orders", cmp("o_totalprice", "<", 100000), _O, "o_totalprice < 100000")
_filter("filter_le", "orders", cmp("o_orderkey", "<=", 100), _O, "o_orderkey <= 100")
_filter("filter_gt", "orders", cmp("o_totalprice", ">", 400000.0), _O, "o_totalprice > 400000")
_filter("filter_ge", "orders", cmp("o_orderkey", ">=", 100), _O, "o_orderkey >= 100")
_filter("filter_and_or_nested", "orders", and_(cmp("o_totalprice", ">", 1000), or_(cmp("o_orderstatus", "=", "F"), and_(cmp("o_orderstatus", "=", "O"), cmp("o_orderkey", "<", 500)))), _O, "o_totalprice > 1000 AND (o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey < 500))")
_filter("filter_empty_and", "customer", Bool("and"), _C, "true")
_filter("filter_empty_or", "customer", Bool("or"), _C, "false")
_filter("filter_in", "customer_n", cmp("c_mktsegment", "IN", ["BUILDING", "MACHINERY", None, 5]), _C, "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("filter_in_number", "orders", cmp("o_orderkey", "IN", [1, 5, 9, "13"]), _O, "o_orderkey IN (1, 5, 9)")
_filter("filter_not_in_with_null", "customer_n", cmp("c_mktsegment", "NOT IN", ["BUILDING", None]), _C, "c_mktsegment IS NOT NULL AND c_mktsegment <> 'BUILDING'")
_filter("filter_not_in_empty", "customer_n", cmp("c_mktsegment", "NOT IN", []), _C, "c_mktsegment IS NOT NULL")
_filter("filter_like", "part", cmp("p_name", "LIKE", "red%"), ["p_partkey", "p_name"], "p_name LIKE 'red%'")
_filter("filter_like_underscore", "part", cmp("p_name", "LIKE", "_e_ %"), ["p_partkey", "p_name"], "p_name LIKE '_e_ %'")
_filter("filter_not_like", "part", cmp("p_name", "NOT LIKE", "%widget"), ["p_partkey", "p_name"], "p_name NOT LIKE '%widget'")
_filter("filter_ilike", "part", cmp("p_name", "ILIKE", "RED%"), ["p_partkey", "p_name"], "lower(p_name) LIKE 'red%'")
_filter("filter_not_ilike", "part", cmp("p_name", "NOT ILIKE", "%WIDGET"), ["p_partkey", "p_name"], "lower(p_name) NOT LIKE '%widget'")
_filter("filter_like_backslash", "part", cmp("p_name", "LIKE", "red\\%"), ["p_partkey", "p_name"], "starts_with(p_name, 'red' || chr(92))")
_filter("filter_like_column", "customer", Simple("LIKE", col("c_name"), col("c_name")), _C, "true")
_filter("filter_is_null", "customer_n", cmp("c_acctbal", "IS", None), _C, "c_acctbal IS NULL")
_filter("filter_is_value", "customer_n", cmp("c_mktsegment", "IS", "BUILDING"), _C, "c_mktsegment IS NOT DISTINCT FROM 'BUILDING'")
_filter("filter_is_not", "customer_n", cmp("c_mktsegment", "IS NOT", "BUILDING"), _C, "c_mktsegment IS DISTINCT FROM 'BUILDING'")
_filter("filter_is_not_null", "customer_n", cmp("c_acctbal", "IS NOT", None), _C, "c_acctbal IS NOT NULL")
_filter("filter_num_eq_string", "orders", cmp("o_orderkey", "=", "37"), _O, "o_orderkey = 37")
_filter("filter_string_ne_num", "orders", cmp("o_orderstatus", "!=", 5), _O, "true")
_filter("filter_eq_null", "customer_n", cmp("c_acctbal", "=", None), _C, "false")
_filter("filter_type_mismatch", "orders", cmp("o_orderkey", "=", True), _O, "false")
_filter("filter_col_col", "lineitem", Simple("<", col("l_tax"), col("l_discount")), ["l_orderkey", "l_linenumber", "l_tax"], "l_tax < l_discount")
_filter("filter_literal_left", "orders", Simple(">", lit(100), col("o_orderkey")), _O, "100 > o_orderkey")
_filter("filter_always_false", "orders", Simple("=", lit(1), lit(0)), _O, "false")
_filter("filter_date", "orders", cmp("o_orderdate", ">=", "1997-01-01 00:00:00"), ["o_orderkey"], "o_orderdate >= TIMESTAMP '1997-01-01'")

# --- order, limit, cursor -----------------------------------------------------------

view("limit_topn", q("orders").where(cmp("o_orderstatus", "=", "F")).order("-o_totalprice").limit(50), _O, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
view("limit_zero", q("orders").limit(0), _O, "SELECT o_orderkey, o_totalprice FROM orders LIMIT 0")
view("order_multi_desc", q("orders").order("-o_orderpriority", "o_orderstatus", "-o_orderdate").limit(100), ["o_orderkey", "o_orderpriority"], "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderstatus, o_orderdate DESC, o_orderkey LIMIT 100")
view("order_nulls_asc", q("customer_n").order("c_acctbal").limit(400), ["c_custkey", "c_acctbal"], f"SELECT c_custkey, c_acctbal FROM ({nulled_sql('customer_n')}) ORDER BY c_acctbal ASC NULLS FIRST, c_custkey LIMIT 400")
view("order_nulls_desc", q("customer_n").order("-c_acctbal").limit(1200), ["c_custkey", "c_acctbal"], f"SELECT c_custkey, c_acctbal FROM ({nulled_sql('customer_n')}) ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 1200")
view("start_inclusive", q("customer").order("c_mktsegment").start({"c_mktsegment": "FURNITURE", "c_custkey": 50}), _C, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'FURNITURE' OR (c_mktsegment = 'FURNITURE' AND c_custkey >= 50)")
view("start_exclusive", q("customer").order("c_mktsegment").start({"c_mktsegment": "FURNITURE", "c_custkey": 50}, True), _C, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'FURNITURE' OR (c_mktsegment = 'FURNITURE' AND c_custkey > 50)")
view("start_partial_exclusive", q("customer").order("c_mktsegment").start({"c_mktsegment": "FURNITURE"}, True), _C, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'FURNITURE'")
view("start_partial_inclusive", q("customer").order("c_mktsegment", "c_name").start({"c_mktsegment": "FURNITURE", "c_custkey": 3}), _C, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'FURNITURE'")
view("start_desc_null", q("customer_n").order("-c_acctbal").start({"c_acctbal": 1000.0, "c_custkey": 1}, True), ["c_custkey"], f"SELECT c_custkey FROM ({nulled_sql('customer_n')}) WHERE c_acctbal < 1000 OR c_acctbal IS NULL OR (c_acctbal = 1000 AND c_custkey > 1)")
view("start_null_asc", q("customer_n").order("c_acctbal").start({"c_acctbal": None, "c_custkey": 100}, True), ["c_custkey"], f"SELECT c_custkey FROM ({nulled_sql('customer_n')}) WHERE c_acctbal IS NOT NULL OR c_custkey > 100")
view("start_limit_page2", q("orders").order("-o_orderdate").start({"o_orderdate": "1997-06-01 00:00:00", "o_orderkey": 0}, True).limit(25), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' OR (o_orderdate = TIMESTAMP '1997-06-01' AND o_orderkey > 0) ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
view("start_empty_exclusive", q("customer").start({}, True), _C, "SELECT c_custkey, c_mktsegment FROM customer WHERE false")

# --- related -------------------------------------------------------------------------

_CO = ("c_custkey", "o_custkey")
_TOP3 = q("orders").order("-o_totalprice").limit(3)
view("related_one_level", q("customer").where(cmp("c_mktsegment", "=", "BUILDING")).related(q("orders").where(cmp("o_orderstatus", "=", "O")), _CO), ["o_custkey", "o_orderkey"], "SELECT o_custkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'", 1)
view("related_child_limit", q("customer").where(cmp("c_mktsegment", "=", "BUILDING")).related(_TOP3, _CO), ["o_custkey", "o_orderkey"], "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) rn FROM orders) JOIN customer ON c_custkey = o_custkey WHERE rn <= 3 AND c_mktsegment = 'BUILDING'", 1)
_TWO = q("region").related(q("nation").related(q("customer").where(cmp("c_acctbal", ">", 5000)), ("n_nationkey", "c_nationkey")), ("r_regionkey", "n_regionkey"))
every_path("related_two_level", _TWO, {"region": "cast(r_regionkey as string)", "nation": "cast(n_nationkey as string)", "customer": "cast(c_custkey as string)"}, """
SELECT 'region' AS path, r_regionkey::VARCHAR AS key FROM region UNION ALL
SELECT 'region/nation', n_nationkey::VARCHAR FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
SELECT 'region/nation/customer', c_custkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000""")
view("related_shared_child", q("orders").where(cmp("o_totalprice", ">", 480000)).related(q("customer").related(q("nation"), ("c_nationkey", "n_nationkey")), ("o_custkey", "c_custkey")), ["n_nationkey", "n_name"], "SELECT n_nationkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 480000", 2)
view("related_compound_key", q("lineitem").where(cmp("l_quantity", ">", 48)).related(q("lineitem").where(cmp("l_quantity", "<", 25)), [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")], alias="other"), ["l_orderkey", "l_partkey", "l_linenumber"], "SELECT b.l_orderkey, b.l_partkey, b.l_linenumber FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 48 AND b.l_quantity < 25", 1)
view("related_self_join", q("orders").where(cmp("o_totalprice", ">", 490000)).related(q("orders"), ("o_custkey", "o_custkey"), alias="same_customer"), ["o_custkey", "o_orderkey"], "SELECT b.o_custkey, b.o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_totalprice > 490000", 1)
view("related_null_key", q("orders_n").where(cmp("o_totalprice", ">", 450000)).related(q("customer"), ("o_custkey", "c_custkey")), ["c_custkey"], f"SELECT c_custkey FROM ({nulled_sql('orders_n')}) JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000", 1)
view("related_limit_parent", q("customer").order("-c_acctbal").limit(20).related(_TOP3, _CO), ["o_custkey", "o_orderkey"], "WITH p AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20) SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) rn FROM orders) JOIN p ON c_custkey = o_custkey WHERE rn <= 3", 1)
view("related_dup_alias", q("customer").limit(30).related(q("orders"), _CO).related(q("orders").where(cmp("o_orderstatus", "=", "P")), _CO), ["o_custkey", "o_orderkey"], "WITH p AS (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 30) SELECT o_custkey, o_orderkey FROM orders JOIN p ON c_custkey = o_custkey WHERE o_orderstatus = 'P'", 1)


@entry("related_nested_rows", "SELECT c_custkey, list_transform(list(o_orderkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) FILTER (o_orderkey IS NOT NULL), lambda x: x)[1:3]::VARCHAR AS top FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey WHERE c_nationkey < 5 GROUP BY c_custkey HAVING count(o_orderkey) > 0 UNION ALL SELECT c_custkey, '[]' FROM customer WHERE c_nationkey < 5 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def related_nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parent keeps its row and a list of children, empty where it has none."""
    frames, specs = tables(spark, sf_dir, ["customer", "orders"])
    query = q("customer").where(cmp("c_nationkey", "<", 5)).related(_TOP3.where(cmp("o_orderstatus", "=", "P")), _CO).query
    found = flatten.nested(Compiler(frames, specs).compile(query))
    keys = F.transform("orders", lambda x: x["row"]["o_orderkey"].cast("string"))
    return found.select("row.c_custkey", F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]")).alias("top"))


# --- exists ----------------------------------------------------------------------------

_BIG = q("orders").where(cmp("o_totalprice", ">", 490000)).query
_BIGSQL = "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 490000)"
view("exists_semi", q("customer").exists(_BIG, _CO), _C, f"SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS {_BIGSQL}")
view("not_exists_anti", q("customer").not_exists(_BIG, _CO), _C, f"SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS {_BIGSQL}")
view("not_exists_no_lines", q("orders").not_exists(q("lineitem"), ("o_orderkey", "l_orderkey")), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
view("exists_null_key", q("orders_n").not_exists(q("customer"), ("o_custkey", "c_custkey")), ["o_orderkey"], f"SELECT o_orderkey FROM ({nulled_sql('orders_n')}) WHERE o_custkey IS NULL")
view("exists_or_simple", q("customer").where(cmp("c_acctbal", ">", 0), or_(cmp("c_mktsegment", "=", "BUILDING"), exists(_BIG, _CO))), _C, f"SELECT c_custkey, c_mktsegment FROM customer c WHERE c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR EXISTS {_BIGSQL})")
view("exists_or_not_exists", q("customer").where(or_(and_(cmp("c_mktsegment", "=", "BUILDING"), not_exists(_BIG, _CO)), exists(q("orders").where(cmp("o_totalprice", "<", 2000)).query, _CO))), _C, f"SELECT c_custkey, c_mktsegment FROM customer c WHERE (c_mktsegment = 'BUILDING' AND NOT EXISTS {_BIGSQL}) OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice < 2000)")
view("exists_and_not_exists", q("customer").exists(q("orders").where(cmp("o_orderstatus", "=", "P")), _CO).not_exists(_BIG, _CO), _C, f"SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') AND NOT EXISTS {_BIGSQL}")
view("exists_nested", q("nation").exists(q("customer").exists(_BIG, _CO), ("n_nationkey", "c_nationkey")), ["n_nationkey", "n_name"], f"SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer c WHERE c_nationkey = n_nationkey AND EXISTS {_BIGSQL})")
view("exists_emits_three_children", q("customer").exists(q("orders").where(cmp("o_totalprice", ">", 100000)).limit(50), _CO), ["o_custkey", "o_orderkey"], "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders WHERE o_totalprice > 100000) JOIN customer ON c_custkey = o_custkey WHERE rn <= 3", 1)
view("exists_or_emits_children", q("customer").where(or_(cmp("c_mktsegment", "=", "BUILDING"), exists(_BIG, _CO))), ["o_custkey", "o_orderkey"], f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders WHERE o_totalprice > 490000) JOIN customer c ON c_custkey = o_custkey WHERE rn <= 3 AND (c_mktsegment = 'BUILDING' OR EXISTS {_BIGSQL})", 1)
every_path("exists_permissions_suppressed", q("customer").exists(q("orders").where(cmp("o_totalprice", ">", 490000)).related(q("lineitem"), ("o_orderkey", "l_orderkey")), _CO, system="permissions"), {"customer": "cast(c_custkey as string)", "orders": "''", "lineitem": "''"}, f"SELECT 'customer' AS path, c_custkey::VARCHAR AS key FROM customer c WHERE EXISTS {_BIGSQL}")
view("exists_in_related_child", q("nation").related(q("customer").exists(_BIG, _CO), ("n_nationkey", "c_nationkey")), ["c_custkey", "c_nationkey"], f"SELECT c_custkey, c_nationkey FROM customer c JOIN nation ON c_nationkey = n_nationkey WHERE EXISTS {_BIGSQL}", 1)
view("exists_flip", q("customer").exists(_BIG, _CO, flip=True), _C, f"SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS {_BIGSQL}")

# --- scalar subqueries --------------------------------------------------------------------


def _scalar(name: str, builder, columns: list[str], sql: str, companion: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = read_tables(spark, sf_dir, {t: TEST_TABLE_KEYS[t] for t in ("nation", "region", "customer")})
        engine = ViewEngine(spark)
        for spec, df in found.values():
            engine.register_table(spec, df)
        engine.add_query("x", builder)
        paths = [p for p in engine.paths("x") if p.path[0].startswith("companion") == companion]
        return paths[0].rows().select(*columns)

    entry(name, sql)(run)


def _region(key: int):
    return q("region").where(cmp("r_regionkey", "=", key)).query


_NR = ("n_regionkey", "r_regionkey")
_scalar("scalar_exists_resolved", q("nation").exists(_region(2), _NR, scalar=True), ["n_nationkey", "n_name"], "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
_scalar("scalar_not_exists_is_not", q("nation").not_exists(_region(2), _NR, scalar=True), ["n_nationkey", "n_name"], "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IS DISTINCT FROM 2")
_scalar("scalar_no_match_false", q("nation").not_exists(_region(99), _NR, scalar=True), ["n_nationkey", "n_name"], "SELECT n_nationkey, n_name FROM nation WHERE false")
_scalar("scalar_non_simple", q("nation").exists(q("region").where(cmp("r_name", "=", "ASIA")), _NR, scalar=True), ["n_nationkey", "n_name"], "SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_scalar("scalar_companion_row", q("nation").exists(_region(2), _NR, scalar=True), ["r_regionkey", "r_name"], "SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2", True)
_scalar("scalar_nested", q("customer").exists(q("nation").where(cmp("n_nationkey", "=", 7)).exists(_region(2), _NR, scalar=True), ("c_nationkey", "n_nationkey"), scalar=True), ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey = 7 AND n_regionkey = 2)")

# --- changes --------------------------------------------------------------------------------


def changed_orders(spark: SparkSession, sf_dir: str) -> tuple[ViewEngine, DataFrame]:
    """An engine over customer, lineitem and version 0 of orders, and the log that leads to version 1."""
    engine = ViewEngine(spark)
    for name, (spec, df) in read_tables(spark, sf_dir, {t: TEST_TABLE_KEYS[t] for t in ("customer", "orders", "lineitem")}).items():
        engine.register_table(spec, df.filter("o_orderkey % 10 <> 0") if name == "orders" else df)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    log = (
        orders.filter("o_orderkey % 10 < 4")
        .withColumn("__seq", F.col("o_orderkey"))
        .withColumn("__op", F.expr("CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END"))
        .withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 10 = 2 THEN o_totalprice + 1000 ELSE o_totalprice END"))
        .withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 10 = 3 THEN (o_custkey + 1) % 100 ELSE o_custkey END"))
    )
    return engine, log


def _delta(name: str, builder, path: str, keys: dict[str, str], sql: str, prune: bool = True) -> None:
    """Registers the changes at one path: type, and key columns (name -> field of row_key, as bigint)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, log = changed_orders(spark, sf_dir)
        engine.add_query("x", builder)
        found = engine.advance({"orders": log}, prune=prune).changes.filter(F.col("path") == path)
        return found.select("type", *(F.get_json_object("row_key", f"$.{f}").cast("bigint").alias(c) for c, f in keys.items()))

    entry(name, sql)(run)


def _pair_sql(v0: str, v1: str, key: str, edited: str) -> str:
    return f"""WITH v0 AS ({V0}), v1 AS ({V1}), a AS ({v0}), b AS ({v1})
SELECT CASE WHEN a.k IS NULL THEN 0 WHEN b.k IS NULL THEN 1 ELSE 2 END::INTEGER AS type, coalesce(b.k, a.k) AS {key}
FROM (SELECT *, 1 AS one FROM a) a FULL OUTER JOIN (SELECT *, 1 AS one FROM b) b ON a.k = b.k AND a.s IS NOT DISTINCT FROM b.s
WHERE a.k IS NULL OR b.k IS NULL OR ({edited})"""


_EDIT = "a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_custkey IS DISTINCT FROM b.o_custkey"
_ord = "SELECT o_orderkey AS k, 0 AS s, * FROM {v} WHERE {w}"
_delta("delta_filter_split", q("orders").where(cmp("o_totalprice", ">", 300000)), "orders", {"o_orderkey": "o_orderkey"}, _pair_sql(_ord.format(v="v0", w="o_totalprice > 300000"), _ord.format(v="v1", w="o_totalprice > 300000"), "o_orderkey", _EDIT))
_delta("delta_edit", q("orders").where(cmp("o_orderstatus", "=", "F")), "orders", {"o_orderkey": "o_orderkey"}, _pair_sql(_ord.format(v="v0", w="o_orderstatus = 'F'"), _ord.format(v="v1", w="o_orderstatus = 'F'"), "o_orderkey", _EDIT))
_top = "SELECT o_orderkey AS k, 0 AS s, * FROM {v} WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50"
_delta("delta_topn_displacement", q("orders").where(cmp("o_orderstatus", "=", "F")).order("-o_totalprice").limit(50), "orders", {"o_orderkey": "o_orderkey"}, _pair_sql(_top.format(v="v0"), _top.format(v="v1"), "o_orderkey", _EDIT))
_back = "SELECT o_orderkey AS k, 0 AS s, * FROM {v} ORDER BY o_orderkey LIMIT 40"
_delta("delta_topn_backfill", q("orders").limit(40), "orders", {"o_orderkey": "o_orderkey"}, _pair_sql(_back.format(v="v0"), _back.format(v="v1"), "o_orderkey", _EDIT))
_childq = "SELECT o_orderkey AS k, o_custkey AS s, v.* FROM {v} v JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"
_delta("delta_child_add_remove", q("customer").where(cmp("c_mktsegment", "=", "BUILDING")).related(q("orders"), _CO), "customer/orders", {"o_orderkey": "o_orderkey"}, _pair_sql(_childq.format(v="v0"), _childq.format(v="v1"), "o_orderkey", _EDIT))
_exq = "SELECT c_custkey AS k, 0 AS s, c_custkey AS o_custkey, 0 AS o_totalprice FROM customer c WHERE {n} EXISTS (SELECT 1 FROM {v} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 470000)"
_rich = q("orders").where(cmp("o_totalprice", ">", 470000)).query
_delta("delta_exists_flip", q("customer").exists(_rich, _CO), "customer", {"c_custkey": "c_custkey"}, _pair_sql(_exq.format(v="v0", n=""), _exq.format(v="v1", n=""), "c_custkey", "false"))
_delta("delta_not_exists_flip", q("customer").not_exists(_rich, _CO), "customer", {"c_custkey": "c_custkey"}, _pair_sql(_exq.format(v="v0", n="NOT"), _exq.format(v="v1", n="NOT"), "c_custkey", "false"))
_corr = "SELECT o_orderkey AS k, o_custkey AS s, v.* FROM {v} v JOIN customer ON o_custkey = c_custkey"
_delta("delta_correlation_edit", q("orders").related(q("customer"), ("o_custkey", "c_custkey")), "orders", {"o_orderkey": "o_orderkey"}, _pair_sql(_corr.format(v="v0").replace("JOIN customer ON o_custkey = c_custkey", ""), _corr.format(v="v1").replace("JOIN customer ON o_custkey = c_custkey", ""), "o_orderkey", _EDIT))
_nest = "SELECT c_custkey AS k, o_orderkey AS s, o_custkey, 0 AS o_totalprice FROM (SELECT * FROM {v} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 30) JOIN customer ON o_custkey = c_custkey"
_delta("delta_nested_related_displacement", q("orders").order("-o_totalprice").limit(30).related(q("customer"), ("o_custkey", "c_custkey")), "orders/customer", {"c_custkey": "c_custkey"}, _pair_sql(_nest.format(v="v0"), _nest.format(v="v1"), "c_custkey", "false"))
_win = "SELECT o_orderkey AS k, o_custkey AS s, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) rn FROM {v}) JOIN customer ON o_custkey = c_custkey WHERE rn <= 3"
_delta("delta_child_window", q("customer").related(_TOP3, _CO), "customer/orders", {"o_orderkey": "o_orderkey"}, _pair_sql(_win.format(v="v0"), _win.format(v="v1"), "o_orderkey", _EDIT))
_delta("delta_child_window_whole_views", q("customer").related(_TOP3, _CO), "customer/orders", {"o_orderkey": "o_orderkey"}, _pair_sql(_win.format(v="v0"), _win.format(v="v1"), "o_orderkey", _EDIT), prune=False)


@entry("delta_multi_table_batch", f"WITH v0 AS ({V0}), v1 AS ({V1}), a AS (SELECT o_orderkey, o_custkey FROM v0 JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderstatus = 'P'), b AS (SELECT o_orderkey, o_custkey FROM v1 JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderstatus = 'P' AND c_custkey % 3 <> 0) SELECT CASE WHEN a.o_orderkey IS NULL THEN 0 ELSE 1 END::INTEGER AS type, coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey AND a.o_custkey = b.o_custkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL")
def delta_multi_table_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch that changes orders and removes a third of the customers."""
    engine, log = changed_orders(spark, sf_dir)
    engine.add_query("x", q("customer").where(cmp("c_acctbal", ">", 0)).related(q("orders").where(cmp("o_orderstatus", "=", "P")), _CO))
    gone = engine.snapshot.frames["customer"].filter("c_custkey % 3 = 0").withColumn("__seq", F.col("c_custkey")).withColumn("__op", F.lit(1))
    found = engine.advance({"orders": log, "customer": gone}).changes.filter((F.col("path") == "customer/orders") & (F.col("type") != 2))
    return found.select("type", F.get_json_object("row_key", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


@entry("delta_noop", "SELECT 0::INTEGER AS type, 'x' AS row_key WHERE false")
def delta_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes outside every query's reach: nothing comes out."""
    engine, log = changed_orders(spark, sf_dir)
    engine.add_query("x", q("customer").exists(q("orders").where(cmp("o_totalprice", "<", -1)), _CO))
    return engine.advance({"orders": log}).changes.select("type", "row_key")


@entry("hydrate_row_changes", f"SELECT 0::INTEGER AS type, 'customer' AS path, c_custkey AS k FROM customer c WHERE EXISTS {_BIGSQL} UNION ALL SELECT 0, 'customer/orders_0', o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders WHERE o_totalprice > 490000) WHERE rn <= 3")
def hydrate_row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat added rows of a query, as a client gets them."""
    engine = ViewEngine(spark)
    for spec, df in read_tables(spark, sf_dir, {t: TEST_TABLE_KEYS[t] for t in ("customer", "orders")}).values():
        engine.register_table(spec, df)
    found = engine.add_query("x", q("customer").exists(_BIG, _CO))
    return found.select("type", "path", F.coalesce(F.get_json_object("row_key", "$.c_custkey"), F.get_json_object("row_key", "$.o_orderkey")).cast("bigint").alias("k"))


@entry("hydrate_chunk_index", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::BIGINT AS chunk_index FROM orders WHERE o_orderstatus = 'F'")
def hydrate_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk of each row when a result is cut into chunks of 1000."""
    frames, specs = tables(spark, sf_dir, ["orders"])
    rows = Compiler(frames, specs).compile(q("orders").where(cmp("o_orderstatus", "=", "F")).query)[0].rows()
    return flatten.chunk_numbers(rows.select("o_orderkey"), ["o_orderkey"], 1000)


@entry("stream_foreach_batch_final_state", "SELECT event_id, event_type FROM events WHERE event_id % 4 <> 3 AND event_type IN ('purchase', 'signup') ORDER BY event_id LIMIT 200")
def stream_foreach_batch_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of events (all added, a quarter removed again) as a stream; the view's rows after the last batch."""
    from viewtide.sources.staging import new_dir
    from viewtide.streaming.changelog import drive, read_log

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    spec = TableSpec("events", events.schema, ("event_id",))
    engine = ViewEngine(spark)
    engine.register_table(spec, events.limit(0))
    engine.add_query("x", q("events").where(cmp("event_type", "IN", ["purchase", "signup"])).order("event_id").limit(200))
    path, checkpoint = new_dir(spark, "log"), new_dir(spark, "stream")
    adds = events.withColumn("__seq", F.col("event_id")).withColumn("__op", F.lit(0))
    gone = events.filter("event_id % 4 = 3").withColumn("__seq", F.col("event_id")).withColumn("__op", F.lit(1))
    for part in (adds, gone):  # the stream goes on from its checkpoint: each part is one batch, however many files it has
        part.select("__seq", "__op", *events.columns).write.mode("append").parquet(path)
        drive(engine, "events", read_log(spark, path, spec), lambda result, batch: result.changes.count(), checkpoint).awaitTermination()
    return engine.paths("x")[0].rows().select("event_id", "event_type")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment with finished orders, the richest 20, their top three orders and those orders' lines, as row changes."""
    engine = ViewEngine(spark)
    for spec, df in read_tables(spark, sf_dir, {t: TEST_TABLE_KEYS[t] for t in ("customer", "orders", "lineitem")}).values():
        engine.register_table(spec, df)
    top = _TOP3.related(q("lineitem"), ("o_orderkey", "l_orderkey"))
    query = q("customer").where(cmp("c_mktsegment", "=", "BUILDING")).exists(q("orders").where(cmp("o_orderstatus", "=", "F")), _CO).order("-c_acctbal").limit(20).related(top, _CO)
    return engine.add_query("flagship", query)


__all__ = ["QUERIES", "SQL", "flagship", "resolve_scalars"]
