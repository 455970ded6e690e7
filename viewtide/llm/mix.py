"""Mixing sources to target weights by systematic sampling (operator 1).

Every document of a source has the same number of expected copies: the source's target over
its size in words. The documents of a source are put in order, expected copies are
prefix-summed, one random offset per source is added, and a document is emitted once for each
integer boundary that its interval crosses. The order is by size class, so that the sum of sizes
taken stays within about one large document of the target.

The prefix sum takes no sort of a whole source: counts by (source, size class, hash of the
id) give each cell's start, and ranks are taken inside cells, of which a hot source
has thousands.

Nulls: a null source is a source, last in order; a null text has no words; a null id is a
value like any other. Repeated rows count each. An empty table gives an empty mix. Size 0: a
source without words has target 0 and no copies. Ties: documents of one size class and cell are in the order of id, size and the text's hash. A very long text is
one document, taken whole or not. Other columns stay as they are; the result's name is lengthened where docs has it. Windows over sources hold one row for each
source in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewtide.llm import common

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Cells of a size class; with the classes (32 to each doubling) they bound what one window of a source holds.
CELLS = 256


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source (key, source_size) -> target and rate. Targets share the total by weight, stop at cap times the size, and the excess is shared again.

    Sources in the order of size over weight reach the cap one after the other, so one pass of running sums
    finds which do; the comparison is in integers. The windows are global over one row per source.
    """
    by_key, by_ratio = Window.orderBy("key"), Window.orderBy((F.col("source_size") / F.col("w")).asc(), "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    place = (F.row_number().over(by_key) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    t = sizes.withColumn("w", w.cast("long"))
    t = t.withColumns({"total": F.sum("source_size").over(everything), "wsum": F.sum("w").over(everything)})
    t = t.withColumns({"s0": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "w0": F.coalesce(F.sum("w").over(before), F.lit(0))})
    capped = (F.col("total") - cap * F.col("s0")) * F.col("w") > cap * F.col("source_size") * (F.col("wsum") - F.col("w0"))
    t = t.withColumn("capped", capped)
    t = t.withColumns({"sc": F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(everything), "wc": F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(everything)})
    share = (F.col("total") - cap * F.col("sc")).cast("double") / (F.col("wsum") - F.col("wc")).cast("double")
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share * F.col("w").cast("double"))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target)
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target / F.col("source_size").cast("double"))
    return t.select("key", "source_size", target.alias("target"), rate.alias("rate"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with a struct column mix of size, source_size, target, copies and taken (copies times size).

    The struct's name is lengthened where docs has a column mix; mix_name() tells it.
    """
    name, made, planned = mix_name(docs), common.fresh(docs, "__mix"), common.fresh(docs, "__plan")
    idtext = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    cell = F.struct(
        F.when(F.col(f"`{source}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(f"`{source}`"))).alias("key"),
        common.n_words(F.col(f"`{text}`")).alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.lit(seed), idtext)), 1, 2), 16, 10).cast("int").alias("cell"),
    )
    d = docs.withColumn(made, cell)
    # the size with its five leading bits: documents of one class differ by 1/16 at most
    shift = f"greatest(length(bin({made}.size)) - 5, 0)"
    d = d.withColumn(made, F.struct(f"{made}.*", F.expr(f"shiftleft(shiftright({made}.size, {shift}), {shift})").alias("class")))
    counts = d.select(f"{made}.*").groupBy("key", "class", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sizes = counts.groupBy("key").agg(F.sum("words").alias("source_size"))
    w = Window.partitionBy("key").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("key").alias("k"), F.col("class").alias("c"), F.col("cell").alias("e"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    goal = targets(sizes, weights, cap).select(F.col("key").alias("k2"), "source_size", "target", "rate")
    plan = starts.join(goal, F.col("k") == F.col("k2")).select(F.struct("k", "c", "e", "start", "source_size", "target", "rate").alias(planned))
    rank = F.row_number().over(Window.partitionBy(f"{made}.key", f"{made}.class", f"{made}.cell").orderBy(F.col(f"`{key}`"), F.col(f"{made}.size"), F.xxhash64(F.col(f"`{text}`"))))
    d = d.withColumn(made, F.struct(f"{made}.*", rank.alias("rank")))
    on = (F.col(f"{made}.key") == F.col(f"{planned}.k")) & (F.col(f"{made}.class") == F.col(f"{planned}.c")) & (F.col(f"{made}.cell") == F.col(f"{planned}.e"))
    d = d.join(plan, on)
    place, rate = (F.col(f"{planned}.start") + F.col(f"{made}.rank")).cast("double"), F.col(f"{planned}.rate")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(f"{made}.key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    # floor(x + rate) - floor(x) is at most the rate rounded up; least() keeps rounding of doubles from adding one
    copies = F.least(F.floor(rate * place + offset) - F.floor(rate * (place - 1) + offset), F.ceil(rate)).cast("long")
    size = F.col(f"{made}.size")
    return d.withColumn(name, F.struct(size.alias("size"), f"{planned}.source_size", f"{planned}.target", copies.alias("copies"), (copies * size).alias("taken"))).drop(made, planned)


def mix_name(docs: DataFrame) -> str:
    return common.fresh(docs, "mix")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it has copies, with the columns of docs."""
    name = mix_name(docs)
    return mix(docs, **how).select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(1), F.col(f"`{name}`.copies").cast("int"))).alias(name)).drop(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: doc_id, size, source_size, target, taken."""
    docs = common.plain(common.read(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || md5('{SEED}' || coalesce(doc_id::VARCHAR, ''))[1:2])::INTEGER AS cell
  FROM documents),
e AS (SELECT *, greatest(length(bin(size)) - 5, 0)::INTEGER AS sh FROM d),
f AS (SELECT doc_id, key, size, cell, ((size >> sh) << sh) AS class FROM e),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM f GROUP BY key),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY key) - 1) % {len(WEIGHTS)} + 1)::INTEGER]::BIGINT AS w FROM s),
t AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS wsum,
             coalesce(sum(source_size) OVER b, 0)::BIGINT AS s0, coalesce(sum(w) OVER b, 0)::BIGINT AS w0
      FROM w WINDOW b AS (ORDER BY source_size::DOUBLE / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - {CAP} * s0) * w > {CAP} * source_size * (wsum - w0) AS capped FROM t),
g AS (SELECT key, source_size, total, w, wsum, capped,
             (sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ())::BIGINT AS sc, (sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())::BIGINT AS wc FROM c),
h AS (SELECT key, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN capped THEN ({CAP} * source_size)::DOUBLE
             ELSE (total - {CAP} * sc)::DOUBLE / (wsum - wc)::DOUBLE * w::DOUBLE END AS target FROM g),
r AS (SELECT f.*, source_size, target, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size::DOUBLE END AS rate,
             (row_number() OVER (PARTITION BY f.key ORDER BY class, cell, doc_id, size))::DOUBLE AS place,
             ('0x' || md5('{SEED}' || f.key)[1:8])::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM f JOIN h ON f.key = h.key)
SELECT doc_id, size, source_size, target,
       (least(floor(rate * place + u) - floor(rate * (place - 1) + u), ceil(rate))::BIGINT * size)::BIGINT AS taken
FROM r
"""
