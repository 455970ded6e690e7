"""Sharding by vector bin packing (operator 7).

A group is a set of documents with equal texts; it goes to one shard whole, unless no shard can hold it. Each group has a vector of
bytes, tokens and rows, and goes where the dot product of its vector with the shards' residual capacities is highest, the largest groups first.

Groups above 1/PIECES of a shard in any dimension are few, whatever the data (3 * shards * PIECES at most): the driver places them one by
one. One that is larger than a whole shard is cut by the hash of the id into pieces of a quarter of a shard. All other groups are dealt to cells of some
CELL groups by their hash, and each cell is one task that places its groups one by one, against its share of the capacity that the large ones
leave: cells of equal law add up to shards of that law. A shard's positions are given out cell by cell.

Nulls: a null text has no bytes and counts as the empty text; a null id is a value like any other. Repeated rows are separate rows, of one
group. Ties go to the first shard, and in a shard to the least id. An empty table gives no rows. A very long text is one group, of whatever size; its text is read
once and not moved. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewtide.llm import common
from viewtide.sources.staging import stage

SHARDS = 24
#: A group above 1/PIECES of a shard is placed by the driver; groups in a cell, about; parts that a large group's positions are given out in.
PIECES, CELL, PARTS = 64, 50_000, 64
#: Pieces of a cut group for each shard that it would fill: smaller pieces leave room beside them.
QUARTER = 4
#: What bytes, tokens and rows weigh in the product: the law is that of bytes.
WEIGHTS = np.array([4.0, 1.0, 1.0])


def pack(share: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each vector, the largest first, each where its dot product with the residual capacity is highest. residual (shards x dimensions) is what is left at the end."""
    out = np.zeros(len(share), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share[:, 0], -share.max(axis=1, initial=0.0))).tolist():
        out[i] = best = int((residual @ (share[i] * WEIGHTS)).argmax())
        residual[best] -= share[i]
    return out


def _vectors(rows) -> np.ndarray:
    return np.array([[x["b"], x["t"], x["r"]] for x in rows], float).reshape(len(rows), 3)


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", cell: int = CELL) -> DataFrame:
    """key, size, text_crc32, tokens, shard, slot for every row of docs."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    thin = stage(
        docs.select(F.col(f"`{key}`").alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("crc"), common.n_words(body).alias("tokens"), F.xxhash64(body).alias("hash")),
        "shard",
    )
    group = ["hash", "crc", "size"]
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    groups = stage(thin.groupBy(*group).agg(*sums), "groups")
    found = groups.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r"), F.count("*").alias("n")).collect()[0]
    if not found["n"]:
        return thin.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    total = np.maximum([found["b"], found["t"], found["r"]], 1).astype(float)
    share = F.greatest(*(F.col(c) * float(shards) / float(x) for c, x in zip("btr", total)))

    # the large groups, cut where no shard holds them: 3 * shards * PIECES rows at most, and QUARTER for each shard that a cut one fills
    pieces = F.when((share > 1) & (F.col("r") > 1), F.least(F.ceil(share * QUARTER), F.col("r"))).otherwise(1).cast("long")
    large = groups.filter(share * PIECES > 1).select(*group, pieces.alias("pieces"))
    piece = F.pmod(F.xxhash64("id", "crc"), F.col("pieces")).cast("int")
    cut = thin.join(F.broadcast(large), group).withColumn("piece", piece)
    big = cut.groupBy(*group, "piece").agg(*sums).orderBy(*group, "piece").collect()
    vectors = _vectors(big)
    residual = np.ones((shards, 3))
    places = pack(vectors / total * shards, residual).tolist()
    schema = "hash long, crc long, size long, piece int, cell long, shard int"
    plan = spark.createDataFrame([(x["hash"], x["crc"], x["size"], x["piece"], i, s) for i, (x, s) in enumerate(zip(big, places))], schema)
    part = -(F.col("cell") * PARTS + F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(PARTS)) + 1)
    cut = cut.join(F.broadcast(plan), [*group, "piece"]).select("id", "size", "crc", "tokens", "hash", "shard", part.alias("cell"))

    # all others, cell by cell
    left = np.maximum(residual, 0.0)
    left = left / np.maximum(left.sum(axis=0), 1e-12)

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("hash", "ascending"), ("crc", "ascending"), ("size", "ascending")])
        v = np.stack([t[c].to_numpy().astype(float) for c in "btr"], axis=1)
        return t.select([*group, "cell"]).append_column("shard", pa.array(pack(v / np.maximum(v.sum(axis=0), 1.0), left.copy()).astype(np.int32)))

    cells = F.pmod(F.xxhash64("hash", "crc", F.lit(3)), F.lit(-(-found["n"] // cell)))
    small = groups.filter(share * PIECES <= 1).withColumn("cell", cells)
    small = small.groupBy("cell").applyInArrow(place, "hash long, crc long, size long, cell long, shard int")
    rest = thin.join(small, group).select("id", "size", "crc", "tokens", "hash", "shard", "cell")

    out = stage(cut.unionByName(rest), "placed")
    first = out.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    first = first.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(F.col("id").asc_nulls_first(), "hash"))
    out = out.withColumn("rank", rank).join(first, ["shard", "cell"])
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "tokens", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest, by the law of near equal bytes."""
    found = shard(common.plain(common.read(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
