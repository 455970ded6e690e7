"""Substring deduplication: passages that repeat across documents (operator 5), by paragraph MinHash banding.

A paragraph is a line with a word in it. Every paragraph is compared, on its set of five-word shingles (one of fewer words is one
shingle). bands() tunes the banding for recall at the threshold: nine bands of four rows at 0.8. Paragraphs that meet in a band are joined, their Jaccard
similarity is computed from the whole shingle sets, and those at 0.8 or more are tied; equal paragraphs are one class from the start. Clusters are
the components. A cluster that spans two documents or more marks its paragraphs as repeated. Consecutive repeated paragraphs make a run, and a run
of PASSAGE words or more is a passage: a line that recurs alone is none. (repeated() takes any least number of words, 1 for every repeated paragraph.)
All but the paragraphs of the cluster's least document are to be removed.

Passages do not keep to lines, so the same is done for sliding paragraphs: each window of PASSAGE words has the least hash of its runs of SEED words as its
band of one row, its anchor. Two equal windows always meet there, and what meets is verified by the windows' own hashes.
Consecutive windows with one anchor are a piece, and equal pieces are one class. Of a piece come the windows that repeat, cut where their least document changes: word by word the
exact shared span, as no window outside repeats. Such rows have word_no (the first word) in place of unit_no, and pieces of a run overlap.

Buckets: the classes of a bucket are distinct texts that share four minimal hashes. A bucket of more than BLOCK words is cut into blocks by the hash of
the class, and each pair of blocks is a group of its own, so that a task holds two blocks and no link is lost; buckets with equal members
are compared once. In a group a prefix filter, which is exact, picks the pairs to compare; what leaves is a spanning forest, never the pairs.

Nulls: a null text has no paragraphs; rows with a null id are left out, as they cannot be told apart. Rows with one id are one document. Ids are
cast to long. Ties go to the least id. An empty table gives no rows. A very long text passes as one row through one task, and a paragraph is never cut. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import gc
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewtide.llm import common
from viewtide.llm.components import components
from viewtide.llm.pairs import BLOCK, THRESHOLD, blocked, forests
from viewtide.sources.staging import new_dir, remove, stage

SHINGLE = 5
#: Words that make a passage; words of a run that can be an anchor: a power of two, from half of PASSAGE down.
PASSAGE, SEED = 50, 16
#: Chance that two paragraphs at the threshold meet, and rows of a band: with four, paragraphs at 0.3 meet with 7 %.
RECALL, ROWS = 0.99, 4
#: Fixed odd multipliers for the five words of a shingle and for the bands (from the digits of the golden ratio and of others).
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> tuple[int, int]:
    """(bands, rows): the fewest bands whose chance to meet at the threshold is at least recall."""
    n = 1
    while 1 - (1 - threshold**rows) ** n < recall:
        n += 1
    return n, rows


def paragraphs(text: str) -> Iterator[list[bytes]]:
    """The words of each line with a word."""
    return filter(None, map(bytes.split, text.encode("utf-8", "surrogatepass").translate(common.LOWER).split(b"\n")))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingled(hashes: list[int], sizes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of paragraphs, end to end, and where each paragraph's begin; one of fewer words has its class."""
    h = np.array(hashes, np.uint64)
    whole = np.maximum(sizes - SHINGLE + 1, 1)
    starts = np.cumsum(whole) - whole
    at = np.arange(int(whole.sum())) + np.repeat(np.cumsum(sizes) - sizes - starts, whole)
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    x = _mixed(sum(padded[at + i] * _MIX[i] for i in range(SHINGLE)))
    short = sizes < SHINGLE
    x[starts[short]] = classes[short]
    return x, starts


def paragraph_table(docs: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """doc_id, unit_no, n_words, class (hash of the paragraph's words), bands (a key for each, of the least hashes of its rows), staged."""
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 1 << 63, (n_bands * rows, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common.drop()
        digest = xxhash.xxh64_intdigest
        for b in batches:
            known = _Hashes()
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids, numbers, sizes, classes, hashes = [], [], [], [], []
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for i, words in enumerate(paragraphs(t)):
                        ids.append(doc)
                        numbers.append(i)
                        sizes.append(len(words))
                        classes.append(digest(b" ".join(words)))
                        hashes.extend(map(known.__getitem__, words))
                if not ids:
                    continue
                n, c = np.array(sizes, np.int64), np.array(classes, np.uint64)
                x, starts = _shingled(hashes, n, c)
                keys = np.empty((len(n), n_bands), np.uint64)
                for i in range(n_bands):
                    k = np.full(len(n), i + 1, np.uint64)
                    for j in range(rows):
                        a, m = odd[i * rows + j]
                        k = _mixed(k * _MIX[1] + np.minimum.reduceat((x ^ a) * m, starts))
                    keys[:, i] = k
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * n_bands), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(n.astype(np.int32)), pa.array(c.view(np.int64)), lists], names=["doc_id", "unit_no", "n_words", "class", "bands"])

    return stage(docs.mapInArrow(run, "doc_id long, unit_no int, n_words int, class long, bands array<long>"), "units", "zstd")


def meetings(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """g, node (a class): the groups to compare. A group is a bucket of two classes or more, or a pair of blocks of a large one."""
    rows = table.select("class", "n_words", F.explode("bands").alias("k")).repartition("k").distinct()
    bucket = Window.partitionBy("k")
    rows = rows.withColumns({"n": F.count("*").over(bucket), "words": F.sum("n_words").over(bucket), "x": F.bit_xor(F.xxhash64("class")).over(bucket), "y": F.bit_xor(F.xxhash64(F.lit(1), "class")).over(bucket)})
    # buckets of the same classes are one; x and y tell sets of classes apart by 128 bits
    rows = rows.filter("n > 1").groupBy("x", "y", "n", "class").agg(F.max("words").alias("words"))
    return blocked(rows, ["x", "y", "n"], "class", F.col("words"), block)


def shingle_sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """class, shingles (distinct, as bytes): asked has doc_id and unit_no of one paragraph of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common.drop()
        for b in batches:
            known = _Hashes()
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sizes, classes, hashes = [], [], []
                for t, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    wanted = set(wanted)
                    for i, words in enumerate(paragraphs(t)):
                        if i in wanted:
                            sizes.append(len(words))
                            classes.append(xxhash.xxh64_intdigest(b" ".join(words)))
                            hashes.extend(map(known.__getitem__, words))
                if not sizes:
                    continue
                n, c = np.array(sizes, np.int64), np.array(classes, np.uint64)
                x, starts = _shingled(hashes, n, c)
                raw = [np.unique(s).tobytes() for s in np.split(x, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(raw, pa.binary())], names=["class", "shingles"])

    by_doc = asked.groupBy("doc_id").agg(F.collect_set("unit_no").alias("wanted"))
    return docs.join(by_doc, "doc_id").select("text", "wanted").mapInArrow(run, "class long, shingles binary")


def tied(docs: DataFrame, table: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of classes that meet in a band and are similar."""
    met = stage(meetings(table, block), "meetings", "zstd")
    first = table.groupBy("class").agg(F.min(F.struct("doc_id", "unit_no")).alias("m"))
    asked = first.join(met.select(F.col("node").alias("class")).distinct(), "class").select("m.doc_id", "m.unit_no")
    sets = shingle_sets(docs, asked).groupBy(F.col("class").alias("node")).agg(F.first("shingles").alias("shingles"))
    return forests(met.join(sets, "node"), threshold)


def _free(spark: SparkSession) -> None:
    """Has Spark delete the shuffles of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class _Hashes(dict):
    """Words -> their hashes, each made once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _widened(x: np.ndarray, have: int, want: int, join) -> np.ndarray:
    """Values of runs of have words -> those of want words, by doubling and a last overlapping step."""
    while have < want:
        by = min(have, want - have)
        x, have = join(x[: len(x) - by], x[by:], by), have + by
    return x


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, anchor and hash of each window of PASSAGE words, in order."""
    known = _Hashes()
    parts = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in map(common.lower_words, texts)]
    n = np.array([len(x) for x in parts], np.int64)
    whole = np.maximum(n - PASSAGE + 1, 0)
    if not whole.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    mix = lambda a, b, by: _mixed(a * _MIX[0] + _mixed(b * _MIX[3] + np.uint64(by)))
    seeds = _widened(np.concatenate(parts), 1, SEED, mix)
    hashes = _widened(seeds, SEED, PASSAGE, mix)
    least = _widened(seeds, 1, PASSAGE - SEED + 1, lambda a, b, _: np.minimum(a, b))
    text = np.repeat(np.arange(len(n)), whole)
    first = np.arange(len(text)) - np.repeat(np.cumsum(whole) - whole, whole)
    at = np.repeat(np.cumsum(n) - n, whole) + first
    return text, first, least[at], hashes[at]


def anchors(docs: DataFrame) -> DataFrame:
    """a, doc_id: each document's distinct anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                text, _, a, _ = windows(part.column(1).to_pylist())
                if not len(a):
                    continue
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])))
                a, text = a[new], text[new]
                order = np.lexsort((a, text))
                a, text = a[order], text[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(part.column(0).to_numpy()[text[new]])], names=["a", "doc_id"])

    return docs.mapInArrow(run, "a long, doc_id long")


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id, text, picked (anchors) -> doc_id, at (its first window), a, class, windows (their hashes): consecutive windows with one anchor among the picked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common.drop()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                text, first, a, h = windows(part.column(1).to_pylist())
                wanted = part.column(2)
                of = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy()).astype(np.uint64)
                keep = np.isin(_mixed(a + text.astype(np.uint64) * _MIX[1]), _mixed(wanted.flatten().to_numpy().view(np.uint64) + of * _MIX[1]))
                text, first, a, h = text[keep], first[keep], a[keep], h[keep]
                if not len(a):
                    continue
                edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1] + 1), [True])))
                start, raw = edge[:-1], h.tobytes()
                classes = np.array([xxhash.xxh64_intdigest(raw[8 * s : 8 * e]) for s, e in zip(start.tolist(), edge[1:].tolist())], np.uint64)
                columns = [pa.array(part.column(0).to_numpy()[text[start]]), pa.array(first[start].astype(np.int32)), pa.array(a[start].view(np.int64)), pa.array(classes.view(np.int64))]
                columns.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(h.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "a", "class", "windows"])

    return docs.mapInArrow(run, "doc_id long, at int, a long, class long, windows array<long>")


def verbatim(d: DataFrame) -> DataFrame:
    """doc_id, word_no, n_words, cluster_id, keeper, run_words, removed: all words in windows of PASSAGE words that two documents have, staged."""
    spark = d.sparkSession
    made: list[str] = []

    def held(df: DataFrame, name: str) -> DataFrame:
        made.append(new_dir(spark, name))
        df.write.option("compression", "zstd").parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    found = held(anchors(d), "anchors")
    twice = found.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("a")
    picked = found.join(twice, "a").groupBy("doc_id").agg(F.collect_list("a").alias("picked"))
    parts = held(pieces(d.join(picked, "doc_id").select("doc_id", "text", "picked")), "pieces")
    classes = parts.groupBy("class").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("a").alias("a"), F.min("windows").alias("windows"))
    each = held(classes.select("class", "a", "lo", "hi", F.posexplode("windows").alias("j", "h")), "windows")
    same = each.groupBy("h").agg(F.min("lo").alias("keeper"), F.max("hi").alias("last")).filter("keeper < last").drop("last")
    # of each class the stretches of repeated windows with one least document
    w = Window.partitionBy("class", "keeper").orderBy("j")
    spans = each.select("class", "a", "j", "h").join(same, "h").withColumn("run", F.col("j") - F.row_number().over(w))
    spans = spans.groupBy("class", "a", "keeper", "run").agg(F.min("j").alias("from"), F.max("j").alias("to")).drop("run")
    rows = parts.select("doc_id", "at", "class").join(spans, "class")
    rows = rows.select("doc_id", (F.col("at") + F.col("from")).alias("word_no"), (F.col("to") - F.col("from") + PASSAGE).alias("n_words"), F.xxhash64("a", "keeper").alias("cluster_id"), "keeper")
    # a document's rows that touch or overlap are one run
    w = Window.partitionBy("doc_id").orderBy("word_no", "n_words")
    end = F.col("word_no") + F.col("n_words")
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.sum(F.coalesce((F.col("word_no") > before).cast("int"), F.lit(1))).over(w))
    one = Window.partitionBy("doc_id", "run")
    rows = rows.withColumn("run_words", (F.max(end).over(one) - F.min("word_no").over(one)).cast("long")).drop("run")
    out = stage(rows.withColumn("removed", F.col("doc_id") != F.col("keeper")), "verbatim")
    # their disk is needed for what follows; shuffles go when their plans do
    for path in made:
        remove(spark, path)
    del found, twice, picked, parts, classes, each, same, spans, rows, d
    _free(spark)
    return out


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = PASSAGE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, unit_no (its place among the paragraphs, from 0), n_words, cluster_id, keeper (the cluster's least document), run_words, removed: paragraphs that repeat across documents, in runs of least words or more;
    and the rows of verbatim(), where unit_no is null (elsewhere word_no is)."""
    common.ready(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).dropna()
    exact = verbatim(docs)
    table = paragraph_table(docs, *bands(threshold))
    labels = components(tied(docs, table, threshold, block), "passages").withColumnRenamed("node", "class")
    _free(docs.sparkSession)
    spans = table.groupBy("class").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).join(labels, "class", "left")
    spans = spans.filter((F.col("lo") < F.col("hi")) | F.col("component").isNotNull()).withColumn("cluster_id", F.coalesce("component", "class"))
    spans = stage(spans.select("class", "cluster_id", "lo", "hi"), "spans")
    clusters = spans.groupBy("cluster_id").agg(F.min("lo").alias("keeper"), F.max("hi").alias("last")).filter("keeper < last").drop("last")
    marked = table.drop("bands").distinct().join(spans.select("class", "cluster_id").join(clusters, "cluster_id"), "class").drop("class")
    w = Window.partitionBy("doc_id").orderBy("unit_no")
    broken = F.coalesce((F.col("unit_no") - F.lag("unit_no").over(w) > 1).cast("int"), F.lit(1))
    runs = marked.withColumn("new", broken).withColumn("run", F.sum("new").over(w))
    runs = runs.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "run")))
    runs = runs.filter(F.col("run_words") >= least).select("doc_id", "unit_no", "n_words", "cluster_id", "keeper", "run_words", (F.col("doc_id") != F.col("keeper")).alias("removed"))
    return runs.unionByName(exact, allowMissingColumns=True)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each paragraph and each piece of a repeated passage, with its document, cluster, and whether it is to go."""
    return repeated(common.plain(common.read(spark, sf_dir, "documents"), "doc_id", "text"))
