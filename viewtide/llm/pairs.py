"""Groups of nodes to compare, and the links of a group: what passages and near-duplicates share.

A group is a bucket, or a pair of blocks of a large one: a task holds two blocks at most, and every pair of a bucket meets in a group.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Words of the sets that one block of a bucket holds.
BLOCK = 1_000_000


def blocked(rows: DataFrame, key: list[str], node: str, words: Column, block: int = BLOCK) -> DataFrame:
    """Rows of buckets -> g (the group) and node. words is what the row's bucket weighs."""
    rows = rows.withColumn("__m", F.greatest(F.ceil(words / block), F.lit(1)).cast("int"))
    rows = rows.withColumn("__i", F.pmod(F.xxhash64(F.lit(2), node), F.col("__m"))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    return rows.select(F.xxhash64(*key, F.least("__i", "__j"), F.greatest("__i", "__j")).alias("g"), F.col(node).alias("node"))


def similar(sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with Jaccard similarity of at least the threshold.

    Elements are ordered from the rarest in the bucket; two such sets share an element of their prefixes.
    """
    counts = Counter(x for s in sets for x in s.tolist())
    ordered = [sorted(s.tolist(), key=lambda x: (counts[x], x)) for s in sets]
    whole = [set(s) for s in ordered]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out, index = [], defaultdict(list)
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        n = len(ordered[i])
        prefix = ordered[i][: n - math.ceil(threshold * n) + 1]
        tried: set[int] = set()
        for x in prefix:
            for j in index[x]:
                if j not in tried and root(i) != root(j) and len(whole[j]) >= threshold * n:
                    both = len(whole[i] & whole[j])
                    if both >= threshold * (n + len(whole[j]) - both):
                        parent[root(i)] = root(j)
                        out.append((i, j))
                tried.add(j)
        for x in prefix:
            index[x].append(i)
    return out


def forests(rows: DataFrame, threshold: float) -> DataFrame:
    """g, node, shingles -> edges (a, b) that join the same nodes as all pairs of a group at the threshold do. A task holds one group at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets = None, [], []

        def done():
            pairs = similar(sets, threshold)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in pairs], pa.int64()), pa.array([names[j] for _, j in pairs], pa.int64())], names=["a", "b"])

        for b in batches:
            for g, c, raw in zip(*(x.to_pylist() for x in b.columns)):
                if g != now and names:
                    yield done()
                    names, sets = [], []
                now = g
                if not names or names[-1] != c:
                    names.append(c)
                    sets.append(np.frombuffer(raw, np.uint64))
        if names:
            yield done()

    rows = rows.select("g", "node", "shingles").repartition("g").sortWithinPartitions("g", "node")
    return rows.mapInArrow(run, "a long, b long").distinct()
