"""SimHash near-duplicates through deletion-variant signatures (operator 9).

A fingerprint has the majority of each bit over the hashes of a text's word shingles. It is cut into
few segments, so few that two fingerprints within the distance have a segment that differs by one bit at most:
two segments of 32 bits for a distance of up to 3. Each distinct fingerprint is
indexed under every segment as it is, and under every segment with one bit deleted; equal keys
meet in one partition, sorted by key. Under a whole segment all members are compared, under a deleted bit those
with 0 with those with 1, so that a pair meets once per segment. Comparing is arithmetic on blocks of bounded size; what
leaves a task is a spanning forest of the links found, never the pairs of a bucket. Components come from
large and small stars, and equal fingerprints are collapsed before all this.

A bucket's members are distinct fingerprints with an equal segment, 8 or 16 bytes each. A bucket of more than BIG of them is not compared in its
task: its members go on to a second step, where they are cut into blocks by their hash and each pair of blocks is a group of its own.

keep_one() does not trust bits: MinHash bands of the distinct shingles join what SimHash links may miss, the components of both are
candidates only, and in each the sets of distinct shingles are compared exactly, a large component in pairs of blocks. Only pairs at the scheme's
similarity are links there.

Nulls: a null text has no words and the fingerprint zero, which links like any other. A null id is never the smallest id of a component unless
it has no other. Repeated rows have equal rows in the result; keep_one() keeps one of them. Ties go to the least id, then to the least hash of the text. An empty
table gives no rows. A very long text passes as one row through one task, which holds its shingles' hashes. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewtide.llm import common
from viewtide.llm.components import components
from viewtide.llm.pairs import blocked, forests
from viewtide.sources.staging import stage

BLOCK = 2048
#: Shingles that all MinHash functions are applied to at once.
STRETCH = 512
#: Buckets of so many members at most are compared by shifts of the sorted array, larger ones by blocks.
SMALL = 32
#: Members of a bucket that one task compares.
BIG = 1 << 16


@dataclass(frozen=True)
class Scheme:
    """ngram words to a shingle; bits 64 (XXH64, seed 42) or 128 (XXH3, seed 42); segments of width bits; links differ in at most distance bits.

    With segments * 2 > distance and segments * width = bits every link is found. Else recall is that of
    one segment among them differing by one bit at most.
    """

    ngram: int = 3
    bits: int = 64
    width: int = 32
    distance: int = 2
    #: Repeated shingles count once; (bands, rows) of MinHash keys beside the segments; links of keep_one() have this Jaccard similarity at least.
    distinct: bool = False
    bands: tuple[int, int] = (0, 0)
    jaccard: float = 0.0

    @property
    def segments(self) -> int:
        return self.bits // self.width


EXACT = Scheme()
#: For a similarity of 0.8 on five-word shingles: there 15 % of the bits differ on average, 19 of 128 with a deviation of 4.
#: Segments alone miss a tenth of these pairs; 20 bands of 8 rows meet with a chance of 0.97.
SIMILAR = Scheme(ngram=5, bits=128, width=16, distance=26, distinct=True, bands=(20, 8), jaccard=0.8)


def shingles(text: str | None, scheme: Scheme) -> list[bytes]:
    """The hashes of a text's word shingles; of one shingle where the words are fewer."""
    import xxhash

    words = common.lower_words(text)
    if not words:
        return []
    k = scheme.ngram
    digest = xxhash.xxh64_digest if scheme.bits == 64 else xxhash.xxh3_128_digest
    if len(words) <= k:
        return [digest(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = [digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return list(set(hashes)) if scheme.distinct else hashes


def as_set(hashes: list[bytes]) -> np.ndarray:
    """The low halves of distinct 128-bit hashes, sorted."""
    return np.unique(np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)[:, 1])


@cache
def _odd(n: int) -> np.ndarray:
    """Two odd numbers for each of n hash functions."""
    return np.random.default_rng(42).integers(0, 1 << 63, (n, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(x: np.ndarray, scheme: Scheme) -> np.ndarray:
    """One key for each band: its number and least values; texts without words have none."""
    n, rows = scheme.bands
    if not len(x):
        return np.zeros(0, np.int64)
    a, b = _odd(n * rows).T[:, :, None]
    least = np.full(n * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), STRETCH):  # all functions at once, over stretches that a cache holds
        part = x[at : at + STRETCH] ^ a
        part *= b
        np.minimum(least, part.min(axis=1), out=least)
    least = least.reshape(n, rows)
    k = np.arange(n, dtype=np.uint64)
    for j in range(rows):
        k = (k ^ least[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(29)
    return k.view(np.int64)


def fingerprint(text: str | None, scheme: Scheme) -> bytes:
    """bits / 8 bytes, the highest bit first."""
    return print_of(shingles(text, scheme), scheme)


def print_of(hashes: list[bytes], scheme: Scheme) -> bytes:
    if not hashes:
        return bytes(scheme.bits // 8)
    n = len(hashes)
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(n, -1), axis=1)
    counts = np.zeros(scheme.bits, np.int64)
    for at in range(0, n, 255):  # sums of bytes, as far as bytes hold them
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, body (a hash of the text, to tell rows of one key apart), hi, lo: the fingerprint as two signed longs (hi is 0 with 64 bits)."""
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop()
        for b in batches:
            raw = np.frombuffer(b"".join(fingerprint(t, scheme) for t in b.column(2).to_pylist()), ">i8").reshape(b.num_rows, -1).astype(np.int64)
            hi = raw[:, 0] if scheme.bits == 128 else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hi), pa.array(raw[:, -1])], names=["key", "body", "hi", "lo"])
        common.give_back()

    d = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("body"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(run, f"key {d.schema['key'].dataType.simpleString()}, body long, hi long, lo long")


def variants(hi: np.ndarray, lo: np.ndarray, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, bit at the deleted place or 2) for each segment whole and with each bit deleted."""
    w, s = scheme.width, scheme.segments
    for i in range(s):
        at = (s - 1 - i) * w  # from the lowest bit
        word = lo if at < 64 else hi
        segment = (word >> np.uint64(at % 64)) & np.uint64((1 << w) - 1)
        for p in range(w + 1):
            tag = np.uint64((i * (w + 1) + p) << 40)
            if p == w:
                yield segment | tag, np.full(len(lo), 2, np.int8)
            else:
                bit = (segment >> np.uint64(p)) & np.uint64(1)
                low = segment & np.uint64((1 << p) - 1)
                yield ((segment >> np.uint64(p + 1)) << np.uint64(p)) | low | tag, bit.astype(np.int8)


def distance(ah, al, bh, bl):
    return np.bitwise_count(ah ^ bh) + np.bitwise_count(al ^ bl)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = np.minimum(label, label[label])
        if np.array_equal(before, label):
            return label


def links(key: np.ndarray, bit: np.ndarray, hi: np.ndarray, lo: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (member, root) of a spanning forest of the links in each run of equal keys; the arrays are sorted by key."""
    n = len(key)
    found_a, found_b = [], []
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(edge)
    small = np.repeat(sizes <= SMALL, sizes)
    at = np.flatnonzero(small)
    for d in range(1, SMALL):
        at = at[at + d < n]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        ok = (bit[at] == 2) | (bit[at] != bit[at + d])
        ok &= distance(hi[at], lo[at], hi[at + d], lo[at + d]) <= most
        found_a.append(at[ok])
        found_b.append(at[ok] + d)
    for g in np.flatnonzero(sizes > SMALL):
        s, e = edge[g], edge[g + 1]
        whole = bit[s] == 2
        left = np.arange(s, e) if whole else s + np.flatnonzero(bit[s:e] == 0)
        right = left if whole else s + np.flatnonzero(bit[s:e] == 1)
        for i in range(0, len(left), BLOCK):
            x = left[i : i + BLOCK]
            for j in range(i if whole else 0, len(right), BLOCK):
                y = right[j : j + BLOCK]
                r, c = np.nonzero(distance(hi[x][:, None], lo[x][:, None], hi[y][None, :], lo[y][None, :]) <= most)
                pair = _thin(x[r], y[c])
                found_a.append(pair[0])
                found_b.append(pair[1])
    if not found_a:
        return np.zeros(0, int), np.zeros(0, int)
    return _thin(np.concatenate(found_a), np.concatenate(found_b))


def _thin(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each node with the least one that it reaches."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = forest(len(nodes), at[: len(a)], at[len(a) :])
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def link(distinct: DataFrame, scheme: Scheme) -> DataFrame:
    """Distinct fingerprints (hi, lo) -> links a_hi, a_lo, b_hi, b_lo that join the same fingerprints as all links within the distance do."""
    wide = scheme.bits == 128

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo = (b.column(i).to_numpy() for i in (0, 1))
            for keys, bit in variants(hi.view(np.uint64), lo.view(np.uint64), scheme):
                # the deleted bit's value goes into the lowest place, so that a row is key, hi, lo
                parts = [pa.array((keys << np.uint64(2) | bit.astype(np.uint64)).view(np.int64)), pa.array(lo)]
                yield pa.RecordBatch.from_arrays([parts[0], pa.array(hi), parts[1]] if wide else parts, names=["k", "hi", "lo"] if wide else ["k", "lo"])

    fields = ["a_hi", "a_lo", "b_hi", "b_lo", "k"]

    def rows_of(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) if x is not None else pa.nulls(len(columns[0]), pa.int64()) for x in columns], names=fields)

    def flush(k, hi, lo) -> pa.RecordBatch:
        a, b = links(k >> 2, (k & 3).astype(np.int8), hi.view(np.uint64), lo.view(np.uint64), scheme.distance)
        # a fingerprint stands in many buckets: one forest over all of them, to the least fingerprint
        ends = np.concatenate([a, b])
        nodes, at = np.unique(np.stack([hi[ends], lo[ends]], axis=1), axis=0, return_inverse=True)
        a, b = _thin(at.ravel()[: len(a)], at.ravel()[len(a) :])
        return rows_of(nodes[a, 0], nodes[a, 1], nodes[b, 0], nodes[b, 1], None)

    def compare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        """Links of runs of one key, which may go on from batch to batch; the members of a run of more than most as they are, with k."""
        held, size, big = [], 0, None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            k, lo = cols[0], cols[-1]
            hi = cols[1] if wide else np.zeros(len(k), np.int64)
            if not len(k):
                continue
            if big is not None:  # the run that is too large goes on
                cut = int(np.searchsorted(k >> 2, big, side="right"))
                if cut:
                    yield rows_of(hi[:cut], lo[:cut], None, None, k[:cut])
                k, hi, lo = k[cut:], hi[cut:], lo[cut:]
                if not len(k):
                    continue
                big = None
            cut = int(np.searchsorted(k >> 2, k[-1] >> 2))
            if cut:
                yield flush(*(np.concatenate(c) for c in zip(*held, (k[:cut], hi[:cut], lo[:cut]))))
                held, size = [], 0
            held.append((k[cut:], hi[cut:], lo[cut:]))
            size += len(k) - cut
            if size > most:
                big = int(k[-1] >> 2)
                for c in held:
                    yield rows_of(c[1], c[2], None, None, c[0])
                held, size = [], 0
        if held:
            yield flush(*(np.concatenate(c) for c in zip(*held)))
        common.give_back()

    def joined(rows: DataFrame, most: int) -> DataFrame:
        rows = rows.repartition(F.shiftright("k", 2)).sortWithinPartitions("k").select("k", *(["hi", "lo"] if wide else ["lo"]))
        return rows.mapInArrow(lambda x: compare(x, most), ", ".join(f"{c} long" for c in fields))

    rows = distinct.select("hi", "lo").mapInArrow(index, "k long, hi long, lo long" if wide else "k long, lo long")
    found = stage(joined(rows, BIG), "links")
    large = found.filter("k IS NOT NULL").select("k", F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).withColumn("key", F.shiftright("k", 2))
    out = found.filter("k IS NULL")
    if not large.isEmpty():
        large = large.withColumn("n", F.count("*").over(Window.partitionBy("key")))
        groups = blocked(large.select("key", "n", F.struct("k", "hi", "lo").alias("member")), ["key"], "member", F.col("n"), BIG // 4)
        again = groups.select(F.shiftleft("g", 2).bitwiseOR(F.col("node.k").bitwiseAND(F.lit(3))).alias("k"), "node.hi", "node.lo")
        out = out.unionByName(joined(again, 1 << 62))
    return out.drop("k").distinct()


def group(prints: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """With bands, their members are joined as well. Rows of fingerprints() -> the same with component (a number of its own) and component_id, the least key reachable over links."""
    prints = stage(prints, "prints")
    node = F.xxhash64("hi", "lo") if scheme.bits == 128 else F.col("lo")
    distinct = stage(prints.groupBy("hi", "lo").agg(F.min("key").alias("least")), "distinct")
    edges = link(distinct, scheme)
    ends = [F.xxhash64(f"{x}_hi", f"{x}_lo").alias(x) if scheme.bits == 128 else F.col(f"{x}_lo").alias(x) for x in "ab"]
    edges = edges.select(*ends)
    if scheme.bands[0]:
        met = prints.select(node.alias("a"), F.explode("bands").alias("k")).distinct()
        least = met.groupBy("k").agg(F.min("a").alias("b"), F.max("a").alias("last")).filter("b < last").select("k", "b")
        edges = edges.unionByName(met.join(least, "k").filter("a <> b").select("a", "b").distinct())
    labels = components(edges, "simhash")
    nodes = distinct.withColumn("node", node).join(labels, "node", "left")
    least = nodes.filter("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "component", "left").select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "node").alias("component"))
    return prints.join(nodes, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l"))).drop("h", "l")


def sketches(docs: DataFrame, scheme: Scheme, text: str, key: str) -> DataFrame:
    """fingerprints() with node (a hash of the set of shingles) and bands."""
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common.drop()
        for b in batches:
            raw, nodes, bands, sizes = [], [], [], []
            for t in b.column(2).to_pylist():
                found = shingles(t, scheme)
                x = as_set(found)
                raw.append(print_of(found, scheme))
                nodes.append(xxhash.xxh64_intdigest(x.tobytes()))
                sizes.append(len(x))
                bands.append(band_keys(x, scheme))
            raw = np.frombuffer(b"".join(raw), ">i8").reshape(b.num_rows, 2).astype(np.int64)
            columns = [b.column(0), b.column(1), pa.array(raw[:, 0]), pa.array(raw[:, 1]), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "body", "hi", "lo", "set", "bands", "n"])
        common.give_back()

    d = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("body"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(run, f"key {d.schema['key'].dataType.simpleString()}, body long, hi long, lo long, set long, bands array<long>, n long")


def verified(found: DataFrame, docs: DataFrame, scheme: Scheme, text: str, key: str) -> DataFrame:
    """Edges (a, b) of sets that share a component and have the scheme's Jaccard similarity: they join the same sets as all such pairs do."""
    many = found.groupBy("component").agg(F.min("set").alias("m"), F.max("set").alias("last")).filter("m < last").select("component")
    asked = found.join(many, "component").groupBy("set", "component").agg(F.min(F.struct("key", "body")).alias("m"), F.max("n").alias("n"))
    asked = stage(asked.select("component", "set", F.col("m.key").alias("k"), F.col("m.body").alias("b"), "n"), "asked")
    groups = blocked(asked.withColumn("words", F.sum("n").over(Window.partitionBy("component"))), ["component"], "set", F.col("words"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [as_set(shingles(t, scheme)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("body"), F.col(f"`{text}`").alias("text"))
    # one document of each set, so that copies do not travel
    once = asked.groupBy("set").agg(F.first("k").alias("k"), F.first("b").alias("b"))
    rows = texts.join(once, texts["key"].eqNullSafe(once["k"]) & (texts["body"] == once["b"])).select("set", "text").mapInArrow(sets, "node long, shingles binary")
    return forests(groups.join(rows, "node"), scheme.jaccard)


def keep_one(docs: DataFrame, scheme: Scheme = SIMILAR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each component of verified links: that of the least key, and of rows with that key the one whose text's hash is least."""
    found = stage(group(sketches(docs, scheme, text, key), scheme).select("key", "body", "set", "n", "component"), "found")
    labels = components(verified(found, docs, scheme, text, key), "similar").select("node", F.col("component").alias("label"))
    found = found.join(labels, found["set"] == labels["node"], "left").withColumn("component", F.coalesce("label", "set"))
    chosen = found.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("n"), "key", "body")).alias("m")).select("m.key", "m.body")
    body, rank = common.fresh(docs, "__body"), common.fresh(docs, "__rank")
    rows = docs.withColumn(body, F.xxhash64(F.col(f"`{text}`")))
    rows = rows.join(chosen, rows[f"`{key}`"].eqNullSafe(chosen["key"]) & (rows[body] == chosen["body"]), "left_semi")
    w = Window.partitionBy(F.col(f"`{key}`"), body).orderBy(F.lit(0))
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).select(*(f"`{c}`" for c in docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: 3-word shingles, links at 2 or fewer differing bits."""
    found = group(fingerprints(common.plain(common.read(spark, sf_dir, "documents"), "doc_id", "text")))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("lo"), 16, "0")).alias("fingerprint"), "component_id")
