"""Benchmark decontamination with a positional inverted index (operator 10).

The training documents are indexed in segments of about a million words: a segment has its terms
in order and, for each, the ascending positions at which it stands. Positions run on from
document to document with a gap between, so that no phrase crosses a border. Segments are rows of a
staged table, spread over the cluster, and can be searched again for other test sets.

A test item's windows are phrases. In each segment a phrase all of whose terms occur is matched by
intersecting the terms' position lists, each moved by the term's place in the phrase, from the rarest term on. With
slop, a term may stand that many positions off its place (proximity matches). Test items become blocks of about BLOCK_WORDS words, files in the
shared folder that each task reads one after the other, so that driver and workers hold one block at a time; segments are searched in place, without a shuffle.

Nulls: a null text, of a document or an item, has no words; an item without words has no
window. Items with the same id count once in a document's list. Null ids are values like any other;
a null item id is left out of the list of ids. Document ids are cast to long. Repeated documents get equal rows. An empty table of items contaminates nothing, an
empty table of documents gives no rows. A very long text is a segment of its own, and an item longer than a block a block of its own. Other columns, whatever
their names, stay as they are (clean) or are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.llm import common
from viewtide.sources.staging import new_dir, stage

WINDOW = 10
SEGMENT_WORDS = 1_000_000
#: Words of test items in one block: some 100 bytes each while it is built, 50 when it is searched.
BLOCK_WORDS = 200_000
#: Bytes: A-Z in lower case; ASCII that is no letter or digit is a space. Words are then what split() finds.
_KEEP = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

INDEX = "doc_ids binary, lengths binary, terms binary, offsets binary, positions binary"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def _delta(lists_start: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Differences inside each list; the first position stays."""
    out = np.diff(positions, prepend=positions[:1] * 0)
    out[lists_start] = positions[lists_start]
    return out


def _undelta(starts: np.ndarray, deltas: np.ndarray) -> np.ndarray:
    """The positions again: sums that begin anew at each list."""
    total = np.cumsum(deltas, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(deltas)))
    return total - np.repeat(np.concatenate(([0], total))[starts], sizes)


def segment(doc_ids: list, texts: list[list[bytes]], gap: int) -> dict:
    """An index segment of some documents' words."""
    lengths = np.array([len(x) for x in texts], np.int64)
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for x in texts for w in x), np.int64, int(lengths.sum()))
    terms = sorted(ids)
    rank = np.empty(len(ids), np.int64)
    rank[[ids[t] for t in terms]] = np.arange(len(ids))
    codes = rank[codes] if len(codes) else codes
    where = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)) * gap, lengths)
    order = np.argsort(codes, kind="stable")
    offsets = np.searchsorted(codes[order], np.arange(len(terms) + 1))
    deltas = _delta(offsets[:-1], where[order]) if len(order) else where
    return {"doc_ids": pickle.dumps(doc_ids), "lengths": lengths.astype("<i4").tobytes(), "terms": b" ".join(terms), "offsets": offsets.astype("<i4").tobytes(), "positions": deltas.astype("<i4").tobytes()}


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", gap: int = WINDOW, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of all documents' words, staged: one row per segment."""
    common.ready(docs.sparkSession)
    schema = pa.schema([(c, pa.binary()) for c in ("doc_ids", "lengths", "terms", "offsets", "positions")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop()
        ids, texts, n = [], [], 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                ids.append(k)
                texts.append(w)
                n += len(w) + 1
                if n >= segment_words:
                    yield pa.RecordBatch.from_pylist([segment(ids, texts, gap)], schema=schema)
                    ids, texts, n = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([segment(ids, texts, gap)], schema=schema)
        del ids, texts
        common.give_back()

    return stage(docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, INDEX), "index")


class Phrases:
    """A block of test items as phrases over a vocabulary of their own."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            w = [vocabulary.setdefault(x, len(vocabulary)) for x in words(text)]
            for s in range(max(1, len(w) - window + 1) if w else 0):
                owners[tuple(w[s : s + window])].add(item)
        self.terms = list(vocabulary)
        self.lengths = np.fromiter(map(len, owners), np.int32, len(owners))
        self.owners = [tuple(sorted(x, key=repr)) for x in owners.values()]
        width = int(self.lengths.max(initial=0))
        # shorter phrases repeat their last term, which leaves the test of presence as it is
        self.table = np.fromiter((t for p in owners for t in p + (p[-1],) * (width - len(p))), np.int32, len(owners) * width).reshape(len(owners), width)

    def phrase(self, i: int) -> np.ndarray:
        return self.table[i, : self.lengths[i]]


class Segment:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict, gap: int):
        self.doc_ids = pickle.loads(row["doc_ids"])  # noqa: S301 - written by build_index
        self.lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        self.starts = np.cumsum(self.lengths + gap) - self.lengths - gap
        terms = row["terms"].split(b" ") if row["terms"] else []
        self.places = {t: i for i, t in enumerate(terms)}
        self.offsets = np.frombuffer(row["offsets"], "<i4").astype(np.int64)
        self.deltas = np.frombuffer(row["positions"], "<i4")
        self.positions = _undelta(self.offsets[:-1], self.deltas) if terms else np.zeros(0, np.int64)
        self.size = int((self.lengths + gap).sum())

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.offsets[term] : self.offsets[term + 1]]

    def search(self, block: Phrases, slop: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the phrase, start positions) of each phrase that occurs."""
        if not len(block.table):
            return
        here = np.array([self.places.get(t, -1) for t in block.terms], np.int64)
        rows = here[block.table]
        for p in np.flatnonzero((rows >= 0).all(axis=1)).tolist():
            terms = here[block.phrase(p)]
            sizes = self.offsets[terms + 1] - self.offsets[terms]
            order = np.argsort(sizes, kind="stable")
            at = self.list_of(terms[order[0]]) - order[0]
            for i in order[1:]:
                other = self.list_of(terms[i]) - i
                j = np.searchsorted(other, at - slop)
                near = np.take(other, j, mode="clip")
                at = at[(j < len(other)) & (near <= at + slop)]
                if not len(at):
                    break
            if len(at):
                yield p, at

    def report(self, blocks: Iterator[Phrases], slop: int = 0) -> list[tuple]:
        """(doc_id, n_words, n_hit, item ids) of each document."""
        marks = np.zeros(self.size + 1 + WINDOW, np.int64)
        items: dict[int, set] = defaultdict(set)
        for block in blocks:
            for p, at in self.search(block, slop):
                np.add.at(marks, np.maximum(at, 0), 1)
                np.add.at(marks, np.minimum(at + block.lengths[p], self.size), -1)
                for d in np.unique(np.searchsorted(self.starts, at, side="right") - 1).tolist():
                    items[d].update(block.owners[p])
        hit = np.concatenate(([0], np.cumsum(np.cumsum(marks) > 0)))
        counts = hit[self.starts + self.lengths] - hit[self.starts]
        return [(k, int(n), int(h), items.get(i, set())) for i, (k, n, h) in enumerate(zip(self.doc_ids, self.lengths, counts))]


def blocks_of(items: DataFrame, key: str, text: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """The test items as files of the shared folder, a block each."""
    from pyarrow import fs

    folder, out, held, size = new_dir(items.sparkSession, "items"), [], [], 0
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)

    def put():
        with store.open_output_stream(f"{base}/{len(out)}") as f:
            f.write(pickle.dumps(Phrases(held, window), pickle.HIGHEST_PROTOCOL))
        out.append(f"{folder}/{len(out)}")

    for r in common.plain(items, key, text).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(words(r[1])) + 1
        if size >= block_words:
            put()
            held, size = [], 0
    if held:
        put()
    return out


def load(path: str) -> Phrases:
    """A block; a worker keeps the last one that it read."""
    def read() -> Phrases:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        with store.open_input_file(base) as f:
            return pickle.loads(f.read())  # noqa: S301 - written by blocks_of

    return common.kept(("items", path), read)


def search(index: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text", window: int = WINDOW, gap: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, item_ids of every indexed document."""
    if window > gap:
        raise ValueError("the gap between documents must be as long as the window")
    blocks = blocks_of(items, item_key, text, window, block_words)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("item_ids", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                out = []
                for doc, n, hit, found in Segment(row, gap).report(map(load, blocks), slop):
                    ids = sorted(str(x) for x in found if x is not None)
                    out.append({"doc_id": doc, "n_words": n, "n_hit": hit, "n_items": len(found), "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(), "item_ids": ids})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        common.give_back()

    return index.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, item_ids array<string>")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the contaminated ones. Rows are matched by the hash of the text, as contamination depends on that alone."""
    body = common.fresh(docs, "__body")
    rows = docs.withColumn(body, F.xxhash64(F.col(f"`{text}`")))
    found = search(build_index(rows.select(F.col(f"`{text}`").alias("text"), F.col(body).alias("key")), "text", "key"), items.select(F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")))
    bad = found.filter("n_hit > 0").select(F.col("doc_id").alias(body)).distinct()
    return rows.join(bad, body, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest for every document."""
    docs = common.plain(common.read(spark, sf_dir, "documents"), "doc_id", "text")
    found = search(build_index(docs), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


#: The same digest: windows of documents joined with the distinct windows of items of the same length. It holds in plain DuckDB SQL for the tables whole.
SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM items)),
places AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT DISTINCT k FROM items) WHERE len(w) >= k),
hits AS (SELECT r, i, k, item_id FROM (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM places) JOIN phrases USING (k, phrase)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
