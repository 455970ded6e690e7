"""Language-model scores from an Elias-Fano n-gram trie (operator 4).

The model is a bigram model with Dirichlet smoothing: p(w | v) = (c(v w) + PRIOR p(w)) / (c(v) + PRIOR), where p(w) is the
base model of the contract. For each pair seen the trie stores log10 of the whole of it as a 16-bit code; a pair not seen has
what is left without the first count, from the counts of v and w.

The vocabulary is cut into shards by word, the trie by context; a context with more than HOT tokens is cut further, by word.
Nothing holds the whole model or vocabulary:
1. Documents become batches of numbered tokens, staged.
2. Each batch asks for the counts of its words. One task sums those of a shard, numbers its words, writes the shard's
   vocabulary (hashes as an Elias-Fano sequence, counts) to the model's folder, and sends counts and numbers back.
3. Each batch sends its distinct pairs with their training counts to the pairs' shards. A shard builds its part of
   the trie from them, writes it to the model's folder, maps it, looks up all pairs asked for, and sends back the codes.
4. Each batch adds up its documents' scores.
A batch's tokens stay where they were staged: answers are written by batch, and read by the task that has it. What moves is one
entry for each distinct word, and pair, of a batch, so that words and pairs that are everywhere are combined first; a batch
sends a row to those shards only that it has something for. The model's folder scores other texts later (score_texts).

Words are told apart by 64 bits of their hash, pairs by the numbers of their words.

Nulls: a null text is empty and has the end alone; a null id hashes like the empty text. Repeated rows are counted and scored each. With nothing to learn from, all words
are unknown. An empty table gives no rows. Ids are cast to long. A very long text is a batch of its own. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections import OrderedDict
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.llm import common
from viewtide.llm.eliasfano import EliasFano, NgramTrie
from viewtide.llm.langid import held_out
from viewtide.sources.staging import new_dir, stage

PRIOR = 200.0
BATCH_TOKENS, SHARD_TOKENS = 2_000_000, 2_000_000
#: Tokens of one context that a shard takes.
HOT = 1_000_000
#: Hashes that stand for the end and for the start of a text.
END, START = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)

BATCHES = "batch long, docs binary, held binary, lengths binary, hashes binary, low binary, high binary, n_tokens long"


def _table(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def batches(docs: DataFrame, text: str = "text", key: str = "doc_id", batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Documents as batches of numbered tokens, staged; numbers are those of the batch's own list of word hashes."""
    common.ready(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        common.drop()

        number, held, ids, lengths, parts, words = TaskContext.get().partitionId() << 24, [], [], [], [], {}

        def out(number):
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            return _table(BATCHES, batch=[number], docs=[pickle.dumps(ids)], held=[np.array(held, np.uint8).tobytes()], lengths=[np.array(lengths, np.int32).tobytes()], hashes=[hashes.tobytes()], low=[(tokens & 0xFFFF).astype(np.uint16).tobytes()], high=[(tokens >> 16).astype(np.uint16).tobytes()], n_tokens=[len(tokens) + len(ids)])

        size = 0
        for b in rows:
            for k, t, h in zip(*(c.to_pylist() for c in b.columns)):
                w = common.lower_words(t)
                ids.append(k)
                held.append(h)
                lengths.append(len(w))
                put = words.setdefault
                parts.append(np.array([put(x, len(words)) for x in w], np.uint32))
                size += len(w) + 1
                if size >= batch_tokens:
                    yield out(number)
                    number, size, held, ids, lengths, parts, words = number + 1, 0, [], [], [], [], {}
        if ids:
            yield out(number)

    d = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), held_out(key, 5, 1).alias("held"))
    return stage(d.mapInArrow(run, BATCHES), "lm-batches", "zstd")


class Batch:
    """A staged batch: v and w number the context and the word of each token, ends included, over hashes with END and START at the end."""

    def __init__(self, row: dict):
        self.number, self.ids = row["batch"], pickle.loads(row["docs"])  # noqa: S301 - written by batches
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        self.hashes = np.concatenate([np.frombuffer(row["hashes"], np.uint64), [END, START]])
        n = len(self.hashes)
        tokens = np.frombuffer(row["low"], np.uint16).astype(np.int64) | np.frombuffer(row["high"], np.uint16).astype(np.int64) << 16
        ends = np.cumsum(lengths + 1) - 1
        self.edges = np.concatenate(([0], ends + 1))
        self.w = np.full(len(tokens) + len(lengths), n - 2, np.int64)
        inner = np.ones(len(self.w), bool)
        inner[ends] = False
        self.w[inner] = tokens
        self.v = np.concatenate(([n - 1], self.w[:-1]))
        self.v[self.edges[:-1]] = n - 1
        self.train = np.repeat(~self.held, lengths + 1)

    def counts(self) -> np.ndarray:
        """Training counts of the words and the end; the start has those of the end."""
        out = np.bincount(self.w[self.train], minlength=len(self.hashes))
        out[-1] = out[-2]
        return out

    def deal(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Words, the start left out, in the order of their shards and hashes, and where each shard's begin."""
        shard = (self.hashes[:-1] % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.hashes[:-1], shard))
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def known(self, answers: dict[int, dict], shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts and numbers of all words, from the answers of the shards; the start has number 0 and the counts of the end."""
        order, _ = self.deal(shards)
        counts, ids = np.zeros(len(self.hashes), np.int64), np.zeros(len(self.hashes), np.int64)
        if answers:
            counts[order] = np.concatenate([np.frombuffer(answers[s]["answer"], np.int64) for s in sorted(answers)])
            ids[order] = np.concatenate([word_ids(np.cumsum(np.frombuffer(answers[s]["ranks"], np.int64)), s, shards) for s in sorted(answers)])
        counts[-1] = counts[-2]
        return counts, ids

    def pairs(self, known: np.ndarray, ids: np.ndarray, shards: int):
        """Distinct pairs' context and word, the pair of each token, which pairs are asked for, in what order, and where each shard's begin."""
        n = len(self.hashes)
        distinct, number = np.unique(self.v * n + self.w, return_inverse=True)
        v, w = distinct // n, distinct % n
        ask = np.flatnonzero((known[v] > 0) & (known[w] > 0))
        shard = pair_shard(self.hashes[v[ask]], self.hashes[w[ask]], known[v[ask]], shards)
        order = np.lexsort((ids[w[ask]], ids[v[ask]], shard))
        return v, w, number, ask[order], np.searchsorted(shard[order], np.arange(shards + 1))


def word_ids(ranks: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Numbers of words from their ranks within a shard of the vocabulary; 0 is the start's."""
    return ranks * shards + shard + 1


def pair_shard(hv: np.ndarray, hw: np.ndarray, known: np.ndarray, shards: int) -> np.ndarray:
    """Shards of pairs: by the context's hash, and by the word's too where the context has more than HOT tokens."""
    pieces = np.clip(-(-known // HOT), 1, shards).astype(np.uint64)
    return ((hv % np.uint64(shards) + (hw >> np.uint64(7)) % pieces) % np.uint64(shards)).astype(np.int64)


def _some(cuts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Shards that something lies in, and where."""
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, slice(cuts[s], cuts[s + 1])


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one in memory at a time."""
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]


def put(folder: str, name: str, data: bytes) -> str:
    """A file of the shared folder, whole or not there: a repeated task writes the same bytes again. The path in its store."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    path, own = f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    try:
        store.move(own, path)
    except OSError:  # stores whose rename does not replace
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(own)
    return path


def get(folder: str, name: str) -> np.ndarray:
    """The bytes of a file of the shared folder: mapped where the store is a mounted one."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    return np.frombuffer(source.read_buffer(), np.uint8)


COUNT_ASK = "shard int, batch long, hashes binary, counts binary"
COUNT_ANSWER = "batch long, shard int, answer binary, ranks binary, n long, v long"


def ask_counts(held: DataFrame, shards: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for row in _rows(b):
                x = Batch(row)
                counts = x.counts()
                order, cuts = x.deal(shards)
                for s, part in _some(cuts):
                    yield _table(COUNT_ASK, shard=[s], batch=[x.number], hashes=[x.hashes[order[part]].tobytes()], counts=[counts[order[part]].astype(np.uint32).tobytes()])

    return held.mapInArrow(run, COUNT_ASK)


def _split(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(sizes)[:-1])


def _joined(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in a column of bytes, end to end, and their sizes."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts), np.array([len(x) for x in parts])


def answer_counts(asked: DataFrame, folder: str) -> DataFrame:
    """Sums of the counts of each word, and steps between the words' ranks among the known ones, for each batch that asked; the shard's tokens and distinct words
    stand in its first row. The shard's vocabulary goes to the folder."""
    def run(t: pa.Table) -> pa.Table:
        hashes, sizes = _joined(t["hashes"], np.uint64)
        counts, _ = _joined(t["counts"], np.uint32)
        distinct, number = np.unique(hashes, return_inverse=True)
        total = np.bincount(number, weights=counts, minlength=len(distinct)).astype(np.int64)
        shard, known = t["shard"][0].as_py(), total > 0
        put(folder, f"words-{shard:08d}", b"".join([*EliasFano.encode(distinct[known]).dump(), total[known].tobytes()]))
        rank = np.maximum(np.cumsum(known) - 1, 0)
        first = np.arange(t.num_rows) == 0
        return pa.Table.from_batches([_table(
            COUNT_ANSWER, batch=t["batch"].to_pylist(), shard=t["shard"].to_pylist(), answer=[x.tobytes() for x in _split(total[number], sizes)],
            ranks=[np.diff(x, prepend=0).tobytes() for x in _split(rank[number], sizes)], n=np.where(first, total.sum(), 0), v=np.where(first, known.sum(), 0),
        )])

    return asked.groupBy("shard").applyInArrow(run, COUNT_ANSWER)


def _by_batch(answers: DataFrame, name: str) -> str:
    """Answers as files by batch, one for each batch."""
    path = new_dir(answers.sparkSession, name)
    answers.repartition("batch").write.option("compression", "zstd").partitionBy("batch").parquet(path)
    return path


def _answers(path: str, batch: int, *columns: str) -> dict[int, dict]:
    from pyarrow import fs, parquet

    store, base = fs.FileSystem.from_uri(path)
    files = store.get_file_info(fs.FileSelector(f"{base}/batch={batch}", allow_not_found=True))
    out: dict[int, dict] = {}
    for f in files:
        if f.path.endswith(".parquet"):
            t = parquet.ParquetFile(store.open_input_file(f.path)).read(columns=["shard", *columns])
            out.update((row["shard"], row) for row in t.to_pylist())
    return out


PAIR_ASK = "shard int, batch long, contexts binary, totals binary, sizes binary, words binary, known binary, places binary, counts binary"
PAIR_ANSWER = "batch long, shard int, answer binary"


def _kind(top: int) -> type:
    """The type of numbers up to top."""
    return np.uint32 if top < 1 << 32 else np.uint64


def _place_kind(words: int) -> type:
    """The type of places in a row's list of words."""
    return np.uint16 if words <= 1 << 16 else np.uint32


def ask_pairs(held: DataFrame, counts: str, shards: int, id_kind: type, count_kind: type) -> DataFrame:
    """Distinct pairs of each batch by shard: contexts and words as steps between their numbers, corpus counts of both, and for each pair its word's place and its training count."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for row in _rows(b):
                x = Batch(row)
                known, ids = x.known(_answers(counts, x.number, "answer", "ranks"), shards)
                v, w, number, order, cuts = x.pairs(known, ids, shards)
                seen = np.bincount(number[x.train], minlength=len(v))
                for s, part in _some(cuts):
                    some = order[part]
                    context, first = np.unique(ids[v[some]], return_index=True)
                    word, at, place = np.unique(ids[w[some]], return_index=True, return_inverse=True)
                    steps = lambda y: np.diff(y, prepend=0).astype(id_kind).tobytes()
                    yield _table(
                        PAIR_ASK, shard=[s], batch=[x.number], contexts=[steps(context)], totals=[known[v[some]][first].astype(count_kind).tobytes()],
                        sizes=[np.diff(np.append(first, len(some))).astype(np.uint32).tobytes()], words=[steps(word)], known=[known[w[some]][at].astype(count_kind).tobytes()],
                        places=[place.astype(_place_kind(len(word))).tobytes()], counts=[seen[some].astype(np.uint32).tobytes()],
                    )

    return held.mapInArrow(run, PAIR_ASK)


class Shard:
    """A shard of the trie: the contexts' numbers as an Elias-Fano sequence, and their successors."""

    def __init__(self, contexts: EliasFano, trie: NgramTrie):
        self.contexts, self.trie = contexts, trie

    def dump(self) -> bytes:
        return b"".join([*self.contexts.dump(), self.trie.dump()])

    @classmethod
    def load(cls, data: np.ndarray) -> "Shard":
        contexts, at = EliasFano.load(data, 0)
        return cls(contexts, NgramTrie.load(data[at:]))

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs of numbers; NONE where there is none."""
        out = np.full(len(context), NgramTrie.NONE, np.uint16)
        if self.contexts.n:
            at = self.contexts.successor(context)
            found = at < self.contexts.n
            found[found] = self.contexts.get(at[found]) == context[found].astype(np.uint64)
            out[found] = self.trie.lookup(at[found], word[found])
        return out


def answer_pairs(asked: DataFrame, folder: str, n: int, v: int, id_kind: type, count_kind: type, prior: float = PRIOR) -> DataFrame:
    """Builds each shard's trie from the pairs sent, and answers with the code of each."""
    def run(t: pa.Table) -> pa.Table:
        def numbers(column, kind):
            """Numbers from steps, their batches' parts end to end, and the parts' sizes."""
            parts = [np.cumsum(np.frombuffer(x, kind).astype(np.int64)) for x in column.to_pylist()]
            return np.concatenate(parts), np.array([len(x) for x in parts])

        contexts, _ = numbers(t["contexts"], id_kind)
        totals, _ = _joined(t["totals"], count_kind)
        repeats, _ = _joined(t["sizes"], np.uint32)
        words, listed = numbers(t["words"], id_kind)
        known, _ = _joined(t["known"], count_kind)
        counts, sizes = _joined(t["counts"], np.uint32)
        context, first, number = np.unique(contexts, return_index=True, return_inverse=True)
        totals = totals[first].astype(np.int64)
        word, first, local = np.unique(words, return_index=True, return_inverse=True)
        base = (known[first] + 0.5) / (n + 0.5 * (v + 1))
        starts = np.cumsum(listed) - listed
        w = np.concatenate([local[at + np.frombuffer(x, _place_kind(k)).astype(np.int64)] for x, k, at in zip(t["places"].to_pylist(), listed.tolist(), starts.tolist())])
        key = np.repeat(number, repeats) * len(word) + w
        del words, known, w
        distinct, place = np.unique(key, return_inverse=True)
        seen = np.bincount(place, weights=counts, minlength=len(distinct))
        c, w = distinct // len(word), distinct % len(word)
        some = seen > 0
        log10 = np.log10((seen[some] + prior * base[w[some]]) / (totals[c[some]] + prior))
        name = f"pairs-{t['shard'][0].as_py():08d}"
        put(folder, name, Shard(EliasFano.encode(context), NgramTrie.build(len(context), c[some], word[w[some]], log10)).dump())
        shard = Shard.load(get(folder, name))
        codes = np.concatenate([shard.lookup(context[c[i : i + 500_000]], word[w[i : i + 500_000]]) for i in range(0, len(c), 500_000)])
        return pa.Table.from_batches([_table(PAIR_ANSWER, batch=t["batch"].to_pylist(), shard=t["shard"].to_pylist(), answer=[x.tobytes() for x in _split(codes[place], sizes)])])

    return asked.groupBy("shard").applyInArrow(run, PAIR_ANSWER)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sums(x: Batch, model: dict, known: np.ndarray, code: np.ndarray, c: np.ndarray, w: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """The scores of a batch's documents from the counts of its words and the codes of its pairs."""
    n, prior = model["n"], model["prior"]
    base = (known + 0.5) / (n + 0.5 * (model["v"] + 1))
    p = np.where(code == NgramTrie.NONE, prior / (known[c] + prior) * base[w], 10.0 ** (code / -float(NgramTrie.STEPS)))
    sums = lambda y: np.add.reduceat(y, x.edges[:-1])  # noqa: E731 - every document has a token, its end
    return _table(SCORES, doc_id=x.ids, held_out=x.held, n_tokens=np.diff(x.edges), n_known=sums((known > 0)[x.w].astype(np.int64)), train_tokens=np.full(len(x.ids), n), base_score=sums(np.log10(base)[x.w]), score=sums(np.log10(p)[number]))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", prior: float = PRIOR, folder: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. The model stays in folder, a URI of a new folder of the shared store; without
    one it goes when the driver's Python ends."""
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "lm-model")
    held = batches(docs, text, key)
    tokens = held.agg(F.sum("n_tokens")).collect()[0][0] or 0
    shards = max(6, -(-tokens // SHARD_TOKENS))
    counts = _by_batch(answer_counts(ask_counts(held, shards), folder), "lm-counts")
    total = spark.read.schema("n long, v long").parquet(counts).agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max("v").alias("most")).collect()[0]
    model = {"n": total["n"] or 0, "v": total["v"] or 0, "shards": shards, "prior": prior}
    put(folder, "model.json", json.dumps(model).encode())
    kinds = _kind(((total["most"] or 0) + 1) * shards), _kind(model["n"])
    codes = _by_batch(answer_pairs(ask_pairs(held, counts, shards, *kinds), folder, model["n"], model["v"], *kinds, prior), "lm-codes")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for row in _rows(b):
                x = Batch(row)
                known, ids = x.known(_answers(counts, x.number, "answer", "ranks"), shards)
                c, w, number, order, _ = x.pairs(known, ids, shards)
                answers = _answers(codes, x.number, "answer")
                code = np.full(len(c), NgramTrie.NONE, np.uint16)
                if answers:
                    code[order] = np.concatenate([np.frombuffer(answers[s]["answer"], np.uint16) for s in sorted(answers)])
                yield _sums(x, model, known, code, c, w, number)

    return held.mapInArrow(run, SCORES)


#: Mapped files that a task of score_texts keeps open.
OPEN_FILES = 64


def score_texts(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of score for texts that need not be those of the model in folder, from its files alone; held_out is what it is there. A task reads those shards of the
    vocabulary and the trie that its batches' words and pairs lie in. The model's own corpus is scored with less reading by score."""
    model = json.loads(get(folder, "model.json").tobytes())
    shards = model["shards"]
    held = batches(docs, text, key)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: OrderedDict = OrderedDict()

        def opened(kind: str, s: int):
            """A shard of the vocabulary as hashes and counts, or one of the trie; None where the model has none."""
            name = f"{kind}-{s:08d}"
            if name not in files:
                try:
                    data = get(folder, name)
                except FileNotFoundError:
                    data = None
                if data is not None and kind == "words":
                    hashes, at = EliasFano.load(data, 0)
                    data = hashes, data[at:].view(np.int64)
                elif data is not None:
                    data = Shard.load(data)
                files[name] = data
                if len(files) > OPEN_FILES:
                    files.popitem(last=False)
            files.move_to_end(name)
            return files[name]

        for b in rows:
            for row in _rows(b):
                x = Batch(row)
                known, ids = np.zeros(len(x.hashes), np.int64), np.zeros(len(x.hashes), np.int64)
                order, cuts = x.deal(shards)
                for s, part in _some(cuts):
                    if (found := opened("words", s)) is None or not found[0].n:
                        continue
                    hashes, counts = found
                    some = order[part]
                    at = hashes.successor(x.hashes[some])
                    inside = at < hashes.n
                    inside[inside] = hashes.get(at[inside]) == x.hashes[some][inside]
                    known[some[inside]], ids[some[inside]] = counts[at[inside]], word_ids(at[inside], s, shards)
                known[-1] = known[-2]
                c, w, number, order, cuts = x.pairs(known, ids, shards)
                code = np.full(len(c), NgramTrie.NONE, np.uint16)
                for s, part in _some(cuts):
                    if shard := opened("pairs", s):
                        code[order[part]] = shard.lookup(ids[c[order[part]]], ids[w[order[part]]])
                yield _sums(x, model, known, code, c, w, number)

    return held.mapInArrow(run, SCORES)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest for every document."""
    return score(common.plain(common.read(spark, sf_dir, "documents"), "doc_id", "text"))
