"""Token ids as Arrow files (operator 6).

Documents are range-sorted by id; each range's token stream is cut into sequences of equal length and
written as an Arrow file (the stream format with a footer) of fixed-size-list batches: the ids, 16 bits wide where the
vocabulary fits, and a mask that is false on the padding after the last id of a file. A second Arrow file
beside it has each document's id, start and length. An uncompressed fixed-size list is one flat
buffer, so a memory-mapped file gives any sequence without a copy.

A task writes under a name of its own and reports it; the manifest lists the files of the tasks
that succeeded, so that a retried or speculative task leaves no trace in the result. Files go through
pyarrow's filesystems, by the URI of the shared folder.

Encoding goes piece by piece: a text is cut before the spaces after other characters than white space, where the
byte-level splitter always cuts, and words of plain letters, signs, digits and line ends into the splitter's own pieces. Each distinct
piece is encoded once for a slice of texts, and kept for later ones, in flat arrays. A text longer than a slice is cut at such a space as well.

Nulls: a null text is empty and has the end id alone; null ids come first. Rows with equal ids follow each other in
the order of their texts' hashes; repeated rows are written each. An empty table writes no sequences. Ids are cast to long. A very long text passes through one task as
one row. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.llm import common
from viewtide.sources.staging import new_dir, stage

SEQUENCE, BATCH = 2048, 64
END = 0
#: Distinct pieces that a worker remembers before it forgets rare ones: a bound of memory, without effect on results.
REMEMBER = 200_000
#: Bytes of texts that are cut and encoded at a time, or one word.
CHUNK = 1_000_000

#: Kinds of bytes: the splitter cuts exactly where one of these kinds follows another, but after a space. ODD ones keep a word whole.
ODD, LETTER, SIGN, DIGIT, LINE, SPACE = range(6)
KIND = np.zeros(256, np.uint8)
KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER  # and U+00C0 to U+024F, see odd()
KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = SIGN  # no apostrophe
KIND[[*b"0123456789"]], KIND[10], KIND[32] = DIGIT, LINE, SPACE
WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), *range(28, 33)]] = True
#: The characters that stand for bytes in a byte-level vocabulary, and bytes that UTF-8 never has.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CHARS = np.zeros(256, "<u4")
CHARS[_SHOWN] = _SHOWN
CHARS[[x for x in range(256) if x not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))
NEVER = [0xFF, 0xFE, 0xC0, 0xC1, *range(0xF5, 0xFE)]

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long"


def plain_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins and the last ends."""
    _, ends, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    edges = np.frombuffer(ends, np.int32)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[edges[0] : edges[-1]], edges - edges[0]


def safe_spaces(data: np.ndarray) -> np.ndarray:
    """Where spaces follow other characters than white space. U+2000 to U+207F, U+1680 to U+16BF and U+3000 to U+303F count as white space."""
    at = np.flatnonzero(data == 32)
    at = at[at > 0]
    before = data[at - 1]
    white = WHITE[before]
    if len(high := np.flatnonzero(before >= 0x80)):
        x, y, z = before[high], data[at[high] - 2], data[np.maximum(at[high] - 3, 0)]
        white[high] = ((y == 0xC2) & ((x == 0x85) | (x == 0xA0))) | ((z == 0xE1) & (y == 0x9A)) | ((z == 0xE2) & ((y == 0x80) | (y == 0x81))) | ((z == 0xE3) & (y == 0x80))
    return at[~white]


class Encoder:
    """Encodes texts with a tokenizers file, given as its JSON."""

    @classmethod
    def of(cls, spec: str, remember: int = REMEMBER) -> "Encoder":
        """The worker's encoder for a file; tasks of one worker share what it remembers."""
        return common.kept(("tokens", hash(spec), remember), lambda: cls(spec, remember))

    def __init__(self, spec: str, remember: int = REMEMBER):
        self.most = remember
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        added = self.tokenizer.get_added_tokens_decoder()
        split = self.tokenizer.pre_tokenizer
        #: cutting is right for byte-level splitters without a normalizer, and added tokens that take no spaces; others get whole texts
        self.cuts = type(split).__name__ == "ByteLevel" and split.use_regex and not split.add_prefix_space and self.tokenizer.normalizer is None
        self.cuts = self.cuts and not any(" " in t.content or t.lstrip or t.rstrip or t.single_word for t in added.values())
        #: a special token that cuts a text exactly where it stands: between pieces, it lets many be encoded at once
        apart = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.apart = apart[0] if apart else None
        self.added = [t.content for t in added.values()]
        #: the same model without a splitter, and a token that merges with no other: between the splitter's own pieces it lets many be encoded at once
        self.model, self.between = Tokenizer(self.tokenizer.model), self._between() if self.cuts else None
        self._forget()

    def _between(self) -> tuple[int, int] | None:
        """The id and the character of a byte that UTF-8 never has and that the model merges with no other."""
        model = self.tokenizer.model
        if type(model).__name__ != "BPE" or model.dropout or model.unk_token or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix:
            return None
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        free = set(CHARS[NEVER].tolist()) - {ord(c) for t in vocab if len(t) > 1 for c in t}
        return next(((vocab[chr(c)], c) for c in sorted(free) if chr(c) in vocab), None)

    def _forget(self) -> None:
        self.known = pa.array([], pa.binary())  # pieces; their ids lie in flat
        self.flat = np.zeros(0, np.uint32)
        self.start, self.size, self.seen = (np.zeros(0, np.int64) for _ in range(3))

    def _thin(self) -> None:
        """Forgets the pieces that were met in one slice."""
        known, start, size, flat, keep = self.known, self.start, self.size, self.flat, np.flatnonzero(self.seen > 1)
        self._forget()
        if len(keep) > self.most // 2 or not len(keep):
            return
        start, size = start[keep], size[keep]
        ends = np.cumsum(size)
        self.flat = flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
        self.known, self.start, self.size, self.seen = known.take(pa.array(keep)), ends - size, size, np.zeros(len(keep), np.int64)

    def odd(self, data: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bytes that keep their word whole; starts: of the texts."""
        after = np.append(kind[1:], np.uint8(ODD))
        after[starts[1:] - 1] = ODD
        odd = (kind == ODD) | ((kind == LINE) & (after >= LINE)) | ((kind == SPACE) & ((after == ODD) | (after >= LINE)))
        lead, then = data[:-1], data[1:]
        odd[:-1] |= ((lead == 0xC3) & ((then == 0x97) | (then == 0xB7))) | ((lead == 0xC9) & (then > 0x8F))
        raw = data.tobytes() if self.added else b""
        for token in (x.encode() for x in self.added):
            at = raw.find(token)
            while at >= 0:
                odd[at] = True
                at = raw.find(token, at + 1)
        return odd

    def _encode_odd(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and their numbers: many pieces at once stand between special tokens of one text."""
        apart = self.apart
        alone = [not apart or any(c in p for c in self.added) for p in pieces]
        sizes, found = np.zeros(len(pieces), np.int64), [np.zeros(0, np.uint32)] * len(pieces)
        group: list[int] = []
        held = 0
        for i, p in enumerate([*pieces, None]):
            if group and (p is None or alone[i] or held + len(p) > 4000):
                (e,) = self.tokenizer.encode_batch_fast([apart[1].join(pieces[k] for k in group)], add_special_tokens=False)
                ids = np.asarray(e.ids, np.uint32)
                edges = np.flatnonzero(np.concatenate(([True], ids == apart[0], [True])))
                for k, s, t in zip(group, edges.tolist(), edges[1:].tolist()):
                    found[k] = ids[s : t - 1]
                group, held = [], 0
            if p is not None and alone[i]:
                (e,) = self.tokenizer.encode_batch_fast([p], add_special_tokens=False)
                found[i] = np.asarray(e.ids, np.uint32)
            elif p is not None:
                group.append(i)
                held += len(p)
        sizes[:] = [len(x) for x in found]
        return np.concatenate(found), sizes

    def _encode_own(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of the splitter's own pieces, which go past the splitter."""
        (data, edges), (between, char) = plain_bytes(pieces), self.between
        n = np.diff(edges)
        chars = np.full(len(data) + len(n), char, "<u4")
        chars[np.arange(len(data)) + np.repeat(np.arange(len(n)), n)] = CHARS[data]
        text = chars.tobytes().decode("utf-32-le")
        ends = (edges[1:] + np.arange(1, len(n) + 1))[99::100].tolist()
        groups = [text[s:e] for s, e in zip([0, *ends], [*ends, len(text)])]
        found = [np.asarray(e.ids, np.uint32) for at in range(0, len(groups), 20) for e in self.model.encode_batch_fast(groups[at : at + 20], add_special_tokens=False)]
        ids = np.concatenate(found)
        apart = ids == between
        return ids[~apart], np.diff(np.flatnonzero(apart), prepend=-1) - 1

    def _learn(self, new: pa.Array) -> None:
        """Encodes pieces and keeps their ids under running numbers."""
        data, edges = plain_bytes(new)
        own = ~np.logical_or.reduceat(self.odd(data, KIND[data], edges[:-1]), edges[:-1]) if self.between else np.zeros(len(new), bool)
        sizes, starts, at = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), len(self.flat)
        for some, encode in ((own, self._encode_own), (~own, lambda x: self._encode_odd([p.decode() for p in x.to_pylist()]))):
            if some.any():
                ids, n = encode(new.filter(pa.array(some)))
                sizes[some], starts[some] = n, at + np.cumsum(n) - n
                self.flat, at = np.concatenate([self.flat, ids]), at + len(ids)
        self.known, self.start = pa.concat_arrays([self.known, new]), np.concatenate([self.start, starts])
        self.size, self.seen = np.concatenate([self.size, sizes]), np.concatenate([self.seen, np.zeros(len(new), np.int64)])

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces; the unknown are learned."""
        if len(self.known) > self.most:
            self._thin()
        number = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = number < 0
        if unknown.any():
            number[unknown] = len(self.known) + np.arange(int(unknown.sum()))
            self._learn(pieces.filter(pa.array(unknown)))
        self.seen[number] += 1
        return number

    def _encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end, and where each text's ids begin and the last ends."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        kind, starts = KIND[data], edges[:-1]
        word = np.zeros(len(data), bool)
        word[safe_spaces(data)] = True
        word[starts[starts < len(data)]] = True
        cut = np.zeros(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        words, odd = np.flatnonzero(word), self.odd(data, kind, starts)
        if odd.any():
            cut &= ~np.repeat(np.logical_or.reduceat(odd, words), np.diff(np.append(words, len(data))))
        at = np.flatnonzero(cut | word).astype(np.int32)
        del kind, word, cut, words, odd
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, np.int32(len(data)))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        which, number = coded.indices.to_numpy(), self._numbers(coded.dictionary)
        sizes = self.size[number][which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        places = np.repeat(self.start[number][which] - ends[:-1], sizes)
        places += np.arange(len(places))
        return self.flat[places], ends[np.searchsorted(at, edges)]

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text, without special tokens added."""
        col = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.cuts:
            return [np.asarray(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in col.to_pylist()]
        data, edges = plain_bytes(col)
        if len(col) == 1:
            return [np.concatenate([self._encode(x, np.array([0, len(x)]))[0] for x in stretches(data)])]
        ids, ends = self._encode(data, edges)
        return [ids[s:e] for s, e in zip(ends.tolist(), ends[1:].tolist())]


def stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in stretches of about CHUNK bytes, cut before spaces where the splitter cuts."""
    while len(data) > CHUNK:
        size, found = CHUNK, safe_spaces(data[:CHUNK])
        while not len(found) and size < len(data):
            size *= 2
            found = safe_spaces(data[:size])
        if not len(found):
            break
        yield data[: found[-1]]
        data = data[found[-1] :]
    yield data


class Writer:
    """One Arrow file of sequences and one of the documents' places."""

    def __init__(self, folder: str, part: int, length: int, dtype):
        from pyarrow import fs

        self.store, base = fs.FileSystem.from_uri(folder)
        self.store.create_dir(base, recursive=True)
        self.name = f"part-{part:06d}-{uuid.uuid4().hex}"
        self.length, self.dtype = length, np.dtype(dtype)
        item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("input_ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.store.open_output_stream(f"{base}/{self.name}{x}.arrow") for x in ("", ".docs")]
        self.out = [pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, self.index))]
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = self.n_sequences = 0

    def add(self, doc_ids: list, ids: list[np.ndarray], end: int) -> None:
        """Documents' ids, each followed by the end id."""
        sizes = np.array([len(x) + 1 for x in ids], dtype=np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.out[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.index))
        flat, inner = np.full(int(sizes.sum()), end, self.dtype), np.ones(int(sizes.sum()), bool)
        inner[np.cumsum(sizes) - 1] = False
        flat[inner] = np.concatenate(ids)
        self.held.append(flat)
        self.n_held, self.n_tokens, self.n_docs = self.n_held + int(sizes.sum()), self.n_tokens + int(sizes.sum()), self.n_docs + len(ids)
        if self.n_held >= self.length * BATCH:
            flat = np.concatenate(self.held)
            keep = len(flat) // (self.length * BATCH) * self.length * BATCH
            for at in range(0, keep, self.length * BATCH):
                self._write(flat[at : at + self.length * BATCH], self.length * BATCH)
            self.held, self.n_held = [flat[keep:]], len(flat) - keep

    def _write(self, flat: np.ndarray, n: int) -> None:
        rows = -(-n // self.length)
        mask = np.arange(rows * self.length) < n
        if len(flat) < rows * self.length:
            flat = np.concatenate([flat, np.zeros(rows * self.length - len(flat), self.dtype)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out[0].write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += rows

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held), self.n_held)
        for x in (*self.out, *self.files):
            x.close()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose second column has CHUNK bytes at most, or one row."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if size and size + n > CHUNK:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows:
        yield batch.slice(start)


def write(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", key: str = "doc_id", length: int = SEQUENCE, end: int = END, remember: int = REMEMBER) -> DataFrame:
    """Writes all documents in ascending order of key and returns the manifest: part, path, n_docs, n_tokens, n_sequences."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # of the vocabulary's size
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(F.col(f"`{key}`").cast("long").alias("key"), body.alias("body"), F.xxhash64(body).alias("hash"))
    # the third column only spreads rows that are equal in the others
    order = [F.col("key").asc_nulls_first(), F.col("hash")]
    d = d.withColumn("spread", F.monotonically_increasing_id())
    d = d.repartitionByRange(*order, F.col("spread")).sortWithinPartitions(*order).select("key", "body")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, writer = TaskContext.get().partitionId(), None, None
        for b in batches:
            if encoder is None:
                encoder = Encoder.of(spec.value, remember)
                small = encoder.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
                writer = Writer(folder, part, length, np.uint16 if small else np.uint32)
            for some in slices(b):
                writer.add(some.column(0).to_pylist(), encoder.encode(some.column(1)), end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{writer.name}", "n_docs": writer.n_docs, "n_tokens": writer.n_tokens, "n_sequences": writer.n_sequences}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    return stage(d.mapInArrow(encode, MANIFEST), "manifest")


class Reader:
    """Random access to a written part: documents and sequences are views of the file where it can be mapped."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        local = isinstance(store, fs.LocalFileSystem)
        self.data, self.docs = ((pa.memory_map(f"{base}{x}.arrow") if local else store.open_input_file(f"{base}{x}.arrow")) for x in ("", ".docs"))
        self.sequences, self.index = pa.ipc.open_file(self.data), pa.ipc.open_file(self.docs)
        self.length = self.sequences.schema.field("input_ids").type.list_size
        self.at, self.flat = -1, np.zeros(0, np.uint16)

    def batch(self, i: int) -> np.ndarray:
        """All ids of a batch, flat; the last one asked for is kept, as many documents lie in one."""
        if i != self.at:
            self.at, self.flat = i, self.sequences.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.flat

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        b = self.sequences.get_batch(i // BATCH)
        at = slice(i % BATCH * self.length, (i % BATCH + 1) * self.length)
        return b.column(0).flatten().to_numpy()[at], b.column(1).flatten().to_numpy(zero_copy_only=False)[at]

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids of a stretch, as views of one or more batches."""
        size = self.length * BATCH
        while n:
            flat = self.batch(start // size)
            got = flat[start % size : start % size + n]
            yield got
            start, n = start + len(got), n - len(got)

    def close(self) -> None:
        self.flat = np.zeros(0, np.uint16)
        for x in (self.data, self.docs):
            x.close()


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every written document, from the files."""
    spark = manifest.sparkSession
    parts = sorted(manifest.collect(), key=lambda r: r["part"])  # one row per file, as in a listing
    before, plan = 0, []
    for r in parts:
        plan.append((r["path"], before))
        before += r["n_tokens"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns)):
                reader = Reader(path)
                for k in range(reader.index.num_record_batches):
                    docs = reader.index.get_batch(k)
                    starts, sizes = (docs.column(i).to_numpy() for i in (1, 2))
                    sums = []
                    for s, n in zip(starts.tolist(), sizes.tolist()):
                        crc = 0
                        for piece in reader.pieces(s, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + base), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                reader.close()

    frame = spark.createDataFrame(plan, "path string, base long").repartition(max(1, len(plan)))
    return frame.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, remember: int = REMEMBER, folder: str | None = None) -> DataFrame:
    """Writes the documents to a folder, and returns what is read back. Without a folder it is a new one of the shared folder, removed when the driver's Python ends; a folder that is given stays."""
    spark = docs.sparkSession
    common.ready(spark)
    return read_back(write(docs, tokenizer or tokenizer_path(), folder or new_dir(spark, "tokens"), remember=remember))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of the written files."""
    return encode_documents(common.plain(common.read(spark, sf_dir, "documents"), "doc_id", "text"))
