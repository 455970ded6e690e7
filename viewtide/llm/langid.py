"""Language identification by hyperdimensional profiles (operator 8).

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram is bound from its
letters' vectors, the first rotated twice and the second once, by elementwise product (an exclusive or of bits, a one being -1); a text is the bundle
(the sum) of its trigrams' vectors, and a language the bundle of its texts'. A text gets the language whose prototype
has the highest cosine with it.

Runs of characters that are no letters count as one space; letters are lower-cased. Whole texts are read, in learning and in
predicting. Learning sums vectors inside tasks and then by language, so that what is shuffled is one vector for each task
and language. Prototypes reach the executors as blocks of BLOCK languages, 4 KB for each language.

Very long texts: a text is read in stretches of CHUNK characters, and trigram vectors are made for BLOCK distinct trigrams at a time and not kept, so
that memory does not grow with a text or its alphabet.

Nulls: a null text, or one without letters, is und with score 0; rows with a null label are not learned from; null ids
hash like the empty text. Ties go to the label that sorts first. Nothing learned: every row is und. Repeated rows get equal rows. An empty table gives no
rows. Other columns stay as they are; the result's name is lengthened where docs has it.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewtide.llm import common
from viewtide.sources.staging import stage

DIMENSIONS = 1024
UNKNOWN = "und"
SPACE = 32
#: Distinct trigrams whose vectors exist at a time; languages in a block of prototypes.
BLOCK = 4096
#: Characters that one pass over texts holds.
CHUNK = 400_000


def letter_bits(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of letters as bits (codes x dimensions), from a mix of code point and word number."""
    words = np.arange(dimensions // 64, dtype=np.uint64)
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (words + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8).reshape(len(codes), -1), axis=1)


def trigram_bits(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of trigrams as bits; a code holds three letters of 21 bits."""
    mask = (1 << 21) - 1
    letters, number = np.unique(np.concatenate([codes >> 42, codes >> 21 & mask, codes & mask]), return_inverse=True)
    plain = letter_bits(letters, dimensions)
    a, b, c = np.split(number, 3)
    return np.roll(plain, 2, axis=1)[a] ^ np.roll(plain, 1, axis=1)[b] ^ plain[c]


class Reader:
    """Texts as trigram codes."""

    def __init__(self):
        self.table = np.zeros(0x110000, np.int32)  # character -> lower-case letter, 32 for others, 0 for not met yet

    def fold(self, chars: np.ndarray) -> np.ndarray:
        out = self.table[chars]
        if (out == 0).any():
            for c in np.unique(chars[out == 0]).tolist():
                low = chr(c).lower()
                self.table[c] = ord(low[0]) if chr(c).isalpha() else SPACE
            out = self.table[chars]
        return out

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigram codes of all texts, end to end; the text of each; whether a text has a letter. Texts stand between spaces."""
        chars = np.frombuffer(" \n ".join(texts).join(("  ", "  ")).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text = np.full(len(chars), -1, np.int64)
        # a text's letters, with the character before and after it, which are spaces
        text[1:-1] = np.repeat(np.arange(len(texts)), sizes + 3)[: len(chars) - 2] if len(texts) else 0
        folded = self.fold(chars)
        keep = np.concatenate(([True], (folded[1:] != SPACE) | (folded[:-1] != SPACE)))
        # keep one space at each text's edge: runs across a border are cut by the owner changing
        keep |= np.concatenate(([True], text[1:] != text[:-1]))
        folded, text = folded[keep].astype(np.int64), text[keep]
        letters = np.bincount(text[(folded != SPACE) & (text >= 0)], minlength=len(texts)) > 0
        code = (folded[:-2] << 42) | (folded[1:-1] << 21) | folded[2:]
        whole = (text[:-2] == text[2:]) & (text[:-2] >= 0)
        return code[whole], text[:-2][whole], letters

    def stretches(self, text: str) -> Iterator[np.ndarray]:
        """The same codes of one long text, stretch by stretch: the last two letters go on into the next."""
        before = np.array([SPACE], np.int64)
        for at in range(0, len(text) + 1, CHUNK):
            part = text[at : at + CHUNK] + (" " if at + CHUNK > len(text) else "")
            if not part:
                continue
            folded = np.concatenate([before, self.fold(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4"))]).astype(np.int64)
            folded = folded[np.concatenate(([True], (folded[1:] != SPACE) | (folded[:-1] != SPACE)))]
            yield (folded[:-2] << 42) | (folded[1:-1] << 21) | folded[2:]
            before = folded[-2:]


def bundle(code: np.ndarray, owner: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """The sums of n texts' trigram vectors, a block of distinct trigrams at a time."""
    out = np.zeros((n, dimensions))
    distinct, number = np.unique(code, return_inverse=True)
    for at in range(0, len(distinct), BLOCK):
        here = (number >= at) & (number < at + BLOCK)
        width = min(BLOCK, len(distinct) - at)
        counts = np.bincount(owner[here] * width + number[here] - at, minlength=n * width).reshape(n, width).astype(np.float32)
        bits = trigram_bits(distinct[at : at + width], dimensions).astype(np.float32)
        out += counts.sum(axis=1, dtype=np.float64)[:, None] - 2.0 * (counts @ bits)
    return out


def bundles(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A vector for each text, its number of trigrams, and whether it has a letter."""
    reader = common.kept("letters", Reader)
    out, n, letters = np.zeros((len(texts), dimensions)), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for part in chunks(texts):
        some = texts[part]
        if len(some) == 1 and len(some[0]) > CHUNK:
            for code in reader.stretches(some[0]):
                out[part] += bundle(code, np.zeros(len(code), np.int64), 1, dimensions)
                n[part] += len(code)
                letters[part] |= bool((code & ((1 << 21) - 1) != SPACE).any())
            continue
        code, owner, letters[part] = reader.trigrams(some)
        out[part] = bundle(code, owner, len(some), dimensions)
        n[part] = np.bincount(owner, minlength=len(some))
    n[~letters] = 0
    return out, n, letters


def chunks(texts: list[str]) -> Iterator[slice]:
    """Slices of a list with so many characters at most, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + 3
    if texts:
        yield slice(start, len(texts))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Labels in order, and a prototype of length 1 for each, from all rows with text and label."""
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            names, at = np.unique(langs, return_inverse=True)
            vectors, _, _ = bundles(texts, dimensions)
            for i, name in enumerate(names.tolist()):
                sums[name] = sums.get(name, 0) + vectors[at == i].sum(axis=0)
            if len(sums) > BLOCK:
                yield pack(sums)
                sums = {}
        if sums:
            yield pack(sums)

    def pack(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    rows = docs.filter(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    sums = rows.mapInArrow(run, "lang string, vector array<double>").select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    lists = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("v")).select("lang", "v.v")
    found = sorted(((r["lang"], np.array(r["v"], np.float32)) for r in lists.toLocalIterator()), key=lambda r: r[0])  # a row for each language
    table = np.array([v for _, v in found], np.float64).reshape(len(found), dimensions)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return [name for name, _ in found], np.divide(table, norms, out=np.zeros_like(table), where=norms > 0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with a struct column langid of lang_pred, score (the cosine, 0 at least) and n_trigrams. The struct's name is lengthened where docs has it."""
    common.ready(docs.sparkSession)
    names, table = model
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(np.ascontiguousarray(table[i : i + BLOCK].T)) for i in range(0, len(names), BLOCK)]  # languages x dimensions

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = [t if isinstance(t, str) else "" for t in series.tolist()]
            vectors, n, letters = bundles(texts, table_dimensions)
            best, at = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
            norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]
            for i, block in enumerate(blocks):
                cosines = vectors @ block.value / norms
                top = cosines.argmax(axis=1)
                value = cosines[np.arange(len(texts)), top]
                more = value > best
                best, at = np.where(more, value, best), np.where(more, top + i * BLOCK, at)
            known = letters & bool(names)
            labels = [names[j] if k else UNKNOWN for j, k in zip(at.tolist(), known.tolist())]
            yield pd.DataFrame({"lang_pred": labels, "score": np.where(known, np.clip(best, 0.0, 1.0), 0.0), "n_trigrams": n})

    table_dimensions = table.shape[1]
    udf = F.pandas_udf(run, "lang_pred string, score double, n_trigrams long")
    return docs.withColumn(common.fresh(docs, "langid"), udf(F.col(f"`{text}`")))


def held_out(key: str = "doc_id", parts: int = 3, rest: int = 1):
    """Rows that nothing is learned from: the crc32 of the id as text has this rest."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == rest


#: A text is in no learned language below this share of the score that nine tenths of its language's texts of its length reach; so many documents of score 0 are added to
#: those, so that few make no fence. Texts in other languages or of random letters stay far below a third of it, and texts of one repeated word above.
SHARE, NONE = 0.2, 2


def fences(seen: DataFrame) -> DataFrame:
    """lang_pred, size, score of known documents -> lang_pred, size, fence. size is the bit length of the number of trigrams, as scores rise
    with length. Scores are counted in thousandths: a row for each language, size and thousandth."""
    cells = seen.groupBy("lang_pred", "size", F.floor(F.col("score") * 1000).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang_pred", "size")
    run = cells.withColumns({"below": F.sum("n").over(w.orderBy("v")) + NONE, "total": F.sum("n").over(w) + NONE})
    low = F.when(F.max("total") <= NONE * 10, 0).otherwise(F.min(F.when(F.col("below") * 10 >= F.col("total"), F.col("v"))))
    return run.groupBy("lang_pred", "size").agg((low * SHARE / 1000).alias("fence"))


def reject(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """docs without those in no language that was learned: without a letter, or with a score below the fence of their language and length.

    Fences come from the rows that were learned from and whose label the model gives back. Where nothing was learned, rows with a letter stay.
    """
    name = common.fresh(docs, "langid")
    model = learn(docs.filter(~held_out(key)), text, lang)
    if not model[0]:
        return docs.filter(F.col(f"`{text}`").rlike(r"\p{L}"))
    size = F.length(F.bin(F.col(f"`{name}`.n_trigrams")))
    found = stage(predict(docs, model, text).withColumn(name, F.struct(F.col(f"`{name}`.lang_pred"), F.col(f"`{name}`.score"), size.alias("size"))), "languages")
    seen = found.filter(~held_out(key) & (F.col(f"`{lang}`") == F.col(f"`{name}`.lang_pred"))).select(f"`{name}`.*")
    mine, fence = F.col(f"`{name}`"), fences(seen).select(F.struct("lang_pred", "size", "fence").alias(common.fresh(found, "fence")))
    f = F.col(f"`{fence.columns[0]}`")
    # a row for each language and bit length: less than the prototypes, which the executors have as well
    out = found.join(F.broadcast(fence), (mine["lang_pred"] == f["lang_pred"]) & (mine["size"] == f["size"]), "left")
    return out.filter((mine["lang_pred"] != UNKNOWN) & (mine["score"] >= F.coalesce(f["fence"], F.lit(0.0)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest for every document."""
    docs = common.plain(common.read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    found = predict(docs.drop("lang"), learn(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "langid.lang_pred", "langid.score")
