"""The operators against brute force on the small tables, and on odd rows."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import oracle
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from viewtide.llm import common, decontaminate, langid, lm, mix, pairs, passages, quality, registry, shard, simhash, tokens, urls
from viewtide.llm.components import components
from viewtide.llm.eliasfano import EliasFano
from viewtide.sources import staging

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def run(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir).toPandas().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert oracle.compare(spark, oracle.connect(sf_dir), sf_dir, registry.QUERIES[name], registry.SQL[name]) == ""


def test_mix_law(spark, sf_dir):
    p = mix.mix(common.read(spark, sf_dir, "documents")).select("source", "mix.*").toPandas()
    by = p.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert math.isclose(by.target.sum(), by["size"].sum()) and (p.taken <= 3 * p["size"]).all()
    assert ((by.taken - by.target).abs() <= 2 * by.most).all()


def test_quality_fences_follow_the_group(spark):
    """Two groups whose rates differ in level and spread: what is usual in one is junk in the other. A small group leans on its language."""
    rng = np.random.default_rng(4)

    def doc(marks):
        w = [f"w{i}x" for i in rng.permutation(400)]
        for i in range(marks):
            w[i] += "#"
        return " ".join(rng.permutation(w))

    rows = [(i, doc(int(rng.integers(0, 3))), "en", "plain") for i in range(900)] + [(1000 + i, doc(int(rng.integers(60, 140))), "xx", "code") for i in range(900)]
    rows += [(5000, doc(120), "en", "plain"), (5001, doc(120), "xx", "code"), (5002, doc(120), "en", "new"), (5003, doc(1), "en", "new")]
    p = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert p.kept[[5000, 5001, 5002, 5003]].tolist() == [False, True, False, True] and p.kept[p.index < 5000].all()
    assert p.max_symbols[1000] > 5 * max(p.max_symbols[0], 1)


def test_quality_edges(spark):
    # the windows of "a b c": at 0 and 3, so all six words are repeated
    d = spark.createDataFrame([(1, "a b c a b c", "en", "s"), (2, None, None, None), (3, "x\nx\n\n x\n", "en", "s"), (4, "", "en", "s"), (4, "é# ü$", "en", None)], "doc_id long, text string, lang string, source string")
    found = {(r["doc_id"], r["n_words"]): r for r in quality.judge(d).collect()}
    assert found[1, 6]["n_repeat_words"] == 6 and found[1, 6]["base_failed"]
    assert found[2, 0]["kept"] is False and found[3, 3]["n_dup_lines"] == 1 and found[3, 3]["n_repeat_words"] == 0
    assert found[4, 2]["word_chars"] == 4 and found[4, 2]["n_symbols"] == 2


def test_lm_scores(spark, sf_dir, docs):
    p = run(spark, sf_dir, "op4_lm_score")
    words = {i: low(r["text"]).encode() for i, r in docs.items()}
    words = {i: t.split() + [b"\n"] for i, t in words.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    c = Counter(w for i in words if not held[i] for w in words[i])
    c2 = Counter(x for i in words if not held[i] for x in zip([b"\t"] + words[i], words[i]))
    n, v, before = sum(c.values()), len(c), Counter(c)
    before[b"\t"] = c[b"\n"]
    for i, w in words.items():
        base = [(c[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        want = sum(math.log10((c2[a, b] + lm.PRIOR * q) / (before[a] + lm.PRIOR)) for a, b, q in zip([b"\t"] + w, w, base))
        r = p.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held[i])
        assert math.isclose(r.base_score, sum(map(math.log10, base)), rel_tol=1e-9) and abs(r.score - want) < 2e-4 * len(w)
    h = p[p.held_out]
    assert h.score.sum() > h.base_score.sum()


def test_lm_files_score_other_texts(spark, tmp_path):
    """The files alone give the scores that the model's own corpus got; texts of unknown words fall back to the counts."""
    folder = f"file://{tmp_path}/model"
    d = spark.createDataFrame([(i, f"a b c w{i % 7} a B\nx{i}") for i in range(200)], "doc_id long, text string")
    want = {r["doc_id"]: r for r in lm.score(d, folder=folder).collect()}
    found = {r["doc_id"]: r for r in lm.score_texts(d, folder).collect()}
    assert found == want and len(want) == 200
    n, v = want[0]["train_tokens"], len({w for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1 for w in (f"x{i}", f"w{i % 7}")}) + 4
    other = spark.createDataFrame([(1, "unseen"), (2, None), (3, "a b")], "doc_id long, text string")
    p = {r["doc_id"]: r for r in lm.score_texts(other, folder).collect()}
    assert [(p[i]["n_tokens"], p[i]["n_known"]) for i in (1, 2, 3)] == [(2, 1), (1, 1), (3, 3)]
    q = 0.5 / (n + 0.5 * (v + 1))
    ends = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(200))
    first = math.log10(lm.PRIOR / (ends + lm.PRIOR) * q)  # an unknown word after the start, then the end after an unknown word
    assert math.isclose(p[1]["score"], first + math.log10((ends + 0.5) / (n + 0.5 * (v + 1))), rel_tol=1e-9)
    assert p[3]["score"] > p[1]["score"]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 5), (1000, 3000), (300, 300), (70000, 10**12)):
        a = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        e, x = EliasFano.encode(a), rng.integers(0, top + 5, 500).astype(np.uint64)
        assert (e.get(np.arange(n)) == a).all() and (e.successor(x) == np.searchsorted(a, x)).all()


def paragraph_rows(texts, least):
    """(doc, place, n_words, keeper) of repeated paragraphs by brute force: exact Jaccard, components, runs."""
    sets, where, spans = {}, defaultdict(set), defaultdict(set)
    units = {i: [tuple(x) for x in map(str.split, low(t).split("\n")) if x] for i, t in texts.items()}
    for i, found in units.items():
        for w in found:
            spans[w].add(i)
            sets[w] = frozenset(w[k : k + 5] for k in range(max(1, len(w) - 4))) if len(w) > 4 else frozenset([w])
    least_of = {w: w for w in sets}

    def root(w):
        while least_of[w] != w:
            w = least_of[w]
        return w

    for w in sorted(sets):
        both = Counter(v for x in sets[w] for v in where[x])
        for v, n in both.items():
            if n >= 0.8 * (len(sets[w]) + len(sets[v]) - n):
                x, y = root(w), root(v)
                least_of[max(x, y)] = min(x, y)
        for x in sets[w]:
            where[x].add(w)
    docs_of = defaultdict(set)
    for w in sets:
        docs_of[root(w)] |= spans[w]
    out = set()
    for i, found in units.items():
        run = []
        for k, w in enumerate([*found, None]):
            if w is not None and len(docs_of[root(w)]) > 1:
                run.append((i, k, len(w), min(docs_of[root(w)])))
                continue
            if sum(x[2] for x in run) >= least:
                out |= set(run)
            run = []
    return out


def paragraph_texts():
    import random

    rng = random.Random(2)
    texts = {}
    for g in range(30):
        base = [[f"g{g}p{k}w{rng.randrange(300)}" for _ in range(rng.randint(1, 60))] for k in range(5)]
        for _ in range(4):
            copy = [list(w) for w in base]
            for w in copy:
                for _ in range(rng.choice([0, 0, 1, 2, 4])):
                    w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rng.shuffle(copy)
            texts[len(texts)] = "\n\n".join(" ".join(w) for w in copy[: rng.randint(1, 5)]) + "\n \n" + f"own{len(texts)}"
    return texts


@pytest.mark.parametrize("least, block", [(1, pairs.BLOCK), (50, pairs.BLOCK), (1, 60)])
def test_paragraphs(spark, least, block):
    texts = paragraph_texts()
    p = passages.repeated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), least=least, block=block).filter("unit_no is not null").toPandas()
    got, want = set(zip(p.doc_id, p.unit_no, p.n_words, p.keeper)), paragraph_rows(texts, least)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want) and (p.removed == (p.doc_id != p.keeper)).all()


def test_passages(spark, sf_dir, docs):
    assert passages.bands() == (9, 4)
    p = registry.QUERIES["op5_repeated_passages"](spark, sf_dir).toPandas()
    where = defaultdict(set)
    for i, r in docs.items():
        w = low(r["text"]).split()
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    repeated = set().union(*(x for x in where.values() if len(x) > 1))
    assert repeated <= set(p.doc_id) and (p.removed == (p.doc_id != p.keeper)).all() and (p.run_words >= passages.PASSAGE).all()
    q = p[p.unit_no.notna()]
    got, want = set(zip(q.doc_id, q.unit_no, q.n_words, q.keeper)), paragraph_rows({i: r["text"] for i, r in docs.items()}, 50)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want) + 1


def test_verbatim_passages_wherever_they_stand(spark):
    import random

    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(400)}" + rng.choice(["", "", "", "", ".", "\n"]) for _ in range(n)]
    planted = [[f"p{k}q{rng.randrange(300)}" for _ in range(rng.randint(50, 120))] for k in range(15)] + [prose(n) for n in (50, 51, 70, 49)]
    texts = {i: prose(rng.randint(0, 90)) + planted[i % len(planted)][: None if i % 3 else 60] + prose(rng.randint(0, 90)) for i in range(57)}
    texts |= {100: ["one"] * 700, 101: ["one"] * 70, 102: ["a", "b"] * 60, 103: ["b"] + ["a", "b"] * 30}
    texts = {i: " ".join(w).replace("\n ", "\n").lower() for i, w in texts.items()}
    where, want = defaultdict(set), set()
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    keeps = {}
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 49):
            if len(ids := where[tuple(w[k : k + 50])]) > 1:
                want |= {(i, j) for j in range(k, k + 50)}
                keeps.setdefault(i, set()).add(min(ids))
    p = passages.repeated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).filter("unit_no is null").toPandas()
    assert want and {(r.doc_id, j) for r in p.itertuples() for j in range(r.word_no, r.word_no + r.n_words)} == want
    assert p.groupby("doc_id").keeper.agg(set).to_dict() == keeps and (p.run_words >= 50).all()
    assert p.groupby("cluster_id").agg(lambda x: x.nunique()).keeper.eq(1).all() and (p.removed == (p.doc_id != p.keeper)).all()


def test_similar_pairs_are_all_joined():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(25, 41), replace=False), [np.uint64(1)]])) for _ in range(60)]
    want, got = list(range(60)), list(range(60))

    def root(p, i):
        while p[i] != i:
            i = p[i]
        return i

    for i in range(60):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.8 * len(a | b):
                want[max(root(want, i), root(want, j))] = min(root(want, i), root(want, j))
    for i, j in pairs.similar(sets):
        got[max(root(got, i), root(got, j))] = min(root(got, i), root(got, j))
    assert {frozenset(i for i in range(60) if root(want, i) == r) for r in range(60)} == {frozenset(i for i in range(60) if root(got, i) == r) for r in range(60)}


def test_token_files(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    p = run(spark, sf_dir, "op6_token_files").sort_index()
    t = Tokenizer.from_file(tokens.tokenizer_path())
    ids = [e.ids + [0] for e in t.encode_batch([docs[i]["text"] for i in sorted(docs)], add_special_tokens=False)]
    assert p.n_tokens.tolist() == [len(x) for x in ids] and p.start.tolist() == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert p.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_encoder_on_odd_texts():
    import random

    from tokenizers import Tokenizer

    with open(tokens.tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    rng, parts = random.Random(1), ["a", "Bé", " ", "  ", "\n", "\n\n", "\t", ".", "!?", "'s", "23", "<|endoftext|>", "<", "×", "中文", "😀", " ", "\x1f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    want = Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)
    assert all(e.ids == g.tolist() for e, g in zip(want, tokens.Encoder(spec).encode(texts)))


def syllable_texts(seed, n, words):
    """Texts of random glued syllables: most words are new ones."""
    import random

    rng, parts = random.Random(seed), ["the", "er", "in", "tion", "ou", "é", "nd", "st", "a", "che", "ly", "qu", "ing", "Th"]
    return ["".join(rng.choice(["", " ", " ", ". ", ",\n"]) + "".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(words)) for _ in range(n)]


def test_encoder_cuts_long_texts_and_forgets(monkeypatch):
    import random

    from tokenizers import Tokenizer

    with open(tokens.tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    rng, parts = random.Random(2), ["a", "Bé", " ", "  ", "\n", "\t", ".", "'s", "23", "<|endoftext|>", "<|", "×", "ɐ", "中文", "\u00a0", "\u2003", "\u3000", "\x1c", "\r", "é", "²", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    want = [e.ids for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]
    encoder, got = tokens.Encoder(spec, 100), []
    for at in range(0, 1000, 50):
        got += encoder.encode(texts[at : at + 50])
    monkeypatch.setattr(tokens, "CHUNK", 10)
    for t in texts[1000:]:
        got += encoder.encode([t])
    assert want == [x.tolist() for x in got]


def test_encoder_memory():
    """pipeline's token output: what a worker needs beside the texts, as many distinct words as they may hold."""
    import multiprocessing

    with multiprocessing.get_context("spawn").Pool(1) as pool:
        assert pool.apply(encoder_growth) < 150


def encoder_growth():
    """MB by which encoding 13 MB makes a fresh process grow, with the encoder's own bounds."""
    import gc
    import resource

    batches = [pa.record_batch([pa.array(range(400)), pa.array(syllable_texts(seed, 400, 900))], names=["a", "b"]) for seed in range(4)]
    gc.collect()
    with open(tokens.tokenizer_path(), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for b in batches:
        for some in tokens.slices(b):
            encoder.encode(some.column(1).to_pylist())
    return (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1000


def test_encoder_time():
    """op6_token_files: where most words are new, encoding by pieces is to take less CPU time than encoding whole texts."""
    import time

    with open(tokens.tokenizer_path(), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    texts = syllable_texts(9, 400, 900)
    start = time.process_time()
    want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    whole = time.process_time() - start
    start = time.process_time()
    got = encoder.encode(texts)
    assert time.process_time() - start < whole
    assert all(e.ids == g.tolist() for e, g in zip(want, got))


def shard_laws(p, texts):
    """One row a document, sizes and checksums, gapless slots, whole groups; returns the shards' sums."""
    assert len(p) == len(texts) and set(p.shard) <= set(range(24))
    assert p["size"].tolist() == [len((t or "").encode()) + 8 for t in texts] and p.text_crc32.tolist() == [zlib.crc32((t or "").encode()) for t in texts]
    g = p.groupby("shard").agg(n=("slot", "size"), top=("slot", "max"), distinct=("slot", "nunique"), size=("size", "sum"), tokens=("tokens", "sum"))
    assert (g.n == g.top + 1).all() and (g.n == g.distinct).all()
    return g


def test_shards(spark, docs):
    p = run(spark, "/root/testdata/sf0.01", "op7_shard").sort_index()
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    g = shard_laws(p, texts)
    assert g["size"].max() <= 1.02 * g["size"].mean() and not (p.groupby(["text_crc32", "size"]).shard.nunique() > 1).any()


def test_shards_with_a_hot_group(spark):
    """A third of all rows are copies: they are cut, as no shard holds them, and nothing else is. Small cells keep the law."""
    texts = [("copy " * 40 if i % 3 == 0 else f"text {i} " * (5 + i % 50 + 400 * (i % 1001 == 1))) for i in range(6000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = shard.shard(d, cell=1000).toPandas().sort_values("doc_id")
    g = shard_laws(p, texts)
    assert g["size"].max() <= 1.05 * g["size"].mean() and g.n.max() <= 1.1 * g.n.mean()
    split = p.groupby("text_crc32").shard.nunique()
    assert split[split > 1].index.tolist() == [zlib.crc32(texts[0].encode())]
    again = shard.shard(d.repartition(5), cell=1000).toPandas().sort_values("doc_id")
    assert (p[["shard", "slot"]].to_numpy() == again[["shard", "slot"]].to_numpy()).all()


def test_language(spark, sf_dir, docs):
    p = run(spark, sf_dir, "op8_language_id")
    h = p[p.held_out]
    assert (h.lang_pred == [docs[i]["lang"] for i in h.index]).mean() > 0.97 and p.score.between(0, 1).all()


def test_language_by_brute_force(spark):
    """Vectors letter by letter, bundles and cosines in plain Python."""
    n = langid.DIMENSIONS
    texts = [(1, "Das ist ein Haus, und noch eins!", "de"), (3, "the house and the other house", "en"), (4, "a  b", "en"), (5, "Der Hund ist gross", None), (7, "12 34", "de"), (8, None, "en"), (9, "x", "fr"), (10, "ÉTÉ l'été", "fr"), (11, "the 2nd house...", None)]
    vector = lambda c: [1 - 2 * int(b) for b in langid.letter_bits(np.array([ord(c)]), n)[0]]

    def sums(text):
        s = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text or "") + " "
        while "  " in s:
            s = s.replace("  ", " ")
        out = [0] * n
        for a, b, c in zip(s, s[1:], s[2:]):
            x, y, z = vector(a), vector(b), vector(c)
            out = [o + x[(i - 2) % n] * y[(i - 1) % n] * z[i] for i, o in enumerate(out)]
        return out if any(c.isalpha() for c in text or "") else None

    known = {}
    for i, t, lang in texts:
        if lang and t and zlib.crc32(str(i).encode()) % 3 != 1:
            known[lang] = [a + b for a, b in zip(known.get(lang, [0] * n), sums(t) or [0] * n)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) or 1)
    d = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["langid"] for r in langid.predict(d, langid.learn(d.filter(~langid.held_out()))).collect()}
    for i, t, _ in texts:
        v = sums(t)
        want = max(((cos(v, known[k]), k) for k in sorted(known)), key=lambda x: x[0]) if v else (0.0, "und")
        assert got[i]["lang_pred"] == want[1] and math.isclose(got[i]["score"], max(0.0, want[0]), abs_tol=1e-5)


def test_language_of_long_texts():
    """A million distinct-looking characters need no more memory than a stretch; stretches make the same vectors."""
    import tracemalloc

    text = "".join(chr(0x4E00 + int(i)) for i in np.random.default_rng(1).integers(0, 20000, 1_000_000))
    tracemalloc.start()
    langid.bundles([text])
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    held, langid.CHUNK = langid.CHUNK, 7
    try:
        odd = [" a b  cde f  ü1 2gh ", "abcdefg", "abcdefgh", "  1234567", "x", "", "ein wort und noch eins "]
        a = langid.bundles(odd)
    finally:
        langid.CHUNK = held
    assert all(np.array_equal(x, y) for x, y in zip(a, langid.bundles(odd)))


def test_language_rejects_what_was_not_learned(spark):
    import random

    rng = random.Random(1)
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    noise = [(10**6 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)), None) for i in range(40)]
    kept = {r["doc_id"] for r in langid.reject(d.unionByName(spark.createDataFrame(noise, d.schema))).select("doc_id").collect()}
    assert len([i for i in kept if i < 10**6]) == d.count() and len([i for i in kept if i >= 10**6]) <= 4


def test_simhash(spark, sf_dir, docs):
    p = run(spark, sf_dir, "op9_simhash")
    prints = {}
    for i, r in docs.items():
        w = WORDS.findall(low(r["text"]))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert all(p.fingerprint[i] == f"{v:016x}" for i, v in prints.items())
    least = {i: i for i in prints}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(prints)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    assert all(p.component_id[i] == root(i) for i in ids)


def test_near_duplicates_are_verified(spark):
    line = "one line that comes again and again "  # repeated shingles must not outweigh the rest
    rows = [(k, line * 60 + " ".join(f"tail{k}x{j}" for j in range(60)), "en", "s") for k in range(5)]
    assert simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).count() == 5


def near_wanted(docs):
    """The ids that stay where links are exactly the pairs at 0.8 on distinct five-word shingles."""
    sets = {}
    for i, t in docs.items():
        w = low(t).split()
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    least, where = {i: i for i in sets}, defaultdict(list)

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sorted(sets):
        both = Counter(j for x in sets[i] for j in where[x])
        for j in both if sets[i] else [j for j in sets if j < i and not sets[j]]:
            if both[j] >= 0.8 * (len(sets[i]) + len(sets[j]) - both[j]):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
        for x in sets[i]:
            where[x].append(i)
    return {i for i in sets if root(i) == i}


def test_near_duplicates_are_exact(spark, sf_dir):
    import random

    rng = random.Random(7)
    texts = {}
    for g in range(60):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randint(40, 200))]
        for _ in range(4):  # some above and some below 0.8
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
            texts[len(texts)] = " ".join(w)
    line = "one line that comes again and again "  # repeated shingles must not outweigh the rest
    texts |= {1000 + k: line * 60 + " ".join(f"tail{k}x{j}" for j in range(60)) for k in range(5)}
    rows = [(i, t, "en", "s") for i, t in texts.items()]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert set(got.doc_id) == near_wanted(texts)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {r["doc_id"] for r in simhash.keep_one(d).select("doc_id").collect()} == near_wanted({r["doc_id"]: r["text"] for r in d.collect()})


def test_links_in_large_buckets():
    rng = np.random.default_rng(5)
    lo = np.unique(rng.integers(0, 1 << 14, 3000)).astype(np.uint64)
    zero = np.zeros(len(lo), np.uint64)
    a, b = simhash.links(np.zeros(len(lo), np.int64), np.full(len(lo), 2, np.int8), zero, lo, 1)
    near = np.bitwise_count(lo[:, None] ^ lo[None, :]) <= 1
    r, c = np.nonzero(near)
    assert (simhash.forest(len(lo), r, c) == simhash.forest(len(lo), a, b)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 80), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 80, 90: 80, 80: 80}


def test_decontamination(spark, sf_dir, docs):
    p = run(spark, sf_dir, "op10_decontaminate")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = word.findall(low(r["text"]))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(r["item_id"])
    for i, r in docs.items():
        w, hit, items = word.findall(low(r["text"])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        x = p.loc[i]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert x.items_sha256 == hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def test_decontamination_in_blocks(spark, sf_dir):
    d, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    index = decontaminate.build_index(d)
    one, many = (sorted(map(tuple, decontaminate.search(index, items, block_words=n).drop("item_ids").collect())) for n in (decontaminate.BLOCK_WORDS, 100))
    assert one == many and len(decontaminate.blocks_of(items, "item_id", "text", block_words=100)) > 5


def test_proximity():
    s = decontaminate.Segment(decontaminate.segment([1], [decontaminate.words("a x b c")], 10), 10)
    block = decontaminate.Phrases([(7, "a b c")], 10)
    assert list(s.search(block)) == [] and [p for p, _ in s.search(block, slop=1)] == [0]


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (None, "Ein Wort und noch eins", None, "b"), (4, "same text here again and again", "en", None), (4, "same text here again and again", "en", None), (5, "same text here again and again", "fr", "a"), (6, "word " * 60000, "en", "a"), (None, "Un autre texte qui ne ressemble à rien", None, "c")]
OPERATORS = {
    "mix": lambda d: mix.mix(d), "mixed": lambda d: mix.mixed(d), "shard": lambda d: shard.shard(d), "quality": lambda d: quality.judge(d), "lm": lambda d: lm.score(d), "passages": lambda d: passages.repeated(d),
    "tokens": lambda d: tokens.encode_documents(d), "language": lambda d: langid.predict(d, langid.learn(d)), "reject": lambda d: langid.reject(d), "simhash": lambda d: simhash.group(simhash.fingerprints(d)), "keep": lambda d: simhash.keep_one(d),
    "index": lambda d: decontaminate.search(decontaminate.build_index(d), d.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 5")), "clean": lambda d: decontaminate.clean(d, d.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 5")),
}
#: Rows that come back from the odd rows: all, but for those that drop rows.
COUNTS = {"mixed": None, "passages": None, "reject": 6, "keep": 5, "clean": 6}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_rows(spark, name, rows):
    clash = ["key", "body", "size", "mix", "hash", "rank", "langid", "n", "class", "__mix", "__plan", "__body", "__rank", "fence", "set", "shard", "cell"]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in clash})
    common.ready(spark)
    n = OPERATORS[name](d).count()
    want = COUNTS.get(name, len(ODD)) if rows else 0
    assert want is None or n == want


def test_odd_urls(spark):
    pages = spark.createDataFrame([(1, None, "2024-05-01"), (2, "no url", "2024-05-01"), (3, "http://a.b.example.com/x/y?q", "2024-05-01"), (3, "http://a.b.example.com/x/y?q", "2024-05-01"), (4, "http://example.com:80/", None), (5, "https://u@Example.com", "2024-07-01")], "page_id long, url string, t string").withColumn("fetched_at", F.to_timestamp_ntz("t")).withColumn("kind", F.lit(1))
    entries = [("domain", "example.com", "x", "add", "2024-04-01"), ("domain", "example.com", "x", "remove", "2024-06-01"), ("prefix", "a.b.example.com/x", "y", "add", "2024-04-30"), ("host", None, "z", "add", "2024-01-01")]
    entries = spark.createDataFrame(entries, "kind string, pattern string, category string, action string, d string").withColumn("dated", F.to_timestamp_ntz("d"))
    got = sorted((r["page_id"], r["listed"]["n_entries"], r["listed"]["blocked"]) for r in urls.filter_urls(pages, entries).collect())
    assert got == [(1, 0, False), (2, 0, False), (3, 2, True), (3, 2, True), (4, 0, False), (5, 0, False)]
    odd = spark.createDataFrame([(1, "http://EXAMPLE.com./a", "2024-05-01"), (2, "http://[::1]:80/x", "2024-05-01"), (3, "http://b.org/p//q", "2024-05-01")], "page_id long, url string, t string").withColumn("fetched_at", F.to_timestamp_ntz("t")).withColumns({"__u": F.lit(1), "__f": F.lit(1), "__e": F.lit(1)})
    some = spark.createDataFrame([(k, p, "x", "add", "2024-04-01") for k, p in (("host", "Example.com."), ("host", "[::1]"), ("prefix", "B.org/p/"))], "kind string, pattern string, category string, action string, d string").withColumn("dated", F.to_timestamp_ntz("d"))
    assert [r["listed"]["blocked"] for r in urls.filter_urls(odd, some).orderBy("page_id").collect()] == [True, True, True]
    assert urls.filter_urls(pages, entries.limit(0)).filter("listed.blocked").count() == 0
    assert urls.filter_urls(pages.limit(0), entries).count() == 0


def test_pipeline(spark, sf_dir, docs):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    found = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert 0 < len(found) and set(found.doc_id) <= set(docs)
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).toPandas()
    assert not kept.text.duplicated().any() and sys.getsizeof(kept)


def test_pipeline_stages_free_disk(spark, sf_dir, tmp_path):
    """What a stage stages for itself goes when the next begins on written rows, and stays as long as the next one's docs read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with staging.recording() as outer:
        first = corpus_pipeline.language_id(spark, docs, sf_dir)
    own = list(corpus_pipeline._left.paths)
    assert own and not outer
    n = first.count()
    lazy = corpus_pipeline.near_duplicates(spark, first, sf_dir)
    assert set(own) <= set(corpus_pipeline._left.paths) and 0 < lazy.count() <= n
    first.write.parquet(str(tmp_path / "first"))
    corpus_pipeline.source_mix(spark, spark.read.parquet(str(tmp_path / "first")), sf_dir)
    assert not any(Path(p.removeprefix("file://")).exists() for p in own)


def test_band_keys_of_stretches():
    """The same keys as by one function after the other."""
    rng = np.random.default_rng(1)
    n, rows = simhash.SIMILAR.bands
    odd = np.random.default_rng(42).integers(0, 1 << 63, (n * rows, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for size in (0, 1, simhash.STRETCH - 1, simhash.STRETCH, 3 * simhash.STRETCH + 1):
        x = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        found = simhash.band_keys(x, simhash.SIMILAR)
        expect = []
        for i in range(n if size else 0):
            k = i
            for a, b in odd[i * rows : (i + 1) * rows]:
                k = (k ^ int(((x ^ a) * b).min())) * 0x9E3779B97F4A7C15 % 2**64
                k ^= k >> 29
            expect.append(k)
        assert found.view(np.uint64).tolist() == expect
