"""Quality rules with adaptive thresholds (operator 2), in DataFrame functions only.

Each rule has a count and the units that it is counted over: symbols, words in repeated windows and characters over words,
repeated lines over lines, capital letters over characters. Their rates are whole numbers, parts in ten thousand. The rates' distributions
are kept as mergeable quantile sketches per language and source: counts over log-linear buckets, which are exact below 64 and within
1/64 above, have a bounded number of buckets, and merge by adding counts. The sketches are staged once; those of a language and of the
whole corpus are merged from them.

A group's distribution is its own sketch, with its language's and the corpus's mixed in at the weight of LANGUAGE and CORPUS documents: a small group leans on
them, a large one on itself, and no size switches. From it come the median and the upper decile, and the group's fence is the decile plus TAIL times its
distance from the median. A document goes when its count is more than CHANCE deviations (and CHANCE events) beyond what the fence's rate gives over its
units: so the spread of the group decides, and a short text is not judged on a few events.

The metrics are computed once and staged, as the sketches and the filter both read them. All windows run inside rows:
window hashes are sorted with their positions, and neighbours compared.

Nulls: a null text has no words, and fails the base rule; null languages and sources are groups of their own. Repeated rows count each. An
empty table gives no rows. Ties: a count at the limit is kept. A very long text is one row; its arrays take some 40 bytes a word in one task. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewtide.llm import common
from viewtide.sources.staging import stage

MIN_WORDS, MAX_REPEAT = 50, 50
#: The upper quantile in tenths, how many times its distance from the median the fence lies beyond it, and deviations that are chance.
UPPER, TAIL, CHANCE = 9, 12, 8
#: Documents' worth of its language, and of the corpus, in each group's distribution.
LANGUAGE, CORPUS = 300, 30
#: Rules: the count and its units.
RULES = {"symbols": ("n_symbols", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "capitals": ("n_capitals", "word_chars"), "word_length": ("word_chars", "n_words")}
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def _without(text, signs: str):
    for c in signs:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def metrics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_capitals."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(*(F.col(f"`{c}`") for c in keep), body.alias("__t"))
    d = d.withColumn("__w", F.filter(F.split("__t", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(common.WORD))
    d = d.select(
        *(F.col(f"`{c}`") for c in keep),
        F.size("__w").cast("long").alias("n_words"),
        F.length(_without(F.col("__t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(_without(F.col("__t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        (F.length("__t") - F.length(F.regexp_replace("__t", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        # hashes of the words; those of three in a row make a window's
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
    )
    n = F.size("__h") - 2
    pairs = F.arrays_zip(F.slice("__h", 1, F.greatest(n, F.lit(0))).alias("a"), F.slice("__h", 2, F.greatest(n, F.lit(0))).alias("b"), F.slice("__h", 3, F.greatest(n, F.lit(0))).alias("c"))
    d = d.withColumn("__g", F.sort_array(F.transform(pairs, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i"))))).drop("__h")
    size = F.size("__g")
    # each window beside its neighbours in the order of hashes
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("__g", 1, F.greatest(size - 1, F.lit(0))))
    after = F.concat(F.slice("__g", 2, F.greatest(size - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    d = d.withColumn("__z", F.when(size >= 2, F.arrays_zip(F.col("__g").alias("x"), before.alias("p"), after.alias("q")))).drop("__g")
    twice = F.filter("__z", lambda z: z["x"]["h"].eqNullSafe(z["p"]["h"]) | z["x"]["h"].eqNullSafe(z["q"]["h"]))
    d = d.withColumn("__s", F.sort_array(F.transform(twice, lambda z: z["x"]["i"]))).drop("__z")
    # words covered by windows at sorted places: three for the first, and up to three more for each next
    covered = F.aggregate("__s", F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")), lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(x - acc["at"], F.lit(3))).alias("n")), lambda acc: acc["n"])
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__s")


def rates() -> dict:
    """Each rule's rate as a whole number."""
    return {m: F.floor(F.col(e) * 10000 / F.greatest(F.col(n), F.lit(1))).cast("long") for m, (e, n) in RULES.items()}


def sketch(values: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """groups, metric, bucket, n: the quantile sketch of each metric. Sketches merge by summing n over fewer groups."""
    long = values.select(*groups, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names))).alias("e")).select(*groups, "e.*")
    shift = "greatest(length(bin(v)) - 7, 0)"
    return long.withColumn("bucket", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})")).groupBy(*groups, "metric", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def running(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches with below (documents up to the bucket) and total. A window holds the buckets of one sketch."""
    w = Window.partitionBy(*groups, "metric")
    return sketches.withColumns({"below": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})


def thresholds(values: DataFrame) -> DataFrame:
    """kl, ks (text forms of language and source) and a fence for each metric."""
    own = stage(sketch(values, ["kl", "ks"], list(RULES)), "sketch")
    lang = running(merge(own, ["kl"]), ["kl"])
    corpus = running(merge(own, []), []).select("metric", "bucket", F.col("below").alias("bc"), F.col("total").alias("nc"))
    share = F.lit(LANGUAGE) * F.col("below") / F.col("total") + F.lit(CORPUS) * F.col("bc") / F.col("nc")
    prior = lang.join(corpus, ["metric", "bucket"]).select("kl", "metric", "bucket", "below", "total", share.alias("share"))
    # a group's quantile is one of its own buckets or of its language's quantiles: those are all in the language's sketch
    marks = [F.min(F.when(F.col("below") * 10 >= F.col("total") * k, F.col("bucket"))) for k in (5, UPPER)]
    marks = prior.groupBy("kl", "metric").agg(F.array(*marks).alias("marks")).select("kl", "metric", F.explode("marks").alias("bucket"))
    marks = own.select("kl", "ks", "metric").distinct().join(marks, ["kl", "metric"]).select("kl", "ks", "metric", "bucket", F.lit(0).cast("long").alias("n"))
    every = running(own.select("kl", "ks", "metric", "bucket", "n").unionByName(marks).groupBy("kl", "ks", "metric", "bucket").agg(F.sum("n").alias("n")), ["kl", "ks"])
    every = every.join(prior.select("kl", "metric", "bucket", "share"), ["kl", "metric", "bucket"])
    reach = lambda k: F.coalesce(F.min(F.when((F.col("below") + F.col("share")) * 10 >= (F.col("total") + LANGUAGE + CORPUS) * k, F.col("bucket"))), F.max("bucket"))
    t = every.groupBy("kl", "ks", "metric").agg(reach(5).alias("mid"), reach(UPPER).alias("top"))
    t = t.withColumn("fence", F.col("top") + TAIL * (F.col("top") - F.col("mid")))
    return t.groupBy("kl", "ks").agg(*(F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"max_{m}") for m in RULES))


def within(metric: str):
    """Whether the count is no more than chance beyond the fence; true where the group has none."""
    e, n = RULES[metric]
    usual = F.col(f"max_{metric}") * F.col(n) / F.lit(10000.0)
    return F.coalesce(F.col(e) <= usual + F.lit(CHANCE) * F.sqrt(usual) + F.lit(CHANCE), F.lit(True))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, the metrics, base_failed, the rates, their fences, and kept."""
    m = metrics(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source")), "text", ("key", "lang", "source"))
    name = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(c)))
    m = m.select("key", name("lang").alias("kl"), name("source").alias("ks"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    m = stage(m.withColumns(rates()).withColumn("base_failed", failed), "quality")
    fences = thresholds(m.filter(~F.col("base_failed")))
    ok = ~F.col("base_failed")
    for x in RULES:
        ok = ok & within(x)
    return m.join(fences, ["kl", "ks"], "left").withColumn("kept", ok).withColumnRenamed("key", key).drop("kl", "ks")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest for every document."""
    found = judge(common.plain(common.read(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _running(name: str, groups: str, source: str) -> str:
    by = f"{groups}, metric" if groups else "metric"
    return f"""{name} AS (SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {by}) AS total
       FROM (SELECT {by}, bucket, sum(n) AS n FROM {source} GROUP BY {by}, bucket))"""


def _reach(k: int) -> str:
    return f"coalesce(min(bucket) FILTER ((below + share) * 10 >= (total + {LANGUAGE + CORPUS}) * {k}), max(bucket))"


def _within(m: str) -> str:
    e, n = RULES[m]
    usual = f"(max_{m}::DOUBLE * {n} / 10000.0::DOUBLE)"
    return f"coalesce({e} <= {usual} + {CHANCE} * sqrt({usual}) + {CHANCE}, true)"


SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IS NULL THEN 'n' ELSE 'a' || lang END AS kl, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS ks,
                  row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2])) AS g, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w),
d AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
rp AS (SELECT rid, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, kl, ks, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rp.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
      FROM w LEFT JOIN rp USING (rid)),
v AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
      {', '.join(f'floor({e} * 10000 / greatest({n}, 1))::BIGINT AS {m}' for m, (e, n) in RULES.items())} FROM m),
sk AS (SELECT kl, ks, metric, ((v >> sh) << sh) AS bucket, count(*) AS n FROM
  (SELECT kl, ks, metric, v, greatest(length(bin(v)) - 7, 0)::INTEGER AS sh FROM
    (SELECT kl, ks, unnest([{', '.join(repr(m) for m in RULES)}]) AS metric, unnest([{', '.join(RULES)}]) AS v FROM v WHERE NOT base_failed)) GROUP BY ALL),
{_running('l', 'kl', 'sk')}, {_running('c', '', 'sk')},
prior AS (SELECT l.*, {LANGUAGE} * l.below::DOUBLE / l.total::DOUBLE + {CORPUS} * c.below::DOUBLE / c.total::DOUBLE AS share FROM l JOIN c ON l.metric = c.metric AND l.bucket = c.bucket),
marks AS (SELECT kl, metric, unnest([min(bucket) FILTER (below * 10 >= total * 5), min(bucket) FILTER (below * 10 >= total * {UPPER})]) AS bucket FROM prior GROUP BY kl, metric),
own AS (SELECT kl, ks, metric, bucket, n FROM sk UNION ALL SELECT x.kl, x.ks, x.metric, marks.bucket, 0 FROM (SELECT DISTINCT kl, ks, metric FROM sk) x JOIN marks ON x.kl = marks.kl AND x.metric = marks.metric),
{_running('every', 'kl, ks', 'own')},
f AS (SELECT kl, ks, metric, top + {TAIL} * (top - mid) AS fence FROM (
  SELECT e.kl, ks, e.metric, {_reach(5)} AS mid, {_reach(UPPER)} AS top
  FROM (SELECT kl, ks, metric, bucket, below::DOUBLE AS below, total::DOUBLE AS total FROM every) e JOIN (SELECT kl, metric, bucket AS b, share FROM prior) p ON e.kl = p.kl AND e.metric = p.metric AND e.bucket = p.b GROUP BY ALL)),
p AS (SELECT kl, ks, {', '.join(f"max(fence) FILTER (metric = '{m}') AS max_{m}" for m in RULES)} FROM f GROUP BY kl, ks)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {' AND '.join(map(_within, RULES))}) AS kept
FROM v LEFT JOIN p USING (kl, ks)
"""
