"""The corpus pipeline: documents -> token files, in five stages, each written as Parquet and read again by the next.

Nulls: documents without text go in the first stage; null ids, sources and labels are values like any other. Repeated rows and ties: one row of equal texts
stays, that of the least id. Empty tables pass through all stages. Very long texts are rows like any other. Extra columns stay as they are.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from viewtide.llm import common, decontaminate, langid, mix, simhash, tokens
from viewtide.sources.staging import free, recording, stage

#: The session's setting that names a folder for the token files; unset, they lie in the shared folder and go when the driver's Python ends.
OUTPUT = "spark.viewtide.output"

#: paths: the folders that this thread's stages have staged for themselves and that no later stage needs.
_left = threading.local()


def frees(f: Callable) -> Callable:
    """A stage whose docs are written: what earlier stages staged for themselves goes when it begins, unless its docs still read it. A frame that an earlier
    stage returned is therefore to be written before the next stage begins, as run() does."""

    @wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = free(spark, getattr(_left, "paths", []), docs)
        with recording() as made:
            out = f(spark, docs, sf_dir)
        _left.paths = held if f.__name__ == "token_files" else held + made  # token files are the result
        return out

    return begin


@frees
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: without a letter, or with a score far below that of their language's texts of their length. Learned from the documents' labels."""
    common.ready(spark)
    return langid.reject(docs)


@frees
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id: five-word shingles, a similarity of 0.8 or more. Texts without words are equal."""
    return simhash.keep_one(docs, simhash.SIMILAR)


@frees
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; an empty benchmark removes none."""
    common.ready(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@frees
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is sampled, or repeated up to three times, to its target weight."""
    return mix.mixed(docs)


@frees
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids as Arrow files, in the folder that OUTPUT names; a row for each document that the files hold."""
    return tokens.encode_documents(docs, remember=100_000, folder=spark.conf.get(OUTPUT, None))  # beside executors whose heap earlier stages have filled


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
    ("token output", token_files),
]

#: SQL cannot express language ID, SimHash groups or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name.split()[0].lower())
    return docs


query = run
