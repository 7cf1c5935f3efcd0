"""Corpus pipeline: five stages over ``documents``, one operator each.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  Stages:

1. language: documents whose language can't be told (null or without a letter,
   or no n-gram known) go; ``lang`` becomes the predicted language.  The model
   learns from the labels of its input.
2. near_duplicates: of each SimHash component the document with the smallest
   id stays.
3. decontaminate: documents with a word inside a test window go.
4. personal_data: spans of personal data are masked by their kind, ``n_chars``
   follows.
5. tokenize: each document gets its token ids, their number and digests of ids
   and decoded text; texts stay as they are.

Columns stay those of ``documents`` until the last stage, which adds
``n_tokens``, ``ids``, ``ids_sha256`` and ``decoded_sha256``.  Further input
columns, whatever their names, are dropped by the first stage.  Empty tables give
empty results.  Null and empty texts have no language and go in stage 1.
Repeated rows share a component, of which stage 2 keeps one; of rows that share
the smallest id the one with the smallest text hash stays.  A null id comes last
there.  Very long texts go through every stage whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.llm import bpe, decontaminate, langid, pii, simhash
from vigilo.llm.common import documents, written
from vigilo.session import apply_runtime_conf
from vigilo.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return langid.label(docs, langid.fit(docs)).filter((F.col("lang") != langid.UNKNOWN) & (F.col("score") > 0)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"])).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenized(docs.select(*COLUMNS), bpe.default_path())


def _set(stage: Stage) -> Stage:
    """The stage under the library's session settings."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(apply_runtime_conf(spark), docs, sf_dir)
    return run_stage


STAGES = [
    ("language", _set(language)),
    ("near_duplicates", _set(near_duplicates)),
    ("decontaminate", _set(decontaminated)),
    ("personal_data", _set(personal_data)),
    ("tokenize", _set(tokenize)),
]

#: No SQL: language filters, fingerprints, automaton and merges have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
