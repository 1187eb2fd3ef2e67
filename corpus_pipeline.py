"""A corpus pipeline of five stages, each written and read again before the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, the next
one's ``docs``. All but the last return the columns of the documents. Nulls, empty texts, repeated rows, empty
tables and further columns are treated as the operator of each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazelake.llm import decontaminate, mixing, quality, simhash, tokens
from hazelake.llm.common import table, written
from hazelake.session import fresh_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "pipeline-tokens")
    tokens.write(docs, folder, as_stored=bool(docs.inputFiles()))  # the files of the stage before are in training order
    return tokens.summary(spark, folder)


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]

#: XXH64 and byte-pair encoding have no SQL counterpart
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
