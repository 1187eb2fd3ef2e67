"""Column helpers and written tables that the training-data operators share.

Rows are documents: one integer ``doc_id``, one ``text``, any further columns. A null text is an
empty text. Repeated rows are documents of their own unless an operator says otherwise.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazelake.session import fresh_path

# --- fixed values: what separates words -------------------------------------------------------
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where the body is a lambda."""
    return F.transform(F.array(value), body)[0]


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def handed(spark: SparkSession, size: int):
    """Jobs started inside hand about ``size`` bytes at most to Python at a time; Spark's default is 64 MB, held several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
