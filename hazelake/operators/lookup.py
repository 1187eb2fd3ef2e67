"""Joins that look something up per key when one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def lookup(rows: DataFrame, table: DataFrame, key, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``rows`` with a table of one row per key.

    If the table is small enough Spark broadcasts it and the salt costs nothing. If it is not,
    rows of a hot key are spread over ``salts`` partitions, each with its own copy of the entry. The
    salt is a hash of the row, so a task that is run again sends every row to the same place.
    """
    key = [key] if isinstance(key, str) else list(key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*key, "_salt"], how).drop("_salt")
