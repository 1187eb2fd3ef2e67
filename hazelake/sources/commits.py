"""Atomic appends: a load is seen as a whole or not at all, and two loads at once cannot both add a date.

A table is a folder of data folders and of versions. A version is a small file that lists the data folders that
belong to the table, with the run that wrote each; readers take the latest version and nothing else. A load reads the
latest version, leaves out the rows whose dates (and ``keys``) it has, writes the rest to a folder of its own and then claims the
next number: the file is written under another name and renamed, which fails if the number has been taken. Then the
load looks again at what has been added meanwhile, leaves out what that has brought, and claims the number after. Of
what it wrote before only the data folder is left, which no version lists.

A run that was committed is not written again; one that broke off left no trace in any version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from py4j.protocol import Py4JJavaError

from hazelake.operators.panel import new_rows


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """(number, entries) of the latest version; number -1 and no entries before the first."""
    _, folder, files = _filesystem(spark, f"{path}/versions")
    if not files.exists(folder):
        return -1, []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
    if not numbers:
        return -1, []
    return max(numbers), json.loads(spark.read.text(f"{path}/versions/{max(numbers):010d}.json", wholetext=True).first()[0])


def claim(spark: SparkSession, path: str, number: int, entries: list[dict]) -> bool:
    """Write version ``number``; False if another load has taken it."""
    jvm, draft, files = _filesystem(spark, f"{path}/versions/draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(entries).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{number:010d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    without_overwriting = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, final, without_overwriting)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        files.delete(draft, False)
        return False
    return True


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of the latest version; of no version, no rows of ``schema``."""
    _, entries = latest(spark, path)
    if not entries:
        if schema is None:
            raise ValueError(f"no load has been committed to {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*[f"{path}/data/{e['folder']}" for e in entries])


def append(batch: DataFrame, path: str, date: str, keys=(), *, run: str, before_claim=None) -> bool:
    """Add the rows of ``batch`` whose date the table lacks; whether this call committed the run.

    ``before_claim(attempt)`` is called between writing and claiming, for tests.
    """
    spark = batch.sparkSession
    folder, attempt, seen = None, 0, None
    while True:
        number, entries = latest(spark, path)
        if any(e["run"] == run for e in entries):
            return False
        known = [e for e in entries if seen is None or e["folder"] not in seen]
        if folder is None or known:  # the first time, or rows have come meanwhile: of these only dates and keys are read
            rows = batch if folder is None else spark.read.schema(batch.schema).parquet(f"{path}/data/{folder}")
            if known:
                there = spark.read.schema(batch.schema).parquet(*[f"{path}/data/{e['folder']}" for e in known])
                first, last = rows.agg(F.min(F.expr(date)), F.max(F.expr(date))).first()
                if first is not None:
                    there = there.where(F.expr(date).between(F.lit(first), F.lit(last)))
                rows = new_rows(there, rows, date, keys)
            folder = f"{run}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{path}/data/{folder}")
        seen = {e["folder"] for e in entries}
        if before_claim:
            before_claim(attempt)
        if claim(spark, path, number + 1, [*entries, {"run": run, "folder": folder}]):
            return True
        attempt += 1
