"""Session settings and the shared folder that materialised tables go to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: the JIT skips methods above 8000 bytes; wide projections run faster split up than fused
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "8000"


def build_session(master: str | None = None, app_name: str = "hazelake", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(*METHOD_LIMIT)
        # call sites in error messages cost several gateway calls per column function
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with the limit above where it has Spark's default of 65535; another one stays.

    Queries get sessions that ``build_session`` did not make; there rolling features ran as interpreted bytecode.
    """
    if spark.conf.get(METHOD_LIMIT[0]) == "65535":
        spark.conf.set(*METHOD_LIMIT)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors must all see.

    Where that is unset, a local session gets a folder of its own; any other raises, because each executor
    would write to its own disk and readers would see a part of the data.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="hazelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps its written tables."""
    return f"{shared_folder(spark)}/hazelake/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run writes to."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that two readers see the same ones."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Remove this application's written tables, once nothing reads them any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
