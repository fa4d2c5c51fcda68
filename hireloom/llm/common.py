"""Shared helpers: the scratch folder, word patterns, tables of the corpus."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir.

    Only where a session on one machine names none (tests), a temporary folder
    is made and set as the session's checkpoint folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='hireloom-')}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/hireloom/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def saved(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the scratch folder and read again.

    The result has no lineage but the files, so a lost executor costs the
    reading of a file and not the work before it.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def forget(df: DataFrame) -> None:
    """Remove what saved() wrote for df, once nothing reads it any more."""
    if path := getattr(df, "_scratch_path", None):
        remove(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has a column of."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_hash(*cols: Column | str) -> Column:
    """128 bits as a struct of two 64-bit xxhash values."""
    return F.struct(F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *cols).alias("h2"))


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5: the split of the labelled and training rows."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5
