"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_CUTS: dict[str, SparkSession] = {}  # tables written by this process and not deleted yet
_OWN: list[str] = []  # the folder of a local session that names none


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names. Where it names none, a local session (driver and executors in one
    process, as in tests) gets a temporary one; a cluster has to name it."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lattica-shared-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a
    lost executor costs a file read, not the stages before it. The table stays until drop()
    or release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    _CUTS[path] = spark
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _CUTS.pop(path, None)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of cut() that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if (path := getattr(df, "_cut_path", None)) in _CUTS:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all tables of cut() of a session, once results have been read or written."""
    for path in [p for p, s in _CUTS.items() if s is spark]:
        _delete(spark, path)
