"""Session helpers: importability on workers, the shared folder, cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it was not shipped with --py-files."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests), and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"rasterloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


_FOLDERS: dict[str, str] = {}
_WRITTEN: list[str] = []


def _folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; the driver's JVM deletes it when it ends."""
    app = spark.sparkContext.applicationId
    at = f"{shared_dir(spark)}/{app}"
    if _FOLDERS.get(app) != at:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS[app] = at
    return at


def written() -> int:
    """A mark for clear(): how many tables cut() has written so far."""
    return len(_WRITTEN)


def clear(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables that cut() wrote after the mark `since`, but for the last `keep`. Nothing may read them any more."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for at in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it again: later stages don't recompute it, and a lost executor costs nothing but its own tasks. The table stays until clear() or the application's end."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)
