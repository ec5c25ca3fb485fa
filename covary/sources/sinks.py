"""Result tables and intermediate ones: written under a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the context's checkpoint folder; a local session without either (as in tests) gets a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = sc._jsc.sc().getCheckpointDir()
        base = at.get() if at.isDefined() else None
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = sc.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-")
        base = f"file://{_own[app]}"
    return base.rstrip("/")


def results_dir(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, read back: what several results derive from is computed once, and survives lost executors."""
    path = results_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Appends rows, partitioned by the given columns; a folder's rows are all of one schema."""
    out = df.write.mode("append")
    (out.partitionBy(*by) if by else out).parquet(path)


def replace_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)
