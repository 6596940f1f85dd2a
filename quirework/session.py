"""Session helpers: tuned defaults and the shared working folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "quirework", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume (UTC, adaptive plans)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update(conf)
    for k, v in defaults.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the folder named by ``spark.checkpoint.dir``, deleted when the application ends.

    The cluster owns that setting, and without it a cluster run is refused: executors could not see each other's files.  Only
    a session in one process (``local[...]``) gets a folder of its own under /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"/tmp/spark-{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    system, folder = _folder(spark, path)
    system.deleteOnExit(folder)
    return path


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own making; one that is not there is no error."""
    system, folder = _folder(spark, path)
    system.delete(folder, True)


def materialise(df, purpose: str):
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    lets several consumers reuse one evaluation even when executors are lost."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
