"""Tables that an analysis writes once and reads several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of policies and calibrators up to this many bytes (of JSON) are sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share; only a local session gets a folder of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and still there if executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame) -> DataFrame:
    """table, marked for broadcast if its rows were measured to take BROADCAST_BYTES at most; else the join shuffles."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table
