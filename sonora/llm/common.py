"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python function holds as objects at once; texts can be long.
ROWS_AT_ONCE = 128
#: Rows that such a function has made and not yet handed on, if it is a generator.
ROWS_OUT = 65_536


#: Rows of an Arrow batch, which is whole in memory on both sides. Tables may be sorted by length, so that
#: a batch of Spark's usual 10,000 rows can hold long texts only.
ARROW_ROWS = 256


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after seeing to it that its session's Arrow batches have few rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder, which goes with the process.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives the loss of executors.

    An application's tables are in a folder of its own, to be removed when it has ended.
    """
    context = df.sparkSession.sparkContext
    path = f"{shared_folder(df.sparkSession)}/{context.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, rows: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Applies rows(), which turns a short list of tuples into output tuples, to Arrow batches of df.

    A task holds ROWS_AT_ONCE rows as Python objects, ROWS_OUT that were made of them and one Arrow batch, whatever
    the partition's size.
    """
    target = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                made = iter(rows(list(zip(*(c.to_pylist() for c in part.columns), strict=True))))
                while out := list(islice(made, ROWS_OUT)):
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return bounded_batches(df).mapInArrow(run, target)


#: Rows of a few numbers that are broadcast at most, some 20 MB.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table of narrow rows, marked for broadcast if it has so few rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df
