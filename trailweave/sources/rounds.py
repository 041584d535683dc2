"""Tables between the rounds of a job: written in the folder that all executors share, so that lineage stays short."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values (those in arrays and maps too) up to which Spark may choose to send a written table through the driver to all executors.
SENT_VALUES = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local sessions without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trailweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df as a written table; the folder goes with the session.

    Rows of maps take up to a hundred times their file's size, by which Spark judges what to broadcast. So a table of more than
    SENT_VALUES values is joined by a shuffle.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rounds/{uuid.uuid4().hex}"
    seen = Observation()
    values = [F.coalesce(F.size(f.name), F.lit(0)) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.lit(1) for f in df.schema.fields]
    df.observe(seen, F.sum(reduce(Column.__add__, values)).alias("values")).write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if (seen.get["values"] or 0) > SENT_VALUES else table
