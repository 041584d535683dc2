"""The tables that the operators read: decision maps and recorded runs; a strict reader of run files.

exits:   workflow, edge_id, junction_id, kind, label, ord, is_retry, to_kind, to_id, only_edge
         One row an exit. to_kind is junction, end, retry or dead; to_id the junction, the end or the retry's
         edge. only_edge is the one exit that may follow on this road. START is the exit before the first
         decision.
traces:  workflow, run_id, steps, and what else a query needs (test, status, function_hash, recorded_at ...)
Maps are small and are joined by broadcast where Spark finds them so; runs are what grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXITS = "workflow string, edge_id string, junction_id string, kind string, label string, ord int, is_retry boolean, to_kind string, to_id string, only_edge string"
START = "START"
VERSION = 2

TRACE_FILE = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()), T.StructField("tool", T.StringType()), T.StructField("workflow", T.StringType()), T.StructField("package", T.StringType()),
    T.StructField("functionHash", T.StringType()), T.StructField("status", T.StringType()), T.StructField("steps", T.ArrayType(T.StringType())), T.StructField("workflowId", T.StringType()),
    T.StructField("runId", T.StringType()), T.StructField("recorder", T.IntegerType()), T.StructField("recordedAt", T.StringType()), T.StructField("testName", T.StringType()),
    T.StructField("conditions", T.ArrayType(T.StringType())), T.StructField("_corrupt_record", T.StringType()),
])


def exits(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, EXITS)


def read_traces(spark: SparkSession, folder: str, pattern: str = "*.trace.json") -> DataFrame:
    """Run files of a folder, one JSON object each; `reading` is ok, older-format, unreadable. A missing folder holds no runs."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        none = spark.createDataFrame([], TRACE_FILE).withColumns({"file": F.lit(""), "modified": F.lit(None).cast("timestamp")})
        return none.withColumns({"reading": F.lit("ok"), "recorded_at": F.lit(None).cast("timestamp")})
    rows = spark.read.schema(TRACE_FILE).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(folder)
    rows = rows.withColumn("file", F.col("_metadata.file_path")).withColumn("modified", F.col("_metadata.file_modification_time"))
    return rows.withColumn("reading", reading(F.col("schemaVersion"), F.col("_corrupt_record"))).withColumn("recorded_at", F.try_to_timestamp("recordedAt"))


def reading(version: Column, corrupt: Column | None = None) -> Column:
    """What a file's version and damage make of it."""
    damaged = version.isNull() if corrupt is None else version.isNull() | corrupt.isNotNull()
    return F.when(damaged, "unreadable").when(version == VERSION, "ok").when((version >= 1) & (version < VERSION), "older-format").otherwise("unreadable")


def older_than(traces: DataFrame, age: str, now: Column | None = None) -> DataFrame:
    """Files older than an age such as 30m, 12h or 7d; to delete them is the caller's work."""
    seconds = int(age[:-1]) * {"m": 60, "h": 3600, "d": 86400}[age[-1]]
    return traces.where(F.col("modified") < (F.current_timestamp() if now is None else now) - F.make_dt_interval(secs=F.lit(seconds)))
