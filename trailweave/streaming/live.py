"""Coverage of runs as they arrive: an addition for Spark, over append-only run files.

What a run has taken stays taken, so the state is one row an exit or path: a sum of runs. Matching is a fold
within a row and needs no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trailweave.functions.ids import path_key
from trailweave.operators.match import matched
from trailweave.sources.tables import TRACE_FILE, reading


def read_stream(spark: SparkSession, folder: str, pattern: str = "*.trace.json", files_at_once: int = 1000) -> DataFrame:
    rows = spark.readStream.schema(TRACE_FILE).option("multiLine", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).json(folder)
    return rows.withColumn("reading", reading(F.col("schemaVersion"), F.col("_corrupt_record"))).select("workflow", F.col("runId").alias("run_id"), F.col("testName").alias("test"), "status", F.coalesce("steps", F.array().cast("array<string>")).alias("steps"), "reading", F.try_to_timestamp("recordedAt").alias("recorded_at"))


def live_exits(runs: DataFrame, exits: DataFrame) -> DataFrame:
    """workflow, edge_id, taken: how often complete runs took each exit so far, before folding."""
    counted = matched(runs.where("reading = 'ok' and status = 'complete'"), exits).where("matched")
    return counted.select("workflow", F.explode("steps").alias("edge_id")).groupBy("workflow", "edge_id").agg(F.count(F.lit(1)).alias("taken"))


def live_paths(runs: DataFrame, exits: DataFrame) -> DataFrame:
    """workflow, path_key, runs: how often each path was taken so far."""
    counted = matched(runs.where("reading = 'ok' and status = 'complete'"), exits).where("matched")
    return counted.select("workflow", path_key(F.col("path"), F.col("end")).alias("path_key")).groupBy("workflow", "path_key").agg(F.count(F.lit(1)).alias("runs"))


def live_triage(runs: DataFrame, exits: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window, workflow, kind, runs: kinds of runs by the time they were recorded; runs later than `late` are left out."""
    kind = F.when(F.col("reading") != "ok", F.col("reading")).when(~F.col("known"), "unknown").when(F.col("status") != "complete", "incomplete").when(~F.col("matched"), "unmatched").otherwise("counted")
    rows = matched(runs, exits).withWatermark("recorded_at", late).withColumn("kind", kind)
    return rows.groupBy(F.window("recorded_at", window), "workflow", "kind").agg(F.count(F.lit(1)).alias("runs"))


def started(live: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> DataStreamWriter:
    """A writer of live counts into a folder, replaced with each batch."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    return live.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(replace)
