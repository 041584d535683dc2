"""Operator 5, sharding by a hierarchical weighted hash tree.

Shards lie in racks, racks in regions; a node's weight is the sum of its shards' weights. A key draws a number for
each shard, -ln(u) / weight with u a hash of key and shard; a node's draw is the least one below it, so it is that
of a node of the summed weight. The key descends region, rack and shard level, each time to the child of the least
draw, which happens with a chance in proportion to the child's weight.

A shard's draws depend on its own number and weight only. So if weights change, rows move only out of shards whose
weight falls and into shards whose weight rises; a further shard takes rows only into itself, and subtrees without
a changed weight exchange none among each other. The draws of a key are as many as there are shards.

Law: key. A row's shard depends on its doc_id and the shards' weights only. Cases: a null doc_id is a key like
others. Rows with one doc_id share a shard. A null text counts as empty. Repeated rows get a slot each. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import mixed, utf8_crc32, written

SHARDS, RACK, REGION = 40, 4, 16


@dataclass(frozen=True)
class Tree:
    """Shards with weights, `rack` shards to a rack, `region` shards to a region."""

    weights: tuple[float, ...]
    rack: int = RACK
    region: int = REGION


#: Keys whose draws are made at once.
AT_ONCE = 4096


def _draws(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One number a key and shard, the less the greater the shard's weight; shards of weight 0 are never drawn."""
    salts = mixed(np.arange(1, len(weights) + 1, dtype=np.uint64))
    u = ((mixed(keys[:, None] ^ salts) >> np.uint64(11)).astype(float) + 1) / float(1 << 53)
    with np.errstate(divide="ignore"):
        return np.where(weights > 0, -np.log(u) / weights, np.inf)


def shard_of(keys: np.ndarray, tree: Tree) -> np.ndarray:
    """The shard of each 64-bit key."""
    weights, out = np.array(tree.weights, float), np.empty(len(keys), np.int64)
    for i in range(0, len(keys), AT_ONCE):
        draws = _draws(keys[i : i + AT_ONCE], weights)
        inside, low = draws, np.zeros(len(draws), np.int64)
        for width in (tree.region, tree.rack, 1):
            nodes = np.minimum.reduceat(inside, np.arange(0, len(weights), width), axis=1)
            low = np.argmin(nodes, axis=1) * width
            shard = np.arange(len(weights))
            inside = np.where((shard >= low[:, None]) & (shard < low[:, None] + width), draws, np.inf)
        out[i : i + AT_ONCE] = low
    return out


def shards(documents: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard, region, rack, slot of each row of documents (doc_id, text).

    Slots count from 0 in each shard. They are the row's number in its part (the shard's rows of one input
    task) after the rows of the shard's earlier parts, so that neither a shard nor a frequent doc_id has to
    meet in one task.
    """

    @F.pandas_udf("shard int, grown_shard int")
    def descended(keys: pd.Series) -> pd.DataFrame:
        k = mixed(keys.to_numpy().astype(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": shard_of(k, tree).astype("int32"), "grown_shard": shard_of(k, grown).astype("int32")})

    placed = documents.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), utf8_crc32().alias("text_crc32"),
        descended(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")))).alias("_to"), F.spark_partition_id().alias("_part"),
    )
    placed = written(placed.select("doc_id", "size", "text_crc32", "_to.shard", "_to.grown_shard", "_part"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = placed.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(starts, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", F.floor(F.col("shard") / tree.region).cast("int").alias("region"), F.floor(F.col("shard") / tree.rack).cast("int").alias("rack"),
        (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"),
    )
