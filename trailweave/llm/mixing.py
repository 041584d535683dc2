"""Operator 2, mixing sources to target weights by systematic sampling.

Each source has a target in words; each of its documents is expected target / size of the source times. The
documents of a source lie in one order (smaller first, ties by a hash), their expected copies are summed along
it, one offset in [0, 1) of the source is added, and a document is taken once for each whole number that its
step crosses. Every document is then taken floor or ceil of its expected copies, twice at most.

The order's sum is made in three narrow steps, so that no task holds a source: counts per (source, size
class, salt), their running total in each source, and the row number within a part. Salts multiply with the
table, so a part stays below about a million rows.

Cases: a null text has size 0; documents of size 0 are never taken (taken 0) but stay in the result. A null
source is a source, the last one. Repeated rows are separate documents. A null doc_id is ordered first. An
empty table gives an empty result; sizes that are all 0 give targets of 0. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import WHITE, sent, text_or_empty, written

WEIGHTS = (5, 2, 1)
#: The mix's words as a share of all words; the most that a source gives, as a multiple of its words.
TOTAL, MOST = 1.5, 2.0
#: Rows that a part of a source's order has at most, about.
PART_ROWS = 1 << 20


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+")).cast("long")


def text_key(text: Column) -> Column:
    """A hash that tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """sizes (source, source_size), one row a source: adds target. min(weight * level, most * size) with the one level whose sum is total.

    The level comes from sums along the sources in the order in which they are capped; the table is as long as
    the list of sources, not as the documents.
    """
    nulls_last = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(nulls_last) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    capped_at = F.col("source_size") * most / F.col("_w")
    order = Window.orderBy("_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        ranked.withColumn("_at", capped_at)
        .withColumn("_all", F.sum("source_size").over(everything).cast("double") * total)
        .withColumn("_used", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_used")) / F.col("_left"))
        # the first source that isn't capped fixes the level; if every one is, none is needed
        .withColumn("_level", F.min(F.when(F.col("_level") < F.col("_at"), F.struct("_at", "source", "_level"))).over(everything)["_level"])
    )
    target = F.when(F.col("_level").isNull() | (F.col("_at") <= F.col("_level")), F.col("source_size") * most).otherwise(F.col("_w") * F.col("_level"))
    return summed.select("source", "source_size", target.alias("target"))


def _size_class(size: Column) -> Column:
    """Four classes for each doubling of the size, in the order of size."""
    binary = F.bin(size)
    return F.when(size < 8, size).otherwise(F.length(binary) * 4 + F.conv(F.substring(binary, 2, 2), 2, 10).cast("long"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 0) -> DataFrame:
    """doc_id, source, text_key, size, source_size, target, expected (copies), copies, taken (words) of each row of documents (doc_id, text, source)."""
    sized = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_key(F.col("text")).alias("text_key"), n_words(text_or_empty()).alias("size"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_tie")))
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most)
    rows = sized.count()
    digits = 1
    while 16**digits * PART_ROWS < rows:
        digits += 1
    part = ["source", "_class", "_salt"]
    parted = sized.withColumn("_class", _size_class(F.col("size"))).withColumn("_salt", F.substring("_tie", 1, digits))
    along = Window.partitionBy("source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    numbered = parted.withColumn("_row", F.row_number().over(Window.partitionBy(*part).orderBy("size", "_tie", "doc_id", "text_key")))
    d, s, t = numbered.alias("d"), starts.alias("s"), sent(sources).alias("t")
    same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._class") == F.col("s._class")) & (F.col("d._salt") == F.col("s._salt"))
    joined = d.join(s, same).join(t, F.col("d.source").eqNullSafe(F.col("t.source")))
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"offset{seed}"), F.coalesce(F.col("d.source"), F.lit("\x00")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rank = F.col("_start") + F.col("_row")
    crossed = F.floor(F.col("expected") * F.col("_rank") + F.col("_u")) - F.floor(F.col("expected") * (F.col("_rank") - 1) + F.col("_u"))
    return (
        joined.select("d.doc_id", "d.source", "d.text_key", "d.size", "t.source_size", "t.target", expected.alias("expected"), rank.cast("double").alias("_rank"), offset.alias("_u"))
        .withColumn("copies", F.least(F.ceil("expected"), crossed).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_rank", "_u")
    )
