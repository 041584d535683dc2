r"""Operator 4, chat formatting by perspective rotation.

For every participant of a conversation, the dialogue is rendered with that speaker as the assistant and all
others as named users; the mask lists the spans of the assistant's words, on which alone a model is trained.
A turn is its head (<|assistant|>, <|user:NAME|> or <|system|>), a line feed, its text and <|end|>. In names and
texts a backslash is doubled and <| is written <\|, so no text can pass for a head and all can be read back.

A conversation is cut into parts of PART_TURNS turns, each rendered in a row of its own, with offsets of its own.
Turns are numbered over the table's whole order (a range partitioning by conversation and turn, and sums of the
partitions' counts), so that a conversation which holds a third of all rows isn't gathered in a task.

Cases: turns lie in the order of turn (null last), then role, then text. A null role is the name "unknown", a
null text is empty. Repeated rows count once. Rows with a null conv_id are one conversation. The roles of
`systems` speak but are no participants; a conversation without participants gives no row. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import written

PART_TURNS, SYSTEMS, END = 128, ("system",), "<|end|>"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with `at`, the turn's number in its conversation from 0."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    ranged = written(turns.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    # the order in a range, then the ranges before it: at most as many rows as conversations and ranges meet
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("_n")).withColumn("start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), "start")
    own = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order[1:])))
    joined = own.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r")))
    return joined.select("conv_id", "turn", "role", "text", (F.col("start") + F.col("_row") - 1).alias("at"))


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
    """conv_id, speaker, part, n_turns, rendered, spans (start, end: characters of rendered) of turns (conv_id, turn, role, text)."""
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    numbered = written(_numbered(plain))
    parts = numbered.withColumn("part", F.floor(F.col("at") / part_turns)).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    speakers = numbered.where(~F.col("role").isin(*systems)).select(F.col("conv_id").alias("_c"), F.col("role").alias("speaker")).distinct()
    rows = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    def head(role: Column) -> Column:
        return F.when(role == F.col("speaker"), "<|assistant|>\n").when(role.isin(*systems), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user:"), _escaped(role), F.lit("|>\n")))

    pieces = F.transform("turns", lambda t: F.struct(head(t["role"]).alias("head"), _escaped(t["text"]).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    rows = rows.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    long = lambda x: F.length(x).cast("long")

    def step(so_far: Column, p: Column) -> Column:
        begin = so_far["at"] + long(p["head"])
        stop = begin + long(p["body"])
        span = F.array(F.struct(begin.alias("start"), stop.alias("end")))
        return F.struct((stop + len(END) + 1).alias("at"), F.when(p["own"], F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    spans = F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return rows.select("conv_id", "speaker", "part", "n_turns", rendered.alias("rendered"), spans.alias("spans"))
