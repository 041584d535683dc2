"""A training corpus from `documents`: five stages, each an operator of trailweave.llm over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of docs. Extra columns ride along; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import lines, minhash, mixing, packing, quality
from trailweave.llm.common import sent, table, written
from trailweave.llm.tokens import byte_bpe_50k


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go; fitted on the labelled ones among docs."""
    return quality.kept_documents(docs, *quality.trained(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go; so do documents that held words and have none left."""
    rows, text = lines.deduped(docs), F.col("row.text")
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & ~text.rlike(r"[^\x20\x09-\x0D]")
    return rows.where(~emptied | text.isNull()).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one text of the smallest doc_id stays, once. Rows without doc_id stay.

    Rows of one doc_id are judged by their own text; if several near texts have the smallest one, that of the least key stays.
    """
    texts = minhash.answers(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"))
    texts = written(texts.agg(F.bool_and("kept").alias("kept"), F.min("component").alias("component"), F.count(F.lit(1)).alias("rows")))
    chosen = texts.where("kept and component is not null").groupBy("component").agg(F.min("of_key").alias("chosen"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    texts = texts.join(sent(chosen), "component", "left").select("of_id", "of_key", "rows", (F.col("kept") & (F.col("chosen").isNull() | (F.col("of_key") == F.col("chosen")))).alias("kept"))
    texts = written(texts)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("of_id"), mixing.text_key(docs.text).alias("of_key"))
    left = keyed.join(sent(texts.where("not kept").select("of_id", "of_key")), ["of_id", "of_key"], "left_anti")
    several = written(texts.where("kept and rows > 1").select("of_id", "of_key"))
    if not several.isEmpty():
        once = left.join(several, ["of_id", "of_key"], "left_semi").dropDuplicates(["of_id", "of_key"])
        left = left.join(several, ["of_id", "of_key"], "left_anti").unionByName(once)
    return left.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Rows of one doc_id, source and text stand in for each other."""
    mixed = mixing.mix(docs).groupBy(F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.col("text_key").alias("of_key"))
    taken = sent(mixed.agg(F.sum("copies").cast("int").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("src"), mixing.text_key(docs.text).alias("key"))
    rows = keyed.join(taken, F.col("id").eqNullSafe(F.col("of_id")) & F.col("src").eqNullSafe(F.col("of_source")) & (F.col("key") == F.col("of_key")))
    if not taken.where("rows > 1").isEmpty():
        rows = rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates(["of_id", "of_source", "of_key"]))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 token ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return packing.pack(docs, byte_bpe_50k)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Models, hashes and token ids are not SQL's; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
