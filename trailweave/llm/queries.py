"""The registered queries of the operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import best_fit, chat, lines, minhash, mixing, neighbours, packing, periodic, quality, sharding, structure, substrings, suffix_tree
from trailweave.llm.common import table, text_or_empty
from trailweave.llm.tokens import byte_bpe_50k, word_bpe_49k


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), byte_bpe_50k)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.deduped(table(spark, sf_dir, "documents"), least=5, near=10)  # the bounds of its SQL
    return rows.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), "n_exact", "n_near", F.md5(text_or_empty("row.text")).alias("kept_md5"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return rows.select("conv_id", "speaker", "part", "n_turns", F.md5("rendered").alias("rendered_md5"), spans.alias("spans"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = lambda n: sharding.Tree((1.0,) * n)
    rows = sharding.shards(table(spark, sf_dir, "documents"), tree(sharding.SHARDS), tree(sharding.SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.content_rules(documents, *quality.trained(documents, table(spark, sf_dir, "labels")))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = suffix_tree.scores(documents, ~suffix_tree.held_out())
    return rows.select("doc_id", suffix_tree.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def digests_of_runs(found: DataFrame) -> DataFrame:
    """The columns of op11 from those of periodic.runs."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", (-F.col("longest.s")).alias("start"), F.col("longest.n").alias("length"), (-F.col("longest.p")).alias("period"),
        F.floor(1000 * F.col("longest.n") / -F.col("longest.p")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests_of_runs(periodic.runs(periodic.planted(table(spark, sf_dir, "documents"))))


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.reports(structure.damaged(table(spark, sf_dir, "conversations")))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit.pack(table(spark, sf_dir, "documents"), word_bpe_49k)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_lines": op3_lines,
    "op4_chat": op4_chat,
    "op5_sharding": op5_sharding,
    "op6_neighbours": op6_neighbours,
    "op7_quality": op7_quality,
    "op8_substrings": op8_substrings,
    "op9_scores": op9_scores,
    "op10_minhash": op10_minhash,
    "op11_periodic": op11_periodic,
    "op12_structure": op12_structure,
    "op13_best_fit": op13_best_fit,
    "pipeline": pipeline,
}
