"""Operator 8, substring dedup by content-defined chunks.

A rolling gear hash runs over a text's bytes: h(i) = 2 h(i - 1) + gear(byte i), so that the last WINDOW bytes
decide it. A chunk ends before a word if the (mixed) hash of the bytes before the word is the least among those of
the RADIUS words before and after; so a chunk has RADIUS + 1 words at least, and 2 RADIUS + 1 on average. As only
the bytes around a cut decide it, an insertion moves no cut but those next to it. Chunks of one digest (of their words, joined by single spaces) are copies. A document's
chunk goes if its digest occurs earlier (smaller doc_id, then place) and if it is in a run of such chunks with
RUN_WORDS words or more: a long repeated passage, not a phrase that texts have in common by chance.

Cases: a null or empty text has no chunk and loses nothing. Rows with a null doc_id come last in the order.
Repeated rows (one doc_id, one text) are one document: they lose the same spans. A text without white space is
one chunk. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import lean, mixed, sent, written

RADIUS, WINDOW, RUN_WORDS = 2, 32, 20

_GEAR = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash of the WINDOW bytes up to and with each byte, modulo 2^32, by doubling the window."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def chunks(text: str, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, words) of each chunk; a chunk ends where the next one starts, the first starts at its first word."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    white = _WHITE[data]
    starts = np.flatnonzero(~white & np.r_[True, white[:-1]]) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, starts
    # mixed, as the lowest bits of a gear hash depend on the last bytes alone
    h = mixed(gear_hashes(data)[starts[1:] - 1])
    least = np.ones(len(h), bool)
    for d in range(1, radius + 1):
        least[d:] &= h[d:] < h[:-d]
        least[:-d] &= h[:-d] <= h[d:]
    cut = np.flatnonzero(least) + 1
    first = np.r_[0, cut]
    return starts[first], np.r_[starts[cut], len(data)], np.diff(np.r_[first, len(starts)])


def _digests(text: str, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    data = text.encode("utf-8", "surrogatepass")
    return [xxhash.xxh3_64_intdigest(b" ".join(data[s:e].split())) for s, e in zip(starts.tolist(), ends.tolist())]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, words, digests = [], [], []
        for text in b.column("text").to_pylist():
            s, e, w = chunks(text or "")
            rows.append((int(w.sum()), len(w)))
            words.append(w.astype(np.int32))
            digests.append(np.array(_digests(text or "", s, e), np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("doc_key"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.int64()))],
            ["doc_id", "doc_key", "n_words", "n_chunks", "words", "digests"],
        )


def repeated_spans(documents: DataFrame, run_words: int = RUN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(one row a row of documents: doc_id, doc_key, n_words, n_chunks; one a repeated span: doc_id, doc_key, first_chunk, last_chunk, first_word, span_words, first_docs)."""
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("doc_key"))
    rows = written(read.mapInArrow(lean(_chunked), "doc_id long, doc_key long, n_words long, n_chunks long, words array<int>, digests array<long>"))
    each = rows.select("doc_id", "doc_key", F.posexplode("digests").alias("at", "digest"))
    copied = each.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "at")
    copies = written(each.join(copied, "digest", "left_semi").withColumn("place", place))
    firsts = copies.groupBy("digest").agg(F.min("place").alias("first"))
    again = copies.join(firsts, "digest").where("place <> first")
    of_document = again.select("doc_id", "doc_key", "at", F.col("first.doc_id").alias("of")).distinct().groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_list(F.struct("at", "of"))).alias("found"))
    sizes = rows.select("doc_id", "doc_key", "words").dropDuplicates(["doc_id", "doc_key"])
    marked = of_document.alias("o").join(sizes.alias("s"), F.col("o.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("o.doc_key") == F.col("s.doc_key"))).select("o.doc_id", "o.doc_key", "o.found", "s.words")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            source = []
            for i, (found, words) in enumerate(zip(b.column("found").to_pylist(), b.column("words").to_pylist())):
                at = np.array([f["at"] for f in found], np.int64)
                ends = np.cumsum(words)
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                for run in np.split(np.arange(len(at)), cuts):
                    first, last = int(at[run[0]]), int(at[run[-1]])
                    begin = int(ends[first - 1]) if first else 0
                    if int(ends[last]) - begin >= run_words:
                        out.append((first, last, begin, int(ends[last]) - begin, sorted({found[r]["of"] for r in run if found[r]["of"] is not None})))
                        source.append(i)
            take = pa.array(source, pa.int64())
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("doc_key").take(take), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.list_(pa.int64()))], ["doc_id", "doc_key", "first_chunk", "last_chunk", "first_word", "span_words", "first_docs"])

    spans = marked.mapInArrow(runs, "doc_id long, doc_key long, first_chunk long, last_chunk long, first_word long, span_words long, first_docs array<long>")
    return rows.drop("words", "digests"), spans


def without_spans(documents: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """row (documents' own columns, with the repeated passages taken out of text), removed_words. A null text stays null."""
    _, spans = repeated_spans(documents, run_words)
    gone = spans.groupBy(F.col("doc_id").alias("of_id"), F.col("doc_key").alias("of_key")).agg(F.sort_array(F.collect_list(F.struct("first_word", "span_words"))).alias("gone"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if not s else _without(t, [(x["first_word"], x["span_words"]) for x in s]) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    key = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    held = documents.select(F.struct(*documents.columns).alias("held"), F.col("doc_id").cast("long").alias("mine"), key.alias("my_key"))
    both = held.join(sent(gone), F.col("mine").eqNullSafe(F.col("of_id")) & (F.col("my_key") == F.col("of_key")), "left")
    both = both.withColumn("left", cut(F.col("held.text"), F.col("gone")))
    row = F.struct(*[F.col("left").alias(c) if c == "text" else F.col("held").getField(c).alias(c) for c in documents.columns])
    return both.select(row.alias("row"), F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda n, s: n + s["span_words"]), F.lit(0).cast("long")).alias("removed_words"))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without spans of words (first, number), each with the white space behind it."""
    data = text.encode("utf-8", "surrogatepass")
    white = _WHITE[np.frombuffer(data, np.uint8)]
    starts = np.r_[np.flatnonzero(~white & np.r_[True, white[:-1]]), len(data)]
    kept, at = [], 0
    for first, number in spans:
        kept.append(data[at : starts[first]])
        at = starts[first + number]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def dedup_substrings(documents: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_words, n_chunks, repeated (whether it loses a passage), removed_words, spans (first word, words), first_docs (where they came first) of each row of documents (doc_id, text)."""
    rows, spans = repeated_spans(documents, run_words)
    by_document = spans.groupBy("doc_id", "doc_key").agg(
        F.sum("span_words").alias("removed_words"), F.sort_array(F.collect_list(F.struct("first_word", "span_words"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_docs")))).alias("first_docs")
    )
    both = rows.alias("r").join(by_document.alias("b"), F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.doc_key") == F.col("b.doc_key")), "left")
    return both.select(
        "r.doc_id", "r.n_words", "r.n_chunks", F.col("b.spans").isNotNull().alias("repeated"), F.coalesce("b.removed_words", F.lit(0)).cast("long").alias("removed_words"),
        F.coalesce("b.spans", F.array().cast("array<struct<first_word:bigint,span_words:bigint>>")).alias("spans"), F.coalesce("b.first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
    )
