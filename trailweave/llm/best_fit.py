"""Operator 13, best-fit packing: partitions pack on their own, what stays half empty is packed again up a tree.

A document is its token ids and END; only one longer than a sequence is cut, into pieces of a whole sequence and a rest.
Where the texts lie, a task takes them in blocks of BLOCK_TOKENS tokens at most (a longer document is a block of its
own) and puts the pieces of a block, longest first, each into the sequence with the least room that holds it. Sequences
with at most `spare` tokens of room are done. Of the others only number and fill are shuffled: as items of their fill
they are packed the same way in groups of FAN_IN blocks, then in groups of FAN_IN groups, until one group is left. A
group hands on its HANDED_ON emptiest sequences: two half-filled ones never stay in a group, as they would have been
joined, so each group has one at most that could still be placed elsewhere, and at a merge of FAN_IN groups no more
than FAN_IN hosts are needed; the emptiest are the ones that can be. So a group's items are bounded at every level, and
all others are answers as they are.

Texts are tokenised once and never shuffled; the ids are written beside their places, and only what the tree has moved
is looked up.

Cases: a null text is empty: its document is END alone. Repeated rows are separate documents. A null doc_id is like
others. Texts of any length are whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import lean, sent, written

LENGTH, END, SPARE = 2048, 0, 8
BLOCK_TOKENS, FAN_IN, HANDED_ON = 8_000_000, 8, 256
_PIECES = "doc_id long, piece int, start long, length long, ids binary, bin long, offset long, fill long, open boolean"
_MERGED = "node long, bin long, into long, place long, filled long, open boolean"


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in falling order, the bin of each, which has the least room that holds it, and its place there."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0  # bit r: a bin has room r
    made = 0
    for i, need in enumerate(lengths.tolist()):
        fitting = some >> need
        if fitting:
            left = need + (fitting & -fitting).bit_length() - 1
            at = with_room[left].pop()
            if not with_room[left]:
                some ^= 1 << left
        else:
            at, made, left = made, made + 1, room
        bins[i], places[i] = at, room - left
        with_room[left - need].append(at)
        some |= 1 << (left - need)
    return bins, places


def _falling(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each of lengths in any order, and the bins' fills."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins[order], places[order] = best_fit(lengths[order], room)
    fills = np.bincount(bins, weights=lengths).astype(np.int64) if len(bins) else np.empty(0, np.int64)
    return bins, places, fills


def _open(fills: np.ndarray, length: int, spare: int, handed_on: int) -> np.ndarray:
    """Which bins are handed on: of those with more than spare room the emptiest."""
    out = np.zeros(len(fills), bool)
    emptiest = np.argsort(fills, kind="stable")[:handed_on]
    out[emptiest] = fills[emptiest] < length - spare
    return out


def _local(tokens: Callable[[], object], length: int, end: int, spare: int, block_tokens: int, handed_on: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: pieces with their bins, block by block. Bins are numbered by partition, block and bin."""

    def packed(block: list[tuple[int | None, np.ndarray]], first: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(ids) for _, ids in block], np.int64)
        pieces = -(-sizes // length)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(length, sizes[doc] - piece * length)
        bins, places, fills = _falling(size, length)
        still = _open(fills, length, spare, handed_on)
        for lo in range(0, len(doc), 1000):
            part = slice(lo, lo + 1000)
            ids = [block[d][1][p * length : (p + 1) * length].tobytes() for d, p in zip(doc[part].tolist(), piece[part].tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array([block[d][0] for d in doc[part].tolist()], pa.int64()), pa.array(piece[part], pa.int32()), pa.array(piece[part] * length),
                pa.array(size[part]), pa.array(ids, pa.binary()), pa.array(first + bins[part]), pa.array(places[part]), pa.array(fills[bins[part]]), pa.array(still[bins[part]]),
            ], names=["doc_id", "piece", "start", "length", "ids", "bin", "offset", "fill", "open"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tail = tokens(), np.array([end], "<u4")
        # 24 bits for the partition, 20 for the block and 19 for the bin; a block has fewer bins than tokens / length * 2
        block, held, n, partition = [], 0, 0, TaskContext.get().partitionId()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), vocabulary.many(texts)):
                ids = np.concatenate([ids, tail])
                if block and held + len(ids) > block_tokens:
                    yield from packed(block, (partition << 39) + (n << 19))
                    block, held, n = [], 0, n + 1
                block.append((doc_id, ids))
                held += len(ids) + 16  # so that a block has not too many short ones either
        if block:
            yield from packed(block, (partition << 39) + (n << 19))

    return lean(work)


def _merged(length: int, spare: int, handed_on: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A function for applyInArrow: the bins of a group packed as items; open says which of them are handed on."""

    def one_group(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("fill", "descending"), ("bin", "ascending")])
        bins, fills = rows["bin"].to_numpy(), rows["fill"].to_numpy()
        into, places, filled = _falling(fills, length)
        hosts = np.full(len(filled), -1, np.int64)
        hosts[into[::-1]] = bins[::-1]  # a sequence takes the number of the first item in it
        still = _open(filled, length, spare, handed_on)
        return pa.table({
            "node": pa.array(np.full(len(bins), key[0].as_py(), np.int64)), "bin": pa.array(bins), "into": pa.array(hosts[into]), "place": pa.array(places),
            "filled": pa.array(filled[into]), "open": pa.array(still[into]),
        })

    return one_group


def _moves(bins: DataFrame, length: int, spare: int, fan_in: int, handed_on: int) -> DataFrame:
    """bin, sequence_id, place of the bins (bin, block, fill; all with room) that the tree puts into others."""
    groups, last, moves = bins.agg(F.countDistinct("block")).first()[0], False, None
    while groups and not last:
        groups = -(-groups // fan_in)
        last = groups == 1
        here = bins.select("bin", "fill", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("node"))
        found = written(here.groupBy("node").applyInArrow(_merged(length, spare, handed_on), _MERGED))
        new = found.where("into <> bin").select("bin", F.col("into").alias("sequence_id"), "place")
        if moves is None:
            moves = new
        else:  # what went into a bin moves with it
            to = new.select(F.col("bin").alias("_b"), F.col("sequence_id").alias("_to"), F.col("place").alias("_place"))
            along = moves.join(to, moves.sequence_id == to["_b"], "left")
            along = along.select("bin", F.coalesce("_to", "sequence_id").alias("sequence_id"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"))
            moves = along.unionByName(new)
        moves = written(moves)
        bins = found.where("open and into = bin").select("bin", F.col("filled").alias("fill"), F.col("node").alias("block"))
    return moves


def pack(documents: DataFrame, tokens: Callable[[], object], length: int = LENGTH, end: int = END, spare: int = SPARE, block_tokens: int = BLOCK_TOKENS, fan_in: int = FAN_IN, handed_on: int = HANDED_ON) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids (their token ids), sequence_id, offset of documents (doc_id, text).

    tokens() gives, on the machine where it is called, something whose many(texts) are the token ids of each. spare: the room that a
    sequence may have to be done before the end.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(texts.mapInArrow(_local(tokens, length, end, spare, block_tokens, handed_on), _PIECES), "zstd")
    part = F.shiftright("bin", 19).alias("block")
    moves = _moves(pieces.where("open and offset = 0").select("bin", part, "fill"), length, spare, fan_in, handed_on)
    columns = ("doc_id", "piece", "start", "length", "ids")
    if moves is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    placed = pieces.join(sent(moves), "bin", "left")
    offset = F.col("offset") + F.coalesce("place", F.lit(0))
    return placed.select(*columns, F.coalesce("sequence_id", "bin").alias("sequence_id"), offset.alias("offset"))
