"""Operator 1, packing: first-fit decreasing over a tournament tree of bin capacities, in random groups.

A document is its token ids and END. Pieces of whole sequences are cut off its front; the rest is one piece. In
each group the pieces, longest first, go to the first sequence with room, which a tournament tree (each node
the largest room below it) finds in logarithmic time. Sequences that stay emptier than MAX_PADDING are cut
into lengths that are powers of two, which need no padding.

A group has about GROUP_DOCS documents or GROUP_CHARS characters, whichever are fewer; documents come to it by
a hash of doc_id and their place in the input, so a frequent doc_id doesn't swell a group. Tokens are made
where they are packed, so only texts are shuffled.

Cases: a null text is empty: its document is END alone. Repeated rows are separate documents. A null doc_id is
like others. A text longer than a group's share is a group's work alone and is never cut short. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import released

LENGTH, END = 1024, 0
GROUP_DOCS, GROUP_CHARS, MAX_PADDING = 4096, 4_000_000, 16


def first_fit(lengths: np.ndarray, room: int) -> np.ndarray:
    """For lengths in falling order, the bin of each: the first that has room."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [room] * (2 * leaves)
    out = np.empty(n, np.int64)
    for i, need in enumerate(lengths.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        out[i] = at - leaves
        tree[at] -= need
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left > right else right
    return out


def packed_group(documents: list[np.ndarray], length: int = LENGTH, max_padding: int = MAX_PADDING) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences from 0."""
    sizes = np.array([len(d) for d in documents], np.int64)
    full = sizes // length
    document = np.repeat(np.arange(len(sizes)), full + (sizes % length > 0))
    first = np.r_[0, np.cumsum(np.bincount(document, minlength=len(sizes)))[:-1]]
    start = (np.arange(len(document)) - first[document]) * length
    size = np.minimum(length, sizes[document] - start)
    order = np.argsort(-size, kind="stable")
    document, start, size = document[order], start[order], size[order]
    sequence = first_fit(size, length)
    by = np.argsort(sequence, kind="stable")
    out, at, new = [], -1, 0
    fill = np.bincount(sequence, weights=size).astype(int) if len(sequence) else []
    new = len(fill)
    parts: list[int] = []
    used = 0
    for d, s, n, q in zip(*(x[by].tolist() for x in (document, start, size, sequence))):
        if q != at:
            at, used = q, 0
            left = int(fill[q])
            parts = [left]
            if length - left > max_padding and left & (left - 1):
                parts = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
            target = q
        while n:
            if used == parts[0]:
                parts, used = parts[1:], 0
                target, new = new, new + 1
            cut = min(n, parts[0] - used)
            out.append((d, s, cut, target, used))
            s, n, used = s + cut, n - cut, used + cut
    return out


def pack(documents: DataFrame, tokens: Callable[[], object], length: int = LENGTH, end: int = END, group_docs: int = GROUP_DOCS, group_chars: int = GROUP_CHARS, max_padding: int = MAX_PADDING, seed: int = 0) -> DataFrame:
    """Pieces: doc_id, start, length, ids (their token ids), doc_tokens, sequence_id, offset of documents (doc_id, text).

    tokens() gives, on the machine where it is called, something whose ids(text) are token ids. Sequences are
    numbered by group: group * 2^32 + number.
    """
    rows, chars = documents.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    groups = max(1, -(-rows // group_docs), -(-chars // group_chars))
    slots = F.pmod(F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups))

    def one_group(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")]))
        vocabulary, tail = tokens(), np.array([end], "<u4")
        ids = [np.concatenate([vocabulary.ids(t.as_py() or ""), tail]) for t in rows["text"]]
        pieces = packed_group(ids, length, max_padding)
        at = pa.array([p[0] for p in pieces], pa.int64())
        released()
        return pa.table({
            "doc_id": rows["doc_id"].take(at), "start": pa.array([p[1] for p in pieces], pa.int64()), "length": pa.array([p[2] for p in pieces], pa.int64()),
            "ids": pa.array([ids[d][s : s + n].tobytes() for d, s, n, _, _ in pieces], pa.binary()), "doc_tokens": pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
            "sequence_id": pa.array([(key[0].as_py() << 32) + p[3] for p in pieces], pa.int64()), "offset": pa.array([p[4] for p in pieces], pa.int64()),
        })

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", slots.alias("_group")).groupBy("_group").applyInArrow(
        one_group, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
