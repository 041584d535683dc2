"""Operator 9, language-model scores by a probabilistic suffix tree.

Symbols are the UTF-8 bytes of a text's words (A-Z in lower case) joined by single spaces, and one end; before a
text stand ends only. A context is up to DEPTH symbols before the next one.

Learning: all (DEPTH + 1)-grams of all training texts are counted, first in each task, then by a shuffle; counts
of shorter contexts are sums of longer ones. A pair (context, next symbol) counts in the tree if it was seen
LEAST times, at any size of the corpus. The upper levels of the tree are tables that grow with it, each made from
the one before by a join; the last two are made from these where all grams of one ending of a context are together
(see chances). They also hold the grams of the texts to score. The tree starts with the empty context; a longer one is retained if its parent (without its first symbol) is and its
next symbols diverge from its parent's: count * KL divergence >= DIVERGENCE. A retained context's distribution
is smoothed by its parent's, which weighs SMOOTHING times the number of its next symbols.
Scoring: each symbol's probability comes from the longest retained suffix of what stands before it. The most
frequent grams (SENT_GRAMS at most) are sent to the executors with their probabilities, the most frequent of them where
a lookup looks first; all others are joined by a shuffle. Texts are worked on a slice at once: its bytes are read as
numbers at each symbol, its words as numbers of its distinct words, so no word is a Python object but the distinct ones.

The base score counts words. Words with at least a share HEAD_SHARE of all tokens (at most 1 / HEAD_SHARE of
them) are sent to the executors; all others are joined by a shuffle.

Cases: a null text is empty: it has one token, the end. Without training texts every count is 0 and every symbol
has the probability 1 / 257. Null doc_ids are held out (the crc32 of an empty text is 0). Repeated rows count and
are scored each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import lean, released, written

DEPTH, LEAST, DIVERGENCE, SMOOTHING = 6, 2, 1.0, 20.0
#: Grams, the most frequent ones, that are sent to the executors.
SENT_GRAMS = 1_500_000
HEAD_SHARE = 1e-6
#: Levels, the deepest ones, that are made with all grams of one ending of a context together: 256^(DEEP + 1) at most.
DEEP = 2
#: Grams of whole endings that a task works on at once.
TOGETHER = 300_000
#: Distinct entries that a task gathers before it hands them on.
GATHERED = 4_000_000
#: Symbols scored at once: what is made for them stays in a processor's cache.
AT_ONCE = 1 << 17
_END = b"\n"  # the end: white space, so no word holds it
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b" " * 5)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def joined(text: bytes | None) -> bytes:
    """words_of a text of UTF-8 bytes, joined by single spaces."""
    text = (text or b"").translate(_PLAIN)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.strip(b" ")


def _joined(batch: pa.RecordBatch) -> list[bytes]:
    return [joined(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]


def grams(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The last depth + 1 symbols at each symbol of the texts, the next symbol in the lowest byte; the number of symbols of each text."""
    return _grams([b" ".join(w) for w in texts], depth)


def _grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """grams of joined texts; depth is 6 at most."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = b"".join([bytes(7 - depth), *(part for t in texts for part in (_END * depth, t, _END))])
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    # eight bytes from each place on, the symbol last: the first number is that of the first text's first symbol
    key = np.ndarray(len(data) - 7, ">u8", data, strides=(1,)).astype(np.uint64)
    key &= np.uint64((1 << 8 * (depth + 1)) - 1)
    scored = np.ones(len(key), bool)
    ends = np.cumsum(sizes + depth)[:-1] - depth  # where those before a later text begin
    scored[(ends[:, None] + np.arange(depth)).ravel()] = False
    return key[scored], sizes


def _numbered(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """The distinct words of joined texts; of each word of the texts its number there; the number of words of each text."""
    data = b" ".join([*filter(None, texts), b""])  # a space behind each word
    ends = np.r_[0, np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1].astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return pc.binary_slice(words.dictionary, 0, -1), words.indices.to_numpy(), np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _gram_counts(depth: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = _merged(held)
            held.clear()
            for i in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000].view(np.int64)), pa.array(counts[i : i + 200_000])], ["gram", "n"])

        for b in batches:
            texts, trains = _joined(b), b.column("trains").to_pylist()
            held.append(np.unique(_grams([t for t, x in zip(texts, trains) if x], depth)[0], return_counts=True))
            others = np.unique(_grams([t for t, x in zip(texts, trains) if not x], depth)[0])
            held.append((others, np.zeros(len(others), np.int64)))
            if sum(len(k) for k, _ in held) > GATHERED:
                merged = _merged(held)
                held[:] = [merged]
                if len(merged[0]) > GATHERED * 2 // 3:
                    yield from out()
        if held:
            yield from out()

    return count


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    most = GATHERED // 3

    def merge() -> None:
        held[:] = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])]

    for b in batches:
        texts = _joined(b)
        words, number, _ = _numbered(texts)
        held.append(pa.table({"word": words, "n": np.bincount(number, minlength=len(words)).astype(np.int64)}))
        held.append(pa.table({"word": pa.array([_END], pa.binary()), "n": np.array([len(texts)], np.int64)}))
        if sum(map(len, held)) > most:
            merge()
            if len(held[0]) > most * 2 // 3:
                yield from held.pop().to_batches(100_000)
    if held:
        merge()
        yield from held.pop().to_batches(100_000)


class Lookup:
    """An open-addressing table from 64-bit keys (not 0) to numbers, for arrays of keys at once.

    Of several keys that belong in one place, the last one given gets it; so the keys that are asked for most stand last.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, load: float = 0.6):
        size = max(16, int(len(keys) / load))
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.float32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several keys for a place the last stays
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) % size

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Lookup:
        """The table whose keys and values, by places, were taken from another."""
        self = cls.__new__(cls)
        self.keys, self.values = keys, values
        return self

    def _home(self, keys: np.ndarray) -> np.ndarray:
        home = keys * np.uint64(0x9E3779B97F4A7C15)
        home >>= np.uint64(32)
        home *= np.uint64(len(self.keys))
        home >>= np.uint64(32)
        return home.view(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the key was found."""
        at = self._home(keys)
        found = self.keys.take(at) == keys
        todo = np.flatnonzero(~found)
        todo = todo[self.keys[at[todo]] != 0]
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.keys)
            held = self.keys[at[todo]]
            here = held == keys[todo]
            found[todo] = here
            todo = todo[(held != 0) & ~here]
        return self.values.take(at), found


def _tagged(key: np.ndarray, depth: int) -> np.ndarray:
    return key | np.uint64(depth + 1 << 56)


@dataclass
class SuffixTree:
    """log10 probabilities of retained (context, symbol) pairs by depth, and what each retained context leaves to its parent."""

    depth: int
    pairs: np.ndarray
    pair_logs: np.ndarray
    contexts: np.ndarray
    context_logs: np.ndarray
    root: np.ndarray

    def scorer(self):
        """A function from grams (the depth + 1 last symbols) to log10 probabilities."""

        def tables(keys: np.ndarray, values: np.ndarray) -> list[Lookup]:  # one a depth: the short contexts' ones are small
            depths = (keys >> np.uint64(56)).astype(np.int64) - 1
            return [Lookup(keys[depths == d], values[depths == d]) for d in range(self.depth + 1)]

        pair, rest = tables(self.pairs, self.pair_logs), tables(self.contexts, self.context_logs)

        def score(keys: np.ndarray) -> np.ndarray:
            parts = [few(keys[i : i + AT_ONCE]) for i in range(0, len(keys), AT_ONCE)]
            return np.concatenate(parts) if parts else np.zeros(0)

        def few(keys: np.ndarray) -> np.ndarray:
            total, left, now = np.zeros(len(keys)), np.arange(len(keys)), keys
            for d in range(self.depth, 0, -1):
                now = now & np.uint64((1 << 8 * (d + 1)) - 1)
                value, found = pair[d](_tagged(now, d))
                total[left[found]] += value[found]
                left, now = left[~found], now[~found]
                value, found = rest[d](_tagged(now >> np.uint64(8), d))
                total[left[found]] += value[found]
            total[left] += self.root[(now & np.uint64(255)).astype(np.int64)]
            return total

        return score


def learned(levels: list[tuple[np.ndarray, np.ndarray]], divergence: float = DIVERGENCE, smoothing: float = SMOOTHING) -> SuffixTree:
    """levels[d]: (context of d symbols * 256 + next symbol, count), of all symbols at depth 0."""
    chance = np.full(256, 0.5)
    chance[levels[0][0].astype(np.int64)] += levels[0][1]
    chance /= chance.sum() * 257 / 256  # the 257th part is for no symbol: bytes that UTF-8 never holds are possible too
    root = np.log10(chance)
    pairs, pair_chances, contexts, context_logs = [], [], [], []
    empty = np.zeros(0, np.uint64)

    def find(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table[0]):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(table[0], key), len(table[0]) - 1)
        return table[1][at], table[0][at] == key

    tables: list = [((empty, np.zeros(0)), (empty, np.zeros(0)))]

    def parent_chance(d: int, key: np.ndarray) -> np.ndarray:
        """The chance of each pair's symbol after its context's last d symbols."""
        if d == 0:
            return chance[(key & np.uint64(255)).astype(np.int64)]
        key = key & np.uint64((1 << 8 * (d + 1)) - 1)
        value, found = find(tables[d][0], key)
        share, retained = find(tables[d][1], key >> np.uint64(8))
        return np.where(found, value, np.where(retained, share, 1.0) * parent_chance(d - 1, key))

    for d in range(1, len(levels)):
        key, n = levels[d]
        if not len(key):
            tables.append(((empty, np.zeros(0)), (empty, np.zeros(0))))
            continue
        order = np.argsort(key)
        key, n = key[order], n[order].astype(float)
        context = key >> np.uint64(8)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        kinds = np.diff(np.r_[first, len(key)])
        total = np.add.reduceat(n, first)
        low = parent_chance(d - 1, key)
        diverges = np.add.reduceat(n * np.log(n / np.repeat(total, kinds) / low), first)
        keep = diverges >= divergence
        if d > 1:
            keep &= find(tables[d - 1][1], context[first] & np.uint64((1 << 8 * (d - 1)) - 1))[1]
        weight = smoothing * kinds
        rows = np.repeat(keep, kinds)
        value = ((n + np.repeat(weight, kinds) * low) / np.repeat(total + weight, kinds))[rows]
        share = (weight / (total + weight))[keep]
        tables.append(((key[rows], value), (context[first][keep], share)))
        pairs.append(_tagged(key[rows], d))
        pair_chances.append(value)
        contexts.append(_tagged(context[first][keep], d))
        context_logs.append(np.log10(share))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return SuffixTree(len(levels) - 1, join(pairs, np.uint64), np.log10(join(pair_chances, float)), join(contexts, np.uint64), join(context_logs, float), root)


def tree_of(training: DataFrame, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, smoothing: float = SMOOTHING) -> SuffixTree:
    """The whole tree of training (text) in memory, for small corpora; scores() makes the same as tables."""
    level = written(training.select("text", F.lit(True).alias("trains")).mapInArrow(lean(_gram_counts(depth)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    levels = []
    for d in range(depth, -1, -1):
        if d < depth:
            level = level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
            level = written(level)
        frequent = level.where(F.col("n") >= (least if d else 1)).toArrow()
        levels.append((frequent["gram"].to_numpy().view(np.uint64), frequent["n"].to_numpy()))
    return learned(levels[::-1], divergence, smoothing)


def _deep(depth: int, upper: int, least: int, divergence: float, smoothing: float):
    """For mapInArrow: rows in order of their context's last `upper` symbols, full grams with n, and the pairs of level `upper` with low and n = -2 (retained) or -1."""

    def endings(gram: np.ndarray) -> np.ndarray:
        return (gram >> 8) & ((1 << 8 * upper) - 1)

    def worked(gram: np.ndarray, n: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        is_known = n < 0
        full, counts = gram[~is_known], n[~is_known]
        order = np.argsort(gram[is_known])
        above, lows, retained = gram[is_known][order], low[is_known][order], n[is_known][order] == -2
        for d in range(upper + 1, depth + 1):
            keys, place = np.unique(full & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
            times = np.bincount(place, weights=counts, minlength=len(keys))
            parent = np.searchsorted(above, keys & ((1 << 8 * d) - 1))  # each one is there
            lows, retained = lows[parent], retained[parent]
            seen = times >= least
            context = keys >> 8
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            pairs = np.diff(np.r_[first, len(keys)])
            in_tree = np.where(seen, times, 0.0)
            total, weight = np.add.reduceat(in_tree, first), smoothing * np.add.reduceat(seen.astype(float), first)
            diverges = np.add.reduceat(in_tree * np.log(np.where(seen, times, 1.0) / lows), first) - total * np.log(np.maximum(total, 1.0))
            retained = retained & np.repeat((total > 0) & (diverges >= divergence), pairs)
            total, weight = np.repeat(total, pairs), np.repeat(weight, pairs)
            lows = np.where(retained, (in_tree + weight * lows) / np.maximum(total + weight, 1e-300), lows)
            above = keys
        return pa.RecordBatch.from_arrays([pa.array(above), pa.array(times.astype(np.int64)), pa.array(np.log10(lows))], ["gram", "n", "log"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, enough = 0, TOGETHER

        def out(all_rows: bool) -> Iterator[pa.RecordBatch]:
            """Hands on what is whole; the last ending may have more rows to come."""
            nonlocal rows, enough
            gram, n, low = (np.concatenate(x) for x in zip(*held))
            ending = endings(gram)
            before = np.flatnonzero(ending != ending[-1])
            cut = len(gram) if all_rows else int(before[-1]) + 1 if len(before) else 0
            if cut:
                made = worked(gram[:cut], n[:cut], low[:cut])
                yield from (made.slice(i, 50_000) for i in range(0, len(made), 50_000))
            held[:] = [[gram[cut:], n[cut:], low[cut:]]]
            rows = len(gram) - cut
            enough = max(TOGETHER, 2 * rows)

        for b in batches:
            if len(b):
                held.append([b.column(i).to_numpy() for i in range(3)])
                rows += len(b)
                if rows >= enough:
                    yield from out(False)
        if rows:
            yield from out(True)
        released()

    return work


def chances(texts: DataFrame, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, smoothing: float = SMOOTHING) -> tuple[DataFrame, int]:
    """gram, n, log of all full grams of texts (text, trains): its count in the training texts, log10 of its probability; the symbols trained on.

    An upper level's table has, of each pair (context, next symbol), the probability of the symbol after the longest
    retained suffix of the context, and whether the context is retained itself. A longer pair's parent is the pair
    without its first symbol, so a level needs one join with the one before and sums over each context's pairs.
    Pairs of the last DEEP levels share the ending of their context, and their ancestors, so these come together by it once.
    """
    full = written(texts.mapInArrow(lean(_gram_counts(depth)), "gram long, n long").repartition("gram").groupBy("gram").agg(F.sum("n").alias("n")))  # a task's grams are distinct: counting begins behind the shuffle
    upper = depth - DEEP if depth > DEEP else depth
    levels = [full] if upper == depth else []
    for d in range(upper - len(levels), -1, -1):
        cut = F.col("gram").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("gram")
        levels.append(written((levels[-1] if levels else full).groupBy(cut).agg(F.sum("n").alias("n"))))
    levels.reverse()
    symbols = {r.gram: r.n for r in levels[0].collect()}  # 256 rows at most
    chance = np.full(256, 0.5)
    for symbol, n in symbols.items():
        chance[symbol] += n
    chance /= chance.sum() * 257 / 256  # the 257th part is for no symbol
    made = texts.sparkSession.createDataFrame([(i, float(x), True) for i, x in enumerate(chance)], "parent long, low double, held boolean")
    if depth == 0:
        return full.join(F.broadcast(made.withColumnRenamed("parent", "gram")), "gram").select("gram", "n", F.log10("low").alias("log")), sum(symbols.values())
    for d in range(1, upper + 1):
        pairs = levels[d].select("gram", "n", F.col("gram").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("parent"), F.shiftrightunsigned("gram", 8).alias("context"))
        seen, over = F.when(F.col("n") >= least, F.col("n").cast("double")), Window.partitionBy("context")
        rows = pairs.join(made.select("parent", "low", "held"), "parent").select("gram", "n", "context", "low", "held", seen.alias("seen"))
        rows = rows.select("*", F.sum("seen").over(over).alias("total"), F.count("seen").over(over).alias("kinds"), F.sum(F.col("seen") * F.log(F.col("seen") / F.col("low"))).over(over).alias("sum"))
        held = F.coalesce(F.col("held") & (F.col("sum") - F.col("total") * F.log("total") >= divergence), F.lit(False))
        weight = smoothing * F.col("kinds")
        value = (F.coalesce("seen", F.lit(0.0)) + weight * F.col("low")) / (F.col("total") + weight)
        rows = rows.select("gram", "n", held.alias("held"), F.when(held, value).otherwise(F.col("low")).alias("low"))
        made = written(rows).select(F.col("gram").alias("parent"), "n", "low", "held")
    if upper < depth:
        known = made.select(F.col("parent").alias("gram"), F.when(F.col("held"), -2).otherwise(-1).cast("long").alias("n"), "low")
        ending = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * upper) - 1))
        rows = full.select("gram", "n", F.lit(0.0).alias("low")).unionAll(known).repartition(ending).sortWithinPartitions(ending)
        return written(rows.mapInArrow(_deep(depth, upper, least, divergence, smoothing), "gram long, n long, log double")), sum(symbols.values())
    return made.select(F.col("parent").alias("gram"), "n", F.log10("low").alias("log")), sum(symbols.values())


def _least_sent(grams: DataFrame, most: int) -> int:
    """A count that at most `most` grams have or exceed, from the numbers of grams by classes of counts, eight a doubling."""
    by_class = F.floor(F.log2(F.col("n") + 1) * 8)
    rows = grams.groupBy(by_class.alias("c")).agg(F.count(F.lit(1)).alias("grams"), F.min("n").alias("least")).orderBy(F.desc("c")).collect()
    least, so_far = max((r.least for r in rows), default=0) + 1, 0
    for r in rows:
        so_far += r.grams
        if so_far > most:
            return least
        least = r.least
    return least


def scores(documents: DataFrame, training: DataFrame | Column, depth: int = DEPTH, head_share: float = HEAD_SHARE, sent_share: float | None = None, sent_grams: int = SENT_GRAMS, **tree: float) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of documents (doc_id, text).

    Learned from training (text), or from those documents for which training, a condition, holds. Grams with at least
    a share sent_share of all symbols are sent to the executors, or else the sent_grams most frequent ones.
    """
    if isinstance(training, Column):
        texts = documents.select("text", F.coalesce(training, F.lit(False)).alias("trains"))
        training = documents.where(training)
    else:
        texts = documents.select("text", F.lit(False).alias("trains")).unionAll(training.select("text", F.lit(True).alias("trains")))
    spark = documents.sparkSession
    counts = written(training.select("text").mapInArrow(lean(_word_counts), "word binary, n long").repartition("word").groupBy("word").agg(F.sum("n").alias("n")))
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(2, math.ceil(tokens * head_share))
    head = counts.where(F.col("n") >= least).toArrow()
    whole = math.log10(tokens + 0.1 * (distinct + 1))
    known = dict(zip(head["word"].to_pylist(), (math.log10(n + 0.1) - whole for n in head["n"].to_pylist())))
    if tokens and _END not in known:  # the end is a head word at any count
        n = counts.where(F.col("word") == F.lit(_END)).first()
        known[_END] = math.log10(n.n + 0.1) - whole
    unknown = -1.0 - whole
    logs_of, symbols = chances(texts, depth, **tree)
    often = F.col("n") >= (_least_sent(logs_of, sent_grams) if sent_share is None else max(1, math.ceil(symbols * sent_share)))
    sent = logs_of.where(often).select("gram", "log", F.col("n").cast("float").alias("n")).toArrow()
    order = np.argsort(sent["n"].to_numpy(), kind="stable")
    frequent = Lookup(_tagged(sent["gram"].to_numpy().view(np.uint64)[order], depth), sent["log"].to_numpy()[order])
    model = spark.sparkContext.broadcast((known, frequent.keys, frequent.values))
    del sent, order, frequent

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        logs, frequent = model.value[0], Lookup.of(*model.value[1:])
        end = logs.get(_END)
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            texts = _joined(b)
            keys, sizes = _grams(texts, depth)
            value, found = np.empty(len(keys), np.float32), np.empty(len(keys), bool)
            for i in range(0, len(keys), AT_ONCE):
                value[i : i + AT_ONCE], found[i : i + AT_ONCE] = frequent(_tagged(keys[i : i + AT_ONCE], depth))
            value[~found] = 0
            starts = np.cumsum(sizes) - sizes
            total = np.add.reduceat(value, starts, dtype=float)
            offsets = np.r_[0, np.cumsum(np.add.reduceat(~found, starts, dtype=np.int64))]
            others = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[~found].view(np.int64)))
            words, number, n = _numbered(texts)
            value = np.fromiter(map(logs.get, words.to_numpy(zero_copy_only=False), repeat(math.nan)), float, len(words))[number]
            in_head, text = ~np.isnan(value), np.repeat(np.arange(len(n)), n)
            base = np.bincount(text, np.where(in_head, value, unknown), len(n)) + (unknown if end is None else end)
            tail, times = np.unique(text[~in_head] * len(words) + number[~in_head], return_counts=True)
            of_text, tail = np.divmod(tail, max(1, len(words)))
            offsets = pa.array(np.searchsorted(of_text, np.arange(len(n) + 1)), pa.int32())
            rare, times = pa.ListArray.from_arrays(offsets, words.take(pa.array(tail))), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))
            rows = pa.array(range(row, row + len(n)), pa.int64())
            row += len(n)
            in_head = np.bincount(text[in_head], minlength=len(n)) + (end is not None)
            yield pa.RecordBatch.from_arrays(
                [rows, b.column("doc_id"), pa.array(n + 1), pa.array(in_head, pa.int64()), pa.array(base), pa.array(total), rare, times, others],
                ["row", "doc_id", "n_tokens", "in_head", "base", "score", "rare", "times", "others"],
            )

    schema = "row long, doc_id long, n_tokens long, in_head long, base double, score double, rare array<binary>, times array<long>, others array<long>"
    scored = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(score), schema))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    gains = rare.join(counts.where(F.col("n") < least), "word").groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) + 1)).alias("gain"), F.sum("times").alias("in_tail"))
    others = scored.select("row", F.explode("others").alias("gram")).join(logs_of.where(~often).select("gram", "log"), "gram")
    rest = others.groupBy("row").agg(F.sum("log").alias("rest"))
    return scored.drop("rare", "times", "others").join(gains, "row", "left").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("in_head") + F.coalesce("in_tail", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def held_out() -> Column:
    """Whether a document is kept from training: the remainder by 10 of crc32 of doc_id as text is 0."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0
