"""Operator 10, near duplicates by circulant MinHash, banding and exact Jaccard similarity.

A shingle is a hash of five neighbouring words (of all words, if fewer). One permutation sigma places the
shingles of a document on a circle of UNIVERSE places; coordinate k of the signature is the least value that
the other permutation pi, turned by k, has at those places. BANDS bands of ROWS coordinates give the keys of
buckets; a pair of similarity s shares no bucket with the chance (1 - s^5)^50, about one in a million at 0.75.

Documents of one shingle set form a class, which is one node. Candidates are verified on full sets:
1. each member of a bucket against the bucket's leader. Links make components.
2. members of buckets that still hold several components, against the buckets' most central members.
3. what is still apart, by an exact join on rare shingles: of two similar sets the rarest common shingle stands
   early in both, counted from the rarest one. So only these few are posted, by classes of sizes, and a pair comes
   out only if the sizes and what lies behind the shingle in both sets leave room for the overlap that a link needs.
Pairs inside one component need no test, so no link that matters is lost, and neither a large group of copies, nor
texts that vary one template, nor those around a frequent passage are expanded into all their pairs.

Cases: without words or text a document has no shingle and is its own component. Rows with a null doc_id are
linked with nothing: component_id is null and kept is true. Repeated rows have equal answers. Rows that share
a doc_id but not a text are answered by their text. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import lean, mixed, written
from trailweave.llm.components import components, joined
from trailweave.llm.mixing import text_key

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, UNIVERSE = 50, 5, 1 << 20
#: Holders of a key that one task compares with all others of it.
BLOCK = 1024
#: Words whose hashes a Python worker remembers.
REMEMBERED = 100_000

_POWERS = mixed(np.arange(1, SHINGLE + 2, dtype=np.uint64)) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    wide = min(n, SHINGLE)
    total = np.full(n - wide + 1, 0 if wide == SHINGLE else wide, np.uint64) * _POWERS[-1]
    for i in range(wide):
        total += h[i : n - wide + 1 + i] * _POWERS[i]
    return np.unique(mixed(total))


@lru_cache(1)
def _circle(universe: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    sigma, pi = rng.permutation(universe).astype(np.int32), rng.permutation(universe).astype(np.int32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:size]]), size)


def signature(found: np.ndarray, size: int = BANDS * ROWS, universe: int = UNIVERSE) -> np.ndarray:
    sigma, turned = _circle(universe, size)
    places = sigma[(found % np.uint64(universe)).astype(np.int64)]
    out = np.full(size, universe, np.int32)
    for i in range(0, len(places), 1024):
        np.minimum(out, turned[places[i : i + 1024]].min(axis=0), out=out)
    return out


def band_keys(sign: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = sign.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(parts.shape[1]):
        key = mixed(key ^ parts[:, i]) + np.uint64(i)
    return key.view(np.int64)


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digests, keys = [], [], []
        for text in b.column("text").to_pylist():
            found = shingles(text or "")
            n.append(len(found))
            digests.append(digest(found) if len(found) else None)
            keys.append(band_keys(signature(found)) if len(found) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "digest", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [shingles(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([digest(f) for f in found], pa.binary()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], ["digest", "items"])


def _ranked(sets: DataFrame) -> DataFrame:
    """node, n, own (number of shingles that no other of these sets has), found (its other shingles, the rarest first) of each set."""
    items = sets.select("node", F.explode("items").alias("key"))
    frequent = items.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = items.join(frequent, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("found"))
    return sets.select("node", F.size("items").alias("n")).join(shared, "node").select("node", "n", (F.col("n") - F.size("found")).alias("own"), F.transform("found", lambda f: f["key"]).alias("found"))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(1.08)).cast("int")


def _postings(ranked: DataFrame) -> DataFrame:
    """key, node, n, at, small: the rarest shingles of each set, with their places in it, by the sizes of the sets they may link it with.

    Two similar sets of sizes m <= n share (m + n) * 75 / 175 shingles at least. So their rarest common one stands
    before all but that many of either, and a partner's size bounds how far in a set it may stand. A set is posted
    as the smaller one under its own class of sizes, and as the larger one under every class that a smaller
    partner can have if this shingle is their rarest common one.
    """
    n, at = F.col("n"), F.col("own") + F.col("_at")
    least = F.ceil(n * PERCENT / 100)
    rows = ranked.where(F.col("own") <= n - least).select("node", "n", "own", F.posexplode(F.slice("found", F.lit(1), (n - least + 1 - F.col("own")).cast("int"))).alias("_at", "of"))
    rows = rows.select("of", "node", "n", at.alias("at"))
    key = lambda size_class: F.xxhash64("of", size_class).alias("key")
    left, most = n - F.col("at"), F.lit(100 + PERCENT)
    small = rows.where(most * left >= 2 * PERCENT * n).select(key(_size_class(n)), "node", "n", "at", F.lit(True).alias("small"))
    largest = F.least(n, F.floor(most * left / PERCENT) - n)
    large = rows.where(largest >= least).select(F.explode(F.sequence(_size_class(least), _size_class(largest))).alias("_c"), "of", "node", "n", "at")
    return small.union(large.select(key(F.col("_c")), "node", "n", "at", F.lit(False).alias("small")))


def _by_postings(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be similar by their sizes and the places of a common shingle.

    The holders of a key with many of them are dealt to blocks, so that no task holds them all.
    """
    dealt = written(_several_components(postings, labels).withColumn("blocks", F.ceil(F.col("holders") / BLOCK).cast("int")))
    x = dealt.where("small").select("key", F.col("node").alias("a"), F.col("n").alias("_na"), F.col("at").alias("_ia"), F.col("label").alias("_la"), (F.col("label") == F.col("top")).alias("_ta"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    y = dealt.where("not small").select("key", F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("at").alias("_ib"), F.col("label").alias("_lb"), (F.col("label") == F.col("top")).alias("_tb"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    left = F.least(F.col("_na") - F.col("_ia"), F.col("_nb") - F.col("_ib"))
    fits = (100 * F.col("_na") >= PERCENT * F.col("_nb")) & ((100 + PERCENT) * left >= PERCENT * (F.col("_na") + F.col("_nb")))
    smaller = (F.col("_na") < F.col("_nb")) | ((F.col("_na") == F.col("_nb")) & (F.col("a") < F.col("b")))

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        on = (x.key == y.key) & (x.block == y.block) & (F.col("_la") != F.col("_lb")) & smaller & fits
        return x.join(y, on).select("a", "b")

    return joined(x.where("not _ta"), y).union(joined(x.where("_ta"), y.where("not _tb")))


def _similar_sizes(m: Column, n: Column) -> Column:
    """Whether sets of these sizes may be linked."""
    return 100 * F.least(m, n) >= PERCENT * F.greatest(m, n)


def _once(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with a < b, each once."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose sets are similar."""
    one, two = sets.select(F.col("node").alias("a"), F.col("items").alias("_one")), sets.select(F.col("node").alias("b"), F.col("items").alias("_two"))
    common = F.size(F.array_intersect("_one", "_two"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("_common"), (F.size("_one") + F.size("_two")).alias("_sizes"))
    return both.where(100 * F.col("_common") >= PERCENT * (F.col("_sizes") - F.col("_common"))).select("a", "b")


def _with_leaders(members: DataFrame) -> DataFrame:
    """Pairs (a, b): each of members (key, node, n) with its bucket's leader, drawn by a hash, if their sizes allow a link."""
    leaders = members.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.xxhash64("key", "node")).alias("leader"))
    met = members.join(leaders, "key").where((F.col("node") != F.col("leader.node")) & _similar_sizes(F.col("n"), F.col("leader.n")))
    return met.select(F.col("node").alias("a"), F.col("leader.node").alias("b"))


def _central(members: DataFrame, ranked: DataFrame) -> DataFrame:
    """Pairs (a, b): each member of an open bucket with the bucket's most central members of other components than its own.

    Central are those with the least share of shingles of their own, one among all and one among those outside the
    largest component: around a text that many vary, the least varied one is similar to all that any of them is similar to.
    """
    share = members.join(ranked.select("node", F.struct(F.col("own") / F.col("n"), "node").alias("_share")), "node")
    who, outside = F.struct("node", "label", "n"), F.col("label") != F.col("top")
    leads = share.groupBy("key").agg(F.array(F.min_by(who, "_share"), F.min_by(F.when(outside, who), F.when(outside, F.col("_share")))).alias("found"))
    leads = leads.select("key", F.explode(F.array_distinct(F.array_compact("found"))).alias("lead"))
    met = members.join(leads, "key").where((F.col("label") != F.col("lead.label")) & _similar_sizes(F.col("n"), F.col("lead.n")))
    return met.select(F.col("node").alias("a"), F.col("lead.node").alias("b"))


def _several_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Of members (key, node, more) those of keys whose nodes are of several components; with label, the key's largest component (top), and its number of holders."""
    labelled = written(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_n"))
    split = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("_parts"), F.max_by("label", F.struct("_n", "label")).alias("top"), F.sum("_n").alias("holders")).where("_parts > 1").drop("_parts")
    return labelled.join(split, "key")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of documents (doc_id, text)."""
    return answers(documents).select("doc_id", "n_shingles", "component_id", "kept")


def answers(documents: DataFrame) -> DataFrame:
    """near_duplicates with text_key and component: components of unlike texts differ even where their least doc_id is one."""
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    rows = written(read.mapInArrow(lean(_signed), "doc_id long, text_key long, n long, digest binary, keys array<long>"))
    known = rows.where("doc_id is not null and n > 0")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    firsts = known.join(classes.select("digest", F.col("rep").alias("doc_id"), "node"), ["digest", "doc_id"]).dropDuplicates(["node"])
    members = firsts.select("node", "n", F.explode("keys").alias("key"))
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    shared = written(members.join(several, "key", "left_semi"))
    pairs = written(_once(_with_leaders(shared)))
    paired = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(shared.select("node")).distinct()
    wanted = written(paired.join(classes, "node").select("node", "digest", F.col("rep").alias("doc_id")))
    texts = read.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(lean(_sets), "digest binary, items array<long>").join(wanted.select("node", "digest"), "digest").select("node", "items").dropDuplicates(["node"]))
    labels = components(_links(pairs, sets))

    # the buckets that several components share: first against their most central members, then all by rare shingles
    open_ = written(_several_components(shared, labels))
    undecided = sets.join(open_.select("node").distinct(), "node", "left_semi")
    ranked = written(_ranked(undecided))
    tried = pairs
    more = written(_once(_central(open_, ranked)).join(tried, ["a", "b"], "left_anti"))
    labels, tried = joined(labels, _links(more, sets)), tried.union(more)
    more = written(_once(_by_postings(_postings(ranked), labels)).join(tried, ["a", "b"], "left_anti"))
    labels = joined(labels, _links(more, sets))

    least = labels.join(classes, "node").groupBy("label").agg(F.min("rep").alias("component_id"))
    found = classes.join(labels, "node", "left").join(least, "label", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("label", "node").alias("component"))
    out = rows.drop("keys").join(found, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
