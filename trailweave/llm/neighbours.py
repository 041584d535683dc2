"""Operator 6, approximate nearest neighbours by a permutation index.

Some vectors (those of the smallest hashes) are pivots; their number grows with the square root of the number of
rows. A vector is represented by its NEAREST nearest pivots and posted in each of their inverted files. A query
orders all pivots from the nearest on, reads the files of the first of them, and takes every vector there by the
inner product on the original vectors: no candidate of a file is left out.

How many files are read is measured in each run, not fixed: SAMPLE queries are held against all vectors (one
linear pass), and the least number is taken that holds a share AIMED of their true neighbours. Clustered vectors
need few files. Vectors without any structure need about half of them at any size, so the work grows with the
square of the rows there; no index of this kind does it with less at that recall.

Equal vectors are one class; it is indexed once and answers with its smallest vec_ids, so a vector that a third of
all rows hold swells no file. Wherever classes are cut off, equal scores are ordered by a class's smallest vec_id, so
that of any number of ties those with the smallest vec_ids stay. Files of near pivots go into one bundle of about BLOCK vectors, a longer file is cut
into blocks, and the queries that read a bundle are cut into parts; a bundle and a part are a task's unit.

Cases: vectors that are null or zero, or hold a null or non-finite component, take no part, as queries or as
candidates; neither do vectors whose number of components isn't the most frequent one, nor null vec_ids. Equal
scores are ordered by vec_id. Repeated rows (one vec_id, one vector) count once. With fewer candidates than
asked for, a query gets all of them. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import written

TOP, NEAREST, BLOCK = 20, 2, 8192
SAMPLE, AIMED = 256, 0.95
LEAST_PIVOTS, MOST_PIVOTS = 64, 16384


def n_pivots(rows: int) -> int:
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(rows) // 2)))


def _sound(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(-1, width)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each vector, nearest first (by inner product with pivots of length 1)."""
    score = vectors @ pivots.T
    n = min(n, len(pivots))
    some = np.argpartition(-score, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1)


def best_of(held: np.ndarray, scores: np.ndarray, n: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The n best of each row: their values of held, and their scores; equal scores by least, if that is given."""
    if scores.shape[1] > n:
        some = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        if least is not None:
            last = np.take_along_axis(scores, some, 1).min(1)
            for i in np.flatnonzero(((scores >= last[:, None]).sum(1) > n) & (last > -np.inf)):  # a tie at the last place
                some[i] = np.lexsort((least[held[i]], -scores[i]))[:n]
        held, scores = np.take_along_axis(held, some, 1), np.take_along_axis(scores, some, 1)
    return held, scores


def alike(scores: np.ndarray) -> np.ndarray:
    """Scores without their last bits, in which equal sums differ that were added in another order."""
    part, power = np.frexp(scores)
    return np.ldexp(np.rint(part * 2.0**44) / 2.0**44, power)


def files_read(index: DataFrame, pivots: np.ndarray, width: int, top: int, sample: int = SAMPLE, aimed: float = AIMED) -> int:
    """How many files of its nearest pivots a query must read for a share aimed of its true neighbours, measured on sample queries."""
    taken = index.where("q").orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(sample).select("cls", "v").toArrow()
    if not len(taken):
        return 1
    asked = _matrix(taken["v"].combine_chunks(), width)
    order = nearest_pivots(asked, pivots, len(pivots))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(pivots))[None], 1)
    sent = index.sparkSession.sparkContext.broadcast((taken["cls"].to_pylist(), asked, place))

    def held_against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, place = sent.value
        number = {c: i for i, c in enumerate(names)}
        at, best = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        for b in batches:
            if not len(b):
                continue
            score = asked @ _matrix(b.column("v"), width).T
            own = np.array(b.column("nearest").to_pylist())
            for j, c in enumerate(b.column("cls").to_pylist()):
                if c in number:
                    score[number[c], j] = -np.inf
            first = place[:, own].min(2)
            at, best = best_of(np.hstack([at, first]), np.hstack([best, score]), top)
        who = np.repeat(np.arange(len(names)), at.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(at.ravel()), pa.array(best.ravel())], ["who", "at", "score"])

    found = index.select("cls", "v", "nearest").mapInArrow(held_against, "who long, at long, score double").where(F.col("score") > float("-inf"))
    true = found.withColumn("_n", F.row_number().over(Window.partitionBy("who").orderBy(F.desc("score")))).where(F.col("_n") <= top)
    at = np.sort(true.select("at").toArrow()["at"].to_numpy())
    return int(at[math.ceil(aimed * len(at)) - 1]) + 1 if len(at) else 1


def bundles(pivots: np.ndarray, sizes: dict[int, int], block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bundle of each pivot's file, and the number of its blocks, each a bundle then; near pivots share one."""
    seeds = pivots[: max(1, math.isqrt(len(pivots)))]
    first, blocks = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    at, room = -1, 0
    for p in np.argsort(np.argmax(pivots @ seeds.T, axis=1), kind="stable"):
        size = sizes.get(int(p), 0)
        if size > block:
            blocks[p] = -(-size // block)
            first[p] = at + 1
            at, room = at + int(blocks[p]), 0
            continue
        if size > room:
            at, room = at + 1, block
        first[p] = max(at, 0)
        room -= size
    return first, blocks


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP, near: int = NEAREST, block: int = BLOCK, aimed: float = AIMED) -> DataFrame:
    """query_id, rank, vec_id, score: the top candidates found for each query; vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & _sound(F.col("embedding")))
    widths = sound.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths["w"]
    sound = sound.where(F.size("v") == width).withColumn("cls", F.unhex(F.md5(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))))))
    rows = written(sound)
    ids = rows.select("cls", "vec_id").distinct()
    numbered = ids.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = Window.partitionBy("cls", "_part").orderBy("vec_id")
    # a class answers with its top + 1 smallest ids, found in parts first
    some = numbered.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= top + 1).groupBy("cls").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, top + 1).alias("ids"))
    asked = rows.where("q").select("cls").distinct().withColumn("q", F.lit(True))
    first_ids = ids.groupBy("cls").agg(F.min("vec_id").alias("least"))
    classes = rows.select("cls", "v").dropDuplicates(["cls"]).join(first_ids, "cls").join(asked, "cls", "left").withColumn("q", F.coalesce("q", F.lit(False)))
    classes = written(classes)
    n_classes = classes.count()
    chosen = classes.orderBy(F.xxhash64("cls"), "cls").limit(n_pivots(n_classes)).select("v").toArrow()
    pivots = _matrix(chosen["v"].combine_chunks(), width)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    held = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most
    near = min(near, len(pivots))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = nearest_pivots(_matrix(b.column("v"), width), held.value, near) if len(b) else np.zeros((0, near), np.int64)
            kept = [b.column(c) for c in ("cls", "v", "q", "least")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(found.astype(np.int32)), pa.list_(pa.int32()))], ["cls", "v", "q", "least", "nearest"])

    index = written(classes.mapInArrow(placed, "cls binary, v array<double>, q boolean, least long, nearest array<int>"))
    reads = files_read(index, pivots, width, top, aimed=aimed)
    sizes = {r.pivot: r["count"] for r in index.select(F.explode("nearest").alias("pivot")).groupBy("pivot").count().collect()}  # a row a pivot
    first, blocks = bundles(pivots, sizes, block)
    parts = max(1, math.ceil(classes.where("q").count() / block))
    small = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    sent = spark.sparkContext.broadcast((pivots, first, blocks))

    def asked_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, first, blocks = sent.value
        for b in batches:
            if not len(b):
                continue
            order = nearest_pivots(_matrix(b.column("v"), width), pivots, min(reads, len(pivots)))
            rows, wanted = [], []
            for i, own in enumerate(order):
                by: dict[int, list[int]] = {}
                for p in own.tolist():
                    for k in range(int(first[p]), int(first[p] + blocks[p])):
                        by.setdefault(k, []).append(p)
                rows += [i] * len(by)
                wanted += by.items()
            took = b.select(["cls", "small", "part"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array([k for k, _ in wanted], pa.int64()), pa.array([w for _, w in wanted], pa.list_(pa.int32()))], ["cls", "v", "part", "bundle", "wanted"])

    deal = lambda into: F.pmod(F.xxhash64("cls"), into).cast("int")
    asking = index.where("q").select("cls", "v", F.col("v").cast(f"array<{small}>").alias("small"), deal(F.lit(parts)).alias("part"))
    asking = asking.mapInArrow(asked_files, f"cls binary, v array<{small}>, part int, bundle long, wanted array<int>")
    # a row a pivot
    cut = F.broadcast(spark.createDataFrame([(i, int(f), int(n)) for i, (f, n) in enumerate(zip(first, blocks))], "pivot int, first long, blocks int"))
    posted = index.select("cls", "least", F.col("v").cast(f"array<{small}>").alias("v"), F.explode("nearest").alias("pivot")).join(cut, "pivot")
    posted = posted.select("cls", "least", "v", "pivot", (F.col("first") + deal(F.col("blocks"))).alias("bundle"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    several = (top + 1) * near

    def one_block(key: tuple, asking: pa.Table, posted: pa.Table) -> pa.Table:
        q, c = asking["cls"].to_pylist(), posted["cls"].to_pylist()
        out_q, out_c, out_s, out_l = [], [], [], []
        if q and c:
            qv, cv = _matrix(asking["v"].combine_chunks(), width), _matrix(posted["v"].combine_chunks(), width)
            wanted = asking["wanted"].combine_chunks()
            asker = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy())
            asked, own, least = wanted.flatten().to_numpy(), posted["pivot"].to_numpy(), posted["least"].to_numpy()
            at, best = np.zeros((len(q), several), np.int64), np.full((len(q), several), -np.inf)
            for p in np.unique(own):
                columns, rows = np.flatnonzero(own == p), asker[asked == p]
                for i in range(0, len(rows), 512):
                    some = rows[i : i + 512]
                    score = alike(qv[some] @ cv[columns].T)
                    here, score = best_of(np.broadcast_to(columns, score.shape), score, several, least)
                    at[some], best[some] = best_of(np.hstack([at[some], here]), np.hstack([best[some], score]), several, least)
            for i in range(len(q)):
                names: dict[bytes, tuple[float, int]] = {}  # a vector may stand in several files of a bundle
                for j in np.lexsort((least[at[i]], -best[i])):
                    if best[i, j] > -np.inf and len(names) <= top:
                        names.setdefault(c[at[i, j]], (best[i, j], least[at[i, j]]))
                out_q += [q[i]] * len(names)
                out_c += names
                out_s += [s for s, _ in names.values()]
                out_l += [n for _, n in names.values()]
        return pa.table({"query": pa.array(out_q, pa.binary()), "cls": pa.array(out_c, pa.binary()), "score": pa.array(out_s, pa.float64()), "least": pa.array(out_l, pa.int64())})

    found = asking.groupBy("bundle", "part").cogroup(posted.groupBy("bundle", "part")).applyInArrow(one_block, "query binary, cls binary, score double, least long")
    # equal pairs of classes come from several files; the sum of products is taken once more, in one order, for all
    best = found.groupBy("query", "cls").agg(F.max("score").alias("near"), F.min("least").alias("least"))
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "least"))).where(F.col("_n") <= top + 1 + 4)
    exact = best.select("query", "cls").join(index.select("cls", F.col("v").alias("cv")), "cls").join(index.select(F.col("cls").alias("query"), F.col("v").alias("qv")), "query")
    exact = exact.select("query", "cls", F.aggregate(F.zip_with("cv", "qv", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("score"))
    listed = exact.join(some, "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    short = listed.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= top + 1).select("query", "score", "vec_id")
    queries = rows.where("q").select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query")).distinct()
    answers = queries.join(short, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= top)
