"""Approximate nearest neighbours by shifted space-filling curves.

Each curve has its own projection and shift; a vector's place on it is its Hilbert key. Spark range-partitions the
keys, which gives every vector its rank on every curve. A query meets the vectors within a window of ranks on each
curve; the windows' best are merged and ranked by the exact distance.

The window is fitted: for a bounded sample of queries the true neighbours are found by a pass over all rows, and the
window is the least that holds the wanted share of them on some curve. So it is narrow where vectors cluster
and wide where they don't; on vectors without any structure it comes near a full scan, as it has to: a window of a fixed share of the ranks
at ten times the rows costs a hundred times the distances.

Equal vectors are one point with the least k + 1 of their ids, so a vector that many rows share costs no more than
any other, and ties by id are exact. Vectors that are null, zero, of another length than most, or with null or
non-finite components take no part; rows without an id neither. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, partitions, table

CURVES = 4
DIMS = 6
BITS = 8
#: Queries whose true neighbours the window is fitted to, and the share of these that it holds.
SAMPLE = 256
SHARE = 0.95
MOST_BLOCK = 16_384


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of integers below 2**bits, by undoing the curve's turns bit by bit."""
    x = x.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(d):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(up, x[0] ^ (q - 1), x[0] ^ t)
            if i:
                x[i] ^= t
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where(x[d - 1] & (1 << b), t ^ ((1 << b) - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b) & 1
    return key


class Curves:
    """Projections and shifts, fitted to the scale of a bounded sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(dims, width)
        self.bits, self.mean = bits, sample.mean(axis=0)
        self.axes = [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)]
        spread = [np.abs((sample - self.mean) @ a).max(axis=0) * 1.25 + 1e-12 for a in self.axes]
        self.scale = [(1 << bits) / (3 * s) for s in spread]
        self.shift = [s * (1.0 + rng.random(dims)) for s in spread]

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        return [hilbert(np.clip(((x - self.mean) @ a + h) * s, 0, (1 << self.bits) - 1), self.bits) for a, s, h in zip(self.axes, self.scale, self.shift, strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of each query's k nearest rows and all that tie with the last, by exact distances.

    Rows are first cut by |x|^2 - 2xy + |y|^2 around their mean; what that may be wrong by follows from the squares, and no row within
    it is cut. Distances are those of the vectors as they are.
    """
    if not len(rows) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who, which, k = [], [], min(k, len(rows))
    mean = rows.mean(axis=0)
    near, asked = rows - mean, queries - mean
    square, wrong = (near**2).sum(axis=1), 4e-16 * (rows.shape[1] + 8)
    loss = 4e-16 * (np.abs(rows).max() + np.abs(queries).max()) * np.sqrt(rows.shape[1])  # of taking the mean away
    for a in range(0, len(queries), 256):
        q = asked[a : a + 256]
        own = (q**2).sum(axis=1)[:, None]
        rough = square[None, :] - 2 * (q @ near.T) + own
        error = wrong * (square[None, :] + own) + 2 * loss * (np.sqrt(square)[None, :] + np.sqrt(own)) + loss**2
        kth = np.partition(rough + error, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(rough - error <= kth[:, None])
        who.append(i + a)
        which.append(j)
    who, which = np.concatenate(who), np.concatenate(which)
    score = np.sqrt(((queries[who] - rows[which]) ** 2).sum(axis=1))
    order = np.lexsort((score, who))
    who, which, score = who[order], which[order], score[order]
    last = np.searchsorted(who, np.arange(len(queries))) + k - 1  # every query has k rows at least
    keep = score <= score[last][who]
    return who[keep], ids[which[keep]], score[keep]


def _least(df: DataFrame, k: int) -> DataFrame:
    """The k best (score, rep) of each query; Spark limits each group before and after the shuffle."""
    best = Window.partitionBy("query").orderBy("score", "rep")
    return df.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).drop("at")


def search(vectors: DataFrame, is_query: Column, scratch: Scratch, k: int = 10, id: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows but itself, nearest first, ties to the smaller id."""
    spark = vectors.sparkSession
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("is_query")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    out = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("v") == width["w"])
    first = Window.partitionBy("v").orderBy("vec_id")
    points = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = scratch.save(points, "points")
    asked = scratch.save(rows.where("is_query").distinct().join(points.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep"), "asked")
    query_points = points.join(asked.select(F.col("rep").alias("r")).distinct(), F.col("rep") == F.col("r")).select("rep", "v")

    fitted = query_points.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
    if not fitted.num_rows:
        return spark.createDataFrame([], out)
    scale = points.select("rep", "v").orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(2000).toArrow()
    curves = Curves(_matrix(scale["v"]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for c, key in enumerate(curves.keys(_matrix(b.column("v")))):
                    yield pa.RecordBatch.from_pydict({"curve": pa.array(np.full(len(key), c, np.int32)), "key": pa.array(key), "rep": b.column("rep"), "v": b.column("v")})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            curve = b.column("curve").to_numpy()
            place = np.empty(len(curve), np.int64)
            for c in np.unique(curve):
                own = np.flatnonzero(curve == c)
                place[own] = np.arange(len(own)) + seen.get(int(c), 0)
                seen[int(c)] = seen.get(int(c), 0) + len(own)
            yield pa.RecordBatch.from_pydict({"curve": b.column("curve"), "part": pa.array(np.full(len(curve), part, np.int32)), "place": pa.array(place), "rep": b.column("rep"), "v": b.column("v")})

    on_curves = points.select("rep", "v").mapInArrow(keys, "curve int, key long, rep long, v array<double>").repartitionByRange(partitions(spark), "curve", "key").sortWithinPartitions("curve", "key", "rep")
    placed = scratch.save(on_curves.mapInArrow(numbered, "curve int, part int, place long, rep long, v array<double>"), "placed")
    # One count a curve and partition, so the sums fit anywhere.
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("curve", "part").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = placed.join(F.broadcast(base), ["curve", "part"]).select("curve", (F.col("base") + F.col("place")).alias("place"), "rep", "v")

    # The window: true neighbours of the sample, and how far off they are on the curve that has them nearest.
    sample_ids, sample = fitted["rep"].to_numpy(), _matrix(fitted["v"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                who, rep, score = nearest(sample, _matrix(b.column("v")), b.column("rep").to_numpy(), k + 1)
                yield pa.RecordBatch.from_pydict({"query": pa.array(sample_ids[who]), "rep": pa.array(rep), "score": pa.array(score)})

    true = _least(points.select("rep", "v").mapInArrow(exact, "query long, rep long, score double"), k + 1).where("query <> rep").select("query", "rep")
    from_, to = ranked.select("curve", "place", "rep").toDF("c", "p", "query"), ranked.select("curve", "place", "rep").toDF("c2", "p2", "rep")
    pairs = true.join(from_, "query").join(to, "rep").where("c = c2")
    off = np.sort(pairs.groupBy("query", "rep").agg(F.min(F.abs(F.col("p") - F.col("p2"))).alias("off")).toArrow()["off"].to_numpy())
    window = int(off[min(len(off) - 1, int(np.ceil(share * len(off))))]) if len(off) else 0
    block = int(np.clip(window, 256, MOST_BLOCK))

    held = ranked.withColumn("block", F.expr(f"place div {block}"))
    blocks = F.sequence(F.expr(f"greatest(0, place - {window}) div {block}"), F.expr(f"(place + {window}) div {block}"))
    asking = ranked.join(asked.select("rep").distinct(), "rep").select("curve", F.explode(blocks).alias("block"), F.col("rep").alias("query"), F.col("v").alias("q")).toDF("curve_", "block_", "query", "q")

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        who, rep, score = nearest(_matrix(theirs["q"]), _matrix(ours["v"]), ours["rep"].to_numpy(), k + 1)
        return pa.table({"query": pa.array(theirs["query"].to_numpy()[who]), "rep": pa.array(rep), "score": pa.array(score)})

    met = held.groupBy("curve", "block").cogroup(asking.groupBy("curve_", "block_")).applyInArrow(meet, "query long, rep long, score double")
    best = _least(met.distinct(), k + 1)
    # Back from points to rows: a point stands for k + 1 ids at most, a query never finds itself.
    own = asked.join(best, asked["rep"] == best["query"]).select("query_id", best["rep"].alias("rep"), "score")
    full = own.join(points.select("rep", "ids"), "rep").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Scratch(spark, "neighbours"))
