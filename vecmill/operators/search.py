"""Exact and compressed-domain nearest neighbours.

The base stays where it is: queries (or their look-up tables) go to its partitions in
passes of bounded size, each task scores its rows in tiles of bounded size and hands on
its k best for every query, and a window merges them. Results are min(k, base rows) a
query, equal distances (6 digits) by id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import RESULT, matrix, merge_best, squared_distances
from .quantizers import Quantizer

TILE = 1 << 19  # scores that a task holds at once


def merge_top_k(found: DataFrame, k: int) -> DataFrame:
    """qid, rank (int, from 1), vec_id, score: the k least scores of each query."""
    order = Window.partitionBy("qid").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")


def block_size(block: int, k: int) -> int:
    """At most so many queries a block that their results take 16 MB, too."""
    return max(1, min(block, (1 << 20) // k))


def query_blocks(queries: DataFrame, size: int, id_col: str, vector: str):
    """The queries in blocks of at most ``size``, one at a time on the driver: ids and rows."""
    rows = queries.select(F.col(id_col).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("q is not null and v is not null").toLocalIterator(prefetchPartitions=True)
    ids, vectors = [], []
    for r in rows:
        ids.append(r["q"])
        vectors.append(r["v"])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def _size(payload) -> int:
    return payload.nbytes if isinstance(payload, np.ndarray) else sum(map(_size, payload))


def passes(blocks, most: int = 64 << 20, k: int = 0):
    """Blocks of queries in lists of about ``most`` bytes, with k results (ids and scores) for each query: what
    one pass over the base takes along."""
    now, size = [], 0
    for block in blocks:
        more = _size(block[1]) + 16 * k * len(block[0])
        if now and size + more > most:
            yield now
            now, size = [], 0
        now.append(block)
        size += more
    if now:
        yield now


def _rows(payload, start: int, stop: int):
    return payload[start:stop] if isinstance(payload, np.ndarray) else [t[start:stop] for t in payload]


def best_of_task(batches, blocks, prepare, kernel, k: int, tile: int = TILE):
    """Record batches of the k least scores of each query over all Arrow batches of a task. Queries are scored
    ``tile`` // rows at a time, so that neither many queries nor large batches make large tables of scores."""
    best = [(np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)) for ids, _ in blocks]
    for b in batches:
        if not b.num_rows:
            continue
        rows, x = b["vec_id"].to_numpy(zero_copy_only=False), prepare(b)
        step = max(1, tile // b.num_rows)
        for i, ((ids, payload), (s, v)) in enumerate(zip(blocks, best)):
            had = s.shape[1]
            more = ((0, 0), (0, min(k, had + b.num_rows) - had))
            if more[1][1]:
                s, v = best[i] = np.pad(s, more), np.pad(v, more)
            for at in range(0, len(ids), step):
                own = slice(at, at + step)
                s[own], v[own] = merge_best(kernel(x, _rows(payload, at, at + step)), rows, (s[own, :had], v[own, :had]), k)
    for (ids, _), (s, v) in zip(blocks, best):
        for at in range(0, len(ids) if s.size else 0, 1024):
            own = slice(at, at + 1024)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[own], s.shape[1])), pa.array(v[own].ravel()), pa.array(s[own].ravel())], ["qid", "vec_id", "score"])


def _over_blocks(base: DataFrame, blocks, prepare, kernel, k: int) -> DataFrame:
    """kernel(prepare(batch), payload) for each Arrow batch of the base and each block; one pass over the base
    for as many blocks as 64 MB hold. Tasks are a few for each core, as each hands on k rows for every query."""
    spark, parts = base.sparkSession, []
    for some in passes(blocks, k=k):
        sent = spark.sparkContext.broadcast(some)  # bounded by the pass

        def run(batches, sent=sent):
            yield from best_of_task(batches, sent.value, prepare, kernel, k)

        parts.append(base.coalesce(max(32, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(run, RESULT))
    if not parts:
        return spark.createDataFrame([], "qid long, rank int, vec_id long, score double")
    return merge_top_k(reduce(DataFrame.unionAll, parts), k)


def exact_top_k(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """qid, rank, vec_id and dist (squared, of metric l2) or score (inner product, of metric dot)."""
    if k <= 0:
        raise ValueError("k must be positive")
    src = base.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")

    def kernel(x, q):
        return -(q @ x.T) if metric == "dot" else squared_distances(q, x)

    found = _over_blocks(src, query_blocks(queries, block_size(block, k), id_col, vector), lambda b: matrix(b["v"]), kernel, k)
    return found.select("qid", "rank", "vec_id", (-F.col("score")).alias("score")) if metric == "dot" else found.withColumnRenamed("score", "dist")


def ground_truth(base: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """Exact neighbours for evaluation; k must be within the base."""
    n = base.count()
    if not 0 < k <= n:
        raise ValueError(f"k must be from 1 to {n}")
    return exact_top_k(base, queries, k, **options)


def _codes(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b["codes"].flatten()).reshape(b.num_rows, -1)


def _lookup(codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(tables[0]), len(codes)))
    for g, t in enumerate(tables):
        out += t[:, codes[:, g]]
    return out


def adc_top_k(model: Quantizer, codes: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """qid, rank, vec_id, dist: queries as they are against coded vectors. Residual codes are decoded batch by batch."""
    residual = model.stages > 1

    def blocks():
        for ids, q in query_blocks(queries, block_size(block, k), id_col, vector):
            yield ids, (model.transform(q) if residual else model.lut(q))

    prepare, kernel = (lambda b: model.rotated(_codes(b)), lambda x, q: squared_distances(q, x)) if residual else (_codes, _lookup)
    return _over_blocks(codes.select("vec_id", "codes"), blocks(), prepare, kernel, k).withColumnRenamed("score", "dist")


def sdc_top_k(model: Quantizer, codes: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """qid, rank, vec_id, dist: coded queries against coded vectors, by tables between centroids."""
    if model.stages > 1:
        raise ValueError("a residual code has no tables between centroids")
    pairs = model.pair_tables()

    def blocks():
        for ids, q in query_blocks(queries, block_size(block, k), id_col, vector):
            c = model.codes(q)
            yield ids, [t[c[:, g]] for g, t in enumerate(pairs)]

    return _over_blocks(codes.select("vec_id", "codes"), blocks(), _codes, _lookup, k).withColumnRenamed("score", "dist")


class VectorIndex:
    """fit on training vectors, add a base, search. ``add`` replaces the base that was there unless ``append``."""

    def __init__(self, fit=None, mode: str = "adc"):
        self.fitter, self.mode, self.model, self.codes, self.base = fit, mode, None, None, None

    def train(self, df: DataFrame) -> VectorIndex:
        if self.fitter is not None:
            self.model = self.fitter(df)
        return self

    def add(self, df: DataFrame, append: bool = False) -> VectorIndex:
        new = df if self.fitter is None else self.model.encode(df)
        what = "base" if self.fitter is None else "codes"
        old = getattr(self, what)
        setattr(self, what, old.unionByName(new) if append and old is not None else new)
        return self

    def fit_add(self, train: DataFrame | None, base: DataFrame) -> VectorIndex:
        return self.train(base if train is None else train).add(base)

    def search(self, queries: DataFrame, k: int, mode: str | None = None) -> DataFrame:
        mode = mode or self.mode
        if self.fitter is None:
            return exact_top_k(self.base, queries, k, "dot" if mode == "dot" else "l2")
        if self.model is None or self.codes is None:
            raise ValueError("train and add come first")
        by_mode = {"adc": adc_top_k, "sdc": sdc_top_k}
        if mode not in by_mode:
            raise ValueError(f"no such mode: {mode}")
        return by_mode[mode](self.model, self.codes, queries, k)
