"""Retrieval and quantization metrics, and the statistics of the reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, long_form
from .kernels import lists, matrix


def recall_at(result: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 10, 100, 1000)) -> DataFrame:
    """k, recall: the share of queries whose nearest true neighbour is among their first k results.
    result and truth: qid, rank, vec_id. A k of 0 or less gives 0; one beyond the results counts them all."""
    first = truth.where("rank = 1").select("qid", "vec_id")
    at = first.join(result.select("qid", "vec_id", "rank"), ["qid", "vec_id"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    return at.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "rank").groupBy("k").agg(F.avg(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("double")).alias("recall"))


def overlap_at(result: DataFrame, truth: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """k, overlap: the mean share of the first min(most, columns) true neighbours among the first k results."""
    use = truth if most is None else truth.where(F.col("rank") <= most)
    width = use.groupBy("qid").agg(F.count("*").alias("n"))
    hits = result.where(F.col("rank") <= k).select("qid", "vec_id").join(use.select("qid", "vec_id"), ["qid", "vec_id"]).groupBy("qid").agg(F.count("*").alias("hits"))
    share = F.coalesce(F.col("hits"), F.lit(0)) / F.col("n")
    return width.join(hits, "qid", "left").agg(F.lit(k).alias("k"), F.avg(share).alias("overlap"))


def ranking_metrics(result: DataFrame, labels: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """k, queries, hit, precision, recall, mrr: means over the queries that have labels. result: qid, rank,
    item; labels: qid, item (repeats count once). Precision divides by k however few results there are."""
    labels = labels.select("qid", "item").distinct()
    sizes = labels.groupBy("qid").agg(F.count("*").alias("n"))
    return _ranking(sizes, _first_ranks(result).join(labels, ["qid", "item"]), ks)


def class_ranking_metrics(result: DataFrame, queries: DataFrame, items: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """The same where all items of a query's class are its labels. queries: qid, label; items: item, label; each has
    one class, repeated rows count once. Classes are counted and results looked up: pairs of a class are never listed."""
    queries, items = queries.select("qid", "label").distinct(), items.select("item", "label").distinct()
    sizes = queries.join(items.groupBy("label").agg(F.count("*").alias("n")), "label").select("qid", "n")
    return _ranking(sizes, _first_ranks(result).join(queries, "qid").join(items, ["item", "label"]), ks)


def _first_ranks(result: DataFrame) -> DataFrame:
    return result.groupBy("qid", "item").agg(F.min("rank").alias("rank"))


def _ranking(sizes: DataFrame, hits: DataFrame, ks) -> DataFrame:
    """sizes: qid, n labels; hits: qid, rank of the results that are labels."""
    hits = hits.select("qid", "rank")
    grid = sizes.select("qid", "n", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    per = grid.join(hits, "qid", "left").groupBy("qid", "k", "n").agg(F.count_if(F.col("rank") <= F.col("k")).alias("hits"), F.min(F.when(F.col("rank") <= F.col("k"), F.col("rank"))).alias("first"))
    return per.groupBy("k").agg(
        F.count("*").alias("queries"),
        F.avg((F.col("hits") > 0).cast("double")).alias("hit"),
        F.avg(F.col("hits") / F.col("k")).alias("precision"),
        F.avg(F.col("hits") / F.col("n")).alias("recall"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def reconstruction_error(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """n, mse (mean squared distance) and mean_distance of vectors and what their codes decode to."""
    pair = original.select("vec_id", F.col("embedding").alias("a")).join(decoded.select("vec_id", F.col("embedding").alias("b")), "vec_id")
    sq = F.aggregate(F.zip_with(doubles("a"), doubles("b"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return pair.select(sq.alias("sq")).agg(F.count("*").alias("n"), F.avg("sq").alias("mse"), F.avg(F.sqrt("sq")).alias("mean_distance"))


def coding_error(model, df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The same of vectors and what a quantizer makes of them, in one pass: no codes or vectors are shuffled."""

    def run(batches):
        n, squares, distances = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = matrix(b["v"])
                sq = ((x - model.decode(model.codes(x))) ** 2).sum(axis=1)
                n, squares, distances = n + len(sq), squares + float(sq.sum()), distances + float(np.sqrt(sq).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([squares]), pa.array([distances])], ["n", "squares", "distances"])

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "n long, squares double, distances double")
    n = F.coalesce(F.sum("n"), F.lit(0))
    return parts.agg(n.alias("n"), (F.sum("squares") / F.nullif(n, F.lit(0))).alias("mse"), (F.sum("distances") / F.nullif(n, F.lit(0))).alias("mean_distance"))


def dim_stats(df: DataFrame, least: float = 1e-6) -> DataFrame:
    """i, mean, std (of the population, at least ``least``) of each component."""
    return long_form(df).groupBy("i").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(least)).alias("std"))


def dim_correlation(df: DataFrame, absolute: bool = False, vector: str = "embedding") -> DataFrame:
    """i, j, r for all pairs of components, within [-1, 1]; a component without variance has r = 0 with all.
    Each task adds up its vectors' sums and products batch by batch and hands on a d x d table, shifted by
    a first vector so that large means cost no digits. Vectors that are null, of another length than
    the first or not finite take no part."""
    src = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    first = src.first()
    if first is None or not len(first["v"]):
        return df.sparkSession.createDataFrame([], "i int, j int, r double")
    shift = np.array(first["v"])
    d = len(shift)

    def run(batches):
        n, sums, products = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                x = np.asarray(b["v"].flatten()).reshape(-1, d) - shift
                n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
        if n:
            each = pa.array(np.arange(d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([each, pa.array(np.full(d, n)), pa.array(sums), lists(np.tile(sums, (d, 1)), pa.float64()), lists(products, pa.float64())], ["i", "n", "s", "t", "p"])

    parts = src.where(F.size("v") == d).mapInArrow(run, "i int, n long, s double, t array<double>, p array<double>")
    cells = parts.select("i", "n", "s", F.posexplode(F.arrays_zip("t", "p")).alias("j", "c")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c.t").alias("t"), F.sum("c.p").alias("p"))
    cells = cells.withColumn("cov", F.col("p") - F.col("s") * F.col("t") / F.col("n"))
    var = cells.where("i = j").select("i", F.col("cov").alias("var"), F.col("p").alias("scale"))
    flat = lambda v, scale: F.col(v) <= F.col(scale) * 1e-14
    wide = cells.join(F.broadcast(var.withColumnsRenamed({"var": "a", "scale": "sa"})), "i").join(F.broadcast(var.withColumnsRenamed({"i": "j", "var": "b", "scale": "sb"})), "j")  # a row for each component
    r = F.when(flat("a", "sa") | flat("b", "sb"), 0.0).otherwise(F.least(F.greatest(F.col("cov") / F.sqrt(F.col("a") * F.col("b")), F.lit(-1.0)), F.lit(1.0)))
    return wide.select("i", "j", (F.abs(r) if absolute else r).alias("r"))


def dim_neighbours(correlation: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """i, rank, j, w: the k components of highest absolute correlation with each, at least ``least``."""
    w = F.round(F.abs("r"), 6)
    order = Window.partitionBy("i").orderBy(F.desc("w"), "j")
    found = correlation.where("i <> j").withColumn("w", w).where(F.col("w") >= least)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "rank", "j", "w")


def adjacency_votes(neighbours: DataFrame) -> DataFrame:
    """a, b, votes, weight of each tie: a mutual one has two votes and both weights."""
    both = neighbours.select(F.col("i").alias("a"), F.col("j").alias("b"), "w").union(neighbours.select("j", "i", "w"))
    return both.groupBy("a", "b").agg(F.count("*").alias("votes"), F.round(F.sum("w"), 6).alias("weight"))


def group_adjacency(neighbours: DataFrame, membership: DataFrame) -> DataFrame:
    """ga, gb: groups tied by some neighbours, both ways. membership: i, gid."""
    a = membership.select(F.col("i"), F.col("gid").alias("ga"))
    b = membership.select(F.col("i").alias("j"), F.col("gid").alias("gb"))
    e = neighbours.select("i", "j").join(a, "i").join(b, "j").where("ga <> gb").select("ga", "gb")
    return e.union(e.select("gb", "ga")).distinct()


def two_hop(adjacency: DataFrame, most: int = 4) -> DataFrame:
    """ga, gc, paths: groups two ties away and not one, by the number of ways, ``most`` for each."""
    first = adjacency.select("ga", F.col("gb").alias("mid"))
    second = adjacency.select(F.col("ga").alias("mid"), F.col("gb").alias("gc"))
    far = first.join(second, "mid").where("ga <> gc").groupBy("ga", "gc").agg(F.count("*").alias("paths"))
    far = far.join(adjacency.select("ga", F.col("gb").alias("gc")), ["ga", "gc"], "left_anti")
    order = Window.partitionBy("ga").orderBy(F.desc("paths"), "gc")
    return far.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def min_max(df: DataFrame, value: str, group: str, out: str = "scaled") -> DataFrame:
    """The value scaled to [0, 1] within its group; 0.5 where all are equal. Groups are aggregated first and joined."""
    ends = df.groupBy(group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    wide = F.col("__hi") - F.col("__lo")
    return df.join(ends, group).withColumn(out, F.when(wide > 0, (F.col(value) - F.col("__lo")) / wide).otherwise(0.5)).drop("__lo", "__hi")


def ols(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """n, slope, intercept, r2 of y on x: no variance of x gives slope 0, none of y an r2 of 1."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    flat = F.coalesce(F.var_pop(a), F.lit(0.0)) <= 1e-12
    even = F.coalesce(F.var_pop(b), F.lit(0.0)) <= 1e-12
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.when(flat, 0.0).otherwise(F.regr_slope(b, a)).alias("slope"),
        F.when(flat, F.avg(b)).otherwise(F.regr_intercept(b, a)).alias("intercept"),
        F.when(even, 1.0).when(flat, 0.0).otherwise(F.regr_r2(b, a)).alias("r2"),
    )


def value_range(df: DataFrame, value: str, *quantiles: float, accuracy: int = 10_000) -> DataFrame:
    """least, most and the interpolated quantiles q1, q2, ... of the values that aren't null. A sketch tells
    between which values each quantile lies; a second pass counts what is below them and takes the exact
    quantile of what is between, so that no buffer holds more than a few of ``accuracy`` parts."""
    x = F.col(value).cast("double")
    src = df.where(x.isNotNull()).select(x.alias("x"))
    ends = [min(max(q + side * 2 / accuracy, 0.0), 1.0) for q in quantiles for side in (-1, 1)]
    first = src.agg(F.count("*").alias("n"), *([F.percentile_approx("x", ends, accuracy).alias("ends")] if ends else [])).first()
    n = first["n"]
    if not n or not quantiles:
        return df.agg(F.min(value).alias("least"), F.max(value).alias("most"), *[F.lit(None).cast("double").alias(f"q{i}") for i in range(1, len(quantiles) + 1)])
    cuts = list(zip(first["ends"][::2], first["ends"][1::2]))
    counts = src.agg(*[f(c).alias(f"{k}{i}") for i, (lo, hi) in enumerate(cuts) for k, f, c in (("below", F.count_if, F.col("x") < lo), ("inside", F.count_if, F.col("x").between(lo, hi)))]).first()
    exact = []
    for i, (q, (lo, hi)) in enumerate(zip(quantiles, cuts)):
        at, inside = q * (n - 1) - counts[f"below{i}"], counts[f"inside{i}"]
        if 0 <= at <= inside - 1:
            exact.append(F.percentile(F.when(F.col("x").between(lo, hi), F.col("x")), F.lit(at / (inside - 1) if inside > 1 else 0.0)))
        else:  # the sketch missed it
            exact.append(F.percentile("x", F.lit(q)))
    return src.agg(F.min("x").alias("least"), F.max("x").alias("most"), *[e.alias(f"q{i}") for i, e in enumerate(exact, 1)])


def keep_rates(df: DataFrame, kept: Column, *by: str) -> DataFrame:
    """raw, kept, skipped, rate (0 of nothing)."""
    got = df.groupBy(*by).agg(F.count("*").alias("raw"), F.count_if(kept).alias("kept"))
    return got.withColumn("skipped", F.col("raw") - F.col("kept")).withColumn("rate", F.when(F.col("raw") > 0, F.col("kept") / F.col("raw")).otherwise(0.0))


def timing(seconds: float, rows: int) -> dict[str, float]:
    """Microseconds a row and rows a second, 0 of nothing."""
    return {"us_per_row": 1e6 * seconds / rows if rows else 0.0, "per_second": rows / seconds if seconds > 0 else 0.0}
