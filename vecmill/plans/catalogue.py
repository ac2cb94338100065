"""Registered queries of the vector engine with their SQL oracles.

Randomised operators are registered in the variant that SQL can follow: samples by MD5
order, codebooks that start from the vectors of least id, fixed rounds. Trained models
are registered, too, and checked by their properties. Distances are rounded to 6 digits
before they are ranked, ties go to the least id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import allocation, metrics, retrieval, search, structure
from ..operators import quantizers as Q
from ..sources import artifacts

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
GROUPS = V.balanced_groups(64, 4)
BITS = 3


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


def asked(spark, sf):
    """The stated query set: rows whose id is divisible by 50."""
    return vectors(spark, sf).where("vec_id % 50 = 0")


# ---- SQL that the oracles share

U = "u AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
PAIRS = U + ", pairs AS (SELECT q.vec_id AS qid, b.vec_id, sum((q.x - b.x) * (q.x - b.x)) AS d2, sum(q.x * b.x) AS dot FROM u q JOIN u b ON q.i = b.i WHERE q.vec_id % 50 = 0 GROUP BY ALL)"
TRUTH = PAIRS + ", exact AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(d2, 6), vec_id) AS INTEGER) AS rank, vec_id, round(d2, 6) AS dist FROM pairs)"
#: Codebooks: the 8 vectors of least id in 4 groups of 16 places, and one round over all rows.
START = U + """, us AS (SELECT vec_id, i, i // 16 AS g, x FROM u),
c0 AS (SELECT g, i, CAST(dense_rank() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS code, x FROM us WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 8)),
d0 AS (SELECT vec_id, us.g, code, round(sum((us.x - c0.x) * (us.x - c0.x)), 6) AS d2 FROM us JOIN c0 ON us.g = c0.g AND us.i = c0.i GROUP BY ALL),
a0 AS (SELECT vec_id, g, code FROM d0 QUALIFY row_number() OVER (PARTITION BY vec_id, g ORDER BY d2, code) = 1),
m1 AS (SELECT us.g, us.i, a0.code, avg(us.x) AS x FROM us JOIN a0 ON us.vec_id = a0.vec_id AND us.g = a0.g GROUP BY ALL),
c1 AS (SELECT c0.g, c0.i, c0.code, coalesce(m1.x, c0.x) AS x FROM c0 LEFT JOIN m1 ON c0.g = m1.g AND c0.i = m1.i AND c0.code = m1.code),
d1 AS (SELECT vec_id, us.g, code, sum((us.x - c1.x) * (us.x - c1.x)) AS d2 FROM us JOIN c1 ON us.g = c1.g AND us.i = c1.i GROUP BY ALL),
codes AS (SELECT vec_id, g, code, d2 FROM d1 QUALIFY row_number() OVER (PARTITION BY vec_id, g ORDER BY round(d2, 6), code) = 1)"""
ADC = START + """, adc AS (SELECT q.vec_id AS qid, b.vec_id, round(sum(q.d2), 6) AS dist FROM d1 q JOIN codes b ON q.g = b.g AND q.code = b.code WHERE q.vec_id % 50 = 0 GROUP BY ALL),
adc_top AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id, dist FROM adc QUALIFY rank <= 10)"""


def fixed_pq(spark, sf) -> Q.Quantizer:
    df = vectors(spark, sf)
    q = Q.Quantizer(64, GROUPS, [BITS] * 4, Q.first_books(df, GROUPS, BITS))
    q.codebooks, _ = Q.lloyd_step(df, q)
    return q


# ---- exact search


@query("WITH " + TRUTH + " SELECT * FROM exact WHERE rank <= 10")
def exact_l2_topk(spark, sf):
    return search.exact_top_k(vectors(spark, sf), asked(spark, sf), 10)


flagship = exact_l2_topk


@query("WITH " + PAIRS + ", s AS (SELECT qid, vec_id, round(dot, 6) AS score FROM pairs) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10")
def exact_cosine_topk(spark, sf):
    return search.exact_top_k(vectors(spark, sf), asked(spark, sf), 10, "dot")


@query("WITH " + TRUTH + " SELECT * FROM exact WHERE rank <= 100")
def ground_truth_k(spark, sf):
    return search.ground_truth(vectors(spark, sf), asked(spark, sf), 100)


# ---- vectors


@query("WITH " + U + " SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm FROM u GROUP BY vec_id")
def vector_norms(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("WITH " + U + ", n AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM u GROUP BY vec_id) SELECT vec_id, CAST(i AS INTEGER) AS i, round(x / n, 6) AS x FROM u JOIN n USING (vec_id)")
def normalize_rows(spark, sf):
    df = vectors(spark, sf).select("vec_id", V.normalized(F.col("embedding")).alias("embedding"))
    return V.long_form(df, "embedding", "vec_id").withColumn("x", F.round("x", 6))


_BROKEN = "CASE CAST(vec_id % 8 AS INTEGER) WHEN 0 THEN NULL WHEN 1 THEN {empty} WHEN 2 THEN {short} WHEN 3 THEN {zero} WHEN 4 THEN {ones} WHEN 5 THEN {nan} ELSE embedding END"


@query(
    "WITH v AS (SELECT vec_id, "
    + _BROKEN.format(empty="CAST([] AS FLOAT[])", short="embedding[1:63]", zero="list_transform(embedding, lambda x: CAST(0 AS FLOAT))", ones="list_transform(embedding, lambda x: CAST(-1 AS FLOAT))", nan="list_transform(embedding, lambda x: CAST('nan' AS FLOAT))")
    + " AS v FROM embeddings) SELECT vec_id, CASE WHEN v IS NULL THEN 'none' WHEN len(v) = 0 THEN 'empty' WHEN len(v) <> 64 THEN 'shape' WHEN len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not_finite' WHEN len(list_filter(v, lambda x: x <> 0)) = 0 THEN 'all_zero' WHEN len(list_filter(v, lambda x: x <> -1)) = 0 THEN 'all_minus_one' END AS error FROM v"
)
def vector_sanity(spark, sf):
    broken = _BROKEN.format(empty="cast(array() as array<float>)", short="slice(embedding, 1, 63)", zero="transform(embedding, x -> float(0))", ones="transform(embedding, x -> float(-1))", nan="transform(embedding, x -> float('nan'))")
    return vectors(spark, sf).select("vec_id", F.expr(broken).alias("v")).select("vec_id", V.vector_error(F.col("v"), 64).alias("error"))


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 50 OFFSET 100")
def slice_vectors(spark, sf):
    from ..sources.vecfile import slice_vectors as cut

    return cut(vectors(spark, sf), 100, 50, d=64).select("vec_id", "label")


@query("WITH " + U + " SELECT vec_id, CAST(96 AS INTEGER) AS width, CAST(32 AS INTEGER) AS zeros, round(sum(x), 6) AS total FROM u GROUP BY vec_id")
def pad_vectors(spark, sf):
    p = vectors(spark, sf).select("vec_id", V.padded(F.col("embedding"), 48).alias("p"))
    return p.select("vec_id", F.size("p").alias("width"), F.size(F.filter("p", lambda x: x == 0)).alias("zeros"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("WITH " + U + " SELECT vec_id, CAST(63 - i AS INTEGER) AS i, x FROM u")
def permute_dims(spark, sf):
    df = vectors(spark, sf).select("vec_id", V.take_dims(F.col("embedding"), list(range(63, -1, -1))).alias("embedding"))
    return V.long_form(df, "embedding", "vec_id")


@query("WITH " + U + ", a AS (SELECT CAST(r.range AS INTEGER) AS r, CAST(c.range AS INTEGER) AS c, CASE WHEN c.range = 0 THEN sqrt(1.0 / 64) ELSE sqrt(2.0 / 64) * cos(pi() * (r.range + 0.5) * c.range / 64) END AS w FROM range(64) r, range(64) c) SELECT vec_id, a.c AS i, round(sum(x * w), 6) AS x FROM u JOIN a ON u.i = a.r GROUP BY vec_id, a.c")
def rotate_vectors(spark, sf):
    r, c = np.arange(64)[:, None], np.arange(64)[None, :]
    a = np.where(c == 0, np.sqrt(1 / 64), np.sqrt(2 / 64) * np.cos(np.pi * (r + 0.5) * c / 64))
    one = Q.Quantizer(64, GROUPS, [0] * 4, [np.zeros((1, 16))] * 4, rotation=a)
    return V.long_form(transformed(one, vectors(spark, sf)), "embedding", "vec_id").withColumn("x", F.round("x", 6))


def transformed(model: Q.Quantizer, df: DataFrame) -> DataFrame:
    """vec_id, embedding: what a model makes of vectors before they are coded."""
    import pyarrow as pa

    from ..operators.kernels import lists, matrix

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["vec_id"], lists(model.transform(matrix(b["embedding"])), pa.float64())], ["vec_id", "embedding"])

    return df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, embedding array<double>")


@query("SELECT vec_id FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 100")
def hash_sample(spark, sf):
    return V.hash_sample(vectors(spark, sf).select("vec_id"), 100, 7)


@query("SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5('123:' || vec_id), vec_id) <= 300 THEN 'train' ELSE 'eval' END AS part FROM embeddings ORDER BY md5('123:' || vec_id), vec_id LIMIT 400")
def train_eval_split(spark, sf):
    return V.train_eval_split(vectors(spark, sf).select("vec_id"), 300, 100)


@query()
def default_train_eval_split(spark, sf):
    """The split with the operator's own sizes; train_eval_split has those that its oracle names."""
    return V.train_eval_split(vectors(spark, sf).select("vec_id"))


# ---- statistics of components

STATS = U + ", corr AS (SELECT a.i, b.i AS j, least(greatest(corr(a.x, b.x), -1.0), 1.0) AS r FROM u a JOIN u b ON a.vec_id = b.vec_id GROUP BY a.i, b.i)"
NEAR = STATS + ", near AS (SELECT CAST(i AS INTEGER) AS i, CAST(row_number() OVER (PARTITION BY i ORDER BY round(abs(r), 6) DESC, j) AS INTEGER) AS rank, CAST(j AS INTEGER) AS j, round(abs(r), 6) AS w FROM corr WHERE i <> j QUALIFY rank <= 8)"
TIES = NEAR + ", e AS (SELECT i // 8 AS ga, j // 8 AS gb FROM near WHERE i // 8 <> j // 8), adj AS (SELECT CAST(ga AS INTEGER) AS ga, CAST(gb AS INTEGER) AS gb FROM (SELECT ga, gb FROM e UNION SELECT gb, ga FROM e))"


@query("WITH " + U + " SELECT CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-6), 6) AS std FROM u GROUP BY i")
def dim_stats(spark, sf):
    return metrics.dim_stats(vectors(spark, sf)).select("i", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("WITH " + STATS + " SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(r, 6) AS r FROM corr")
def dim_correlation(spark, sf):
    return metrics.dim_correlation(vectors(spark, sf)).withColumn("r", F.round("r", 6))


def neighbours(spark, sf):
    return metrics.dim_neighbours(metrics.dim_correlation(vectors(spark, sf)), 8)


@query("WITH " + NEAR + " SELECT * FROM near")
def dim_neighbors(spark, sf):
    return neighbours(spark, sf)


@query("WITH " + NEAR + ", b AS (SELECT i AS a, j AS b, w FROM near UNION ALL SELECT j, i, w FROM near) SELECT a, b, count(*) AS votes, round(sum(w), 6) AS weight FROM b GROUP BY a, b")
def mutual_adjacency_votes(spark, sf):
    return metrics.adjacency_votes(neighbours(spark, sf))


def members(spark):
    return spark.range(64).select(F.col("id").cast("int").alias("i"), F.expr("cast(id div 8 as int)").alias("gid"))


@query("WITH " + TIES + " SELECT * FROM adj")
def group_adjacency(spark, sf):
    return metrics.group_adjacency(neighbours(spark, sf), members(spark))


@query(
    "WITH " + TIES.replace("<= 8)", "<= 1)") + ", far AS (SELECT a.ga, b.gb AS gc, count(*) AS paths FROM adj a JOIN adj b ON a.gb = b.ga WHERE a.ga <> b.gb AND (a.ga, b.gb) NOT IN (SELECT (ga, gb) FROM adj) GROUP BY a.ga, b.gb) SELECT ga, gc, paths FROM far QUALIFY row_number() OVER (PARTITION BY ga ORDER BY paths DESC, gc) <= 4"
)
def two_hop_groups(spark, sf):
    near = metrics.dim_neighbours(metrics.dim_correlation(vectors(spark, sf)), 1)
    return metrics.two_hop(metrics.group_adjacency(near, members(spark)))


# ---- groups and bits


@query("SELECT CAST(CASE WHEN range < 32 THEN range // 8 ELSE 4 + (range - 32) // 7 END AS INTEGER) AS group_id, CAST(range AS INTEGER) AS i FROM range(67)")
def balanced_groups(spark, sf):
    return spark.createDataFrame([(g, i) for g, dims in enumerate(V.balanced_groups(67, 9)) for i in dims], "group_id int, i int")


@query("SELECT CAST(range AS INTEGER) AS group_id, CAST(16 AS INTEGER) AS ndims, CAST(CASE WHEN range = 3 THEN 11 ELSE 8 END AS INTEGER) AS nbits FROM range(4)")
def even_groups(spark, sf):
    groups, bits = structure.even_groups(64, 35)
    return spark.createDataFrame([(g, len(d), b) for g, (d, b) in enumerate(zip(groups, bits))], "group_id int, ndims int, nbits int")


@query("WITH want AS (SELECT DISTINCT generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), got AS (SELECT (range * 7) % 70 AS i FROM range(63)) SELECT CAST(i AS INTEGER) AS i, 'missing' AS problem FROM want WHERE i NOT IN (SELECT i FROM got) UNION ALL SELECT CAST(i AS INTEGER), 'unknown' FROM got WHERE i NOT IN (SELECT i FROM want) UNION ALL SELECT CAST(i AS INTEGER), 'repeated' FROM got GROUP BY i HAVING count(*) > 1")
def partition_check(spark, sf):
    want = vectors(spark, sf).select(F.posexplode("embedding").alias("i", "x")).select("i").distinct()
    got = spark.range(63).select(((F.col("id") * 7) % 70).cast("int").alias("i"))
    return want.exceptAll(got.distinct()).withColumn("problem", F.lit("missing")).union(got.distinct().exceptAll(want).withColumn("problem", F.lit("unknown"))).union(got.groupBy("i").count().where("count > 1").select("i", F.lit("repeated")))


COSTS = U + ", costs AS (SELECT CAST(i // 8 AS INTEGER) AS g, CAST(b.range AS INTEGER) AS b, round(sum(v) * (0.6 + 0.05 * (i // 8)) ** b.range, 6) AS cost FROM (SELECT i, var_pop(x) AS v FROM u GROUP BY i), range(5) b GROUP BY i // 8, b.range)"


def cost_rows(spark, sf) -> DataFrame:
    """g, b, cost: eight groups, the variance of their places falling by a factor of their own for each bit."""
    var = V.long_form(vectors(spark, sf)).groupBy("i").agg(F.var_pop("x").alias("v")).groupBy(F.expr("cast(i div 8 as int)").alias("g")).agg(F.sum("v").alias("v"))
    return var.select("g", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("b"), "v").select("g", "b", F.round(F.col("v") * F.pow(F.lit(0.6) + 0.05 * F.col("g"), F.col("b")), 6).alias("cost"))


def cost_lists(spark, sf) -> list[list[float]]:
    out: list[list[float]] = [[] for _ in range(8)]
    for r in cost_rows(spark, sf).orderBy("g", "b").collect():  # groups times bits
        out[r["g"]].append(r["cost"])
    return out


@query("WITH " + COSTS + " SELECT g, b, cost, coalesce(round(cost - lead(cost) OVER w, 6), 0.0) AS gain, round(lag(cost) OVER w - cost, 6) AS loss FROM costs WINDOW w AS (PARTITION BY g ORDER BY b)")
def marginal_gain_loss(spark, sf):
    w = Window.partitionBy("g").orderBy("b")
    c = cost_rows(spark, sf)
    return c.select("g", "b", "cost", F.coalesce(F.round(F.col("cost") - F.lead("cost").over(w), 6), F.lit(0.0)).alias("gain"), F.round(F.lag("cost").over(w) - F.col("cost"), 6).alias("loss"))


_DP = """, states(g, t, j, bits) AS (
  SELECT -1, 0, CAST(0 AS DOUBLE), CAST([] AS INTEGER[])
  UNION ALL
  SELECT g, t, j, bits FROM (
    SELECT c.g, s.t + c.b AS t, s.j + c.cost AS j, list_append(s.bits, c.b) AS bits, row_number() OVER (PARTITION BY c.g, s.t + c.b ORDER BY s.j + c.cost, c.b DESC) AS n
    FROM states s JOIN costs c ON c.g = s.g + 1 WHERE s.t + c.b <= {total}) WHERE n = 1)
SELECT CAST(unnest(range({m})) AS INTEGER) AS g, unnest(bits) AS nbits, round(j, 6) AS total FROM states WHERE g = {m} - 1 AND t = {total}"""


@query("WITH RECURSIVE " + COSTS + _DP.format(total=14, m=8))
def dp_bit_allocation(spark, sf):
    bits, j = allocation.dp_bits(cost_lists(spark, sf), 14)
    return spark.createDataFrame([(g, b, round(j, 6)) for g, b in enumerate(bits)], "g int, nbits int, total double")


@query(
    "WITH RECURSIVE " + COSTS + ", steps(n, bits) AS (SELECT 0, [0, 0, 0, 0, 0, 0, 0, 0] UNION ALL SELECT n + 1, list_transform(bits, lambda v, i: CASE WHEN i = g + 1 THEN v + 1 ELSE v END) FROM (SELECT s.n, s.bits, a.g, row_number() OVER (PARTITION BY s.n ORDER BY b.cost - a.cost, a.g) AS k FROM steps s JOIN costs a ON a.b = s.bits[a.g + 1] JOIN costs b ON b.g = a.g AND b.b = a.b + 1 WHERE s.n < 14) WHERE k = 1) SELECT CAST(unnest(range(8)) AS INTEGER) AS g, CAST(unnest(bits) AS INTEGER) AS nbits FROM steps WHERE n = 14"
)
def greedy_bit_allocation(spark, sf):
    return spark.createDataFrame(list(enumerate(allocation.greedy_from_table(cost_lists(spark, sf), 14))), "g int, nbits int")


@query("WITH RECURSIVE " + U + ", costs AS (SELECT CAST(i AS INTEGER) AS g, CAST(b.range AS INTEGER) AS b, round(v / (b.range + 1), 6) AS cost FROM (SELECT i, var_pop(x) AS v FROM u GROUP BY i), range(4) b)" + _DP.format(total=96, m=64))
def singleton_bits(spark, sf):
    var = V.long_form(vectors(spark, sf)).groupBy("i").agg(F.var_pop("x").alias("v"))
    rows = var.select("i", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b"), "v").select("i", "b", F.round(F.col("v") / (F.col("b") + 1), 6).alias("c")).orderBy("i", "b").collect()  # places times bits
    costs: list[list[float]] = [[] for _ in range(64)]
    for r in rows:
        costs[r["i"]].append(r["c"])
    bits, j = allocation.dp_bits(costs, 96)
    return spark.createDataFrame([(g, b, round(j, 6)) for g, b in enumerate(bits)], "g int, nbits int, total double")


# ---- product quantization, in the variant that SQL can follow


@query("WITH " + START + " SELECT CAST(g AS INTEGER) AS g, code, CAST(i - 16 * g AS INTEGER) AS i, round(x, 6) AS x FROM c1")
def pq_lloyd_step(spark, sf):
    q = fixed_pq(spark, sf)
    return spark.createDataFrame([(g, c, i, round(float(x), 6)) for g, b in enumerate(q.codebooks) for c, v in enumerate(b) for i, x in enumerate(v)], "g int, code int, i int, x double")


@query("WITH " + START + " SELECT CAST(g AS INTEGER) AS g, code, CAST(i - 16 * g AS INTEGER) AS i, x FROM c0")
def pq_init_codebook(spark, sf):
    books = Q.first_books(vectors(spark, sf), GROUPS, BITS)
    return spark.createDataFrame([(g, c, i, float(x)) for g, b in enumerate(books) for c, v in enumerate(b) for i, x in enumerate(v)], "g int, code int, i int, x double")


def coded(spark, sf) -> tuple[Q.Quantizer, DataFrame]:
    q = fixed_pq(spark, sf)
    return q, q.encode(vectors(spark, sf))


@query("WITH " + START + " SELECT vec_id, CAST(g AS INTEGER) AS g, code FROM codes")
def pq_encode(spark, sf):
    return coded(spark, sf)[1].select("vec_id", F.posexplode("codes").alias("g", "code"))


@query("WITH " + START + " SELECT CAST(g AS INTEGER) AS g, code, count(*) AS n FROM codes GROUP BY g, code")
def pq_codes_histogram(spark, sf):
    return coded(spark, sf)[1].select(F.posexplode("codes").alias("g", "code")).groupBy("g", "code").agg(F.count("*").alias("n"))


@query("WITH " + START + ", e AS (SELECT vec_id, sum(d2) AS sq FROM codes GROUP BY vec_id) SELECT count(*) AS n, round(avg(sq), 6) AS mse, round(avg(sqrt(sq)), 6) AS mean_distance FROM e")
def pq_decode_error(spark, sf):
    e = metrics.coding_error(fixed_pq(spark, sf), vectors(spark, sf))
    return e.select("n", F.round("mse", 6).alias("mse"), F.round("mean_distance", 6).alias("mean_distance"))


@query("WITH " + START + " SELECT CAST(g AS INTEGER) AS g, round(avg(d2), 6) AS mse FROM codes GROUP BY g")
def pq_train_mse(spark, sf):
    q = fixed_pq(spark, sf)
    _, t = Q.lloyd_step(vectors(spark, sf), q)
    return t.groupBy(F.col("group_id").alias("g")).agg(F.round(F.sum("error") / F.sum("n"), 6).alias("mse"))


@query("WITH " + START + " SELECT vec_id AS qid, CAST(g AS INTEGER) AS g, code, round(d2, 6) AS d2 FROM d1 WHERE vec_id % 50 = 0")
def lut_build(spark, sf):
    q, rows = fixed_pq(spark, sf), []
    for ids, x in search.query_blocks(asked(spark, sf), 4096, "vec_id", "embedding"):
        for g, t in enumerate(q.lut(x)):
            rows += [(int(i), g, c, round(float(v), 6)) for i, line in zip(ids, t) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "qid long, g int, code int, d2 double")


@query("WITH " + ADC + " SELECT * FROM adc_top")
def adc_topk(spark, sf):
    q, c = coded(spark, sf)
    return search.adc_top_k(q, c, asked(spark, sf), 10)


@query("WITH " + START + ", t AS (SELECT a.g, a.code AS x, b.code AS y, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM c1 a JOIN c1 b ON a.g = b.g AND a.i = b.i GROUP BY ALL), s AS (SELECT q.vec_id AS qid, b.vec_id, round(sum(t.d2), 6) AS dist FROM codes q JOIN codes b ON q.g = b.g JOIN t ON t.g = q.g AND t.x = q.code AND t.y = b.code WHERE q.vec_id % 50 = 0 GROUP BY ALL) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id, dist FROM s QUALIFY rank <= 10")
def sdc_topk(spark, sf):
    q, c = coded(spark, sf)
    return search.sdc_top_k(q, c, asked(spark, sf), 10)


BOTH = ADC + TRUTH[len(U) :]


@query("WITH " + BOTH + " SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN adc_top.rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT qid, vec_id, unnest([1, 5, 10]) AS k FROM exact WHERE rank = 1) LEFT JOIN adc_top USING (qid, vec_id) GROUP BY k")
def adc_vs_exact_recall(spark, sf):
    q, c = coded(spark, sf)
    a = asked(spark, sf)
    return metrics.recall_at(search.adc_top_k(q, c, a, 10), search.exact_top_k(vectors(spark, sf), a, 10), (1, 5, 10)).select("k", F.round("recall", 6).alias("recall"))


@query("WITH " + BOTH + " SELECT CAST(10 AS INTEGER) AS k, round(avg(n), 6) AS overlap FROM (SELECT e.qid, count(a.vec_id) / 10 AS n FROM (SELECT * FROM exact WHERE rank <= 10) e LEFT JOIN adc_top a USING (qid, vec_id) GROUP BY e.qid)")
def overlap_at_k(spark, sf):
    q, c = coded(spark, sf)
    a = asked(spark, sf)
    return metrics.overlap_at(search.adc_top_k(q, c, a, 10), search.exact_top_k(vectors(spark, sf), a, 10), 10).select("k", F.round("overlap", 6).alias("overlap"))


@query(
    "WITH " + START + ", r AS (SELECT us.vec_id, us.g, us.i, us.x - c1.x AS x FROM us JOIN codes k ON us.vec_id = k.vec_id AND us.g = k.g JOIN c1 ON c1.g = k.g AND c1.code = k.code AND c1.i = us.i), e0 AS (SELECT g, i, CAST(dense_rank() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS code, x FROM r WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 8)), d2s AS (SELECT r.vec_id, r.g, e0.code, round(sum((r.x - e0.x) * (r.x - e0.x)), 6) AS d2 FROM r JOIN e0 ON r.g = e0.g AND r.i = e0.i GROUP BY ALL), k2 AS (SELECT vec_id, g, code FROM d2s QUALIFY row_number() OVER (PARTITION BY vec_id, g ORDER BY d2, code) = 1) SELECT codes.vec_id, CAST(codes.g AS INTEGER) AS g, codes.code AS first, k2.code AS second FROM codes JOIN k2 USING (vec_id, g)"
)
def rq_two_stage_encode(spark, sf):
    df, q = vectors(spark, sf), fixed_pq(spark, sf)
    x = np.array([r["v"] for r in df.orderBy("vec_id").limit(8).select(F.col("embedding").cast("array<double>").alias("v")).collect()])
    left = x - q.decode(q.codes(x))
    groups = [d for d in GROUPS for _ in (0, 1)]
    books = [b for g, d in enumerate(GROUPS) for b in (q.codebooks[g], left[:, d])]
    two = Q.Quantizer(64, groups, [BITS] * 8, books, kind="residual", stages=2)
    return two.encode(df).select("vec_id", F.explode(F.expr("transform(sequence(0, 3), g -> struct(g as g, codes[2 * g] as first, codes[2 * g + 1] as second))")).alias("r")).select("vec_id", "r.g", "r.first", "r.second")


@query(
    "WITH " + START + ", m AS (SELECT g, i, avg(x) AS x FROM us WHERE g = 3 GROUP BY ALL), z AS (SELECT us.vec_id, sum((us.x - m.x) * (us.x - m.x)) AS d2 FROM us JOIN m ON us.g = m.g AND us.i = m.i GROUP BY us.vec_id), s AS (SELECT q.vec_id AS qid, b.vec_id, round(sum(q.d2) + any_value(z.d2), 6) AS dist FROM d1 q JOIN codes b ON q.g = b.g AND q.code = b.code JOIN z ON z.vec_id = q.vec_id WHERE q.vec_id % 50 = 0 AND q.g < 3 GROUP BY ALL) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id, dist FROM s QUALIFY rank <= 10"
)
def zero_bit_group_invariance(spark, sf):
    df, q = vectors(spark, sf), fixed_pq(spark, sf)
    mean = np.array([r["mean"] for r in metrics.dim_stats(df).orderBy("i").collect()])
    q.nbits[3], q.codebooks[3] = 0, mean[None, GROUPS[3]]
    return search.adc_top_k(q, q.encode(df), asked(spark, sf), 10)


@query("WITH " + COSTS + ", p AS (SELECT g, cost FROM costs WHERE b = 2) SELECT 'pq' AS quantizer, 'original' AS space, g AS group_id, CAST(8 AS INTEGER) AS ndims, CAST(2 AS INTEGER) AS bits, cost AS d_proxy FROM p UNION ALL SELECT 'pq', 'original', NULL, CAST(64 AS INTEGER), CAST(16 AS INTEGER), round(sum(cost), 6) FROM p")
def group_stats_report(spark, sf):
    costs = cost_lists(spark, sf)
    rows = structure.group_stats("pq", "original", V.balanced_groups(64, 8), [2] * 8, lambda dims, b: costs[dims[0] // 8][b])
    return spark.createDataFrame([(*r[:-1], round(r[-1], 6)) for r in rows], "quantizer string, space string, group_id int, ndims int, bits int, d_proxy double")


_HOLD = U + """, part AS (SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5('123:' || vec_id), vec_id) <= 300 THEN 'train' ELSE 'eval' END AS part FROM embeddings ORDER BY md5('123:' || vec_id), vec_id LIMIT 400),
us AS (SELECT vec_id, part, i, i // 16 AS g, x FROM u JOIN part USING (vec_id)),
c AS (SELECT b.range AS b, g, i, code, x FROM (SELECT g, i, dense_rank() OVER (ORDER BY vec_id) - 1 AS code, x FROM us WHERE part = 'train') JOIN range(5) b ON code < 2 ** b.range),
d AS (SELECT c.b, us.g, us.vec_id, c.code, sum((us.x - c.x) * (us.x - c.x)) AS d2 FROM us JOIN c ON us.g = c.g AND us.i = c.i WHERE part = 'eval' GROUP BY ALL)
SELECT CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, round(avg(m), 6) AS cost FROM (SELECT b, g, vec_id, min(d2) AS m FROM d GROUP BY ALL) GROUP BY g, b"""


@query("WITH " + _HOLD)
def proxy_cost_table(spark, sf):
    """Holdout costs of groups and bits with the training vectors of least id for centroids: a task for each group."""
    import pandas as pd

    split = V.train_eval_split(vectors(spark, sf).select("vec_id", "embedding"), 300, 100)
    e = split.select("vec_id", "part", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("g"), "embedding")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        g = int(f["g"].iloc[0])
        f = f.sort_values("vec_id")
        x = np.stack(f["embedding"].to_numpy()).astype(float)[:, GROUPS[g]]
        train, held = x[(f["part"] == "train").to_numpy()], x[(f["part"] == "eval").to_numpy()]
        from ..operators.kernels import squared_distances

        return pd.DataFrame({"g": g, "b": range(5), "cost": [round(float(squared_distances(held, train[: 1 << b]).min(axis=1).mean()), 6) for b in range(5)]})

    return e.groupBy("g").applyInPandas(run, "g int, b int, cost double")


@query()
def holdout_cost_table(spark, sf):
    """Holdout costs of groups and bits as the structure search takes them: k-means, the operator's own sizes."""
    cost = structure.HoldoutCost(Q.training_rows(vectors(spark, sf), 20_480, 123), spark=spark, job_from=1)
    cells = [(g, b) for g in range(len(GROUPS)) for b in range(5)]
    cost.need([(GROUPS[g], b) for g, b in cells])
    return spark.createDataFrame([(g, b, round(cost(GROUPS[g], b), 6)) for g, b in cells], "g int, b int, cost double")


# ---- ranking metrics and retrieval tables


@query(
    "WITH " + TRUTH + ", top AS (SELECT qid, rank, e.label = q.label AS hit FROM exact JOIN embeddings e USING (vec_id) JOIN embeddings q ON q.vec_id = qid WHERE rank <= 10), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), per AS (SELECT k, q.vec_id AS qid, any_value(n.n) AS n, count(*) FILTER (WHERE hit AND rank <= k) AS hits, min(rank) FILTER (WHERE hit AND rank <= k) AS first FROM embeddings q JOIN n USING (label) JOIN top ON top.qid = q.vec_id, (SELECT unnest([1, 5, 10]) AS k) GROUP BY k, q.vec_id) SELECT CAST(k AS INTEGER) AS k, count(*) AS queries, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(hits / k), 6) AS precision, round(avg(hits / n), 6) AS recall, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM per GROUP BY k"
)
def label_retrieval_metrics(spark, sf):
    df, a = vectors(spark, sf), asked(spark, sf)
    result = search.exact_top_k(df, a, 10).select("qid", "rank", F.col("vec_id").alias("item"))
    m = metrics.class_ranking_metrics(result, a.select(F.col("vec_id").alias("qid"), "label"), df.select(F.col("vec_id").alias("item"), "label"))
    return m.select("k", "queries", *[F.round(c, 6).alias(c) for c in ("hit", "precision", "recall", "mrr")])


def judged(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    rel = table(spark, sf, "labels").select((F.col("doc_id") % 40).cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("corpus_id"), F.col("quality").alias("score"))
    corpus = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("corpus_id"), F.array(retrieval.text_part(F.col("text"))).alias("parts"))
    return retrieval.parse_judgements(q, rel, corpus, "judged")


@query("SELECT 'judged:' || b.item_id AS query_id, count(DISTINCT l.doc_id) AS n_labels FROM benchmark b JOIN labels l ON l.doc_id % 40 = b.item_id JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality > 0 GROUP BY b.item_id")
def qrels_join(spark, sf):
    return judged(spark, sf)[0].select("query_id", F.size("labels").cast("long").alias("n_labels"))


@query("SELECT 'judged:' || b.item_id AS query_id, count(DISTINCT l.doc_id) AS left_labels FROM benchmark b JOIN labels l ON l.doc_id % 40 = b.item_id JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality > 0 AND d.lang = 'en' GROUP BY b.item_id")
def query_availability(spark, sf):
    there = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("name"))
    return retrieval.available(judged(spark, sf)[0], there).select("query_id", F.size("labels").cast("long").alias("left_labels"))


@query("SELECT lang IS NOT NULL AND lang = 'en' AS english, count(*) AS raw, count(*) FILTER (WHERE n_chars > 1000) AS kept, count(*) FILTER (WHERE NOT n_chars > 1000) AS skipped, round(count(*) FILTER (WHERE n_chars > 1000) / count(*), 6) AS rate FROM documents GROUP BY ALL")
def keep_rates(spark, sf):
    d = table(spark, sf, "documents").withColumn("english", F.coalesce(F.col("lang") == "en", F.lit(False)))
    return metrics.keep_rates(d, F.col("n_chars") > 1000, "english").withColumn("rate", F.round("rate", 6))


@query("SELECT source || ':' || lang AS name, min(doc_id) AS first_doc, arg_min(sha256(text), doc_id) AS digest FROM documents GROUP BY source, lang")
def corpus_first_wins(spark, sf):
    c = table(spark, sf, "documents").select(F.concat_ws(":", "source", "lang").alias("name"), F.struct(F.col("doc_id"), F.sha2("text", 256).alias("digest")).alias("parts"), F.col("doc_id").alias("pos"))
    return retrieval.first_wins(c, "pos").select("name", F.col("parts.doc_id").alias("first_doc"), "parts.digest")


@query("SELECT sha256(text) AS signature, min(doc_id) AS first_doc FROM documents GROUP BY text")
def corpus_distinct_signature(spark, sf):
    corpus = table(spark, sf, "documents").select(F.format_string("%020d", "doc_id").alias("name"), F.array(retrieval.text_part(F.col("text"))).alias("parts"))
    found = retrieval.distinct_corpus([corpus])
    return found.select(F.sha2(F.col("parts")[0]["value"], 256).alias("signature"), F.col("name").cast("long").alias("first_doc"))


@query("SELECT doc_id, CAST(n AS INTEGER) AS batch FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS n FROM documents)")
def numbered_batches(spark, sf):
    """Rows in batches of 64 by id, as a chunked reader hands them out: places come from counts of id ranges."""
    d = table(spark, sf, "documents").select("doc_id")
    part = d.repartitionByRange("doc_id").withColumn("p", F.spark_partition_id())
    part = part.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("doc_id")))
    before = part.groupBy("p").agg(F.max("n").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return part.join(before, "p").select("doc_id", F.floor((F.col("before") + F.col("n") - 1) / 64).cast("int").alias("batch"))


@query("SELECT doc_id, coalesce(lang, source, 'none') AS value FROM documents")
def first_present_value(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.first_present(d, "no such column", "lang", "source", default="none").alias("value"))


@query("SELECT CAST(b AS INTEGER) AS bits, CASE WHEN b <= 7 THEN 'tinyint' WHEN b <= 15 THEN 'smallint' ELSE 'int' END AS type FROM range(1, 17) r(b)")
def code_types(spark, sf):
    return spark.createDataFrame([(b, V.code_type(b)) for b in range(1, 17)], "bits int, type string")


@query("SELECT CAST(g AS INTEGER) AS g, CAST(i AS INTEGER) AS i FROM (SELECT label AS g, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM embeddings GROUP BY label) t, range(1000000) r(i) WHERE i >= s AND i < s + n")
def contiguous_blocks(spark, sf):
    """Consecutive blocks as long as the labels are frequent."""
    sizes = [r["count"] for r in vectors(spark, sf).groupBy("label").count().orderBy("label").collect()]  # a row for each label
    return spark.createDataFrame([(g, i) for g, block in enumerate(V.contiguous(sizes)) for i in block], "g int, i int")


def _folder(spark, what: str) -> str:
    """A new folder where all executors can write: below spark.checkpoint.dir or, in local mode only, a temporary one."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="vecmill-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _written_lines(spark, df: DataFrame, what: str) -> str:
    """Text lines in one file, in their order."""
    path = _folder(spark, what)
    df.coalesce(1).write.text(path)
    return path


@query(
    "SELECT 'm:' || item_id AS query_id, text AS prompt, [CAST(item_id % 7 AS VARCHAR)] AS labels, CAST(2 AS INTEGER) AS n_candidates FROM benchmark"
)
def manifest_task(spark, sf):
    """Benchmark items written as a manifest and read back."""
    part = lambda v: F.struct(F.lit("text").alias("kind"), v.alias("value"))
    name = (F.col("item_id") % 7).cast("string")
    lines = table(spark, sf, "benchmark").select(
        F.to_json(F.struct(F.concat(F.lit("m:"), "item_id").alias("query_id"), F.array(part(F.col("text"))).alias("query_parts"), F.array(name).alias("labels"), F.array(*[F.struct(n.alias("name"), F.array(part(n)).alias("parts")) for n in (name, F.lit("other"))]).alias("candidates"))).alias("value")
    )
    q, _ = artifacts.read_manifest(spark, _written_lines(spark, lines, "manifest"), "m")
    return q.select("query_id", F.col("parts")[0]["value"].alias("prompt"), "labels", F.size("candidate_names").alias("n_candidates"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def jsonl_scan(spark, sf):
    """The first 25 lines of documents written by id."""
    lines = table(spark, sf, "documents").orderBy("doc_id").select(F.to_json(F.struct("doc_id", "lang")).alias("value"))
    return artifacts.read_jsonl(spark, _written_lines(spark, lines, "jsonl"), "doc_id long, lang string", 25).select("doc_id", "lang")


@query("SELECT source AS section, lang AS method, round(n / 1000, 4) AS recall1, round(n / 7, 4) AS j FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL)")
def result_tables(spark, sf):
    """Counts of documents as tables of a Markdown report, parsed back."""
    n = table(spark, sf, "documents").where("lang is not null and source is not null").groupBy("source", "lang").count()
    rows = n.select("source", F.col("lang").alias("k"), F.format_string("| **%s** | %.4f | %.4f |", "lang", F.col("count") / 1000, F.col("count") / 7).alias("value"))
    heads = n.select("source").distinct().select("source", F.posexplode(F.array(F.concat(F.lit("## "), "source"), F.lit("| method | recall@1 | J |"), F.lit("|---|---|---|"))).alias("k", "value"))
    lines = rows.withColumn("pos", F.struct("source", F.lit(9).alias("a"), "k")).select("pos", "value").union(heads.select(F.struct("source", F.col("k").alias("a"), F.lit("").alias("k")).alias("pos"), "value"))
    return artifacts.parse_result_tables(lines).select("section", "method", "recall1", "j")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS embedding FROM embeddings")
def vector_file_round_trip(spark, sf):
    """Vectors written by id as vector files and read back: a record's number is its id."""
    from ..sources import vecfile

    path = _folder(spark, "vectors").removeprefix("file://")
    vecfile.write_vectors(vectors(spark, sf).orderBy("vec_id"), path)
    return vecfile.read_vectors(spark, path).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def unique_in_order(spark, sf):
    return retrieval.unique(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(replace('<image>' || text || chr(13) || chr(10) || '  ', '<|image_1|>', ' '), '<image>', ' '), chr(13) || chr(10) || '?', chr(10), 'g'), '[ \t]+(\n|$)', '\\1', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS prompt FROM conversations")
def prompt_normalize(spark, sf):
    t = F.concat(F.lit("<image>"), F.col("text"), F.lit("\r\n  "))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalized_prompt(t).alias("prompt"))


_PROMPT = "trim(regexp_replace(regexp_replace(replace(replace({0}, '<|image_1|>', ' '), '<image>', ' '), chr(13) || chr(10) || '?', chr(10), 'g'), '[ \t]+(\n|$)', '\\1', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query("SELECT conv_id, turn, concat_ws(chr(10), nullif(" + _PROMPT.format("role") + ", ''), nullif(" + _PROMPT.format("text") + ", '')) AS prompt FROM conversations")
def join_prompt(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.joined_prompt(F.col("role"), F.lit("  "), F.col("text")).alias("prompt"))


@query("SELECT page_id, CASE lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '\\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'txt' THEN 'text/plain' END AS media_type FROM pages")
def mime_guess(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.media_type(F.regexp_replace("url", "[?#].*$", "")).alias("media_type"))


@query("SELECT page_id, coalesce(nullif(lower(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-')), ''), 'untitled') AS slug FROM pages")
def slugify(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), 80) AS stem FROM pages")
def cache_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.cache_stem(F.col("url")).alias("stem"))


@query("SELECT page_id, left(regexp_replace(name, '\\.[^.]+$', ''), 50) || '_' || left(md5(url), 8) || CASE WHEN regexp_extract(name, '(\\.[^.]+)$', 1) = '' THEN '.png' ELSE regexp_extract(name, '(\\.[^.]+)$', 1) END AS short FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)")
def short_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.short_name(F.col("url")).alias("short"))


@query("SELECT vec_id, CAST(n AS INTEGER) AS place, embedding[1 + [0, 9, 18, 27, 36, 45, 54, 63][n + 1]] AS x FROM embeddings, range(8) r(n)")
def sample_evenly(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(T.sampled_evenly(F.col("embedding"), 8)).alias("place", "x"))


@query("SELECT doc_id, 'model:64:document:' || sha256('[{\"kind\":\"text\",\"value\":\"' || lang || '/' || source || '\"}]') AS cache_key FROM documents")
def media_cache_key(spark, sf):
    parts = F.array(retrieval.text_part(F.concat_ws("/", "lang", "source")))
    return table(spark, sf, "documents").select("doc_id", T.cache_key("model", 64, "document", T.media_signature(parts)).alias("cache_key"))


def _cache(spark, sf):
    rows = vectors(spark, sf)
    status = F.when(F.col("label") == 9, "unavailable").otherwise("ok")
    return rows.select(F.concat(F.lit("k"), F.col("vec_id")).alias("cache_key"), status.alias("status"), F.col("embedding").alias("vector"), F.when(F.col("label") == 9, F.repeat(F.lit("e"), 2500)).alias("error"))


@query("SELECT doc_id, CASE WHEN label IS NULL THEN 'miss' WHEN label = 9 THEN 'unavailable' ELSE 'hit' END AS state FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def cache_three_way_split(spark, sf):
    wanted = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id")).alias("cache_key"))
    return artifacts.cache_split(wanted, _cache(spark, sf)).select("doc_id", "state")


@query("WITH new AS (SELECT doc_id FROM documents WHERE lang = 'fr'), every AS (SELECT 'k' || vec_id AS cache_key, CASE WHEN label = 9 THEN 'unavailable' ELSE 'ok' END AS status, CASE WHEN label = 9 THEN 2500 ELSE 0 END AS error_chars FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT 'k' || doc_id, 'unavailable', 2000 FROM new) SELECT cache_key, status, CAST(error_chars AS INTEGER) AS error_chars FROM every")
def cache_upsert(spark, sf):
    new = table(spark, sf, "documents").where("lang = 'fr'").select(F.concat(F.lit("k"), F.col("doc_id")).alias("cache_key"), F.lit("unavailable").alias("status"), F.lit(None).cast("array<float>").alias("vector"), F.repeat(F.lit("x"), 3000).alias("error"))
    return artifacts.cache_upsert(_cache(spark, sf), new).select("cache_key", "status", F.coalesce(F.length("error"), F.lit(0)).alias("error_chars"))


# ---- task parsers over documents as annotation rows


def annotated(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("pos"), F.lit("Find it.").alias("qry_inst"), F.col("lang").alias("qry_text"), F.concat("source", F.lit(".png")).alias("qry_img_path"), F.array(F.col("source"), F.col("lang")).alias("tgt_text"), F.array(F.concat("source", F.lit("/a.jpg")), F.concat("lang", F.lit("/b.jpg")), F.lit("c.jpg")).alias("tgt_img_path"))


@query("SELECT 'qa:' || doc_id AS query_id, source AS label, CAST(2 AS INTEGER) AS n_candidates, 'Find it.' || chr(10) || lang AS prompt FROM documents")
def task_image_to_text(spark, sf):
    q, _ = retrieval.parse_image_to_text(annotated(spark, sf), "qa")
    return q.select("query_id", F.get("labels", F.lit(0)).alias("label"), F.size("candidate_names").alias("n_candidates"), F.col("parts")[0]["value"].alias("prompt"))


@query("SELECT 't2i:' || doc_id AS query_id, source || '/a.jpg:' || source AS label, CAST(2 AS INTEGER) AS n_candidates, 'Find it.' || chr(10) || lang AS prompt FROM documents")
def task_text_to_image_queries(spark, sf):
    q, _ = retrieval.parse_text_to_image(annotated(spark, sf), "t2i", named_by_caption=True)
    return q.select("query_id", F.get("labels", F.lit(0)).alias("label"), F.size("candidate_names").alias("n_candidates"), F.col("parts")[0]["value"].alias("prompt"))


@query("SELECT DISTINCT name FROM (SELECT source || '/a.jpg:' || source AS name FROM documents UNION ALL SELECT lang || '/b.jpg:' || lang FROM documents)")
def task_text_to_image(spark, sf):
    return retrieval.parse_text_to_image(annotated(spark, sf), "t2i", named_by_caption=True)[1].select("name")


@query("SELECT 'cls:' || doc_id AS query_id, lang AS label, CAST((SELECT count(DISTINCT lang) FROM documents) AS INTEGER) AS n_candidates FROM documents")
def task_video_classes(spark, sf):
    rows = annotated(spark, sf).select("pos", F.col("qry_text").alias("pos_text"), F.lit("v.mp4").alias("video_path"))
    q, _ = retrieval.parse_video_classes(rows, "cls")
    return q.select("query_id", F.get("labels", F.lit(0)).alias("label"), F.size("candidate_names").alias("n_candidates"))


@query("SELECT CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS label, count(*) AS n FROM labels GROUP BY ALL")
def task_yes_no(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.lit("v.mp4").alias("video_name"), F.lit("Is it?").alias("question"), F.when(F.col("toxic") == 1, " Yes").otherwise("No").alias("answer"))
    return retrieval.parse_yes_no(rows, "yn")[0].groupBy(F.get("labels", F.lit(0)).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT 'moment:' || min(doc_id) AS query_id, count(*) FILTER (WHERE lang = 'en') AS n_labels, count(*) AS n_candidates FROM documents GROUP BY source")
def task_moments(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.groupBy(F.col("source").alias("clips_dir_path")).agg(F.min("doc_id").alias("pos")).withColumn("query", F.lit("when?"))
    clips = d.select(F.col("source").alias("clips_dir_path"), F.concat("doc_id", F.when(F.col("lang") == "en", "_Positive.mp4").otherwise("_other.mp4")).alias("clip"))
    q, _ = retrieval.parse_moments(rows, clips, "moment")
    return q.select("query_id", F.size("labels").cast("long").alias("n_labels"), F.size("candidate_names").cast("long").alias("n_candidates"))


@query("SELECT key, min(url) AS path FROM (SELECT url, unnest([n, regexp_replace(n, '\\.[^.]+$', ''), regexp_replace(regexp_replace(n, '\\.[^.]+$', ''), '^v_', '')]) AS key FROM (SELECT url, regexp_extract(url, '([^/]*)$', 1) AS n FROM pages)) GROUP BY key")
def directory_lookup(spark, sf):
    return retrieval.path_index(table(spark, sf, "pages").select(F.col("url").alias("path")))


# ---- statistics of reports


@query("SELECT l_orderkey, l_linenumber, round(coalesce((l_quantity - lo) / nullif(hi - lo, 0), 0.5), 6) AS scaled FROM lineitem JOIN (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL) USING (l_returnflag)")
def minmax_by_group(spark, sf):
    m = metrics.min_max(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag")
    return m.select("l_orderkey", "l_linenumber", F.round("scaled", 6).alias("scaled"))


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def ols_fit(spark, sf):
    o = metrics.ols(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return o.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("SELECT min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(quantile_cont(l_extendedprice, 0.02), 4) AS q1, round(quantile_cont(l_extendedprice, 0.98), 4) AS q2 FROM lineitem")
def quantile_range(spark, sf):
    r = metrics.value_range(table(spark, sf, "lineitem"), "l_extendedprice", 0.02, 0.98)
    return r.select("least", "most", F.round("q1", 4).alias("q1"), F.round("q2", 4).alias("q2"))


@query("SELECT source AS quantizer, 'original' AS space, CAST(row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS INTEGER) AS group_id, CAST(n AS INTEGER) AS ndims, CAST(8 AS INTEGER) AS bits, round(n / 8, 6) AS d_proxy FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL)")
def group_stats_log(spark, sf):
    """Log lines made of counts of documents, a file a source, and parsed back."""
    n = table(spark, sf, "documents").where("lang is not null and source is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("lang"))
    rows = n.select(F.col("source").alias("name"), place.alias("pos"), F.format_string("[group-stats] group[%03d] ndims=%d bits=8 D_proxy=%.6f", place - 1, F.col("n"), F.col("n") / 8).alias("value"))
    heads = n.select(F.col("source").alias("name"), F.lit(0).alias("pos"), F.concat(F.lit("[group-stats] quantizer="), "source", F.lit(" space=original entries=4")).alias("value")).distinct()
    return artifacts.parse_group_stats(heads.unionByName(rows))


# ---- trained models: checked by their properties


def _report(name: str, q: Q.Quantizer, spark, sf) -> DataFrame:
    df, a = vectors(spark, sf), asked(spark, sf)
    codes = q.encode(df).persist()
    found = search.adc_top_k(q, codes, a, 100).persist()  # read twice
    truth = search.exact_top_k(df, a, 100).persist()
    r = metrics.recall_at(found, truth, (1, 10, 100)).groupBy().pivot("k", [1, 10, 100]).agg(F.first("recall")).toDF("recall_1", "recall_10", "recall_100")
    row = [F.lit(name).alias("model"), F.lit(len(q.groups)).alias("groups"), F.lit(int(sum(q.nbits))).alias("bits"), "mse", "recall_1", "recall_10", "recall_100", "overlap"]
    return metrics.coding_error(q, df).crossJoin(r).crossJoin(metrics.overlap_at(found, truth, 100).drop("k")).select(*row)  # one row each


@query()
def trained_pq(spark, sf):
    return _report("pq", Q.fit_pq(vectors(spark, sf), 8, 4), spark, sf)


@query()
def trained_opq(spark, sf):
    return _report("opq", Q.fit_opq(vectors(spark, sf), 32, 4, rounds=10), spark, sf)


@query()
def trained_pca_bits(spark, sf):
    return _report("pca_bits", Q.fit_pca_bits(vectors(spark, sf), 32, most=6), spark, sf)


def small_structure(spark, sf):
    options = {"grow": {"least_groups": 8}, "merge": {"width": 2, "children": 3, "pool": 64, "shortlist": 16}, "moves": {"rounds": 4, "patience": 2, "moves": 12, "swaps": 6}}
    return structure.find(vectors(spark, sf), 32, most_bits=6, options=options)


@query()
def structure_search(spark, sf):
    s = small_structure(spark, sf)
    return spark.createDataFrame([(g, d, b) for g, (d, b) in enumerate(zip(s.groups, s.nbits))], "group_id int, dims array<int>, nbits int")


@query()
def trained_uneven(spark, sf):
    s = small_structure(spark, sf)
    return _report("uneven", Q.fit_uneven(vectors(spark, sf), s.groups, s.nbits, rotate=False), spark, sf)


@query()
def trained_uneven_rotated(spark, sf):
    s = small_structure(spark, sf)
    return _report("uneven_rotated", Q.fit_uneven(vectors(spark, sf), s.groups, s.nbits, rotation_rounds=8), spark, sf)


@query()
def trained_residual(spark, sf):
    return _report("residual", Q.fit_residual(vectors(spark, sf), 8, 4), spark, sf)


@query()
def trained_product_residual(spark, sf):
    return _report("product_residual", Q.fit_residual(vectors(spark, sf), 4, 4, m=2), spark, sf)


@query()
def trained_local_search(spark, sf):
    return _report("local_search", Q.fit_residual(vectors(spark, sf), 8, 4, refine=2), spark, sf)


@query()
def benchmark_run(spark, sf):
    """Metrics of a retrieval task over judged documents with the seeded embedder."""
    q, corpus = judged(spark, sf)
    return retrieval.run_benchmark(q, corpus, retrieval.HashEmbedder(32), search.VectorIndex(mode="dot"))[0]


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)
