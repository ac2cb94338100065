"""Operators against small recomputations, and their properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from vecmill.functions import text as T
from vecmill.functions import vectors as V
from vecmill.operators import allocation, kernels, metrics, retrieval, search, structure
from vecmill.operators import quantizers as Q


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(5).standard_normal((60, 6)).round(3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=3, max_size=5), min_size=1, max_size=5), st.integers(0, 12))
def test_dp_is_best(costs, total):
    import itertools

    every = [b for b in itertools.product(*[range(len(c)) for c in costs]) if sum(b) == total]
    table = [list(map(float, c)) for c in costs]
    if not every:
        with pytest.raises(ValueError):
            allocation.dp_bits(table, total)
        return
    least = min(sum(c[b] for c, b in zip(table, bs)) for bs in every)
    bits, j = allocation.dp_bits(table, total)
    assert sum(bits) == total and j == least == sum(c[b] for c, b in zip(table, bits))
    # of equal sums the last group takes most
    assert bits[-1] == max(bs[-1] for bs in every if sum(c[b] for c, b in zip(table, bs)) == least)
    greedy = allocation.greedy_from_table(table, total)
    assert sum(greedy) == total and sum(c[b] for c, b in zip(table, greedy)) >= least


def test_kmeans_edges():
    x = np.array([[0.0, 0], [0, 1], [5, 5]])
    assert np.allclose(kernels.kmeans(x, 1), x.mean(0))
    assert len(kernels.kmeans(x, 8)) == 3
    assert len(kernels.kmeans(np.zeros((10, 2)), 4)) == 4


def test_rotation_is_orthogonal():
    rng = np.random.default_rng(1)
    for _ in range(5):
        x, y = rng.standard_normal((30, 5)), rng.standard_normal((30, 5))
        r = kernels.procrustes(x, y)
        assert np.allclose(r.T @ r, np.eye(5)) and np.isclose(np.linalg.det(r), 1)
    q = np.linalg.qr(rng.standard_normal((5, 5)))[0]
    q[:, 0] *= np.sign(np.linalg.det(q))
    assert np.allclose(kernels.procrustes(x, x @ q), q)


def test_ties_and_clamp(spark):
    base = frame(spark, [[1, 0], [1, 0], [0, 1]])
    got = search.exact_top_k(base, frame(spark, [[1, 0]], 9), 10).orderBy("rank").collect()
    assert [(r["vec_id"], r["dist"]) for r in got] == [(0, 0.0), (1, 0.0), (2, 2.0)]
    with pytest.raises(ValueError):
        search.ground_truth(base, base, 4)
    assert search.exact_top_k(base.where("false"), base, 3).count() == 0
    assert search.exact_top_k(base, base.where("false"), 3).count() == 0


def test_compressed_search(spark, points):
    df = frame(spark, points)
    groups, bits = [[0, 5], [1, 2], [3, 4]], [2, 3, 0]
    for rotate in (False, True):
        q = Q.fit_uneven(df, groups, bits, rotate=rotate, rotation_rounds=2)
        x = np.array(points, np.float32).astype(float)
        codes = q.codes(x)
        assert (codes[:, 2] == 0).all()
        back = q.decode(codes)
        got = search.adc_top_k(q, q.encode(df), df, 60).toPandas()
        want = kernels.squared_distances(x, back)
        assert np.allclose(got["dist"], want[got["qid"], got["vec_id"]], atol=2e-6)
        own = search.sdc_top_k(q, q.encode(df), df, 60).toPandas()
        assert np.allclose(own["dist"], kernels.squared_distances(back, back)[own["qid"], own["vec_id"]], atol=2e-6)
        assert np.allclose(q.codes(back), codes)


def test_full_precision(spark, points):
    df = frame(spark, points[:8])
    q = Q.fit_pq(df, 4, bits=3)
    assert q.width == 8 and q.d == 6
    e = metrics.reconstruction_error(df, q.decoded(q.encode(df))).first()
    assert e["mse"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        Q.fit_pq(df, 4, pad=False)
    with pytest.raises(ValueError):
        Q.opq_layout(6, 33, 8)


def test_residuals_help(spark, points):
    df = frame(spark, points)
    errors = []
    for stages in (1, 2, 3):
        q = Q.fit_residual(df, stages, 2)
        errors.append(metrics.reconstruction_error(df, q.decoded(q.encode(df))).first()["mse"])
    assert errors[0] > errors[1] > errors[2]
    x = np.array(points, np.float32).astype(float)
    codes = Q.local_search_codes(q, x)
    assert ((x - q.decode(codes)) ** 2).sum() <= ((x - q.decode(q.codes(x))) ** 2).sum() + 1e-9
    with pytest.raises(ValueError):
        search.sdc_top_k(q, q.encode(df), df, 2)


def test_lloyd_step_lowers_the_error(spark, points):
    df = frame(spark, points)
    q = Q.Quantizer(6, V.balanced_groups(6, 2), [2, 2], Q.first_books(df, V.balanced_groups(6, 2), 2))
    errors = []
    for _ in range(3):
        q.codebooks, t = Q.lloyd_step(df, q)
        errors.append(t.agg(F.sum("error")).first()[0])
    assert errors[0] >= errors[1] >= errors[2]


@pytest.mark.parametrize("bad", [[[0, 1], [1, 2]], [[0], [2]], [[0, 1], [2, 3]], [[0, 1, 2], []], []])
def test_bad_partitions(bad):
    with pytest.raises(ValueError):
        Q.check_partition(bad, 3)


def test_structure_json():
    s = structure.Structure(4, 6, [[0, 3], [1, 2]], [4, 2], {"note": "x"})
    assert structure.Structure.load(s.dump()) == s
    for change in ({"nbits": [4, 3]}, {"format_version": 3}, {"groups": [[0, 3], [1]]}):
        import json

        with pytest.raises(ValueError):
            structure.Structure.load(json.dumps(json.loads(s.dump()) | change))


def test_search_stages_better_the_cost(points):
    ctx = structure.Context(points, 8, 4)
    groups = structure.grow(ctx, least_groups=4, k=3)
    bits, j = ctx.solve(groups)
    assert sum(bits) == 8
    merged, mbits, mj = structure.merge_beam(ctx, groups, width=2, children=2, pool=32, shortlist=8)
    assert mj <= j and sum(mbits) == 8
    moved, _, vj = structure.marginal_beam(ctx, merged, rounds=3, patience=2, moves=8, swaps=4)
    assert vj <= mj
    Q.check_partition(moved, 6)
    assert structure.singleton_groups(ctx)[0] == [[i] for i in range(6)]
    assert structure.parse_stages("full") == structure.STAGES and structure.parse_stages("moves+grow") == ("grow", "moves")
    with pytest.raises(ValueError):
        structure.parse_stages("other")


def test_costs_by_job_and_alone_agree(spark, points):
    a = structure.HoldoutCost(points, job_from=1, spark=spark)
    b = structure.HoldoutCost(points)
    keys = [((0, 1), 1), ((2,), 2), ((3, 5, 4), 0)]
    a.need(keys)
    assert [a(*k) for k in keys] == [b(*k) for k in keys]


def test_mutual_ties_have_two_votes(spark):
    n = spark.createDataFrame([(0, 1, 1, 0.5), (1, 1, 0, 0.5), (2, 1, 0, 0.25)], "i int, rank int, j int, w double")
    got = {(r["a"], r["b"]): (r["votes"], r["weight"]) for r in metrics.adjacency_votes(n).collect()}
    assert got == {(0, 1): (2, 1.0), (1, 0): (2, 1.0), (2, 0): (1, 0.25), (0, 2): (1, 0.25)}


def test_split_sizes():
    assert V.split_sizes(1, 9, 9, 0.2) == (1, 1)
    assert V.split_sizes(100, 60, 30, 0.2) == (60, 30)
    assert V.split_sizes(10, 60, 30, 0.9) == (5, 5)
    assert V.split_sizes(2, 60, 30, 0.0) == (1, 1)


def test_one_row_is_both(spark):
    parts = V.train_eval_split(frame(spark, [[1, 2]])).select("part").collect()
    assert sorted(r["part"] for r in parts) == ["eval", "train"]


def test_prompts(spark):
    df = spark.createDataFrame([("<image>a \r\nb\t\r",), ("  ",), (None,), ("<|image_1|>x",)], "t string")
    got = [r[0] for r in df.select(T.normalized_prompt(F.col("t"))).collect()]
    assert got == ["a\nb", "", None, "x"]
    assert spark.range(1).select(T.joined_prompt(F.lit(" a "), F.lit(""), F.lit("b"))).first()[0] == "a\nb"
    assert T.evenly(list(range(10)), 4) == [0, 3, 6, 9]


def test_ranking_metrics(spark):
    result = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "qid long, rank int, item string")
    labels = spark.createDataFrame([(1, "b"), (1, "b"), (1, "z"), (2, "x"), (3, "y")], "qid long, item string")
    m = {r["k"]: r for r in metrics.ranking_metrics(result, labels, (1, 2)).collect()}
    assert (m[1]["hit"], m[1]["mrr"]) == (0.0, 0.0)
    assert m[2]["queries"] == 3 and m[2]["hit"] == pytest.approx(1 / 3) and m[2]["precision"] == pytest.approx(1 / 6) and m[2]["recall"] == pytest.approx(1 / 6) and m[2]["mrr"] == pytest.approx(1 / 6)


def test_ols_guards(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    r = metrics.ols(flat, "x", "y").first()
    assert (r["slope"], r["intercept"], r["r2"]) == (0.0, 3.0, 0.0)
    r = metrics.ols(flat.select("y", "x"), "y", "x").first()
    assert (r["slope"], r["r2"]) == (0.0, 1.0)


def test_client_embedder_halves_batches(spark):
    def client():
        def call(parts, is_query):
            if any(p[0]["value"] == "bad" for p in parts):
                raise retrieval.InvalidInput("no")
            return [[float(len(p[0]["value"])), 1.0] for p in parts]

        return call

    items = spark.createDataFrame([(i, [("text", v, None)]) for i, v in enumerate(["a", "bad", "ccc", "dd"])], f"key long, parts array<{retrieval.PART}>")
    got = {r["key"]: (r["vector"], r["error"]) for r in retrieval.ClientEmbedder(client, 2).embed(items, False).collect()}
    assert got[0] == ([1.0, 1.0], None) and got[1] == (None, "no") and got[2][0] == [3.0, 1.0]


def test_hash_embedder(spark):
    items = spark.createDataFrame([(1, [("text", "a", None)]), (2, [("text", "a", None)]), (3, [("text", "b", None)])], f"key long, parts array<{retrieval.PART}>")
    v = {r["key"]: r["vector"] for r in retrieval.HashEmbedder(8).embed(items, False).collect()}
    q = {r["key"]: r["vector"] for r in retrieval.HashEmbedder(8).embed(items, True).collect()}
    assert v[1] == v[2] != v[3] and v[1] != q[1]
    assert np.linalg.norm(v[1]) == pytest.approx(1, abs=1e-5)


def test_streamed_codes(spark, tmp_path):
    from vecmill.streaming.encode import encode_stream

    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    df.write.parquet(str(tmp_path / "in"))
    q = Q.fit_pq(df, 4, 2)
    done = encode_stream(spark, q, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    done.awaitTermination(120)
    a = spark.read.parquet(str(tmp_path / "out")).orderBy("vec_id").collect()
    assert a == q.encode(df).orderBy("vec_id").collect()


def test_correlation_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 5)) + 1e6
    x[:, 3] = 7.0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = np.zeros((5, 5))
    for r in metrics.dim_correlation(df).collect():
        got[r["i"], r["j"]] = r["r"]
    want = np.zeros((5, 5))
    keep = [0, 1, 2, 4]
    want[np.ix_(keep, keep)] = np.corrcoef(x[:, keep].T)
    assert np.allclose(got, want, atol=1e-9)
    assert metrics.dim_correlation(df.where("false")).count() == 0


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    for x in (rng.standard_normal(3001), rng.integers(0, 3, 500) * 1.0, np.array([5.0]), np.full(100, 2.5)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(4)
        r = metrics.value_range(df, "x", 0.02, 0.5, 1.0, accuracy=100).first()
        assert np.allclose(list(r), [x.min(), x.max(), *np.quantile(x, [0.02, 0.5, 1.0])])
    assert list(metrics.value_range(df.where("false"), "x", 0.5).first()) == [None, None, None]


def test_coding_error_is_reconstruction_error(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((200, 8)))], "vec_id long, embedding array<double>")
    q = Q.fit_pq(df, 4, 3)
    assert np.allclose(list(metrics.coding_error(q, df).first()), list(metrics.reconstruction_error(df, q.decoded(q.encode(df))).first()))
    assert metrics.coding_error(q, df.where("false")).first()["n"] == 0


def test_many_query_blocks_in_one_pass():
    blocks = [(np.arange(4), np.zeros((4, 8)))] * 10
    assert [len(p) for p in search.passes(iter(blocks), most=3 * 256)] == [3, 3, 3, 1] and list(search.passes(iter([]))) == []


def one_task(x, ids, queries, k, size, **options):
    """Rows that a task of exact search hands on, from batches of ``size`` rows."""
    import pyarrow as pa

    batches = (pa.RecordBatch.from_arrays([pa.array(ids[i : i + size]), kernels.lists(x[i : i + size], pa.float64())], ["vec_id", "v"]) for i in range(0, len(x), size))
    blocks = [(np.arange(len(queries)), queries)]
    return list(search.best_of_task(batches, blocks, lambda b: kernels.matrix(b["v"]), lambda v, q: kernels.squared_distances(q, v), k, **options))


def test_task_search_against_sorting():
    rng = np.random.default_rng(5)
    for k, size, tile in ((1, 7, 1), (5, 3, 40), (100, 20, 64), (4, 1000, 1 << 19)):
        x, q = rng.integers(-2, 3, (60, 3)) * 1.0, rng.integers(-2, 3, (9, 3)) * 1.0
        x[::7] = np.nan  # last, by id
        ids = rng.permutation(60) * 50
        got = [r for b in one_task(x, ids, q, k, size, tile=tile) for r in zip(*(b[c].to_pylist() for c in ("qid", "vec_id")))]
        want = [(i, ids[j]) for i, d in enumerate(kernels.squared_distances(q, x)) for j in np.lexsort((ids, d))[:k]]
        assert got == want


def test_task_search_holds_tiles_not_all_pairs():
    import tracemalloc

    rng = np.random.default_rng(6)
    peaks = []
    for n in (500, 4000):
        x, q = rng.standard_normal((10_000, 4)), rng.standard_normal((n, 4))
        tracemalloc.start()
        rows = sum(b.num_rows for b in one_task(x, np.arange(10_000), q, 10, 5000))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        assert rows == n * 10  # once a task, not once a batch
    assert peaks[1] < 40 and peaks[1] < 2 * peaks[0]  # 4000 x 5000 scores are 160 MB


def test_results_count_in_passes():
    blocks = [(np.arange(4), np.zeros((4, 8)))] * 10
    assert [len(p) for p in search.passes(iter(blocks), most=3 * 256, k=8)] == [1] * 10
    assert search.block_size(4096, 10) == 4096 and search.block_size(4096, 10_000) == 104 and search.block_size(4096, 1 << 30) == 1


def test_class_metrics_list_no_pairs(spark):
    queries = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, None), (4, "a")], "qid long, label string")
    items = spark.createDataFrame([(i, "abx"[i % 3]) for i in range(30)] + [(0, "a"), (99, None)], "item long, label string")
    result = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 3), (1, 1, 0), (1, 5, 4), (3, 1, 0), (4, 1, 99), (4, 2, 3), (4, 4, 3)], "qid long, rank int, item long")
    got = metrics.class_ranking_metrics(result, queries, items).orderBy("k")
    want = metrics.ranking_metrics(result, queries.join(items, "label").select("qid", "item")).orderBy("k")
    assert np.allclose(got.collect(), want.collect())
    many = spark.range(40_000).selectExpr("id as item", "'a' as label")
    r = metrics.class_ranking_metrics(spark.createDataFrame([(0, 1, 5)], "qid long, rank int, item long"), many.selectExpr("item as qid", "label"), many, (1,)).first()  # 1,600,000,000 pairs
    assert r["queries"] == 40_000 and r["recall"] == pytest.approx(1 / 40_000 / 40_000)
