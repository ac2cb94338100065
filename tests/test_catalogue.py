"""Every registered query of the vector engine: against its oracle, or by its properties."""

import pytest

from tests.conftest import SF
from vecmill.plans import catalogue

ORACLES = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("trained_")))
def test_trained(name, spark):
    r = QUERIES[name](spark, SF).first()
    assert r["bits"] == 32 and 0 < r["mse"] < 0.75
    assert r["recall_1"] <= r["recall_10"] <= r["recall_100"] == 1.0
    assert r["overlap"] > 0.35


def test_structure_search(spark):
    rows = QUERIES["structure_search"](spark, SF).collect()
    assert sorted(i for r in rows for i in r["dims"]) == list(range(64))
    assert sum(r["nbits"] for r in rows) == 32


def test_split_and_costs_take_all_rows(spark):
    import hashlib

    import numpy as np

    from vecmill.operators.structure import holdout_cost

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) as v").collect()
    parts = QUERIES["default_train_eval_split"](spark, SF).collect()
    assert sorted(r["vec_id"] for r in parts) == sorted(r["vec_id"] for r in rows) and sum(r["part"] == "eval" for r in parts) == len(rows) // 5
    x = np.array([r["v"] for r in sorted(rows, key=lambda r: (hashlib.md5(f"123:{r['vec_id']}".encode()).hexdigest(), r["vec_id"]))])
    order = np.random.default_rng(123).permutation(len(x))
    n = len(x) - len(x) // 5
    train, held = x[order[:n]], x[order[n:]]
    got = {(r["g"], r["b"]): r["cost"] for r in QUERIES["holdout_cost_table"](spark, SF).collect()}
    assert len(got) == 20
    for (g, b), cost in got.items():
        dims = tuple(catalogue.GROUPS[g])
        want = ((held[:, dims] - train[:, dims].mean(axis=0)) ** 2).sum(axis=1).mean() if b == 0 else holdout_cost(train, held, dims, b, 123)
        assert abs(cost - want) < 1e-5
        assert b == 0 or cost < got[g, b - 1]


def test_benchmark_run(spark):
    rows = {r["k"]: r for r in QUERIES["benchmark_run"](spark, SF).collect()}
    assert set(rows) == {1, 5, 10}
    assert rows[10]["kept_queries"] == 40 and rows[10]["kept_candidates"] == 1000
    assert rows[1]["hit"] <= rows[10]["hit"]


def test_entry_without_training_operators(monkeypatch, spark):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "vecmill.llm", None)
    monkeypatch.setitem(sys.modules, "vecmill.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLES)
    assert entry.entry(spark).count() > 0
    sys.modules.pop("__spark_entry__", None)
