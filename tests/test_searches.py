"""The searches of registered queries, as their tasks run them."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from vecmill.operators import kernels
from vecmill.operators.structure import Structure
from vecmill.plans import catalogue

#: Each with its k and whether it searches codes before the vectors.
SEARCHES = {
    "trained_residual": (100, True),
    "trained_product_residual": (100, True),
    "trained_opq": (100, True),
    "exact_cosine_topk": (10, False),
    "ground_truth_k": (100, False),
    "trained_uneven": (100, True),
    "overlap_at_k": (10, True),
    "exact_l2_topk": (10, False),
    "trained_local_search": (100, True),
    "adc_vs_exact_recall": (10, True),
    "trained_pq": (100, True),
    "trained_uneven_rotated": (100, True),
}


@pytest.mark.parametrize("name", SEARCHES)
def test_search_of_query_is_bounded(spark, tmp_path, monkeypatch, name):
    """A task of the query's searches gets three batches. It holds less than one table of a batch's pairs and hands
    on the k best of all three once for each query."""
    n, (k, codes) = 2500, SEARCHES[name]
    x, ids = np.random.default_rng(3).standard_normal((n, 64)), np.arange(n) * 50  # all are queries
    spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": list(x)})).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(catalogue, "small_structure", lambda spark, sf: Structure(64, 32, [list(range(g, 64, 8)) for g in range(8)], [6, 2] * 4))
    runs, frames = [], type(spark.range(1))
    real = frames.mapInArrow
    monkeypatch.setattr(frames, "mapInArrow", lambda df, f, schema, *a, **o: runs.append((f, schema)) or real(df, f, schema, *a, **o))
    catalogue.queries()[name](spark, str(tmp_path))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), kernels.lists(x, pa.float64())], ["vec_id", "v"])
    given = [next(f(iter([batch]))) for f, schema in runs if schema == "vec_id long, codes array<int>"] + [batch]
    searches = [f for f, schema in runs if schema == kernels.RESULT]
    assert len(searches) == len(given) == 1 + codes
    for f, b in zip(searches, given):
        tracemalloc.start()
        rows = sum(r.num_rows for r in f(iter([b, b, b])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n * k and peak < 8 * n * n
