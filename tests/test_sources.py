"""Files, stores and parsers."""

import numpy as np
import pytest

from vecmill.operators import quantizers as Q
from vecmill.operators import search
from vecmill.sources import artifacts, vecfile


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def test_vector_files(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((50, 7)).astype("<f4")
    one = tmp_path / "base.fvecs"
    one.write_bytes(np.hstack([np.full((50, 1), 7, "<i4"), x.view("<i4")]).tobytes())
    vecfile.register(spark)
    df = spark.read.format("vecfile").option("recordsPerPartition", 20).load(str(one))
    assert df.rdd.getNumPartitions() == 3
    assert np.allclose([r["embedding"] for r in df.orderBy("vec_id").collect()], x)
    out = str(tmp_path / "copy")
    vecfile.write_vectors(df.coalesce(2), out)
    back = vecfile.read_vectors(spark, out)
    assert np.allclose(sorted(map(tuple, (r["embedding"] for r in back.collect()))), sorted(map(tuple, x.tolist())))
    truth = search.exact_top_k(df, df, 3)
    ids = str(tmp_path / "truth")
    vecfile.write_vectors(vecfile.truth_rows(truth).coalesce(1), ids, "i")
    assert [r["embedding"][0] for r in vecfile.read_vectors(spark, ids, "i").orderBy("vec_id").collect()] == list(range(50))
    vecfile.register_dataset("tiny", str(one), str(one), str(one), ids)
    got = vecfile.load_dataset(spark, "Tiny", max_train=10)
    assert got["learn"].count() == 10 and got["truth"].count() == 50
    with pytest.raises(KeyError):
        vecfile.load_dataset(spark, "other")
    with pytest.raises(ValueError):
        vecfile.slice_vectors(df, 45, 10)


def test_bad_vector_files(tmp_path):
    for name, raw in (("empty", b""), ("cut", np.array([2, 0], "<i4").tobytes()), ("zero", np.array([0], "<i4").tobytes())):
        p = tmp_path / f"{name}.fvecs"
        p.write_bytes(raw)
        with pytest.raises(ValueError):
            vecfile.record_shape(str(p))
    with pytest.raises(FileNotFoundError):
        vecfile.dataset_from_folder(str(tmp_path))


def test_model_store(spark, tmp_path):
    df = frame(spark, np.random.default_rng(1).standard_normal((40, 6)))
    for q in (Q.fit_pq(df, 4, 2), Q.fit_opq(df, 6, 2, rounds=2), Q.fit_pca_bits(df, 5, q=2, most=3), Q.fit_residual(df, 2, 2)):
        path = str(tmp_path / q.kind)
        artifacts.save_model(spark, q, path, q.encode(df))
        r = artifacts.load_model(spark, path)
        assert (r.groups, r.nbits, r.kind, r.stages) == (q.groups, q.nbits, q.kind, q.stages)
        assert r.encode(df).orderBy("vec_id").collect() == q.encode(df).orderBy("vec_id").collect() == artifacts.load_codes(spark, path).orderBy("vec_id").collect()


def test_model_cache_path(spark):
    df = frame(spark, [[1, 2], [3, 4]])
    a = artifacts.model_cache_path("/c", "pq", {"bits": 8}, df)
    assert a == artifacts.model_cache_path("/c", "pq", {"bits": 8}, df.orderBy("vec_id", ascending=False))
    assert a != artifacts.model_cache_path("/c", "pq", {"bits": 4}, df) and a.startswith("/c/pq/bits8_")
    assert a != artifacts.model_cache_path("/c", "pq", {"bits": 8}, df.limit(1))


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    part = '{"kind":"text","value":"%s"}'
    p.write_text("\n".join(['{"query_parts":[%s],"labels":["x"],"candidates":[{"name":"x","parts":[%s]},{"name":"y","parts":[]}]}' % (part % "q1", part % "first"), "", '{"query_id":"own","query_parts":[],"candidates":[{"name":"x","parts":[%s]}]}' % (part % "second")]))
    q, c = artifacts.read_manifest(spark, str(p), "t", limit=5)
    assert [(r["query_id"], r["labels"], r["candidate_names"]) for r in q.orderBy("pos").collect()] == [("t:0", ["x"], ["x", "y"]), ("own", [], ["x"])]
    assert {r["name"]: r["parts"][0]["value"] if r["parts"] else None for r in c.collect()} == {"x": "first", "y": None}


def test_catalog(tmp_path):
    text = "# tasks\nA:\n  group: cls\n  aliases: [core, 'other']\nB:\n  group: qa\n  aliases:\n    - core\n"
    tasks = artifacts.parse_catalog(text)
    assert tasks["A"] == {"dataset_split": "test", "media_root": "image-tasks", "aliases": ["core", "other"], "group": "cls"}
    assert artifacts.in_group(tasks, "core") == ["A", "B"] and artifacts.in_group(tasks, "qa") == ["B"]
    a, b = tmp_path / "a.yaml", tmp_path / "b.yaml"
    a.write_text(text)
    b.write_text("A:\n  group: new\n")
    assert artifacts.load_catalogs([str(a), str(b)])["A"]["group"] == "new"


def test_result_tables(spark):
    lines = ["# Results", "| method | M | recall@1 | J |", "|---|---|---|---|", "| **PQ** | 8 | 0.25 | 10.5 |", "## Next", "| variant | recall@1 | J_proxy |", "|--|--|--|", "| <b>X</b> | **0.5** | 3 |", "| note | - | - |"]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, value string")
    got = [tuple(r) for r in artifacts.parse_result_tables(df).orderBy("recall1").collect()]
    assert got == [("Results", "PQ", 0.25, 10.5), ("Next", "X", 0.5, 3.0)]


def test_cache_upsert_cuts_errors(spark):
    old = spark.createDataFrame([("a", "ok", "x")], "cache_key string, status string, error string")
    new = spark.createDataFrame([("a", "unavailable", "e" * 2500), ("b", None, None)], "cache_key string, status string, error string")
    got = {r["cache_key"]: (r["status"], len(r["error"] or "")) for r in artifacts.cache_upsert(old, new).collect()}
    assert got == {"a": ("unavailable", 2000), "b": ("ok", 0)}


def test_structure_files(tmp_path):
    from vecmill.operators.structure import Structure

    s = Structure(3, 4, [[0, 2], [1]], [3, 1])
    p = artifacts.structure_cache_path(str(tmp_path), 3, 4, ("grow",))
    artifacts.save_structure(s, p)
    assert artifacts.load_structure(p, 3, 4) == s
    assert artifacts.find_structure("structure_d3_b4_grow", (str(tmp_path),)) == p
    with pytest.raises(ValueError):
        artifacts.load_structure(p, 4, 4)


def test_charts():
    from xml.etree import ElementTree

    from vecmill.report import svg

    bar = ElementTree.fromstring(svg.group_bar([(0, 3, 8, 0.5), (1, 5, 4, 0.5)], "a < b"))
    assert len([e for e in bar if e.tag.endswith("rect")]) == 2 and svg.scale([2.0, 2.0]) == [0.5, 0.5]
    chart = ElementTree.fromstring(svg.scatter([(0, 1, "x"), (2, 3, "y")], {"slope": 1.0, "intercept": 1.0, "r2": 1.0}))
    assert len([e for e in chart if e.tag.endswith("circle")]) == 2


def test_command_lines(spark, tmp_path, monkeypatch, capsys):
    from vecmill.cli import bench, retrieval

    monkeypatch.setattr(bench, "build_session", lambda *a: spark)
    monkeypatch.setattr(retrieval, "build_session", lambda *a: spark)
    rows = bench.main(["/root/testdata/sf0.01/embeddings.parquet", "32", "pq", "uneven", "--stages", "none", "--most-bits", "8", "--top", "20", "--group-stats"])
    assert [r["model"] for r in rows] == ["pq", "uneven"] and all(0 < r["overlap@20"] <= 1 for r in rows)
    m = tmp_path / "task.jsonl"
    m.write_text("".join('{"query_id":"q%d","query_parts":[{"kind":"text","value":"%d"}],"labels":["c%d"],"candidates":[{"name":"c%d","parts":[{"kind":"text","value":"c%d"}]}]}\n' % (i, i, i, i, i) for i in range(6)))
    retrieval.main([str(m), "--train-pool", "--top", "3", "--k", "1", "6"])
    assert '"recall": 1.0' in capsys.readouterr().out


def test_loaders(spark, tmp_path):
    from vecmill.sources import loaders

    spark.range(5).write.parquet(str(tmp_path / "own/task/test/a/b"))
    spark.range(5, 8).write.parquet(str(tmp_path / "own/task/test/c"))
    assert loaders.load_annotations(spark, "task", "test", str(tmp_path / "own")).count() == 8
    assert loaders.load_annotations(spark, "task", "dev", str(tmp_path / "own"), "local").count() == 8
    hubs = {"one": lambda name, split: (_ for _ in ()).throw(OSError("away")), "two": lambda name, split: spark.range(3)}
    assert loaders.load_annotations(spark, "else", "test", str(tmp_path / "own"), hubs=hubs).count() == 3
    with pytest.raises(FileNotFoundError, match="away"):
        loaders.load_annotations(spark, "else", "test", hubs=hubs, backend="one")
    with pytest.raises(ValueError):
        loaders.load_annotations(spark, "else", "test", backend="three")
    with pytest.raises(FileNotFoundError):
        loaders.read_tree(spark, str(tmp_path / "nothing"))
    calls = []

    def source():
        calls.append(1)
        return spark.range(4)

    where = str(tmp_path / "copy")
    assert loaders.materialize(source, where, split="test").count() == 4 and loaders.materialize(source, where).count() == 4
    assert calls == [1] and loaders.manifest(where)["split"] == "test" and loaders.manifest(where)["files"]
    (tmp_path / "copy" / loaders.COMPLETE).unlink()
    assert not loaders.is_complete(where) and loaders.materialize(source, where).count() == 4 and calls == [1, 1]
