"""Cover-tree search and the Merkle audit."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.llm import cover_tree as T
from vecmill.llm import warc_merkle as W
from vecmill.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["op4_warc_merkle", "op6_cover_tree"])
def test_oracle(name, same):
    same(queries()[name], oracle_sql()[name])


def brute(rows, k, scale=64.0):
    ok = [(i, np.floor(scale * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, d - len(v)))) for i, v in ok]
    out = []
    for q, x in ok:
        if q % 5 == 0:
            scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(x, y))), i) for i, y in ok if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "random", "ties", "hot"])
def test_top_k(spark, shape):
    rng = np.random.default_rng(1)
    n = 400
    x = {"clusters": rng.standard_normal((8, 3))[rng.integers(0, 8, n)] + 0.01 * rng.standard_normal((n, 3)), "random": rng.standard_normal((n, 16)), "ties": rng.integers(-1, 2, (n, 3)) * 1.0, "hot": np.where(np.arange(n)[:, None] % 3 == 0, np.ones(4), rng.standard_normal((n, 4)))}[shape]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = T.top_k(df, F.col("vec_id") % 5 == 0, 7, block=60, group=16).collect()
    assert sorted(map(tuple, got)) == brute(rows, 7)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "q": F.lit(1), "v": F.lit(2), "block": F.lit(3)})
    assert sorted(map(tuple, T.top_k(df, F.col("vec_id") % 5 == 0, 3).collect())) == brute(rows, 3)
    assert T.top_k(df.where("false"), F.col("vec_id") % 5 == 0, 3).count() == 0
    assert T.top_k(df.where("vec_id = 0"), F.lit(True), 3).count() == 0


def test_repeated_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((40, 4)).astype(np.float32))]
    rows += [rows[0], rows[0], rows[7], (5, [1.0, -1.0, 0.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 5 == 0}:
        scored = sorted((-int(np.floor(64 * np.array(v)) @ np.floor(64 * np.array(w))), i) for i, w in rows if i != q)[:6]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    got = sorted(map(tuple, T.top_k(df, F.col("vec_id") % 5 == 0, 6, block=10, group=3).collect()))
    assert got == sorted(want) and len([r for r in got if r[0] == 0]) == 6 and len([r for r in got if r[0] == 5]) == 12


def test_large_components_are_exact():
    q, d = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**20, 0.0]])
    assert T.exact(q, d).tolist() == [[2**60 + 1, 2**60]]
    assert T.exact(np.array([[1e30]]), np.array([[1e30], [-1e30]])).tolist() == [[2**63 - 1, -(2**63)]]


@pytest.mark.parametrize("d,n", [(2, 500), (64, 400), (3, 1), (2, 0)])
def test_tree_covers(d, n):
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.standard_normal((n, d))) if n else np.zeros((1, d))
    x = np.concatenate([x, x[:5]])  # repeated points
    t = T.CoverTree(x)
    assert len(t.rows[0]) == 1 and t.rows[-1].tolist() == list(range(len(x)))
    if d == 2 and n:
        assert len(t.rows) > 4
    for level, (rows, above, radius) in enumerate(zip(t.rows, t.above, t.radius)):
        far = np.sqrt(((x - x[rows[above]]) ** 2).sum(1))
        assert (far <= radius[above] + 1e-9).all()
        if 0 < level < len(t.rows) - 1:
            assert set(t.rows[level - 1]) <= set(rows)
            gaps = np.sqrt(((x[rows][:, None] - x[rows][None]) ** 2).sum(2)) + np.eye(len(rows)) * 1e9
            assert gaps.min() > t.apart[level] - 1e-6 and np.sqrt(((x[:, None] - x[rows][None]) ** 2).sum(2)).min(1).max() <= t.apart[level] + 1e-6
        if level:
            assert (t.above[level - 1] == t.parent[level][above]).all()


def test_pruning(spark):
    """Clustered vectors: most pairs are never scored, and the results are the same."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 8))
    x = centres[rng.integers(0, 30, 2000)] * 4 + 0.02 * rng.standard_normal((2000, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, T.top_k(df, F.col("vec_id") % 50 == 0, 5, block=500, counts=counts).collect()))
    ints = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, 2000, 50):
        scored = sorted((-int(s), i) for i, s in enumerate(ints @ ints[q]) if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert got == sorted(want)
    assert counts[0].value == 40 * 2000 and 0 < counts[1].value < 0.5 * counts[0].value


def test_records_survive_packing():
    parts = [W.record(f"http://x/{i}", b"<p>\r\n\r\n" * i, str(i)) for i in range(50)]
    raw = b"".join(map(W.packed, parts))
    assert [one for _, _, one, _ in W.parse(raw)] == parts
    hurt = bytearray(raw)
    at = sum(len(W.packed(p)) for p in parts[:20]) + 30
    hurt[at] ^= 0xFF
    got = list(W.parse(bytes(hurt)))
    assert [h is None for *_, h in got] == [i == 20 for i in range(50)] and got[20][0] <= at < got[20][1]


def leaves(raw):
    return [(a, b, hashlib.sha256(raw[a:b]).digest()) for a, b, _ in W.members(raw)]


def test_every_changed_byte_is_located():
    raw = b"".join(W.packed(W.record(f"http://x/{i}", b"<p>text &amp; more</p>" * (i % 3), str(i))) for i in range(8))
    own = leaves(raw)
    assert own[0][0] == 0 and own[-1][1] == len(raw) and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    for at in range(len(raw)):
        for bit in (1, 16, 128):
            hurt = bytearray(raw)
            hurt[at] ^= bit
            got = leaves(bytes(hurt))
            wrong = [i for i, (x, y) in enumerate(zip(own, got)) if x != y]
            assert len(got) == len(own) and [own[i][0] <= at < own[i][1] for i in wrong] == [True]
    for end in range(0, len(raw), 7):
        got = leaves(raw[:end])
        assert (got[-1][1] if got else 0) == end and got != own


def pages(spark, n):
    rows = [(i, None if i == 3 else f"http://h/{i}", None if i == 4 else "" if i == 5 else f"<p>{i}</p>" * (i % 7)) for i in range(n)] + [(None, "u", "no id"), (1, "http://h/1", "<p>1</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("n", [0, 30, 900])
def test_audit_finds_the_damage(spark, n):
    df = pages(spark, n).withColumns({"key": F.lit("k"), "name": F.lit("n"), "body": F.lit("b")})
    got = W.fixity_report(df).collect()
    assert len(got) == n + 2
    for r in got:
        digit = hashlib.sha256(("" if r["page_id"] is None else str(r["page_id"])).encode()).hexdigest()[0]
        assert r["damaged"] == (digit in "0123") and (r["copy_sha256"] is None) == (digit in "23")
        assert digit in "23" or (r["record_sha256"] == r["copy_sha256"]) == (digit != "0")
    assert W.fixity_report(df.where("false")).count() == 0


def test_audit_of_a_long_body(spark):
    rows = [(1, "u", "long " * 1_000_000), (2, "u", "short"), (3, "u", "0" * 3_000_000)]
    got = {r["page_id"]: r for r in W.fixity_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["record_sha256"] == hashlib.sha256(W.record("u", t.encode(), str(i))).hexdigest() for i, _, t in rows)


def test_audit_descends_only_where_roots_differ(spark):
    folder = W.new_folder(spark, "warc")
    made = W.write_warc(pages(spark, 200), folder, lambda key, raw, member: member, records=20)
    both = W.written(made.selectExpr("'original' as replica", "name", "path").union(made.selectExpr("'copy'", "name", "copy")), "files")
    nodes = W.file_trees(both, folder)
    assert nodes.where("level > 0").count() > 0
    assert W.audit(nodes).count() == 0
    names = [r["name"] for r in made.orderBy("name").collect()]
    path = dict(made.select("name", "copy").collect())
    raw = bytearray(open(path[names[0]], "rb").read())
    raw[len(raw) // 2] ^= 0x10
    open(path[names[0]], "wb").write(bytes(raw))
    cut = open(path[names[1]], "rb").read()
    ends = [end for _, end, _ in W.members(cut)]
    open(path[names[1]], "wb").write(cut[: ends[-3] - 5])  # the last two records and a part of the one before
    gone = both.where(~((F.col("name") == names[2]) & (F.col("replica") == "copy")))
    gone = gone.union(gone.where((F.col("name") == names[3]) & (F.col("replica") == "copy")).selectExpr("replica", "'extra'", "path"))
    found = {}
    for r in W.audit(W.file_trees(gone, folder)).collect():
        found.setdefault(r["name"], []).append((r["start"], r["end"]))
    size = {n: len(list(W.members(open(path[n], "rb").read()))) for n in names[2:4]}
    assert set(found) == {*names[:3], "extra"}
    assert len(found[names[0]]) == 1 and found[names[0]][0][0] <= len(raw) // 2 < found[names[0]][0][1]
    assert sorted(found[names[1]]) == list(zip(ends[-4:-1], ends[-3:]))
    assert len(found[names[2]]) == size[names[2]] and len(found["extra"]) == size[names[3]]
