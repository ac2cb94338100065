"""Near duplicates against all pairs."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF
from tests.llm.cases import DOCS, documents, prose
from vecmill.llm import components as C
from vecmill.llm import superminhash as S
from vecmill.llm.queries import oracle_sql, queries

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if a is not None and b is not None and s | t and 100 * len(s & t) >= percent * len(s | t):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return sorted(((d, len(s), None if d is None else find(d), True if d is None else find(d) == d) for d, s in sets), key=str)


def result(df):
    return sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str)


def test_odd_rows(spark):
    assert result(documents(spark)) == brute(DOCS)
    assert result(documents(spark).where("false")) == []


def edited(text, share, seed):
    rng = np.random.default_rng(seed)
    words = text.split()
    for i in rng.choice(len(words), int(len(words) * share), replace=False):
        words[i] = f"w{seed}x{i}"
    return " ".join(words)


def test_chains_and_clusters(spark):
    """Copies of copies: members of one bucket that its leader isn't linked with."""
    rows, n = [], 0
    for base in range(6):
        text = prose(150, base)
        for step in range(12):
            rows.append((n, text, "en", "a", 1))
            n += 1
            text = edited(text, 0.02, 100 * base + step)
    for i in range(40):
        rows.append((n + i, edited(prose(150, 77), 0.04, i), "en", "a", 1))
    got = result(documents(spark, rows))
    assert got == brute(rows)
    assert 6 < len({r[2] for r in got}) < len(rows)


def test_blocks_find_what_leaders_miss(spark):
    """Links within a bucket are found whatever the blocks."""
    rows = [(i, edited(prose(60, i // 4), 0.03, i), "en", "a", 1) for i in range(32)]
    sig = S.signatures(documents(spark, rows), 20, 4, "doc_id", "text")
    sets = S.sets_of(documents(spark, rows), sig, sig.limit(0).select("id", "h1", "h2"), "doc_id", "text")
    members = sig.selectExpr("1L as key", "id", "h1", "n", "id as component")
    links = C.components(S.confirm_blocks(members, sets, 85, block=5)).collect()
    got = {r["node"]: r["component"] for r in links}
    assert {d: got.get(d, d) for d, *_ in rows} == {r[0]: r[2] for r in brute(rows)}


def test_oracle(same):
    same(queries()["op7_superminhash"], oracle_sql()["op7_superminhash"])


def test_many_copies(spark):
    rows = [(i, prose(30, 1) if i % 3 == 0 else prose(30, 1000 + i), "en", "a", 1) for i in range(400)]
    got = S.near_duplicates(documents(spark, rows)).where("component_id = 0").count()
    assert got == len([i for i in range(400) if i % 3 == 0])


def test_superminhash_estimates():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    for share in (0.2, 0.5, 0.9):
        b = np.concatenate([a[: int(len(a) * share)], np.unique(rng.integers(0, 2**63, len(a) - int(len(a) * share)).astype(np.uint64))])
        exact = int(len(a) * share) / len(np.union1d(a, b))
        s = S.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
        assert abs((s[0] == s[1]).mean() - exact) < 0.07


def test_superminhash_against_the_plain_algorithm():
    """Slot by slot, element by element, without early stopping."""
    m = 16
    for n in (1, 2, 5, 40, 200):
        x = np.arange(n, dtype=np.uint64) * np.uint64(7919)
        state = S.mix(x + np.uint64(1 * 0x632BE59BD9B4E019 & (2**64 - 1)))
        want = [2**64 - 1] * m
        for e in range(n):
            p = list(range(m))
            for j in range(m):
                draw = int(S.mix(state[e : e + 1] + np.uint64((j + 1) * S._BASE & (2**64 - 1)))[0])
                k = j + ((draw & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], (draw >> 32) | j << 32)
        assert S.superminhash(x, np.array([0, n]), m)[0].tolist() == want
    assert (S.superminhash(np.zeros(0, np.uint64), np.array([0, 0]), m) == 2**64 - 1).all()


def test_shingle_counts_of_slices():
    texts = [None, "", "a", "A b", "a  b\tc", "x y z x y z x", prose(500, 1), " a b c "]
    column = pa.array(["skip me now please", *texts]).slice(1)
    sets, at = S.shingle_sets(column)
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
    assert set(sets[at[4] : at[5]]) == set(S.shingle_sets(pa.array(["A B\nC"]))[0])


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (None, 3)], [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(500, 600)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    sets = C.UnionFind()
    for u, v in edges:
        if u is not None and v is not None and u != v:
            sets.union(u, v)
    assert {r["node"]: r["component"] for r in C.components(df).collect()} == {x: sets.find(x) for x in sets.parent}


def test_query_runs(spark):
    assert queries()["op7_superminhash"](spark, SF).columns == ["doc_id", "n_shingles", "component_id", "kept"]
