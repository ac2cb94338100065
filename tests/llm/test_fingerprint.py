"""Fingerprints: fixed points, likeness, and the report against a brute-force one."""

import hashlib

from tests.conftest import SF
from tests.llm.cases import DOCS, documents, prose
from vecmill.llm import fingerprint as P
from vecmill.llm.queries import op1_fingerprint


def test_equal_and_empty():
    assert P.fingerprint(None) == P.fingerprint("") == "4::"
    assert P.likeness("4::", "4::") == 1.0 and P.likeness("4::", P.fingerprint("some words")) == 0.0
    assert P.fingerprint("abc") == P.fingerprint("abc")


def test_whole_texts_count():
    a = prose(20_000, 1)
    b = a[:-1] + "#"
    assert P.fingerprint(a) != P.fingerprint(b) and P.likeness(P.fingerprint(a), P.fingerprint(b)) > 0.9
    assert P.likeness(P.fingerprint(a), P.fingerprint("intro: " + a)) > 0.9


def test_repeated_text_is_bounded():
    assert len(P.fingerprint("x" * 100_000)) < 60
    assert len(P.fingerprint("Heat " * 20_000)) < 2_000


def test_likeness_tells_edits_from_others():
    texts = [prose(n, n) for n in (60, 150, 400, 1500, 5000)]
    for t in texts:
        assert P.likeness(P.fingerprint(t), P.fingerprint(P.edit(t, texts[0] * 50))) > 0.5
    for a, b in zip(texts[2:], texts[3:]):
        assert P.likeness(P.fingerprint(a), P.fingerprint(b)) < 0.3


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        e = P.edit(t, nxt)
        f, g = P.fingerprint(t), P.fingerprint(e)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, P.likeness(f, g), P.likeness(f, P.fingerprint(nxt))))
    return out


def test_report(spark):
    got = op1_fingerprint(spark, SF).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == brute(rows)
    near = sorted(r["near_edited"] for r in got)
    assert near[len(near) // 20] > 0.55


def test_odd_rows(spark):
    got = P.fingerprint_report(documents(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, *_ in DOCS)
    single = [r for r in DOCS if r[0] is not None and r[0] != 7]
    assert sorted(map(tuple, P.fingerprint_report(documents(spark, single)).collect())) == brute([(d, t or "") for d, t, *_ in single])
    one = P.fingerprint_report(documents(spark, [DOCS[0]])).first()
    assert one["near_next"] == 1.0
    assert P.fingerprint_report(documents(spark).where("false")).count() == 0


def test_a_hot_id_is_spread(spark):
    rows = [(5 if i % 3 else i, prose(5, i), "en", "a", 1) for i in range(300)]
    assert P.fingerprint_report(documents(spark, rows)).count() == 300
