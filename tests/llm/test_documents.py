"""Mixing, quality, language, page text and the pipeline."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.cases import DOCS, documents, prose
from vecmill.llm import html_density as H
from vecmill.llm import langid, mixing, quality
from vecmill.llm.queries import op5_mixing, op8_quality_eb, op9_langid, op10_html_density


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# mixing


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8), st.integers(0, 400), st.integers(0, 200))
def test_fit_budget(lengths, budget, reserve):
    ls, cs = list(lengths), list(lengths.values())
    got = mixing.fit_budget(np.array(ls), np.array(cs), budget, reserve)
    assert all(0 <= g <= c for g, c in zip(got, cs))
    total = sum(g * n for g, n in zip(got, ls))
    assert total <= budget
    if reserve >= budget:  # all of it is fitted: the best sum there is
        sums = {0}
        for n, c in zip(ls, cs):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        assert total == max(s for s in sums if s <= budget)


def water(sizes, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    pool, open_ = 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = (pool - sum(2 * sizes[s] for s in order if s not in open_)) / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not over:
            break
        open_ -= over
    return {s: w[s] * level if s in open_ else 2.0 * sizes[s] for s in order}


def check_mix(rows, got, slack):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken = water(sizes), {}
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), size(t)) for d, t, *_ in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= slack(s, t)


def test_mix(spark):
    rows = [tuple(r) for r in table(spark, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = op5_mixing(spark, SF).collect()
    check_mix(rows, got, lambda s, t: 5)
    again = mixing.mix(table(spark, "documents").repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_odd_rows(spark):
    check_mix(DOCS, mixing.mix(documents(spark)).collect(), lambda s, t: 6001)
    assert mixing.mix(documents(spark).where("false")).count() == 0


def test_take_keeps_rows_apart(spark):
    """Rows that share id and text, or all columns, or nothing but the words."""
    rows = [(1, "a b c d e f", "en", "s1", 1), (1, "a b c d e f", "en", "s2", 1), (None, "x y", "en", "s1", 1), (None, "x y", "de", "s1", 1), (None, "x y", "de", None, 1)]
    rows += [(7, "p q r s", "en", "s2", n % 2) for n in range(9)] + [(8, None, "en", "s2", 1)]
    df = documents(spark, rows).withColumns({"__h": F.lit(1), "row": F.lit(2), "copies": F.lit(3)})
    plan, got = mixing.mix(df).collect(), mixing.take(df)
    assert got.columns == df.columns
    words, count = {}, {}
    for r in plan:
        words[r["doc_id"], r["source"], r["size"]] = words.get((r["doc_id"], r["source"], r["size"]), 0) + r["taken"]
    for r in got.collect():
        key = r["doc_id"], r["source"], len(r["text"].split())
        count[key] = count.get(key, 0) + key[2]
    assert count == {k: n for k, n in words.items() if n} and {"s1", "s2", None} == {s for _, s, _ in count}
    per = {}
    for r in got.where("doc_id = 7").collect():
        per[r["n_chars"]] = per.get(r["n_chars"], 0) + 1
    assert per.get(0, 0) <= 2 * 5 and per.get(1, 0) <= 2 * 4


def test_mix_of_one_hot_length(spark):
    """One source and length with most rows: buckets, and repeated rows."""
    rows = [(i // 2, f"a b {i // 2 % 50}", "en", "hot" if i % 4 else "cold", 1) for i in range(600)]
    got = mixing.mix(documents(spark, rows), bucket_rows=16).collect()
    check_mix(rows, got, lambda s, t: 3)


# quality


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = quality.score_quality(docs, labels.where(~held)).drop("quality").join(labels.where(held), "doc_id").collect()
    assert len(rows) > 60
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.97
    assert all(r["kept"] for r in rows if r["quality"] == 1)


def slow_features(text):
    """The features once more, a character and a word at a time."""
    words, raw = (text or "").split(), (text or "").encode()
    if not words:
        return [0.0] * 12 + [1.0]
    share = lambda f: sum(map(f, raw)) / len(raw)
    kinds = (lambda c: chr(c) in "#$%&*+<=>@\\^_`~{}!?", lambda c: chr(c) == "|", lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c == 32 or 9 <= c <= 13, lambda c: c >= 128)
    lines = text.split("\n")
    return [
        np.log(1 + len(words)), *(share(k) ** 0.5 for k in kinds), 1 - len(set(words)) / len(words) ** 0.9 if len(words) > 1 else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / len(words), 1 - len(set(lines)) / len(lines), min((len(text) - text.count(" ")) / len(words), 30) / 10, float(max(map(len, words)) > 60), 0.0,
    ]


def slow_quality(docs, labels, pseudo=0.5):
    """(evidence, host rate, path rate, quality) of each document, all by loops. Few enough labels that all are fitted on."""
    x = {d: slow_features(r["text"]) for d, r in docs.items()}
    own = sorted(set(labels) & set(docs))
    z, y = np.array([x[d] for d in own]), np.array([labels[d] for d in own], float)
    mean, scale = z.mean(0), np.where(z.std(0) > 1e-9, z.std(0), 1)
    z = np.hstack([(z - mean) / scale, np.ones((len(z), 1))])
    w, ridge = np.zeros(14), np.array([1.0] * 13 + [1e-6])
    for _ in range(200):  # damped, unlike the operator's own steps
        p = 1 / (1 + np.exp(-z @ w))
        w -= 0.5 * np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge) + 1e-9 * np.eye(14), z.T @ (p - y) + ridge * w)
    e = {d: 1 / (1 + np.exp(-np.clip(((np.array(v) - mean) / scale) @ w[:-1] + w[-1], -12, 12))) for d, v in x.items()}
    hosts, paths = {}, {}
    for d, r in docs.items():
        for groups, key in ((hosts, r["source"]), (paths, (r["source"], r["shard"]))):
            n, good = groups.get(key, (0.0, 0.0))
            groups[key] = (n + pseudo + (d in labels), good + pseudo * e[d] + labels.get(d, 0))
    rate = sum(g for _, g in hosts.values()) / sum(n for n, _ in hosts.values())

    def strength(groups, centre):
        every = sum(n for n, _ in groups.values())
        spread = sum(n * (g / n - centre(k)) ** 2 for k, (n, g) in groups.items())
        base = {k: centre(k) * (1 - centre(k)) for k in groups}
        between = max((spread - sum(base.values())) / every, 1e-6)
        return min(max(sum(groups[k][0] * base[k] for k in groups) / every / between - 1, 1), 1e6)

    kh = strength(hosts, lambda k: rate)
    host_rate = {k: (g + kh * rate) / (n + kh) for k, (n, g) in hosts.items()}
    kp = strength(paths, lambda k: host_rate[k[0]])
    out = {}
    for d, r in docs.items():
        (hn, hg), (pn, pg) = hosts[r["source"]], paths[r["source"], r["shard"]]
        hr = (hg - pseudo * e[d] + kh * rate) / (hn - pseudo + kh)
        pr = (pg - pseudo * e[d] + kp * hr) / (pn - pseudo + kp)
        odds = np.log(e[d] / (1 - e[d])) + np.log(pr / (1 - pr)) - np.log(rate / (1 - rate))
        out[d] = (e[d], hr, pr, 1 / (1 + np.exp(-odds)))
    return out


def test_quality_against_loops(spark):
    rows = op8_quality_eb(spark, SF).collect()
    docs = {r["doc_id"]: r.asDict() for r in table(spark, "documents").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(quality.SHARDS))).collect()}
    want = slow_quality(docs, {r["doc_id"]: r["quality"] for r in table(spark, "labels").collect()})
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["evidence"], r["host_rate"], r["path_rate"], r["quality"]) == pytest.approx(want[r["doc_id"]], rel=1e-4, abs=1e-6)
        assert r["kept"] == (r["quality"] >= 0.5)


def test_site_levels_change_decisions(spark):
    """The same borderline text: its site's labels decide."""
    good, bad, between = prose(60, 1), "### $$$ " * 30, prose(40, 2) + " ### $$$" * 8
    rows = [(i, good if i % 2 else bad, "en", f"{'ab'[i // 2 % 2]}.org/x", 1) for i in range(200)]
    rows += [(1000 + i, between, "en", f"{'ab'[i % 2]}.org/{'xy'[i // 2 % 2]}", 1) for i in range(80)]
    labels = [(i, i % 2, 0) for i in range(200)] + [(1000 + i, i % 2, 0) for i in range(40)]
    got = {r["doc_id"]: r for r in quality.score_quality(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[1000 + i]["path_rate"] < got[1000 + i + 1]["path_rate"] for i in range(40, 80, 2))
    assert {got[1000 + i]["kept"] for i in range(40, 80, 2)} == {False} and {got[1001 + i]["kept"] for i in range(40, 80, 2)} == {True}


def test_sparse_sites_shrink(spark):
    good, bad = prose(60, 1), "### $$$ " * 30
    rows = [(i, bad if i < 40 else good, "en", "bad" if i < 40 else "good" if i < 200 else f"rare{i}", 1) for i in range(220)]
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(0, 200, 3)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(documents(spark, rows), labels).collect()}
    assert len(got) == 220 and all(got[i]["kept"] == (i >= 40) for i in got)
    assert got[0]["host_rate"] < 0.3 < got[210]["host_rate"] < got[100]["host_rate"]


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(documents(spark), labels).count() == len(DOCS)
    none = quality.score_quality(documents(spark), labels.where("false")).collect()
    assert len(none) == len(DOCS) and all(r["kept"] and r["evidence"] == 0.5 for r in none)
    kept = quality.keep_good(documents(spark), labels.where("false"))
    assert kept.columns == documents(spark).columns and kept.count() == len(DOCS)
    assert quality.score_quality(documents(spark).where("false"), labels).count() == 0


# language


def test_languages_held_out(spark):
    docs = {r["doc_id"]: r for r in table(spark, "documents").collect()}
    rows = op9_langid(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(docs) and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.99


def test_languages_against_loops(spark):
    """Every document scored word by word from plain counts."""
    import math
    import unicodedata
    from collections import Counter

    def words(text):
        return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()

    rows = table(spark, "documents").collect()
    count: dict = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] and r["text"]:
            for w in words(r["text"]):
                count.setdefault((r["lang"], 0), Counter())[w] += 1
    langs = sorted({lang for lang, _ in count})
    for lang in langs:
        for w, n in count[lang, 0].items():
            for size in range(1, 5):
                c = count.setdefault((lang, size), Counter())
                for g in (f" {w} "[i : i + size] for i in range(len(w) + 3 - size)):
                    if g.strip():
                        c[g] += n
    total = {k: c.total() for k, c in count.items()}
    seen = {}

    def penalties(kind, x):
        if any(x in count[lang, kind] for lang in langs):
            return [min(7 * math.log(10), -math.log(count[lang, kind][x] / total[lang, kind])) if count[lang, kind][x] else 7 * math.log(10) for lang in langs]

    def score(w):
        got = penalties(0, w)
        for size in range(4, 0, -1):
            if got:
                break
            grams = [p for i in range(len(w) + 3 - size) if (p := penalties(size, f" {w} "[i : i + size]))]
            got = [sum(x) / len(grams) for x in zip(*grams)] if grams else None
        return got

    got = {r["doc_id"]: r for r in op9_langid(spark, SF).collect()}
    for r in rows:
        sums = [0.0] * len(langs)
        for w in words(r["text"] or ""):
            if w not in seen:
                seen[w] = score(w)
            sums = [a + b for a, b in zip(sums, seen[w] or sums)] if seen[w] else sums
        best = min(range(len(langs)), key=lambda i: sums[i])
        assert got[r["doc_id"]]["lang_pred"] == langs[best]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / sum(math.exp(min(700, sums[best] - s)) for s in sums), rel=1e-3)


@pytest.mark.parametrize("text", ["\u00b2\u00bd 12 \u2167", "12 34 _ \u0661", "\u0301 \u20ac!", ""])
def test_no_letters(spark, text):
    df = spark.createDataFrame([(1, text, "en"), (3, "words here", "en")], "doc_id long, text string, lang string")
    m = langid.train_model(df, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict(df.withColumns({"row": F.lit(1), "__text": F.lit(2)}), m, ["doc_id", "row"]).collect()}
    assert got[1]["lang_pred"] == "und" and got[1]["score"] == 0.0 and got[3]["lang_pred"] == "en" and got[3]["known"] == 1.0 and got[3]["n_words"] == 2


def test_languages_odd_rows(spark):
    got = {}
    for r in langid.identify(documents(spark)).collect():
        got.setdefault(r["doc_id"], r)
    assert len(got) == len({d for d, *_ in DOCS})
    learned = {lang for _, _, lang, *_ in DOCS if lang}
    for d, t, *_ in DOCS:
        if d is not None:
            assert got[d]["lang_pred"] in (learned if any(c.isalpha() for c in t or "") else {"und"})
    assert not got[None]["held_out"]
    assert langid.identify(documents(spark).where("false")).count() == 0
    blank = langid.identify(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in blank} == {"und"}


def test_word_counts_cover_all_texts(spark):
    from collections import Counter

    docs = table(spark, "documents").where("lang is not null").select("text", "lang")
    got = {(r["lang"], r["feature"]): r["n"] for r in langid.count_words(docs, most=2000).collect()}
    want = Counter()
    for r in docs.collect():
        want.update((r["lang"], w) for w in langid.LETTERS.findall(r["text"].lower()))
    assert got == dict(want)


def test_backoff():
    rows = [("en", 0, "the", 5, 10), ("en", 2, "th", 3, 30), ("de", 2, "th", 1, 30), ("de", 1, "z", 2, 9)]
    m = langid.Model(rows, {"en": 10, "de": 9})
    assert m.langs == ["de", "en"] and np.allclose(m.word("the"), [langid.PENALTY, -np.log(0.5)])
    assert np.allclose(m.word("thing"), [-np.log(1 / 30), -np.log(0.1)])
    assert np.allclose(m.word("zq"), [-np.log(2 / 9), langid.PENALTY]) and m.word("qq") is None


def test_model_keeps_every_word(spark):
    from collections import Counter
    from itertools import product

    words = ["".join(p) for p in product("abcdefghijklmnopqrstuvwxyzäöüß", repeat=3)] + ["".join(p) for p in product("ghijklmno", repeat=4)]
    texts = [(" ".join(words[i::40]), "en") for i in range(40)] + [("der die das der aaa", "de")] * 3
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "doc_id long, text string, lang string")
    counts = {x: Counter(w for t, lang in texts if lang == x for w in t.split()) for x in ("de", "en")}
    m = langid.train_model(df, F.lit(True))
    for w in [*words, "der", "die"]:
        assert np.allclose(m.word(w), [-np.log(c[w] / c.total()) if c[w] else langid.PENALTY for c in counts.values()])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, m, ["doc_id"]).collect()}
    assert got == {i: lang for i, (_, lang) in enumerate(texts)}


# pages


def test_synthetic_pages(spark):
    from html import unescape

    html = {r["page_id"]: r["html"] for r in table(spark, "pages").collect()}
    for r in op10_html_density(spark, SF).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", html[r["page_id"]], re.S)[1]
        blocks = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("just words &amp; more", "just words & more"),
        ("<p>One<p>two <b>three", "One\n\ntwo three"),
        ("<body><nav><a href=x>Menu</a></nav><div class='main'><h1>T</h1><p>" + "Long text of an article. " * 9 + "</p><div class=\"ad-box\">Buy!</div><p>End</p></div><div id=comments><p>" + "I say so. " * 80 + "</p></div><footer>f</footer>", "T\n\n" + ("Long text of an article. " * 9).strip() + "\n\nEnd"),
        ("<article><header><h1>Title</h1></header><p>Body</p><aside>side</aside><form>f<input></form></article>", "Title\n\nBody"),
        ("<body><header>Site</header><main><p>a\n  b&nbsp;c</p></main></body>", "a b c"),
        ("<article><p>x<!-- <p>no --><script>if (a</b) {'</p>'}</script> y</p>", "x y"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"),
        ("<article><p>1 < 2 & 3 > 2</p><p title='a>b'>q</p></article>", "1 < 2 & 3 > 2\n\nq"),
        ("<p>cut <a href='unclosed", "cut"),
        ("<script>only</script>", ""),
    ],
)
def test_page(html, text):
    assert H.main_text(html) == text


WORDS = ("Long text of an article. " * 9).strip()


@pytest.mark.parametrize(
    "inner,text",
    [
        ("See <a href='/page?id=comments'>the talk page</a>.", "See the talk page."),
        ("x</p><p title='a hidden gem'>gem", "x\n\ngem"),
        ("x</p><p data-id='share-42' data-state=\"hidden\" data-role=menu>kept", "x\n\nkept"),
        ("x</p><p data-x='a\" class=\"ad'>kept", "x\n\nkept"),
        ("x</p><p class='menu-of-the-day'>soup</p><p class='promo-caption'>cap</p><p class='notice-text'>law", "x\n\nsoup\n\ncap\n\nlaw"),
        ("x</p><p hidden>gone</p><p style='color:red; display : none'>gone</p><p class='ad'>gone</p><p>y", "x\n\ny"),
        ("\u0130" * 40 + "</p><script>var x = '<p>';</SCRIPT ><p>kept one</p><script>2</script><p>kept two", "\u0130" * 40 + "\n\nkept one\n\nkept two"),
        ("x</p><style>a</styles></style><p>y", "x\n\ny"),
    ],
)
def test_attributes_and_scripts(inner, text):
    assert H.main_text(f"<body><nav>m</nav><article><p>{inner}</p><p>{WORDS}</p></article></body>") == text + "\n\n" + WORDS


def test_lead_and_closing_parts():
    html = f"<body><div id=nav><a href=a>Menu</a></div><div><h1>T</h1></div><div class=lead><p>A short lead.</p></div><div class=story><p>{WORDS}</p><p>{WORDS}</p></div><div><p>The end.</p></div><div><p>See <a href=b>more of it</a></p></div><footer><p>f</p></footer></body>"
    assert H.main_text(html) == f"T\n\nA short lead.\n\n{WORDS}\n\n{WORDS}\n\nThe end."


def slow_sums(page):
    """Density sums from the formula, each subtree counted anew."""
    below = {i: [j for j in range(len(page.tag)) if i in set(up(page, j))] for i in range(len(page.tag))}
    own = [(c, k) for c, k in zip(page.chars, page.links)]
    body = sum(c for c, _ in own), sum(k for _, k in own)

    def density(i):
        inside = [i, *below[i]]
        c, k = sum(own[j][0] for j in inside), sum(own[j][1] for j in inside)
        t, lt = max(1, len(below[i])), max(1, sum(page.tag[j] == "a" for j in below[i]))
        if not c:
            return 0.0
        base = np.log(c / max(1, c - k) * max(1, k) + body[1] / max(1, body[0]) * c + np.e)
        return max(0.0, c / t * np.log(c / max(1, k) * t / lt) / np.log(base))

    d = [density(i) for i in range(len(page.tag))]
    return [sum(d[j] for j in range(len(page.tag)) if page.parent[j] == i) for i in range(len(page.tag))]


def up(page, i):
    while i > 0:
        i = page.parent[i]
        yield i


def test_density_sums_against_the_formula(spark):
    for r in table(spark, "pages").orderBy(F.length("html")).limit(40).collect():
        page = H.Page(r["html"])
        want = slow_sums(page)
        _, got = page.densities()
        assert got == pytest.approx(want)


def test_long_page():
    body = " ".join(f"<p>{WORDS} {i}</p>" for i in range(20_000))
    assert H.main_text(f"<article>{body}</article>").count("\n\n") == 19_999


@pytest.mark.parametrize("wrapper", ['class="content has-sidebar"', 'id="page-with-comments"', 'class="widget-text"', 'class="share-post"', 'class="widget"', 'id="noSidebar"'])
@pytest.mark.parametrize("tag", ["article", "section"])
def test_wrapper_named_for_noise(wrapper, tag):
    words = "Long text of an article. " * 9
    html = f"<body><div class='ad-box'>Buy!</div><div {wrapper}><{tag}><h1>T</h1><p>{words}</p><div class='related-list'>More</div></{tag}></div><p class=copyright>c</p></body>"
    assert H.main_text(html) == "T\n\n" + words.strip()


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>a"), (1, None, None)], "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(3)})
    got = sorted((tuple(r) for r in H.extract(df).collect()), key=str)
    assert got == [(1, None, "", 0), (1, None, "", 0), (None, "u", "a", 1)]
    assert H.extract(df.where("false")).count() == 0
    assert H.main_text("<div>" * 3000 + "deep") == "deep"


# the pipeline


def test_pipeline_stages(spark):
    docs = table(spark, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels").collect()}
    got, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.new_folder(spark, "test")
        stage(spark, before, SF).write.parquet(path)
        got[name] = before = spark.read.parquet(path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(got[n].columns == docs.columns for n in names[:-1])
    good = {r["doc_id"] for r in got[names[0]].collect()}
    assert all((d in good) == (q == 1) for d, q in labels.items())
    assert {r["doc_id"] for r in got[names[1]].collect()} == good
    kept = [tuple(r) for r in got[names[2]].select("doc_id", "text").collect()]
    from tests.llm.test_near_duplicates import shingles

    sets = [shingles(t) for _, t in kept]
    assert len(kept) == len({d for d, _ in kept})
    assert not any(s | t and len(s) * 100 >= 85 * len(t) and len(t) * 100 >= 85 * len(s) and 100 * len(s & t) >= 85 * len(s | t) for i, s in enumerate(sets) for t in sets[:i])
    copies = [r["doc_id"] for r in got[names[3]].collect()]
    assert set(copies) <= {d for d, _ in kept} and max(copies.count(d) for d in set(copies)) <= 2
    assert got[names[4]].count() == len(copies)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, got[names[4]].collect()))


def test_pipeline_odd_rows(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas().astype(object).where(lambda f: f.notna(), None), stage(spark, docs, SF).schema)
        assert docs.count() > 0
    empty = documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
