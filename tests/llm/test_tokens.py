"""Token files and the BPE automaton, against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import DOCS, documents
from vecmill.llm import dac_tokens as D
from vecmill.llm.bpe_automaton import BpeCodec, MergeAutomaton, encode_documents, round_trip_digests
from vecmill.llm.tokens import CachedEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXTRA = ["", " ", "  ", "a  b", "a\n b", "a \n\n  b", "x<|endoftext|>y <|endoftext|> ", "\n", "  a　b", "12 345,67\t\tq", "it's we'll I'D", "日本語 テキスト 🎉🎉", "aaaaaaaaaa aaaa", " \x1c a", "a\x1c b", "é́ x", "the,*** the... 'the''s (the) the)", "a" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return BpeCodec.of(PATH, most=5000)


def ids_of(codec, text):
    return [int(i) for some in codec.encode_one(text) for i in some.split(",")]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for alphabet in ("abcdefghij  \n\t.,'!0123éß漢🎉ÀÁth", "abet hinor") for _ in range(n)]


def test_same_ids_as_the_library(library, codec):
    encoder = CachedEncoder(PATH, most=50)
    for t in EXTRA + texts(1500, 1):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids_of(codec, t) == want, t
        assert np.frombuffer(encoder.encode_one(t), encoder.dtype).tolist() == want, t
        assert codec.decode(codec.encode_one(t)) == library.decode(want, skip_special_tokens=False)


def test_every_token_is_its_own_path(codec):
    a = codec.automaton
    assert all(a.encode(a.label(i)) == [i] for i in range(len(a.state)) if a.state[i] >= 0) and min(a.state) >= 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8), st.text("abc", max_size=12))
def test_automaton_is_merging(pairs, word):
    """Any merges over three letters, against merging by rank."""
    vocab, merges = {b"a": 0, b"b": 1, b"c": 2}, []
    for x, y in pairs:
        tokens = list(vocab)
        u, v = tokens[x % len(tokens)], tokens[y % len(tokens)]
        if u + v not in vocab:
            vocab[u + v] = len(vocab)
            merges.append((u, v))
    now = [bytes([c]) for c in word.encode()]
    for u, v in merges:
        out = []
        for t in now:
            if out and out[-1] == u and t == v:
                out[-1] = u + v
            else:
                out.append(t)
        now = out
    assert MergeAutomaton.of(vocab, merges).encode(word.encode()) == [vocab[t] for t in now]


def merged(text, merges):
    now = [bytes([c]) for c in text]
    for u, v in merges:
        out = []
        for t in now:
            if out and out[-1] == u and t == v:
                out[-1] = u + v
            else:
                out.append(t)
        now = out
    return now


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=7))
def test_every_state_has_the_arcs_of_correct_tokenizations(pairs):
    """State by state: a token may follow a path if the two together merge into just that."""
    vocab, merges = {b"a": 0, b"b": 1}, []
    for x, y in pairs:
        tokens = list(vocab)
        u, v = tokens[x % len(tokens)], tokens[y % len(tokens)]
        if u + v not in vocab:
            vocab[u + v] = len(vocab)
            merges.append((u, v))
    a, names = MergeAutomaton.of(vocab, merges), list(vocab)
    own = [t for t in names if merged(t, merges) == [t]]
    assert [t for t in names if a.step(0, vocab[t]) >= 0] == own
    for u in own:
        after = a.step(0, vocab[u])
        assert [v for v in own if a.step(after, vocab[v]) >= 0] == [v for v in own if merged(u + v, merges) == [u, v]]
        for v in own:  # and a step further
            if (then := a.step(after, vocab[v])) >= 0:
                assert [w for w in own if a.step(then, vocab[w]) >= 0] == [w for w in own if merged(u + v + w, merges) == [u, v, w]]


def test_every_code_point(library, codec):
    """Each character among letters, marks, digits and spaces."""
    points = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 500):
        text = "".join(f"a{c}'s x{c} {c}1 " for c in points[at : at + 500])
        assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1300), st.integers(1, 8), st.data())
def test_codes_are_addressable(ids, bits, data):
    x = np.array(ids, np.uint32)
    cut = data.draw(st.integers(0, len(x)))
    docs, starts, codes = D.load(D.dump([7, None], [x[:cut], x[cut:]], bits))
    assert docs == [7, None] and starts.tolist() == [0, cut, len(x)]
    assert (codes.slice(0, len(x)) == x).all() and (codes.slice(cut, len(x)) == x[cut:]).all()
    if ids:
        at = data.draw(st.lists(st.integers(0, len(x) - 1), max_size=20))
        assert codes.access(at).tolist() == x[at].tolist() if at else True
    with pytest.raises(IndexError):
        codes.access([len(x)])


def test_damaged_file():
    raw = D.dump([1], [np.arange(5, dtype=np.uint16)])
    with pytest.raises(ValueError):
        D.load(b"XXXX" + raw[4:])


def test_token_files(spark, library):
    docs = documents(spark)
    folder = D.new_folder(spark, "tokens")
    manifest = D.write_tokens(docs, PATH, folder=folder, file_tokens=500)
    rows = D.read_tokens(manifest, folder, digest=True).orderBy("start").collect()
    ids = {}
    for d, t, *_ in DOCS:
        ids.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    assert [r["doc_id"] for r in rows] == sorted((d for d, *_ in DOCS), key=lambda d: (d is not None, d))
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in v) for d, v in ids.items()}
    every = [i for r in D.read_tokens(manifest, folder).orderBy("start").collect() for i in np.frombuffer(r["ids"], "<u4").tolist()]
    at = [0, len(every) // 2, len(every) - 1]
    assert D.token_at(manifest, folder, at) == {i: every[i] for i in at}
    assert D.dac_round_trip(docs.where("false"), PATH).count() == 0


def test_round_trip(spark, library):
    docs = documents(spark)
    got = sorted((tuple(r) for r in round_trip_digests(docs, PATH).collect()), key=str)
    want = []
    for d, t, *_ in DOCS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    rows = encode_documents(docs, PATH).collect()
    assert sorted(str(r["decoded"]) for r in rows) == sorted(t or "" for _, t, *_ in DOCS)
    assert round_trip_digests(docs.where("false"), PATH).count() == 0
