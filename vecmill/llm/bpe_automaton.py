"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It begins as one state with a loop for each byte. Every
merge (u, v) -> w, in rank order, adds its gadget: the state that u leads to is copied
without its v arc (u then v can't be a correct tokenization any more), and wherever u
followed by v could be read, an arc w leads to where v led. The end result is
deterministic and accepts exactly the correct tokenizations, so a word has one
accepted path and its arc labels are the word's tokens (Berglund, Martens and
van der Merwe, "Constructing a BPE tokenization DFA").

``compile_merges`` builds it so, gadget by gadget, once on the driver. A state's row of
the transition table says which arcs it lacks. Tokens are numbered so that those which
lose their arc with v (v itself, and what was made later with v as its left part) are
neighbours; a row is then a sorted list of intervals, and an arc is looked up by
bisection. States that several tokens lead to are one until a gadget copies one of them.
The tables are a file in the shared folder, which the workers of a machine map together.

Each prefix of a word has one accepted path, so its last token is a function of the prefix:
of the tokens that the prefix ends with, the one that the state at the end of what is left
has an arc for. It is looked up from the word's end, for the prefixes that this needs and
for each of them once.

Texts are pre-split as the byte-level pre-tokenizer does, with its frozen classes of
characters.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, new_folder, slices, text_batches
from .tokens import NotCut, Words, byte_alphabet
from .unicode_classes import PRE_SPLIT

#: The arrays of a compiled automaton, in the order of its file.
ARRAYS = ("state", "place", "starts", "bounds", "length", "label_at", "shorter", "edges", "token", "labels")


def compile_merges(vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> dict[str, np.ndarray]:
    """The tables of a vocabulary (token bytes to id) and ranked merges.

    state: where a token's arcs lead (-1: no token, or one that nothing can lead to). place: a token's
    number among arcs. starts, bounds: each state's intervals of lacking arcs. length, label_at, labels:
    the tokens' bytes. edges, token: a trie of them read backwards; edge k leads from node
    edges[k] >> 8 by the byte edges[k] & 255 to node k + 1, and token is the longest that ends on the
    way to a node. shorter: the longest other token that a token ends with."""
    size = max(vocab.values(), default=-1) + 1
    left, rank, live, cut = [-1] * size, [-1] * size, [False] * size, [{} for _ in range(size)]
    right = [-1] * size
    for token, i in vocab.items():
        live[i] = len(token) == 1

    def has(after: int, token: int) -> bool:
        """Whether the state that ``after`` leads to has the arc just now."""
        before = len(merges)
        while after >= 0:
            t, made = token, len(merges)
            while t >= 0:
                r = cut[after].get(t)
                if r is not None and r < before and r <= made:
                    return False
                t, made = left[t], rank[t]
            after, before = right[after], min(before, rank[after]) if right[after] >= 0 else before
        return True

    gadgets, children = [], [[] for _ in range(size)]
    for r, (a, b) in enumerate(merges):
        u, v, w = vocab[a], vocab[b], vocab[a + b]
        if not (live[u] and live[v] and has(u, v)):
            continue  # u then v can't be read: the gadget is empty
        if live[w]:
            raise ValueError(f"two merges make the token {a + b!r}")
        live[w], left[w], right[w], rank[w] = True, u, v, r
        cut[u][v] = r
        children[u].append(w)
        gadgets.append((u, v, w))
    # What is made with v after an arc v is cut lacks that arc, too: later children come first.
    place, end, n = [-1] * size, [0] * size, 0
    for root in (i for i in range(size) if live[i] and left[i] < 0):
        stack = [root]
        while stack:
            t = stack.pop()
            if t < 0:
                end[~t] = n
                continue
            place[t] = n
            n += 1
            stack.append(~t)
            stack += children[t]
    # The gadgets themselves. A state is a sorted array of the ends of its intervals.
    states, users, state = [array("i")], [0], [0 if x and left[i] < 0 else -1 for i, x in enumerate(live)]
    users[0] = sum(s == 0 for s in state) + 1  # and the start, which keeps every arc
    done = [0] * size  # of a token's children, how many are made
    for u, v, w in gadgets:
        state[w] = state[v]
        users[state[w]] += 1
        done[u] += 1
        if users[state[u]] > 1:
            users[state[u]] -= 1
            users.append(1)
            states.append(states[state[u]][:])
            state[u] = len(states) - 1
        row, lo = states[state[u]], place[v]
        made = done[v] - (u == v)  # w itself, if u is v, is made when this arc is cut
        hi = place[children[v][made - 1]] if made > 0 else end[v]
        at, to = bisect_left(row, lo), bisect_right(row, hi)
        row[at:to] = array("i", ([lo] if at % 2 == 0 else []) + ([hi] if to % 2 == 0 else []))
    used = sorted({s for s in state if s >= 0} | {0})
    number = {s: k for k, s in enumerate(used)}
    bounds = array("i")
    starts = [0]
    for s in used:
        bounds += states[s]
        starts.append(len(bounds))
    own = sorted((t[::-1], i) for t, i in vocab.items() if live[i])
    label = [b""] * size
    for t, i in vocab.items():
        label[i] = t
    edges, ends, shorter, todo = [], [], [-1] * size, deque([(0, len(own), 0, -1)])
    while todo:
        a, b, depth, longest = todo.popleft()
        if a < b and len(own[a][0]) == depth:
            shorter[own[a][1]], longest = longest, own[a][1]
            a += 1
        ends.append(longest)
        while a < b:
            byte, first = own[a][0][depth], a
            while a < b and own[a][0][depth] == byte:
                a += 1
            edges.append(len(ends) - 1 << 8 | byte)
            todo.append((first, a, depth + 1, longest))
    lengths = np.array([len(t) for t in label], np.int32)
    return {
        "state": np.array([number.get(s, -1) for s in state], np.int32), "place": np.array(place, np.int32), "starts": np.array(starts, np.int32), "bounds": np.frombuffer(bounds, np.int32) if bounds else np.zeros(0, np.int32),
        "length": lengths, "label_at": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), "shorter": np.array(shorter, np.int32), "edges": np.array(edges, np.int32), "token": np.array(ends, np.int32),
        "labels": np.frombuffer(b"".join(label), np.uint8),
    }


class MergeAutomaton:
    """Walks the tables that compile_merges made."""

    def __init__(self, tables: dict[str, np.ndarray]):
        views = {k: memoryview(np.ascontiguousarray(v)) for k, v in tables.items()}
        self.state, self.place, self.starts, self.bounds, self.length, self.label_at, self.shorter = (views[k] for k in ARRAYS[:7])
        self.longest = max(self.length, default=0)
        self.labels, self.token = views["labels"], views["token"].tolist()
        self.child = dict(zip(views["edges"].tolist(), range(1, len(self.token))))

    @classmethod
    def of(cls, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> MergeAutomaton:
        return cls(compile_merges(vocab, merges))

    def label(self, token: int) -> bytes:
        return bytes(self.labels[self.label_at[token] : self.label_at[token + 1]])

    def step(self, state: int, token: int) -> int:
        """The transition: where the token leads from a state, -1 if it has no such arc. State 0 is the start."""
        a, b = self.starts[state], self.starts[state + 1]
        if self.place[token] < 0 or bisect_right(self.bounds, self.place[token], a, b) - a & 1:
            return -1
        return self.state[token]

    def encode(self, word: bytes) -> list[int]:
        """The labels of the word's accepted path."""
        n, child, state, starts, bounds, place, length, shorter = len(word), self.child.get, self.state, self.starts, self.bounds, self.place, self.length, self.shorter
        last = [-1] * (n + 1)  # the label that the path of a prefix ends with
        back, longest = word[::-1], self.longest
        open_: list[tuple[int, int]] = []  # prefixes in work, each with the longest token that it may end with
        end = n
        while end:
            node = 0
            for byte in back[n - end : n - end + longest]:
                there = child(node << 8 | byte)
                if there is None:
                    break
                node = there
            t = self.token[node]
            while True:
                if t < 0:
                    raise ValueError(f"no path for {word!r}: the vocabulary lacks one of its bytes")
                before = end - length[t]
                if before:
                    label = last[before]
                    if label < 0:
                        open_.append((end, t))
                        end = before
                        break
                    a = starts[s := state[label]]
                    if bisect_right(bounds, place[t], a, starts[s + 1]) - a & 1:
                        t = shorter[t]
                        continue
                last[end] = t
                if not open_:
                    end = 0
                    break
                end, t = open_.pop()
        path, at = [], n
        while at:
            path.append(last[at])
            at -= length[path[-1]]
        return path[::-1]


def read_spec(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Vocabulary, merges and special tokens of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("only plain byte-level BPE files can be compiled")
    of = byte_alphabet()
    raw = lambda s: bytes(of[c] for c in s)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    return vocab, [(raw(a), raw(b)) for a, b in merges], special


def write_tables(path: str, folder: str) -> tuple[str, dict[str, int]]:
    """Compiles a tokenizer file into one of tables in the shared folder: its path, and the special tokens."""
    vocab, merges, special = read_spec(path)
    tables = compile_merges(vocab, merges)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/automaton", compression=None) as f:
        f.write(np.array([len(tables[k]) for k in ARRAYS], "<i8").tobytes())
        for k in ARRAYS:
            f.write(tables[k].tobytes())
    return f"{root}/automaton", special


def read_tables(path: str, folder: str) -> dict[str, np.ndarray]:
    """The tables of a file: mapped where the shared folder is a file system of the machine, else read."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
    else:
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    sizes = raw[: 8 * len(ARRAYS)].view("<i8").tolist()
    out, at = {}, 8 * len(ARRAYS)
    for k, n in zip(ARRAYS, sizes):
        width = 1 if k == "labels" else 4
        out[k] = raw[at : at + n * width].view(np.uint8 if width == 1 else np.int32)
        at += n * width
    return out


class BpeCodec:
    """Encodes and decodes texts as a byte-level BPE file of the tokenizers library says,
    without that library. Special tokens in a text become their ids. Up to twice ``most``
    words are kept, which bounds memory, not what is encoded."""

    def __init__(self, tables: dict[str, np.ndarray], special: dict[str, int], most: int = 200_000):
        self.automaton = MergeAutomaton(tables)
        self.special = {t: str(i) for t, i in special.items()}
        self.cut_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pre_split = re.compile(PRE_SPLIT).findall
        self.has_special = self.cut_special.search if special else lambda _: None
        self.words = Words(self.encode_plain, self._part, ",".join, self.has_special, most, self.pre_split)
        self.emits = {str(i): self.automaton.label(i) for i in range(len(self.automaton.state))} | {str(i): t.encode() for t, i in special.items()}

    @classmethod
    def of(cls, path: str, most: int = 200_000) -> BpeCodec:
        vocab, merges, special = read_spec(path)
        return cls(compile_merges(vocab, merges), special, most)

    def _part(self, part: str) -> str:
        return ",".join(map(str, self.automaton.encode(part.encode())))

    def encode_plain(self, text: str) -> str:
        """Ids in decimal, joined by commas, of a text without special tokens."""
        return ",".join(map(self.words.mark, self.pre_split(text)))

    def encode_whole(self, text: str) -> list[str]:
        if not self.cut_special:
            return [self.encode_plain(text)] if text else []
        return [self.special[p] if p in self.special else self.encode_plain(p) for p in self.cut_special.split(text) if p]

    def encode_one(self, text: str) -> list[str]:
        """The text's ids as strings, some ids in each, joined by commas."""
        # A word begins at a single space, so texts without other white space beside one are cut there.
        first, *rest = text.split(" ")
        self.words.trim()
        if first[:1].isspace() or self.has_special(first):
            return self.encode_whole(text)
        try:
            ids = list(map(self.words.__getitem__, rest))
        except NotCut:
            return self.encode_whole(text)
        return [self.encode_plain(first), *ids] if first else ids

    def encode(self, texts: list[str]) -> list[list[str]]:
        return list(map(self.encode_one, texts))

    def decode(self, ids: list[str]) -> str:
        """The text that ids spell: their arc labels, bytes that aren't UTF-8 replaced."""
        return b"".join(map(self.emits.__getitem__, ",".join(ids).split(","))).decode("utf-8", "replace") if ids else ""


def compiled(spark, tokenizer: str):
    """What tasks call for their worker's codec of this file, compiled here and now."""
    folder = new_folder(spark, "automaton")
    path, special = write_tables(tokenizer, folder)
    return lambda: held(f"codec {path}", lambda: BpeCodec(read_tables(path, folder), special))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ids array<int> and the decoded text of each document. A null or empty text has
    no ids and decodes to an empty one; a null id, repeated rows and extra columns make no difference."""

    codec = compiled(docs.sparkSession, tokenizer)

    def run(batches):
        c = codec()
        for b in slices(batches):
            ids = c.encode(b["text"].to_pylist())
            flat = [[int(i) for some in x for i in some.split(",")] for x in ids]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(flat, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], [id_col, "ids", "decoded"])

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """op3: doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text. No shuffle."""

    codec = compiled(docs.sparkSession, tokenizer)

    def run(batches):
        c = codec()
        for b in slices(batches):
            n, left, right = [], [], []
            for ids in c.encode(b["text"].to_pylist()):
                line = ",".join(ids)
                n.append(line.count(",") + 1 if line else 0)
                left.append(hashlib.sha256(line.encode()).hexdigest())
                right.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(left), pa.array(right)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    text_batches(docs.sparkSession)
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
