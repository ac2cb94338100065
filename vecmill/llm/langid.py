"""Language identification by word-first backoff.

Each word is scored by its log relative frequency in every language; a language that
lacks the word gets a penalty. A word that no language knows falls back to its character
n-grams (padded with spaces), from the longest to the shortest length that has a known
one, scored by their mean. A text's score is the sum over its words (Jauhiainen et al.,
"HeLI, a word-based backoff method for language identification").

All training texts are counted, whole, and the model keeps every counted word and n-gram.
It is a table in files of the shared folder, cut into parts by the features' 64-bit hashes
and sorted by them, which workers map into memory and search: neither driver nor broadcast
holds it, and mapped pages are the system's to drop. Where the shared folder is no file
system of the machine, a worker holds the parts that it read last, up to ``HELD_BYTES``. Two of n features share a hash with
probability n^2 / 2^65 (5e-8 for a million), and one that isn't there is taken for one
that is with n / 2^64.

A text that is null or has no letter (Unicode's category L) is ``und`` with score 0. One with letters of which
the model knows nothing gets the language with most training words. Rows without a
language or id are not learned from. An empty training set knows no language: ``und``.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, new_folder, release, slices, text_batches, written
from .unicode_classes import LETTERS as LETTER

LETTERS = re.compile(f"[{LETTER}]+")
HELD_BYTES = 256 << 20
PENALTY = 7.0 * math.log(10)
COUNTED = "lang string, kind int, feature string, n long"


def _flush(counts: dict[tuple[str, int], Counter]):
    for (lang, kind), c in counts.items():
        rows = list(c.items())
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([kind] * len(part), pa.int32()), pa.array([k for k, _ in part]), pa.array([n for _, n in part], pa.int64())], ["lang", "kind", "feature", "n"])


def count_words(train: DataFrame, most: int = 200_000) -> DataFrame:
    """Words (kind 0) of each language in whole texts, counted in tasks before they are shuffled."""

    def run(batches):
        release()
        chunks: dict[str, Counter] = {}

        def words():
            for lang, c in chunks.items():
                out: Counter = Counter()
                for chunk, n in c.items():
                    if chunk.isalpha():
                        out[chunk] += n
                    else:
                        for w in LETTERS.findall(chunk):
                            out[w] += n
                yield from _flush({(lang, 0): out})

        for b in slices(batches):
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist()):
                chunks.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, chunks.values())) > most:
                yield from words()
                chunks = {}
        yield from words()

    return train.mapInArrow(run, COUNTED).groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame, longest: int, most: int = 200_000) -> DataFrame:
    """Character n-grams (kind = length) of the counted words."""

    def run(batches):
        release()
        counts: dict[tuple[str, int], Counter] = {}
        for b in slices(batches, 4096):
            for lang, word, n in zip(b["lang"].to_pylist(), b["feature"].to_pylist(), b["n"].to_pylist()):
                padded = f" {word} "
                for size in range(1, longest + 1):
                    c = counts.get((lang, size))
                    if c is None:
                        c = counts[lang, size] = Counter()
                    for i in range(len(padded) - size + 1):
                        g = padded[i : i + size]
                        c[g] = c.get(g, 0) + n
            if sum(map(len, counts.values())) > most:
                yield from _flush(counts)
                counts = {}
        yield from _flush(counts)

    return words.select("lang", "feature", "n").mapInArrow(run, COUNTED).where("trim(feature) <> ''").groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))


def feature_key(kind: int, feature: str) -> int:
    """64 bits of a word (kind 0) or an n-gram, whose length tells its kind."""
    return xxhash.xxh3_64_intdigest(("g" if kind else "w") + feature)


def store(counts: DataFrame, totals: dict[tuple[str, int], int], langs: list[str], size: int = 250_000) -> tuple[str, dict[int, str], int]:
    """Writes every counted feature's penalties as files of about ``size`` cells: their folder, the paths
    by part and the bits of a hash that tell its part. A file has the numbers of keys and cells, the
    keys in order, where each one's cells start, and the cells' languages and penalties."""
    spark = counts.sparkSession
    bits = max(0, math.ceil(math.log2(max(1, counts.count()) / size)))
    folder = new_folder(spark, "language-model")
    where = {lang: i for i, lang in enumerate(langs)}

    def hashed(batches):
        release()
        for b in slices(batches, 4096):
            langs_, kinds = b["lang"].to_pylist(), b["kind"].to_pylist()
            keys = np.array([feature_key(k, f) for k, f in zip(kinds, b["feature"].to_pylist())], np.uint64)
            share = b["n"].to_numpy() / np.array([totals[x] for x in zip(langs_, kinds)], np.float64)
            scores = np.minimum(PENALTY, -np.log(share)).astype(np.float32)
            part = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(keys.view(np.int64)), pa.array([where[x] for x in langs_], pa.int32()), pa.array(scores)], ["part", "key", "lang", "score"])

    def write(table: pa.Table) -> pa.Table:
        keys = table["key"].combine_chunks().to_numpy().view(np.uint64)
        lang, score = table["lang"].combine_chunks().to_numpy(), table["score"].combine_chunks().to_numpy()
        order = np.lexsort((lang, keys))
        one, starts = np.unique(keys[order], return_index=True)
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}"
        with fs.open_output_stream(path, compression=None) as f:
            for column, kind in (((len(one), len(keys)), "<i8"), (one, "<u8"), ((*starts, len(keys)), "<i4"), (lang[order], "<i4"), (score[order], "<f4")):
                f.write(np.asarray(column, kind).tobytes())
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "path": [path]})

    cells = counts.mapInArrow(hashed, "part int, key long, lang int, score float")
    files = written(cells.groupBy("part").applyInArrow(write, "part int, path string"), "language-manifest")
    return folder, {r["part"]: r["path"] for r in files.collect()}, bits  # a row for each file


class Model:
    """rows[kind][feature] is a row of matrix: a penalty for each language, lower is likelier."""

    def __init__(self, rows, totals: dict[str, int]):
        self.langs = sorted(totals)
        where = {lang: i for i, lang in enumerate(self.langs)}
        self.prior = max(self.langs, key=lambda x: (totals[x], x)) if self.langs else None
        self.share = totals[self.prior] / sum(totals.values()) if self.langs else 0.0
        self.rows: dict[int, dict[str, int]] = {}
        cells, used = [], 0
        for lang, kind, feature, n, total in rows:
            of = self.rows.setdefault(int(kind), {})
            if feature not in of:
                of[feature] = used
                used += 1
            cells.append((of[feature], where[lang], min(PENALTY, -math.log(n / total))))
        self.matrix = np.full((used, len(self.langs)), PENALTY)
        for r, c, score in cells:
            self.matrix[r, c] = score
        self.longest = max(self.rows, default=0)

    def find(self, kind: int, feature: str) -> np.ndarray | None:
        row = self.rows.get(kind, {}).get(feature)
        return None if row is None else self.matrix[row]

    def word(self, w: str) -> np.ndarray | None:
        known = self.find(0, w)
        return self.backoff(w) if known is None else known

    def backoff(self, w: str) -> np.ndarray | None:
        """The mean over the longest n-grams of which one is known."""
        padded = f" {w} "
        for size in range(self.longest, 0, -1):
            found = [r for i in range(len(padded) - size + 1) if (r := self.find(size, padded[i : i + size])) is not None]
            if found:
                return np.sum(found, axis=0) / len(found)
        return None

    def words(self, words: list[str]) -> np.ndarray:
        """A row for each word: its penalties (zeros where nothing is known), whether it has any, whether
        it is itself known, and 1."""
        n = len(self.langs)
        out = np.zeros((len(words), n + 3), np.float32)
        out[:, n + 2] = 1
        known = self.known(words, out)
        out[known, n : n + 2] = 1
        for i in np.flatnonzero(~known).tolist():
            row = self.backoff(words[i])
            if row is not None:
                out[i, :n], out[i, n] = row, 1
        return out

    def known(self, words: list[str], out: np.ndarray) -> np.ndarray:
        """Which words are known; their penalties are put into out."""
        rows = [self.find(0, w) for w in words]
        for i, row in enumerate(rows):
            if row is not None:
                out[i, : len(self.langs)] = row
        return np.array([r is not None for r in rows], bool)


class StoredModel(Model):
    """A model in files; n-grams that were asked for are kept, up to ``most``."""

    def __init__(self, folder: str, paths: dict[int, str], bits: int, totals: dict[str, int], longest: int, most: int = 50_000):
        super().__init__([], totals)
        self.folder, self.paths, self.shift, self.longest, self.most = folder, paths, 64 - bits, longest, most
        self.parts, self.grams, self.bytes = {}, {}, 0

    def __getstate__(self):
        return self.__dict__ | {"parts": {}, "grams": {}, "bytes": 0}

    def part(self, number: int) -> tuple[np.ndarray, ...] | None:
        if number in self.parts:
            got = self.parts[number] = self.parts.pop(number)
            return got
        path = self.paths.get(number)
        if path is None:
            return None
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        if isinstance(fs, pafs.LocalFileSystem):
            raw = np.asarray(np.memmap(path, np.uint8, "r"))
        else:
            with fs.open_input_file(path) as f:
                raw = np.frombuffer(f.read(), np.uint8)
            self.bytes += len(raw)
            while self.parts and self.bytes > HELD_BYTES:
                self.bytes -= sum(x.nbytes for x in self.parts.pop(next(iter(self.parts)))) + 16
        n, m = raw[:16].view("<i8").tolist()
        ends = np.cumsum([16, 8 * n, 4 * n + 4, 4 * m, 4 * m])
        got = self.parts[number] = tuple(raw[a:b].view(kind) for a, b, kind in zip(ends, ends[1:], ("<u8", "<i4", "<i4", "<f4")))
        return got

    def find(self, kind: int, feature: str) -> np.ndarray | None:
        if kind and feature in self.grams:
            return self.grams[feature]
        key = feature_key(kind, feature)
        row, part = None, self.part(key >> self.shift)
        if part is not None:
            keys, starts, langs, scores = part
            at = int(keys.searchsorted(np.uint64(key)))
            if at < len(keys) and int(keys[at]) == key:
                row = np.full(len(self.langs), PENALTY)
                row[langs[starts[at] : starts[at + 1]]] = scores[starts[at] : starts[at + 1]]
        if kind:
            if len(self.grams) >= self.most:
                self.grams.clear()
            self.grams[feature] = row
        return row

    def known(self, words: list[str], out: np.ndarray) -> np.ndarray:
        """All words of a part at a time."""
        known = np.zeros(len(words), bool)
        wanted = np.array([feature_key(0, w) for w in words], np.uint64)
        numbers = (wanted >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(words), np.int64)
        order = np.lexsort((wanted, numbers))
        cut = np.flatnonzero(np.diff(numbers[order])) + 1
        for who in np.split(order, cut) if len(words) else []:
            part = self.part(int(numbers[who[0]]))
            if part is None or not len(part[0]):
                continue
            keys, starts, langs, scores = part
            at = np.minimum(keys.searchsorted(wanted[who]), len(keys) - 1)
            there = keys[at] == wanted[who]
            who, at = who[there], at[there]
            if not len(who):
                continue
            known[who] = True
            out[who, : len(self.langs)] = PENALTY
            first = starts[at].astype(np.int64)
            n = starts[at + 1] - first
            cells = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[np.repeat(who, n), langs[cells]] = scores[cells]
        return known


class _Chunks:
    """Rows (as Model.words gives them) of what lies between white space, summed over its words; row 0 is
    of what has no letter. When there are ``most`` they become the old ones and those that were old
    are dropped, but a chunk that is met again moves on."""

    def __init__(self, model: Model, most: int):
        self.model, self.most = model, most
        self.rows: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.table = self.old_table = np.zeros((1, len(model.langs) + 3), np.float32)
        self.used = 1

    def _add(self, rows: np.ndarray) -> range:
        start, end = self.used, self.used + len(rows)
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((end - len(self.table) + 20_000, self.table.shape[1]), np.float32)])
        self.table[start:end] = rows
        self.used = end
        return range(start, end)

    def learn(self, chunks: set[str]) -> None:
        """Finds rows for chunks that have none."""
        if len(self.rows) > self.most:
            self.old, self.old_table = self.rows, self.table[: self.used].copy()
            self.rows, self.used = {}, 1
        fresh = chunks.difference(self.rows)
        parts = {c: [c] if c.isalpha() else LETTERS.findall(c) for c in fresh}
        words = [w for w in set().union(*parts.values()) if w not in self.rows]
        again = [w for w in words if w in self.old]
        self.rows.update(zip(again, self._add(self.old_table[[self.old[w] for w in again]])))
        new = [w for w in words if w not in self.old]
        self.rows.update(zip(new, self._add(self.model.words(new))))
        for chunk, of in parts.items():
            if len(of) == 1:
                self.rows[chunk] = self.rows[of[0]]
            elif of:
                self.rows[chunk] = self._add(self.table[[self.rows[w] for w in of]].sum(axis=0, keepdims=True))[0]
            else:
                self.rows[chunk] = 0

    def sums(self, texts: list[list[str]]) -> list[np.ndarray]:
        self.learn(set().union(*texts))
        get = self.rows.__getitem__
        return [self.table[np.fromiter(map(get, t), np.int64, len(t))].sum(axis=0, dtype=np.float64) for t in texts]


def train_model(docs: DataFrame, trains: Column, text_col: str = "text", lang_col: str = "lang", longest: int = 4) -> Model:
    """Learns from whole texts of the rows for which ``trains`` is true and the language isn't null."""
    text_batches(docs.sparkSession)
    train = docs.where(trains & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    words = written(count_words(train), "words")
    grams = written(count_grams(words, longest), "grams")
    counts = words.unionByName(grams)
    totals = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}  # some rows a language
    of_words = {lang: n for (lang, kind), n in totals.items() if not kind}
    return StoredModel(*store(counts, totals, sorted(of_words)), of_words, longest)


def predict(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", most: int = 100_000) -> DataFrame:
    """The named columns, lang_pred, score (the winner's share of likelihood, 0 to 1), n_words (runs of
    letters) and known (the share of them that the model learned)."""
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    number = f"languages {uuid.uuid4().hex}"  # workers outlive models

    def run(batches):
        chunks = held(number, lambda: _Chunks(sent.value, most))
        langs = chunks.model.langs
        for b in slices(batches):
            texts = [t if t is not None and langs and LETTERS.search(t) else "" for t in b["text"].to_pylist()]
            out = []
            for text, s in zip(texts, chunks.sums([t.lower().split() for t in texts])):
                scored, known, words = s[len(langs) :].tolist()
                s = s[: len(langs)]
                if not text or not words:
                    out.append(("und", 0.0, 0, 0.0))
                elif not scored:
                    out.append((chunks.model.prior, chunks.model.share, int(words), 0.0))
                else:
                    best = int(s.argmin())
                    out.append((langs[best], float(1.0 / np.exp(np.minimum(s[best] - s, 0.0)).sum()), int(words), known / words))
            new = zip(zip(*out), (pa.string(), pa.float64(), pa.int64(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b["row"].field(i) for i in range(len(columns))), *(pa.array(c, t) for c, t in new)], names)

    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("known", T.DoubleType())])
    schema = T.StructType([docs.schema[c] for c in columns] + added.fields)
    names = schema.fieldNames()
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """op9: doc_id, held_out, lang_pred and score of every document."""
    trains = F.col("doc_id").isNotNull() & ~held_out()
    model = train_model(docs, trains)
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
