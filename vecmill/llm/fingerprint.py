"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last 7 bytes ends a chunk wherever its k highest bits are zero,
so boundaries depend on content only and an edit changes the chunks it touches. Each
chunk gives 12 bits of its hash, two base64 characters; a run of equal chunks counts
three times at most. The block size 2**k is the largest with 32 boundaries at least, or
4: no chunk swallows the rest of a long text. The fingerprint ``block:signature:signature of the doubled block`` is compared by
edit distance (insertions and deletions) wherever two fingerprints have a block size in
common: likeness = 1 - distance / total length, the higher if two sizes agree.

A null text is an empty one, with the fingerprint ``4::``; an empty fingerprint is like
another empty one (1.0) and unlike all else (0.0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, bucket_of, longs, partitions, range_bounds, release, slices, text_batches

WINDOW, FEWEST, LEAST_K = 7, 32, 2
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in ALPHABET for b in ALPHABET]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as some text needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


def _signature(sums: np.ndarray, down: np.ndarray, ends: np.ndarray) -> str:
    n = len(sums)
    if not len(ends) or ends[-1] != n - 1:
        ends = np.append(ends, n - 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    before = np.where(starts > 0, sums[starts - 1], 0).astype(np.uint64)
    h = (sums[ends] - before) * down[starts]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    code = h >> np.uint64(52)
    if len(code) > 3:  # a run of one chunk counts three times at most
        code = code[np.concatenate([[True] * 3, (code[3:] != code[2:-1]) | (code[3:] != code[1:-2]) | (code[3:] != code[:-3])])]
    return "".join([_PAIRS[i] for i in code.tolist()])


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{1 << LEAST_K}::"
    up, down = _Powers.of(n)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)
    rolling = sums.copy()
    rolling[WINDOW:] -= sums[:-WINDOW]
    rolling *= down
    k = max(LEAST_K, (n // FEWEST).bit_length() - 2)
    at = np.flatnonzero(rolling < np.uint64(1 << (64 - k)))
    if len(at) < FEWEST and k > LEAST_K:
        k = LEAST_K
        at = np.flatnonzero(rolling < np.uint64(1 << (64 - k)))
    double = at[rolling[at] < np.uint64(1 << (63 - k))]
    while len(double) >= FEWEST and k < 62:
        k, at = k + 1, double
        double = at[rolling[at] < np.uint64(1 << (63 - k))]
    return f"{1 << k}:{_signature(sums, down, at)}:{_signature(sums, down, double)}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    if not set(a).intersection(b):
        return 0
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _likeness(a: str, b: str) -> float:
    x, y = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
    if not x or not y:
        return float(x == y)
    distance = len(x) + len(y) - 2 * _common(x, y)
    return 1.0 - distance / (len(x) + len(y))


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal fingerprints, 0 for block sizes that aren't compatible."""
    if a == b:
        return 1.0
    (p, a1, a2), (q, b1, b2) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_likeness(a1, b1), _likeness(a2, b2))
    if p == 2 * q:
        return _likeness(a1, b2)
    if q == 2 * p:
        return _likeness(a2, b1)
    return 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and the fingerprint of each row's whole text."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([fingerprint(t) for t in b["text"].to_pylist()], pa.string())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def with_next(docs: DataFrame, pair, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Applies ``pair(ids, texts, state)`` to runs of consecutive documents, ascending by id.

    Rows are put into range buckets (nulls first; rows of one id ordered by their text's
    hash, over which an id that fills whole buckets is spread), and the first row of each
    bucket goes to the bucket before, too (of the first bucket: to the last). So no task
    sees more than its bucket, and the text is shuffled once.
    """
    spark = docs.sparkSession
    text_batches(spark)
    n = 2 * partitions(spark)
    bounds = range_bounds(docs, id_col, n)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(LOWEST))

    @F.pandas_udf("int")
    def bucket(k: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(bounds, k.to_numpy(np.int64), tie.to_numpy(np.int64)))

    firsts = src.select(bucket(key, "tie").alias("bucket"), F.struct(key.alias("k"), "tie").alias("row")).groupBy("bucket").agg(F.min("row").alias("row")).collect()  # a row for each bucket
    order = sorted(r["bucket"] for r in firsts)
    before = dict(zip(order, order[-1:] + order[:-1]))
    first = {(r["row"]["k"], r["row"]["tie"]): before[r["bucket"]] for r in firsts}

    @F.pandas_udf("array<int>")
    def targets(k: pd.Series, tie: pd.Series) -> pd.Series:
        """The row's bucket, and as -1 - bucket the one that needs it as its end."""
        own = bucket_of(bounds, k.to_numpy(np.int64), tie.to_numpy(np.int64)).tolist()
        seen, out = set(), []
        for b, at in zip(own, zip(k.tolist(), tie.tolist())):
            if at in first and at not in seen:
                seen.add(at)
                out.append([b, -1 - first[at]])
            else:
                out.append([b])
        return pd.Series(out)

    spread = src.withColumn("to", F.explode(targets(key, "tie")))
    spread = spread.select("id", "tie", "text", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("bucket"), (F.col("to") < 0).alias("ghost"))
    rows = spread.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "ghost", F.asc_nulls_first("id"), "tie")

    def run(batches):
        release()
        held: tuple | None = None  # bucket, id, text, ghost: the row that waits for its next one
        state: dict = {}
        for b in slices(batches):
            ids, texts, nexts = [], [], []
            for row in zip(b["bucket"].to_pylist(), b["id"].to_pylist(), b["text"].to_pylist(), b["ghost"].to_pylist()):
                if held is not None and not held[3] and held[0] == row[0]:
                    ids.append(held[1])
                    texts.append(held[2])
                    nexts.append(row[2])
                held = row
            if ids:
                yield pair(ids, texts, nexts, state)

    return rows.mapInArrow(run, schema)


def edit(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the next one's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """op1: fingerprints of each document and of its edited text, and how near the edited
    text and the next document are. Columns as the query's contract has them."""

    def pair(ids, texts, nexts, state):
        known = state.get("text") == texts[0]
        marks = [state["next"] if known and i == 0 else fingerprint(t) for i, t in enumerate(texts)]
        ahead = [*marks[1:], None]
        rows = []
        for i, (t, f) in enumerate(zip(texts, nexts)):
            g = ahead[i] if ahead[i] is not None and texts[i + 1] == f else fingerprint(f)
            e = edit(t, f)
            h = fingerprint(e)
            rows.append((len(t), hashlib.sha256(e.encode()).hexdigest(), marks[i], h, likeness(marks[i], h), likeness(marks[i], g)))
            if i == len(texts) - 1:
                state.update(text=f, next=g)
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
