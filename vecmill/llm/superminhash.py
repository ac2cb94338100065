"""Near duplicates by SuperMinHash, banding, verification and union-find grouping.

A document's set is its distinct 3-word shingles, A-Z lower-cased, words being runs
without space and \\t \\n \\v \\f \\r. Shingles are kept as 64-bit hashes. SuperMinHash
(Ertl, "SuperMinHash - a new minwise hashing algorithm for Jaccard similarity
estimation") gives each element a random permutation of the slots and puts round j's
number j + r into the slot of rank j, so an element's ranks are correlated and the
variance lower than independent hashes have; a document stops at the first round after
which every slot holds less than the next round could put there.

Bands of equal numbers propose links. Documents with equal sets are one class from the
start, found by the set's 128-bit hash. Each bucket ties its members to its leader;
these links are confirmed on full sets. Members of a bucket that its leader did not
bring into one component are then compared with each other, in blocks, until no bucket
holds an unconfirmed pair of different components: no candidate is dropped.

Nulls: a null or empty text, or one without words, has an empty set and no link. A null
doc_id has no component (null) and is kept. Rows that repeat a doc_id are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, release, slices, text_batches, written
from .components import UnionFind, components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
U = np.uint64


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; no two numbers share a result."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls as empty) and the n + 1 offsets of its rows."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def shingle_sets(column: pa.Array, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and n + 1 offsets."""
    raw, at = text_buffer(column)
    n = len(at) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    left = np.empty(len(raw), bool)
    left[0] = False
    left[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first[:-1] | ~left))
    right = np.empty(len(raw), bool)
    right[-1] = False
    right[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (first[1:] | ~right))
    up, down = _Powers.of(len(raw))
    sums = np.cumsum((_LOWER[raw].astype(np.uint64) + U(1)) * up)
    words = mix((sums[ends] - np.where(starts > 0, sums[starts - 1], U(0))) * down[starts])
    doc = np.searchsorted(at, starts, "right") - 1
    counts = np.bincount(doc, minlength=n)
    hashes, owner = [], []
    if len(words) >= width:
        h = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            h = mix(h) + words[k : len(words) - width + 1 + k]
        same = doc[: len(h)] == doc[width - 1 :]
        hashes.append(mix(h[same]))
        owner.append(doc[: len(h)][same])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = np.cumsum(counts) - counts
        h = U(0xA5A5A5A5) + counts[short].astype(np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            w = words[np.minimum(begin[short] + k, len(words) - 1)]
            h = np.where(has, mix(h) + w, h)
        hashes.append(mix(mix(h)))
        owner.append(short)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h, who = np.concatenate(hashes), np.concatenate(owner)
    if len(hashes) > 1:
        order = np.argsort(who, kind="stable")
        h, who = h[order], who[order]
    cut = np.searchsorted(who, np.arange(n + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def superminhash(elements: np.ndarray, offsets: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """The signature (n x m, round in the high 32 bits) of each set; an empty set's is all ones."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out = np.full(n * m, U(2**64 - 1))
    state = mix(elements + U(seed * 0x632BE59BD9B4E019 & (2**64 - 1)))
    ranks = row = None
    for j in range(m):
        if not len(doc):
            break
        draw = mix(state + U((j + 1) * _BASE & (2**64 - 1)))
        k = (j + (((draw & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if ranks is None:  # few documents come to a second round
                ranks = np.tile(np.arange(m, dtype=np.uint16), (len(doc), 1))
                row = np.arange(len(doc))
                ranks[row, first] = 0
                ranks[:, 0] = first
            slot = ranks[row, k].astype(np.int64)
            ranks[row, k] = ranks[:, j]
        np.minimum.at(out, doc * m + slot, (draw >> U(32)) | U(j << 32))
        open_ = (out.reshape(n, m).max(axis=1) >> U(32)) > j
        stay = open_[doc]
        if not stay.all():
            doc, state, first = doc[stay], state[stay], first[stay]
            if ranks is not None:
                ranks = ranks[stay]
                row = np.arange(len(doc))
    return out.reshape(n, m)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    n, m = signature.shape
    rows = signature.reshape(n, bands, m // bands)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) + U(7), (n, bands)).copy()
    for r in range(m // bands):
        h = mix(h) + rows[:, :, r]
    return mix(h).view(np.int64)


def set_hash(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, by sums of its elements mixed two ways."""
    both = []
    for salt in (0x1234567, 0x89ABCDEF):
        total = np.concatenate([[U(0)], np.cumsum(mix(elements ^ U(salt)))])
        both.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64))
    return both[0], both[1]


def signatures(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), h1, h2 (the set's hash) and the hashes of the bands of every row."""

    text_batches(docs.sparkSession)

    def run(batches):
        release()
        for b in slices(batches, 256, 1 << 18):
            sets, at = shingle_sets(b["text"])
            bandh = band_hashes(superminhash(sets, at, bands * rows), bands)
            h1, h2 = set_hash(sets, at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bandh) + 1) * bands, pa.int32()), pa.array(bandh.ravel()))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(np.diff(at)), pa.array(h1), pa.array(h2), lists], ["id", "n", "h1", "h2", "bands"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, n long, h1 long, h2 long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, id_col: str, text_col: str, most_broadcast: int = 1_000_000) -> DataFrame:
    """id, h1, set (binary of sorted uint64): the full sets of the wanted (id, h1, h2) classes, one row
    each. They are broadcast only where there are at most a million of them (24 MB). ``repeated`` has the
    (id, h1, h2) of which there are several rows; only their sets are shuffled."""
    side = wanted.select("id", F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    side = F.broadcast(side) if wanted.count() <= most_broadcast else side
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(side, "id")

    def run(batches):
        for b in slices(batches, 256, 1 << 18):
            sets, at = shingle_sets(b["text"])
            h1, h2 = set_hash(sets, at)
            own = np.flatnonzero((h1 == b["w1"].to_numpy()) & (h2 == b["w2"].to_numpy()))  # an id may have other texts
            parts = [sets[at[i] : at[i + 1]].tobytes() for i in own.tolist()]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(own)), pa.array(h1[own]), pa.array(h2[own]), pa.array(parts, pa.binary())], ["id", "h1", "h2", "set"])

    sets = written(src.mapInArrow(run, "id long, h1 long, h2 long, set binary"), "sets")
    if repeated.limit(1).count():
        keys = ["id", "h1", "h2"]
        twice = sets.join(repeated, keys, "left_semi").groupBy(keys).agg(F.first("set").alias("set"))
        sets = sets.join(repeated, keys, "left_anti").unionByName(twice)
    return sets.select("id", "h1", "set")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common) > 0


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, group: int = 500) -> DataFrame:
    """The pairs (u, uh, v, vh: ids and set hashes) that are links, as u, v. Pairs of one u are dealt over
    groups of about ``group``; u's set goes to each group once and v's sets stream past it. An id alone
    doesn't name a set where rows repeat it."""
    counted = pairs.groupBy("u", "uh").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
    dealt = pairs.join(counted, ["u", "uh"]).withColumn("g", F.pmod(F.xxhash64("v", "vh"), F.col("groups")).cast("int"))
    hubs = counted.select("u", "uh", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g")).join(sets.withColumnsRenamed({"id": "u", "h1": "uh"}), ["u", "uh"]).select("u", "uh", "g", F.lit(None).cast("long").alias("v"), "set")
    spokes = dealt.select("u", "uh", "g", "v", "vh").join(sets.withColumnsRenamed({"id": "v", "h1": "vh"}), ["v", "vh"]).select("u", "uh", "g", "v", "set")
    n = partitions(pairs.sparkSession)
    rows = hubs.union(spokes).repartition(n, "u", "uh", "g").sortWithinPartitions("u", "uh", "g", F.asc_nulls_first("v"))

    def run(batches):
        hub, own = None, None
        for b in slices(batches, 256):
            us, vs = [], []
            for u, uh, g, v, s in zip(b["u"].to_pylist(), b["uh"].to_pylist(), b["g"].to_pylist(), b["v"].to_pylist(), b["set"]):
                a = np.frombuffer(s.as_buffer(), np.uint64)
                if v is None:
                    hub, own = (u, uh, g), a.copy()
                elif hub == (u, uh, g) and _linked(own, a, percent):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def confirm_blocks(members: DataFrame, sets: DataFrame, percent: int, block: int = 128) -> DataFrame:
    """Links between bucket members (key, id, h1, n, component) of different components. Set sizes fall
    into classes such that linked sets are of one class or of neighbours; a bucket's members of a class
    are cut into blocks of about ``block``. Each pair of blocks that can hold a link is one group
    of at most about 2 * block sets, whose pairs are compared where they lie and joined by
    union-find: only links that tie components together come out, never all pairs."""
    m = members.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / float(1.001 * np.log(100 / percent)) if percent < 100 else F.col("n")).cast("long"))
    counted = m.groupBy("key", "c").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    m = m.join(counted, ["key", "c"]).withColumn("b", F.pmod(F.xxhash64("id", "h1", "key"), F.col("blocks")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = m.withColumn("o", every("blocks")).select("key", F.col("c").alias("low"), F.lit(0).alias("up"), F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "id", "h1", "component", F.col("b").alias("side"))
    above = counted.select("key", (F.col("c") - 1).alias("c"), F.col("blocks").alias("others"))
    below = counted.select("key", (F.col("c") + 1).alias("c"), F.col("blocks").alias("others"))
    upward = m.join(above, ["key", "c"]).withColumn("o", every("others")).select("key", F.col("c").alias("low"), F.lit(1).alias("up"), F.col("b").alias("x"), F.col("o").alias("y"), "id", "h1", "component", F.lit(-1).alias("side"))
    downward = m.join(below, ["key", "c"]).withColumn("o", every("others")).select("key", (F.col("c") - 1).alias("low"), F.lit(1).alias("up"), F.col("o").alias("x"), F.col("b").alias("y"), "id", "h1", "component", F.lit(-2).alias("side"))
    group = ["key", "low", "up", "x", "y"]
    spread = own.unionByName(upward).unionByName(downward)
    # Sets go only to groups that hold two components.
    open_ = spread.groupBy(*group).agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select(*group)
    rows = spread.join(open_, group, "left_semi").join(sets, ["id", "h1"])

    def run(table: pa.Table) -> pa.Table:
        ids, comp, side = (table[c].to_pylist() for c in ("id", "component", "side"))
        arrays = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["set"]]
        same = len(set(side)) == 1 and side[0] >= 0
        order = sorted(range(len(ids)), key=lambda i: len(arrays[i]))
        known, us, vs = UnionFind(), [], []
        for x, i in enumerate(order):
            for j in order[x + 1 :]:
                if 100 * len(arrays[i]) < percent * len(arrays[j]):
                    break
                if not same and side[i] == side[j] or known.find(comp[i]) == known.find(comp[j]):
                    continue
                if _linked(arrays[i], arrays[j], percent):
                    known.union(comp[i], comp[j])
                    us.append(ids[i])
                    vs.append(ids[j])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return rows.groupBy(*group).applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = 20, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of at least
    ``percent`` % Jaccard, itself included), kept (doc_id = component_id)."""
    sig = written(signatures(docs, bands, rows, id_col, text_col), "signatures")
    full = sig.where("n > 0 and id is not null")
    # One class for each different set; all rows of a class have the same n and bands.
    classes = written(full.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    same = full.select("h1", "h2", F.col("id").alias("u")).join(classes.select("h1", "h2", F.col("id").alias("v")), ["h1", "h2"]).where("u <> v").select("u", "v")
    keyed = classes.select("id", "h1", "n", F.explode("bands").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min(F.struct("id", "h1", "n")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    crowd = written(keyed.join(leaders, "key").select("key", "id", "h1", "n", F.col("leader.id").alias("u"), F.col("leader.h1").alias("uh"), F.col("leader.n").alias("un"), "size"), "buckets")
    near = F.least("n", "un") * 100 >= F.greatest("n", "un") * percent  # sets of other sizes can't be linked
    pairs = crowd.where("id <> u or h1 <> uh").where(near).select("u", "uh", F.col("id").alias("v"), F.col("h1").alias("vh")).distinct()
    wanted = classes.join(crowd.select("id", "h1").distinct(), ["id", "h1"], "left_semi").select("id", "h1", "h2")
    repeated = written(full.groupBy("id", "h1", "h2").count().where("count > 1").drop("count"), "repeated")
    sets = sets_of(docs, wanted, repeated, id_col, text_col)
    links = written(confirm(pairs, sets, percent), "links")
    edges = same.union(links)
    found = written(components(edges), "components")
    # Buckets whose members are not of one component yet: compare what the leader did not settle.
    wide = crowd.where("size > 2").select("key", "id", "h1", "n")
    placed = wide.join(found, wide.id == found.node, "left").select("key", "id", "h1", "n", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    rest = written(confirm_blocks(placed.join(split, "key", "left_semi"), sets, percent), "more-links")
    if rest.limit(1).count():
        found = written(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(rest)), "components")
    out = sig.join(found.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
