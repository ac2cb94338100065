"""Product quantizers with even or uneven groups, learned rotations and bit allocation.

Training takes a bounded sample to the driver (as published quantizers do; the bound is a
parameter), encoding, decoding and search run over all vectors in Arrow batches. A model
is small: its codebooks hold at most 2**most_bits centroids a group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import balanced_groups, hash_sample
from .kernels import kmeans, lists, matrix, nearest, rotation_of, squared_distances

Groups = list[list[int]]


def check_partition(groups: Groups, d: int, partial: bool = False) -> None:
    """Each place once, none empty, all of them unless ``partial``."""
    flat = [i for g in groups for i in g]
    if not groups or any(not g for g in groups):
        raise ValueError("a group is empty")
    seen = set(flat)
    if len(flat) > len(seen):
        raise ValueError("a place is in two groups")
    if seen - set(range(d)):
        raise ValueError("a place is out of range")
    if not partial and len(seen) < d:
        raise ValueError("a place is in no group")


def check_bits(nbits: list[int], groups: Groups, total: int | None, most: int, least: int = 0) -> None:
    if len(nbits) != len(groups):
        raise ValueError("bits and groups differ in number")
    if any(not least <= b <= most for b in nbits):
        raise ValueError("bits are out of range")
    if total is not None and sum(nbits) != total:
        raise ValueError("bits don't add up to the budget")


@dataclass
class Quantizer:
    """Groups of places, a codebook for each, and what is done to vectors first: zeros up to ``width``,
    the mean taken off, a rotation (x @ rotation)."""

    d: int
    groups: Groups
    nbits: list[int]
    codebooks: list[np.ndarray]
    rotation: np.ndarray | None = None
    mean: np.ndarray | None = None
    width: int = 0
    kind: str = "pq"
    stages: int = 1  # residual stages: groups repeat, each stage codes what the last one left
    info: dict = field(default_factory=dict)

    def __post_init__(self):
        self.width = self.width or self.d

    def transform(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        if x.shape[1] != self.d:
            raise ValueError(f"vectors have {x.shape[1]} places, the model {self.d}")
        if self.width > self.d:
            x = np.hstack([x, np.zeros((len(x), self.width - self.d))])
        if self.mean is not None:
            x = x - self.mean
        return x if self.rotation is None else x @ self.rotation

    def restore(self, z: np.ndarray) -> np.ndarray:
        if self.rotation is not None:
            z = z @ self.rotation.T
        if self.mean is not None:
            z = z + self.mean
        return z[:, : self.d]

    def codes(self, x: np.ndarray) -> np.ndarray:
        z = self.transform(x)
        out = np.zeros((len(z), len(self.groups)), np.int32)
        rest = z.copy() if self.stages > 1 else z
        for g, (dims, book) in enumerate(zip(self.groups, self.codebooks)):
            if len(book) > 1:
                out[:, g] = nearest(rest[:, dims], book)
            if self.stages > 1:
                rest[:, dims] -= book[out[:, g]]
        return out

    def rotated(self, codes: np.ndarray) -> np.ndarray:
        z = np.zeros((len(codes), self.width))
        for g, (dims, book) in enumerate(zip(self.groups, self.codebooks)):
            z[:, dims] += book[codes[:, g]]
        return z

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.restore(self.rotated(codes))

    def lut(self, x: np.ndarray) -> list[np.ndarray]:
        """For each group the squared distances of the queries to its centroids. Groups of no bits keep
        theirs, so that sums are true distances."""
        z = self.transform(x)
        return [squared_distances(z[:, dims], book) for dims, book in zip(self.groups, self.codebooks)]

    def pair_tables(self) -> list[np.ndarray]:
        """For each group the squared distances between its centroids."""
        return [squared_distances(b, b) for b in self.codebooks]

    # DataFrames

    def encode(self, df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """vec_id, codes array<int>."""
        model = self

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b["vec_id"], lists(model.codes(matrix(b["v"])), pa.int32())], ["vec_id", "codes"])

        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "vec_id long, codes array<int>")

    def decoded(self, codes: DataFrame) -> DataFrame:
        """vec_id, embedding array<double> of (vec_id, codes)."""
        model = self

        def run(batches):
            for b in batches:
                if b.num_rows:
                    c = np.asarray(b["codes"].flatten()).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b["vec_id"], lists(model.decode(c), pa.float64())], ["vec_id", "embedding"])

        return codes.select("vec_id", "codes").mapInArrow(run, "vec_id long, embedding array<double>")

    def codebook_table(self, spark) -> DataFrame:
        rows = [(g, c, [float(x) for x in v]) for g, book in enumerate(self.codebooks) for c, v in enumerate(book)]
        return spark.createDataFrame(rows, "group_id int, code int, centroid array<double>")

    def group_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(g, list(map(int, dims)), int(b)) for g, (dims, b) in enumerate(zip(self.groups, self.nbits))], "group_id int, dims array<int>, nbits int")


def training_rows(df: DataFrame, most: int, seed: int, id_col: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """At most ``most`` vectors by the hash order of their ids, on the driver."""
    rows = hash_sample(df.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null"), most, seed)
    got = rows.select("v").toPandas()["v"]
    if not len(got):
        raise ValueError("there are no training vectors")
    return np.stack([np.asarray(v, np.float64) for v in got])


def books(z: np.ndarray, groups: Groups, nbits: list[int], rounds: int, seed: int, redo: int = 1) -> list[np.ndarray]:
    """A codebook for each group; no bits give its mean."""
    return [kmeans(z[:, dims], 1 << b, rounds, seed + 10_007 * g, redo) for g, (dims, b) in enumerate(zip(groups, nbits))]


def fit_pq(df: DataFrame, m: int, bits: int = 8, rounds: int = 20, most_train: int = 4096, seed: int = 123, pad: bool = True, **cols) -> Quantizer:
    """Even groups of one size. Vectors are filled with zeros to a multiple of m, or with
    ``pad=False`` must be one."""
    x = training_rows(df, most_train, seed, **cols)
    d = x.shape[1]
    if d % m and not pad:
        raise ValueError("the number of places isn't a multiple of the groups")
    width = -(-d // m) * m
    q = Quantizer(d, balanced_groups(width, m), [bits] * m, [], width=width)
    q.codebooks = books(q.transform(x), q.groups, q.nbits, rounds, seed)
    return q


def opq_layout(d: int, total: int, bits: int = 8, m: int = 0) -> tuple[int, int]:
    """Groups and width of a rotated quantizer: m groups if their bits make the total, else as many as
    the total has."""
    if m:
        if m * bits != total:
            raise ValueError("groups times bits isn't the budget")
    elif total % bits:
        raise ValueError("the budget isn't a multiple of the bits")
    m = m or total // bits
    return m, -(-d // m) * m


def fit_opq(df: DataFrame, total: int, bits: int = 8, m: int = 0, rounds: int = 25, inner: int = 4, most_train: int = 65_536, seed: int = 123, **cols) -> Quantizer:
    """A rotation learned by turns with the codebooks (orthogonal Procrustes)."""
    x = training_rows(df, most_train, seed, **cols)
    m, width = opq_layout(x.shape[1], total, bits, m)
    q = Quantizer(x.shape[1], balanced_groups(width, m), [bits] * m, [], width=width, kind="opq")
    x = np.hstack([x, np.zeros((len(x), width - x.shape[1]))])
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]
    if width <= len(x):  # start from the principal axes, spread over the groups
        values, axes = np.linalg.eigh(np.cov(x.T) + 1e-12 * np.eye(width))
        axes = axes[:, np.argsort(-values)]
        r = axes[:, np.argsort(np.arange(width) % m, kind="stable")]
    for _ in range(rounds):
        z = x @ r
        b = books(z, q.groups, q.nbits, inner, seed)
        back = np.hstack([c[nearest(z[:, dims], c)] for dims, c in zip(q.groups, b)])
        r = rotation_of(x.T @ back)
    q.rotation = r
    q.codebooks = books(x @ r, q.groups, q.nbits, 25, seed)
    return q


def pca(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes (columns, by falling variance), none left out."""
    mean = x.mean(axis=0)
    values, axes = np.linalg.eigh((x - mean).T @ (x - mean) / max(len(x), 1))
    return mean, axes[:, np.argsort(-values, kind="stable")]


def greedy_bits(cost, m: int, total: int, most: int) -> list[int]:
    """total times one more bit to the group where it leaves the least sum of costs, the first of
    equals; cost(g, b)."""
    if total > m * most:
        raise ValueError("the budget is above what the groups can hold")
    bits = [0] * m
    for _ in range(total):
        gains = [(cost(g, bits[g] + 1) - cost(g, bits[g]), g) for g in range(m) if bits[g] < most]
        bits[min(gains)[1]] += 1
    return bits


def fit_pca_bits(df: DataFrame, total: int, q: int = 4, m: int = 0, most: int = 12, rounds: int = 20, redo: int = 1, most_train: int = 200_000, seed: int = 123, **cols) -> Quantizer:
    """Principal axes in runs of about q, bits given out one by one by training error; the codebooks
    of the errors are kept."""
    x = training_rows(df, most_train, seed, **cols)
    d = x.shape[1]
    mean, axes = pca(x)
    z = (x - mean) @ axes
    groups = balanced_groups(d, m or -(-d // q))
    made: dict[tuple[int, int], np.ndarray] = {}
    costs: dict[tuple[int, int], float] = {}

    def cost(g: int, b: int) -> float:
        if (g, b) not in costs:
            part = z[:, groups[g]]
            made[g, b] = kmeans(part, 1 << b, rounds, seed + 10_007 * g + 7919 * b, redo)
            costs[g, b] = float(squared_distances(part, made[g, b]).min(axis=1).mean())
        return costs[g, b]

    bits = greedy_bits(cost, len(groups), total, most)
    for g, b in enumerate(bits):
        cost(g, b)
    return Quantizer(d, groups, bits, [made[g, b] for g, b in enumerate(bits)], axes, mean, kind="pca_bits")


def fit_rotation(x: np.ndarray, groups: Groups, nbits: list[int], rounds: int = 0, inner: int = 15, redo: int = 1, most_train: int = 65_536, most_eval: int = 16_384, fraction: float = 0.2, seed: int = 0, keep_best: bool = True) -> tuple[np.ndarray, list[float]]:
    """A rotation for uneven groups: codebooks and Procrustes by turns. ``rounds`` turns, or for 0 until
    5 turns don't better the evaluation error per component by 1e-7 (256 at most). Returns x @ A's A and
    the errors. ``keep_best`` takes the rotation of least error, else the last."""
    order = [i for g in groups for i in g]
    n = len(x)
    perm = np.random.default_rng(seed).permutation(n)
    x = x[:, order]
    if n > most_train:
        fit = x[perm[:most_train]]
        rest = perm[most_train:]
        held = x[rest[: min(len(rest), most_eval or max(1, int(round(n * fraction))))]]
    else:
        fit = x
        held = x[perm[:most_eval]] if most_eval < n else None
    at, spans = 0, []
    for g in groups:
        spans.append(list(range(at, at + len(g))))
        at += len(g)
    r = best = np.eye(len(order))
    least, since, errors = np.inf, 0, []
    for turn in range(rounds or 256):
        z = fit @ r
        b = books(z, spans, nbits, inner, seed, redo)
        back = np.hstack([c[nearest(z[:, dims], c)] for dims, c in zip(spans, b)])
        r = rotation_of(fit.T @ back)
        watched = (held if held is not None else fit) @ r
        b = books(fit @ r, spans, nbits, inner, seed, redo)
        error = sum(float(squared_distances(watched[:, dims], c).min(axis=1).mean()) for dims, c in zip(spans, b)) / len(order)
        errors.append(error)
        if error < least - 1e-7:
            least, since, best = error, 0, r
        else:
            since += 1
        if not rounds and since >= 5:
            break
    p = np.zeros((len(order), len(order)))
    p[order, np.arange(len(order))] = 1.0
    return p @ (best if keep_best else r), errors


def fit_uneven(df: DataFrame, groups: Groups, nbits: list[int], rotate: bool = True, rounds: int = 25, redo: int = 1, most_train: int = 65_536, seed: int = 123, rotation_rounds: int = 0, least: int = 0, most: int = 12, **cols) -> Quantizer:
    """A quantizer of a given structure (``structure.find`` makes one). With ``rotate`` the rotation makes
    each group a run of the rotated places."""
    x = training_rows(df, most_train, seed, **cols)
    d = x.shape[1]
    check_partition(groups, d)
    check_bits(nbits, groups, None, most, least)
    if not rotate:
        return Quantizer(d, groups, nbits, books(x, groups, nbits, rounds, seed, redo), kind="uneven")
    a, errors = fit_rotation(x, groups, nbits, rotation_rounds, seed=seed)
    at, spans = 0, []
    for g in groups:
        spans.append(list(range(at, at + len(g))))
        at += len(g)
    return Quantizer(d, spans, nbits, books(x @ a, spans, nbits, rounds, seed, redo), a, kind="uneven_rotated", info={"errors": errors})


def fit_residual(df: DataFrame, stages: int, bits: int = 8, m: int = 1, rounds: int = 20, most_train: int = 65_536, seed: int = 123, refine: int = 0, **cols) -> Quantizer:
    """Residual stages, over the whole vector (m = 1) or in m parts (product-residual): each stage codes what
    the stages before left. ``refine`` rounds re-fit all codebooks at once to the codes by least squares
    and re-code one stage at a time, the other stages held (local search)."""
    x = training_rows(df, most_train, seed, **cols)
    d = x.shape[1]
    parts = balanced_groups(d, m)
    groups = [p for p in parts for _ in range(stages)]
    q = Quantizer(d, groups, [bits] * len(groups), [], kind="residual" if m == 1 else "product_residual", stages=2 if stages > 1 else 1)
    rest = x.copy()
    for g, dims in enumerate(groups):
        book = kmeans(rest[:, dims], 1 << bits, rounds, seed + 10_007 * g)
        rest[:, dims] -= book[nearest(rest[:, dims], book)]
        q.codebooks.append(book)
    for _ in range(refine):
        codes = q.codes(x)
        for p, dims in enumerate(parts):
            own = range(p * stages, (p + 1) * stages)
            sizes = [len(q.codebooks[g]) for g in own]
            one = np.zeros((len(x), sum(sizes)))
            for g, start in zip(own, np.cumsum([0, *sizes[:-1]])):
                one[np.arange(len(x)), start + codes[:, g]] = 1.0
            fitted = np.linalg.solve(one.T @ one + 1e-6 * np.eye(sum(sizes)), one.T @ x[:, dims])
            before = float(((x[:, dims] - one @ np.vstack([q.codebooks[g] for g in own])) ** 2).sum())
            if float(((x[:, dims] - one @ fitted) ** 2).sum()) <= before:
                for g, start, size in zip(own, np.cumsum([0, *sizes[:-1]]), sizes):
                    q.codebooks[g] = fitted[start : start + size]
    return q


def local_search_codes(q: Quantizer, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes of a residual quantizer bettered one stage at a time, the others held."""
    codes, z = q.codes(x), q.transform(x)
    for _ in range(sweeps):
        for g, (dims, book) in enumerate(zip(q.groups, q.codebooks)):
            others = q.rotated(codes)[:, dims] - book[codes[:, g]]
            codes[:, g] = nearest(z[:, dims] - others, book)
    return codes


def first_books(df: DataFrame, groups: Groups, bits: int, id_col: str = "vec_id", vector: str = "embedding") -> list[np.ndarray]:
    """Codebooks of the 2**bits vectors of least id: a start that every engine can make."""
    rows = df.where(F.col(vector).isNotNull()).orderBy(id_col).limit(1 << bits).select(F.col(vector).cast("array<double>").alias("v")).collect()
    x = np.array([r["v"] for r in rows], np.float64)
    return [x[:, dims].copy() for dims in groups]


def lloyd_step(df: DataFrame, q: Quantizer, id_col: str = "vec_id", vector: str = "embedding") -> tuple[list[np.ndarray], DataFrame]:
    """One round of k-means of all groups over all vectors, wherever they are: each Arrow batch gives sums by group and code,
    and only these are shuffled. Returns the new codebooks (an empty cluster keeps its centroid) and group_id, code, n, error."""
    model = q

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b["v"])
            codes, z = model.codes(x), model.transform(x)
            for g, (dims, book) in enumerate(zip(model.groups, model.codebooks)):
                part, c = z[:, dims], codes[:, g]
                used, own = np.unique(c, return_inverse=True)
                sums = np.zeros((len(used), len(dims)))
                np.add.at(sums, own, part)
                error = np.zeros(len(used))
                np.add.at(error, own, ((part - book[c]) ** 2).sum(axis=1))
                n = np.bincount(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), g, np.int32)), pa.array(used.astype(np.int32)), pa.array(n), pa.array(error), lists(sums, pa.float64())], ["group_id", "code", "n", "error", "sums"])

    part = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "group_id int, code int, n long, error double, sums array<double>")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    table = part.groupBy("group_id", "code").agg(F.sum("n").alias("n"), F.sum("error").alias("error"), F.reduce(F.collect_list("sums"), F.array_repeat(F.lit(0.0), 0), lambda s, v: F.when(F.size(s) == 0, v).otherwise(add(s, v))).alias("sums")).persist()
    new = [b.copy() for b in q.codebooks]
    for r in table.collect():  # a row for each centroid
        new[r["group_id"]][r["code"]] = np.array(r["sums"]) / r["n"]
    return new, table.select("group_id", "code", "n", "error")
