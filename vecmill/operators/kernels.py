"""Arrow batch kernels: blocks of vectors against a bounded set of queries or centroids."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

os.environ.setdefault("OMP_NUM_THREADS", "1")
DIGITS = 6
RESULT = "qid long, vec_id long, score double"


def matrix(column: pa.Array, d: int | None = None) -> np.ndarray:
    """A batch's vectors as rows of doubles."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1 if d is None and len(column) else d or 0)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, m = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(x.ravel()).cast(kind))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs; never below zero. Two tables of their size are held at once, not four."""
    twice = a @ b.T
    twice *= 2.0
    out = np.add.outer((a * a).sum(1), (b * b).sum(1))
    out -= twice
    return np.maximum(out, 0.0, out=out)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The code of each row's nearest centroid, ties (to 6 digits) to the least."""
    return np.round(squared_distances(x, centroids), DIGITS).argmin(axis=1)


def merge_best(scores: np.ndarray, ids: np.ndarray, had: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least scores (6 digits) of each query, equal ones by id, and their ids: of those it had (queries x at
    most k, in order) and of a tile (queries x rows). NaN comes last. A row that can't be among them is only compared."""
    (nq, n), (old, own) = scores.shape, had
    full = old.shape[1] == k

    def beyond(kth):
        return scores > kth + (10.0**-DIGITS + 1e-15 * np.abs(kth))  # more than rounding moves either

    near = ~beyond(old[:, -1:]) if full else np.ones(scores.shape, bool)
    if n > k and np.count_nonzero(near) > 2 * k * nq:
        near &= ~beyond(np.partition(scores, k - 1, axis=1)[:, k - 1 : k])
    q, at = np.nonzero(near)
    s, v = np.round(scores[q, at], DIGITS) + 0.0, ids[at]
    if full:
        worst, last = old[q, -1], own[q, -1]
        better = ~(s >= worst) & ~np.isnan(s) | ((s == worst) | np.isnan(s) & np.isnan(worst)) & (v < last)
        q, s, v = q[better], s[better], v[better]
        if not len(q):
            return had
    q = np.concatenate([np.repeat(np.arange(nq), old.shape[1]), q])
    s, v = np.concatenate([old.ravel(), s]), np.concatenate([own.ravel(), v])
    order = np.lexsort((v, s, q))
    q = q[order]
    order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return s[order].reshape(nq, -1), v[order].reshape(nq, -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 25, seed: int = 0, redo: int = 1) -> np.ndarray:
    """Lloyd's centroids; k is cut to the rows there are. An empty cluster takes the point farthest
    from its centroid. Of ``redo`` runs the best is kept."""
    n = len(x)
    k = min(k, n)
    if k <= 1:
        return x.mean(axis=0, keepdims=True)
    if k == n:
        return x.copy()
    best, least = None, np.inf
    for run in range(max(1, redo)):
        rng = np.random.default_rng([seed, run, k])
        c = x[np.sort(rng.choice(n, k, replace=False))].copy()
        for _ in range(rounds):
            d = squared_distances(x, c)
            own = d.argmin(axis=1)
            counts = np.bincount(own, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            new = sums / np.maximum(counts, 1)[:, None]
            empty = np.flatnonzero(counts == 0)
            if len(empty):
                far = np.argsort(-d[np.arange(n), own], kind="stable")[: len(empty)]
                new[empty] = x[far]
            if np.allclose(new, c, atol=1e-10):
                c = new
                break
            c = new
        cost = float(squared_distances(x, c).min(axis=1).mean())
        if cost < least:
            best, least = c, cost
    return best


def procrustes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rotation R (determinant 1) that brings x R nearest to y, from x'y."""
    return rotation_of(x.T @ y)


def rotation_of(gram: np.ndarray) -> np.ndarray:
    gram = np.asarray(gram, np.float64)
    try:
        u, _, vt = np.linalg.svd(gram)
    except np.linalg.LinAlgError:
        try:
            u, _, vt = np.linalg.svd(gram + 1e-8 * np.eye(len(gram)))
        except np.linalg.LinAlgError:
            return np.eye(len(gram))
    if np.linalg.det(u @ vt) < 0:
        u[:, -1] = -u[:, -1]
    return u @ vt
