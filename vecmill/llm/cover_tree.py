"""Exact top-k by inner product with dual cover trees.

Vectors fall into cells around pivots (farthest-first points of a bounded sample, the top
of the tree); a cell is cut into blocks of about ``block`` rows by the hash of the id, so
that no cell, however full, is one task's. Queries form groups of about ``group`` per
cell. Blocks and groups each carry a cover tree of explicit levels: the centres of a level
are some of its points, more than r apart from each other and within r of every point;
each level holds the centres of the one above and halves r; the last level is all points.
Every node knows the distance of its furthest descendant. There is no limit to a node's
children; a level of more than a quarter of the points would not be worth its price and
is left out.

Both trees are descended together, level by level, the bounds of all open node pairs of a
level being one matrix product. A node pair can't hold a score above q.d + |q| rd +
|d| rq + rq rd (centres q, d; radii rq, rd), so it is pruned when that is below the worst
kth score of the query node's queries; only the children of open pairs come to the next
level, and only points below open pairs are scored, the likeliest first. First each group
meets a block of its own cell, which bounds its kth scores; then only the blocks that these
bounds leave. Queries meet all rows, in blocks; pruning never drops a possible result, and
equal scores are kept for the smaller id. ``counts`` adds up pairs and scored pairs.

Components are floor(scale * x), kept in as few bytes as the largest needs. Vectors that are
null or hold null or non-finite components take no part, nor do rows without an id; shorter
vectors count as padded with zeros, and very long ones make a block hold as many numbers, so
``block`` is for vectors of up to some thousand components. A query meets every row but
those of its own id; rows that repeat an id are candidates of their own, each with its rank.
Query rows of the same id and components are one query; those of the same id with other
components are queries of their own, each with its k results, ranked from 1. Scores beyond
a long stop at its ends. An empty table gives no rows; other columns make no difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, written

LONG = 2**63 - 1
PACKED = "kind int, block int, qgroup long, ids binary, vectors binary, kth binary"
#: A query is known by its group and its place there: ids may repeat.
FOUND = "qgroup long, at long, query_id long, vec_id long, score long"


def exact(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products. Floats are exact below 2**24, doubles below 2**53; beyond, Python's integers are used."""
    most = (np.abs(q).max(initial=0.0) * np.abs(d).max(initial=0.0)) * max(1, q.shape[1])
    if most < 2.0**24:
        return (q.astype(np.float32) @ d.T.astype(np.float32)).astype(np.int64)
    if most < 2.0**53:
        return (q @ d.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    big = whole(q).dot(whole(d.T)) if q.size and d.size else np.zeros((len(q), len(d)), object)
    return np.vectorize(lambda x: max(-LONG - 1, min(LONG, int(x))), otypes=[np.int64])(big)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T


class CoverTree:
    """Levels from the root to all points. rows[l]: the centres of level l, as rows of x; parent[l]: each
    centre's node on the level above; above[l]: each point's node; radius[l]: the distance of each
    node's furthest point; norm[l]: the length of each centre."""

    def __init__(self, x: np.ndarray, share: float = 0.25):
        n = len(x)
        self.x = x
        root = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        self.rows, self.parent, self.apart = [np.array([root])], [np.zeros(1, np.int64)], [float("inf")]
        near = np.sqrt(((x - x[root]) ** 2).sum(axis=1))
        who = np.zeros(n, np.int64)  # the nearest centre so far
        r = float(near.max())
        while r > 0 and near.max() > 0 and len(self.rows[-1]) < share * n:
            r = min(r, float(near.max())) / 2
            owner, centres = who.copy(), self._net(near, who, r, share * n)
            if centres is None:
                break
            self.rows.append(centres)
            self.parent.append(owner[centres])
            self.apart.append(r)
        # Points hang below the nearest centre of the last level; a point's path runs up from there.
        self.rows.append(np.arange(n))
        self.parent.append(self._below(len(self.rows[-2])))
        self.apart.append(0.0)
        self.above = [np.arange(n)]
        for parent in reversed(self.parent[1:]):
            self.above.insert(0, parent[self.above[0]])
        self.radius = []
        for rows, above in zip(self.rows, self.above):
            far = np.zeros(len(rows))
            np.maximum.at(far, above, np.sqrt(((x - x[rows[above]]) ** 2).sum(axis=1)))
            self.radius.append(far)
        self.norm = [np.sqrt((x[rows] ** 2).sum(axis=1)) for rows in self.rows]

    def _below(self, m: int) -> np.ndarray:
        """Each point's nearest centre of the last level."""
        centres, out = self.x[self.rows[-2]], np.zeros(len(self.x), np.int64)
        for at in range(0, len(out), 1024):
            out[at : at + 1024] = _squares(self.x[at : at + 1024], centres).argmin(axis=1)
        out[self.rows[-2]] = np.arange(m)
        return out

    def _net(self, near: np.ndarray, who: np.ndarray, r: float, most: float, step: int = 256) -> np.ndarray | None:
        """The centres of the last level and more, until every point is within r of one; None if there are
        too many. near and who are kept up."""
        x, centres = self.x, self.rows[-1].tolist()
        far, dist = who.copy(), near.copy()
        open_ = np.flatnonzero(dist > r)
        while len(open_):
            some = open_[:step]
            apart = _squares(x[some], x[some]) > r * r
            free, chosen = np.ones(len(some), bool), []
            for i in range(len(some)):
                if free[i]:
                    chosen.append(i)
                    free &= apart[i]
            new = some[chosen]
            if len(centres) + len(new) > most:
                return None
            to = np.sqrt(np.maximum(_squares(x, x[new]), 0))
            least = to.argmin(axis=1)
            least_to = to[np.arange(len(x)), least]
            least_to[new], least[new] = 0.0, np.arange(len(new))
            closer = least_to < dist
            dist[closer], far[closer] = least_to[closer], least[closer] + len(centres)
            centres += new.tolist()
            open_ = np.flatnonzero(dist > r)
        near[:], who[:] = dist, far
        return np.array(centres)


class TopK:
    """The best k of each query so far: scores descending, ids ascending among equals."""

    def __init__(self, n: int, k: int, kth: np.ndarray | None = None):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        #: below this a score can't be in the result; equal may
        self.kth = np.full(n, -LONG - 1, np.int64) if kth is None else kth.copy()

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        fits = scores >= self.kth[rows][:, None]
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            r = int(rows[i])
            at = np.flatnonzero(fits[i] & (ids != own[r]))
            if not len(at):
                continue
            s, v = np.concatenate([self.scores[r], scores[i, at]]), np.concatenate([self.ids[r], ids[at]])
            if len(s) > self.k:
                least = np.partition(s, len(s) - self.k)[len(s) - self.k]
                keep = s >= least
                s, v = s[keep], v[keep]
            order = np.lexsort((v, -s))[: self.k]
            self.scores[r], self.ids[r] = s[order], v[order]
            if len(order) == self.k:
                self.kth[r] = max(self.kth[r], s[order[-1]])


def seed(queries: CoverTree, data: CoverTree, q_ids: np.ndarray, d_ids: np.ndarray, top: TopK) -> None:
    """A lower bound of each kth score from some centres of the data."""
    level = next((rows for rows in data.rows if len(rows) >= 4 * top.k), data.rows[-1])[: 16 * top.k]
    scores = exact(queries.x, data.x[level]).astype(np.float64)
    scores[q_ids[:, None] == d_ids[level]] = -np.inf
    if len(level) > top.k:
        kth = -np.partition(-scores, top.k - 1, axis=1)[:, top.k - 1]
        ok = np.isfinite(kth) & (np.abs(kth) < 2.0**53)
        top.kth[ok] = np.maximum(top.kth[ok], kth[ok].astype(np.int64))


def dual(queries: CoverTree, data: CoverTree, q_ids: np.ndarray, d_ids: np.ndarray, top: TopK, step: int = 4096) -> int:
    """Descends both trees together; returns how many pairs of points were scored."""
    seed(queries, data, q_ids, d_ids, top)
    deep = max(len(queries.rows), len(data.rows) - 1)
    a = b = 0
    open_ = best = np.ones((1, 1))
    for level in range(deep):  # down to single queries, and to the data's last level of nodes
        i, j = min(level, len(queries.rows) - 1), min(level, len(data.rows) - 2)
        if level:
            open_ = open_[queries.parent[i]] if i > a else open_
            open_ = open_[:, data.parent[j]] if j > b else open_
        a, b = i, j
        kth = np.full(len(queries.rows[i]), np.inf)
        np.minimum.at(kth, queries.above[i], top.kth.astype(np.float64))
        q, d = queries.x[queries.rows[i]], data.x[data.rows[j]]
        best = q @ d.T + np.outer(queries.norm[i], data.radius[j]) + np.outer(queries.radius[i], data.norm[j]) + np.outer(queries.radius[i], data.radius[j])
        best += 1e-9 * np.abs(best) + 1e-6 + 1e-15 * np.abs(kth)[:, None]
        open_ = (open_ > 0) & (best >= kth[:, None])
        if not open_.any():
            return 0
    # Points below open pairs, data nodes in order of their best bound.
    order = np.argsort(-np.where(open_, best, -np.inf).max(axis=0), kind="stable")
    order = order[open_.any(axis=0)[order]]
    sizes = np.bincount(data.above[b], minlength=len(data.rows[b]))
    places = np.concatenate([[step // 8], np.arange(step, sizes[order].sum(), step)])
    cut = np.unique(np.searchsorted(np.cumsum(sizes[order]), places))
    q_sizes = np.bincount(queries.above[a], minlength=len(queries.rows[a]))
    points = np.argsort(data.above[b], kind="stable")  # a node's lie together
    start = np.concatenate([[0], np.cumsum(sizes)])
    scored = 0

    def score(q_nodes: np.ndarray, d_nodes: np.ndarray) -> int:
        here = np.zeros(len(q_sizes), bool)
        here[q_nodes] = True
        rows = np.flatnonzero(here[queries.above[a]])
        columns = np.concatenate([points[start[n] : start[n + 1]] for n in d_nodes.tolist()])
        top.add(rows, d_ids[columns], exact(queries.x[rows], data.x[columns]), q_ids)
        return len(rows) * len(columns)

    for nodes in np.split(order, cut):
        kth = np.full(len(q_sizes), np.inf)
        np.minimum.at(kth, queries.above[a], top.kth.astype(np.float64))
        still = open_[:, nodes] & (best[:, nodes] >= kth[:, None])
        q_nodes, d_nodes = np.flatnonzero(still.any(axis=1)), nodes[still.any(axis=0)]
        if not len(q_nodes):
            continue
        if 2 * float(q_sizes @ still @ sizes[nodes]) >= float(q_sizes[q_nodes].sum() * sizes[d_nodes].sum()):
            scored += score(q_nodes, d_nodes)
        else:  # most of these pairs are closed: each query node meets its own
            for n in q_nodes.tolist():
                scored += score(np.array([n]), nodes[still[n]])
    return scored


def _matrix(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1).astype(np.float64)


def _search(rows: DataFrame, k: int, packed: bool, number: str, counts=None) -> DataFrame:
    """rows (PACKED): blocks (kind 0) and the query groups (kind 1) that come to them. Packed: groups
    with their kth scores come out, else single results; either way results are there as rows."""
    n = partitions(rows.sparkSession)
    rows = rows.repartition(n, "block").sortWithinPartitions("block", "kind", "qgroup")

    def run(batches):
        data = None
        for b in batches:
            for kind, block, group, ids, raw, kth in zip(*(b[c].to_pylist() for c in ("kind", "block", "qgroup", "ids", "vectors", "kth"))):
                ids = np.frombuffer(ids, np.int64)
                x = _matrix(raw, len(ids), number)
                if kind == 0:
                    data = (block, ids, CoverTree(x))
                    continue
                if data is None or data[0] != block:
                    continue
                top = TopK(len(ids), k, np.frombuffer(kth, np.int64))
                scored = dual(CoverTree(x), data[2], ids, data[1], top)
                if counts:
                    counts[1].add(scored)
                sizes = [len(s) for s in top.scores]
                cols = [pa.array(np.repeat(np.arange(len(ids)), sizes)), pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([*top.ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*top.scores, np.zeros(0, np.int64)]))]
                if packed:
                    lists = [pa.array([c.to_numpy().tobytes()], pa.binary()) for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([group], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([raw], pa.binary()), pa.array([top.kth.tobytes()], pa.binary()), *lists], ["block", "qgroup", "ids", "vectors", "kth", "at", "query_id", "vec_id", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(sizes), group, np.int64)), *cols], ["qgroup", "at", "query_id", "vec_id", "score"])

    schema = "block int, qgroup long, ids binary, vectors binary, kth binary, at binary, query_id binary, vec_id binary, score binary" if packed else FOUND
    return rows.mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0, block: int = 8192, group: int = 512, sample: int = 4096, most_pivots: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", counts=None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best other rows. ``counts``: two
    accumulators, of pairs of a query and a row, and of those that were scored."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    src = src.select("id", "q", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double") if scale else x.cast("double")).alias("v"))
    n, d, most, asked = src.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))), F.count_if("q")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], empty)
    d = max(d or 0, 1)
    number = next((k for k, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if scale and most <= top), "<f8")
    if counts:
        counts[0].add(asked * n)

    def padded(column) -> np.ndarray:
        x = np.zeros((len(column), d))
        sizes = np.asarray(column.value_lengths())
        if len(column) and (sizes == d).all():
            return np.asarray(column.flatten(), np.float64).reshape(-1, d)
        for i, v in enumerate(column.to_pylist()):
            x[i, : len(v)] = v
        return x

    # Least hashes; a bound that the sample's stay under first, so that no task sorts more than about that many.
    hashed = src.select("id", "v", F.xxhash64("id").alias("h")).where(F.col("h") <= min(2**63 - 1, int((1.5 * sample + 64) / n * 2**64) - 2**63))
    picked = hashed.orderBy("h", "id").limit(sample).select("v").toPandas()["v"]  # at most ``sample``
    if not len(picked):
        picked = src.limit(1).select("v").toPandas()["v"]
    x = np.array([np.pad(np.asarray(v, float), (0, d - len(v))) for v in picked])
    pivots, near = [0], np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(pivots) < min(most_pivots, -(-n // block)) and near.max() > 0:
        pivots.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((x - x[pivots[-1]]) ** 2).sum(axis=1)))
    centres = x[pivots]

    def assign(batches):
        for b in slices(batches, 2048):
            v = padded(b["v"])
            square = (v**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * v @ centres.T
            cell = square.argmin(axis=1)
            far = np.sqrt(((v - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b["id"], b["q"], pa.array(cell.astype(np.int32)), pa.array(far), pa.array([row.tobytes() for row in (v + 0.0).astype(number)], pa.binary())], ["id", "q", "cell", "far", "v"])

    rows = written(src.mapInArrow(assign, "id long, q boolean, cell int, far double, v binary"), "vectors")
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("q").alias("queries"), F.max("far").alias("far")).orderBy("cell").collect()  # at most ``most_pivots``
    first, meta, at = {}, [], 0
    for c in cells:
        blocks = -(-c["n"] // block)
        first[c["cell"]] = (at, blocks, -(-c["queries"] // group) or 1)
        meta += [(b, c["cell"], c["far"]) for b in range(at, at + blocks)]
        at += blocks
    plan = F.broadcast(spark.createDataFrame([(c, *v) for c, v in first.items()], "cell int, start int, blocks int, groups int"))  # a row for each pivot
    placed = rows.join(plan, "cell").withColumn("block", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))

    def pack(kind: int):
        def run(table: pa.Table) -> pa.Table:
            ids = table["id"].combine_chunks().to_numpy()
            order = np.argsort(ids, kind="stable")
            raw = table["v"].to_pylist()
            one = lambda value, t: pa.array([value], t)
            kth = np.full(len(ids), -LONG - 1, np.int64).tobytes() if kind else None
            group = table["g"][0].as_py() if kind else None
            return pa.table({"kind": one(kind, pa.int32()), "block": one(table["block"][0].as_py(), pa.int32()), "qgroup": one(group, pa.int64()), "ids": one(ids[order].tobytes(), pa.binary()), "vectors": one(b"".join([raw[i] for i in order]), pa.binary()), "kth": one(kth, pa.binary())})

        return run

    blocks = written(placed.select("block", "id", "v").groupBy("block").applyInArrow(pack(0), PACKED), "blocks")
    queries = placed.where("q").select("start", "groups", "id", "v").dropDuplicates(["id", "v"]).withColumn("g", F.col("start").cast("long") * 1_000_000_000 + F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")))
    groups = queries.select("g", F.col("start").alias("block"), "id", "v").groupBy("g").applyInArrow(pack(1), PACKED)
    home = written(_search(blocks.unionByName(groups), k, True, number, counts), "home")
    table = np.array([(m[0], m[1], m[2]) for m in meta])
    norms = np.sqrt((centres**2).sum(axis=1))

    def send(batches):
        """Each group to the blocks that may hold a score as high as its queries' kth."""
        cell = table[:, 1].astype(np.int64)
        for b in batches:
            for block_, group_, ids, raw, kth in zip(*(b[c].to_pylist() for c in ("block", "qgroup", "ids", "vectors", "kth"))):
                q = _matrix(raw, len(ids) // 8, number)
                centre = q.mean(axis=0)
                radius = float(np.sqrt(((q - centre) ** 2).sum(axis=1)).max())
                norm = float(np.sqrt(centre @ centre))
                best = (centres @ centre)[cell] + norm * table[:, 2] + norms[cell] * radius + radius * table[:, 2]
                open_ = best + 1e-9 * np.abs(best) + 1e-6 >= np.frombuffer(kth, np.int64).min()
                for t in table[open_, 0].astype(int).tolist():
                    if t != block_:
                        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([t], pa.int32()), pa.array([group_], pa.int64()), *(pa.array([v], pa.binary()) for v in (ids, raw, kth))], ["kind", "block", "qgroup", "ids", "vectors", "kth"])

    def unpack(batches):
        for b in batches:
            for group_, *lists in zip(*(b[c].to_pylist() for c in ("qgroup", "at", "query_id", "vec_id", "score"))):
                parts = [np.frombuffer(part, np.int64) for part in lists]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(parts[0]), group_, np.int64), *parts)], ["qgroup", "at", "query_id", "vec_id", "score"])

    others = _search(blocks.unionByName(home.mapInArrow(send, PACKED)), k, False, number, counts)
    found = home.select("qgroup", "at", "query_id", "vec_id", "score").mapInArrow(unpack, FOUND).unionByName(others)
    order = Window.partitionBy("qgroup", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
