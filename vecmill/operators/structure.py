"""Search for a structure: which places form groups, and how many bits each group gets.

The objective is the holdout cost D(group, bits): centroids are trained on a train split of
a bounded sample, the cost is the mean squared distance of the eval split. Costs are
remembered; those that a step needs are made in one Spark job, a task for some keys each
(``HoldoutCost.need``). The search itself (grow, merge, marginal moves) runs on the driver
and sees only costs.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.vectors import balanced_groups, split_sizes
from .allocation import dp_bits, marginal
from .kernels import kmeans, squared_distances
from .quantizers import Groups, check_bits, check_partition, training_rows


def holdout_cost(train: np.ndarray, held: np.ndarray, dims: tuple[int, ...], bits: int, seed: int, rounds: int = 8, redo: int = 1) -> float:
    """The median over ``redo`` trainings. The seed follows from places and bits, so the cost is a function of them."""
    own = seed + zlib.crc32(np.array(dims, np.int32).tobytes()) % 100_000 + 7919 * bits
    a, b = train[:, dims], held[:, dims]
    runs = []
    for r in range(max(1, redo)):
        c = kmeans(a, 1 << bits, rounds, (own + r) & 0x7FFFFFFF)
        runs.append(float(squared_distances(b, c).min(axis=1).mean()))
    return float(np.median(runs))


class HoldoutCost:
    """D(dims, bits), remembered. With a session, many costs at once are made by one job over a broadcast of
    the sample, which is bounded by its rows."""

    def __init__(self, x: np.ndarray, seed: int = 123, most_train: int = 16_384, most_eval: int = 4_096, fraction: float = 0.2, rounds: int = 8, redo: int = 1, spark: SparkSession | None = None, job_from: int = 64):
        n_train, n_eval = split_sizes(len(x), most_train, most_eval, fraction)
        order = np.random.default_rng(seed).permutation(len(x))
        self.train = x[order[:n_train]]
        self.held = x[order[n_train : n_train + n_eval]] if len(x) > 1 else x
        self.seed, self.rounds, self.redo, self.spark, self.job_from = seed, rounds, redo, spark, job_from
        self.known: dict[tuple[tuple[int, ...], int], float] = {}
        self.sent = None

    def key(self, dims, bits: int):
        return tuple(sorted(map(int, dims))), int(bits)

    def need(self, keys) -> None:
        missing = sorted({self.key(*k) for k in keys} - self.known.keys())
        if self.spark is None or len(missing) < self.job_from:
            for dims, bits in missing:
                self.known[dims, bits] = holdout_cost(self.train, self.held, dims, bits, self.seed, self.rounds, self.redo)
            return
        if self.sent is None:
            self.sent = self.spark.sparkContext.broadcast((self.train, self.held))
        sent, seed, rounds, redo = self.sent, self.seed, self.rounds, self.redo

        def run(frames):
            train, held = sent.value
            for f in frames:
                yield f.assign(cost=[holdout_cost(train, held, tuple(d), int(b), seed, rounds, redo) for d, b in zip(f["dims"], f["bits"])])[["at", "cost"]]

        rows = pd.DataFrame({"at": range(len(missing)), "dims": [list(d) for d, _ in missing], "bits": [b for _, b in missing]})
        frame = self.spark.createDataFrame(rows, "at int, dims array<int>, bits int").repartition(min(len(missing), 4 * self.spark.sparkContext.defaultParallelism), "at")
        for r in frame.mapInPandas(run, "at int, cost double").collect():
            self.known[missing[r["at"]]] = r["cost"]

    def __call__(self, dims, bits: int) -> float:
        k = self.key(dims, bits)
        if k not in self.known:
            self.need([k])
        return self.known[k]


@dataclass
class Structure:
    d: int
    total: int
    groups: Groups
    nbits: list[int]
    meta: dict = field(default_factory=dict)

    def check(self, most: int = 32) -> Structure:
        check_partition(self.groups, self.d)
        check_bits(self.nbits, self.groups, self.total, most)
        return self

    def dump(self) -> str:
        return json.dumps({"format_version": 2, "d": self.d, "B": self.total, "groups": self.groups, "nbits": self.nbits, "meta": self.meta}, indent=1)

    @classmethod
    def load(cls, text: str) -> Structure:
        got = json.loads(text)
        if got.get("format_version") not in (1, 2):
            raise ValueError("no such version of a structure")
        return cls(int(got["d"]), int(got["B"]), [list(map(int, g)) for g in got["groups"]], list(map(int, got["nbits"])), got.get("meta") or {}).check()


def canonical(groups) -> tuple:
    """One key for all orders of a partition."""
    return tuple(sorted(tuple(sorted(g)) for g in groups))


class Context:
    """Costs, a budget and what the steps share."""

    def __init__(self, x: np.ndarray, total: int, most_bits: int = 12, seed: int = 123, least_bits: int = 0, spark: SparkSession | None = None, **cost):
        self.x, self.d, self.total, self.most, self.least = x, x.shape[1], total, most_bits, least_bits
        self.rng = np.random.default_rng(seed)
        self.cost = HoldoutCost(x, seed, spark=spark, **cost)
        if total > self.d * most_bits:
            raise ValueError("the budget is above what the places can hold")

    def solve(self, groups: Groups, partial: bool = False) -> tuple[list[int], float]:
        """The best bits for these groups and their cost."""
        check_partition(groups, self.d, partial)
        top = min(self.most, self.total)
        self.cost.need((g, b) for g in groups for b in range(top + 1))
        return dp_bits([[self.cost(g, b) for b in range(top + 1)] for g in groups], self.total, self.least)


def even_groups(d: int, total: int, bits: int = 8) -> tuple[Groups, list[int]]:
    """A group for each 8 bits, what is left to the last; one group below 8 bits."""
    m = max(1, min(total // bits, d))
    out = [bits] * m if total >= bits else [total]
    out[-1] += total - sum(out)
    return balanced_groups(d, len(out)), out


def neighbour_lists(x: np.ndarray, k: int = 16, least: float = 0.0, rows: int = 4096, seed: int = 0) -> list[list[tuple[int, float]]]:
    """For each place the others of highest absolute correlation on at most ``rows`` rows."""
    d = x.shape[1]
    if d < 2:
        return [[]] * d
    if len(x) > rows:
        x = x[np.random.default_rng(seed).permutation(len(x))[:rows]]
    if len(x) <= 1:
        return [[(j, 0.0) for j in range(d) if j != i][:k] for i in range(d)]
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    r = np.abs(np.clip(z.T @ z / len(z), -1, 1))
    np.fill_diagonal(r, -1)
    order = np.argsort(-r, axis=1, kind="stable")[:, : min(k, d - 1)]
    return [[(int(j), float(r[i, j])) for j in order[i] if r[i, j] >= least] for i in range(d)]


def tie_lists(neighbours) -> list[list[tuple[int, float]]]:
    """Neighbours both ways; a mutual tie is there twice and so has two votes."""
    ties = [list(ns) for ns in neighbours]
    for i, ns in enumerate(neighbours):
        for j, w in ns:
            ties[j].append((i, w))
    return ties


def grow(ctx: Context, alpha: float = 2.0, least_groups: int = 16, k: int = 16, most_dims: int = 1024, votes: int = 2, score_bits: int = 4, rerank: int = 32, top_seeds: int = 16, pair: bool = True, least_size: int = 1) -> Groups:
    """Groups grown around hard seeds by correlation: each round every group offers its best tied place (by
    cost lowered), and the best offer of all is taken; what no group reaches is dealt at the end."""
    d, cost = ctx.d, ctx.cost
    m = max(round(alpha * (ctx.total // 8)), least_groups, math.ceil(d / most_dims), math.ceil(ctx.total / ctx.most))
    m = min(m, d)
    ties = tie_lists(neighbour_lists(ctx.x, k))
    free = set(range(d))
    cost.need(((i,), score_bits) for i in range(d))
    groups: Groups = []
    for left in range(m, 0, -1):
        ranked = sorted(free, key=lambda i: (-cost((i,), score_bits), i))
        seed = ranked[int(ctx.rng.integers(min(top_seeds, len(ranked))))]
        free.discard(seed)
        g = [seed]
        if pair and len(free) >= left:
            near = sorted({j for j, _ in ties[seed] if j in free})
            cost.need(((seed, j), score_bits) for j in near)
            offers = [(cost((seed,), score_bits) - cost((seed, j), score_bits), -j) for j in near]
            if offers and max(offers)[0] > 0:
                g.append(-max(offers)[1])
                free.discard(g[-1])
        while len(g) < least_size and len(free) > left - 1:
            g.append(sorted(free)[int(ctx.rng.integers(len(free)))])
            free.discard(g[-1])
        groups.append(g)
    offers: dict[int, tuple[float, int] | None] = {}

    def offer(gi: int) -> tuple[float, int] | None:
        g = groups[gi]
        if len(g) >= most_dims:
            return None
        weight: dict[int, list[float]] = {}
        for i in g:
            for j, w in ties[i]:
                if j in free:
                    weight.setdefault(j, []).append(w)
        strong = {j: w for j, w in weight.items() if len(w) >= votes} or weight
        short = sorted(strong, key=lambda j: (-sum(strong[j]), j))[:rerank]
        if not short:
            return None
        cost.need([(g, score_bits)] + [((*g, j), score_bits) for j in short])
        return max((cost(g, score_bits) - cost((*g, j), score_bits), -j) for j in short)

    while free:
        for gi in range(len(groups)):
            if gi not in offers or offers[gi] is not None and -offers[gi][1] not in free:
                offers[gi] = offer(gi)
        live = [(o[0], -gi, -o[1]) for gi, o in offers.items() if o is not None]
        if not live:
            rest = sorted(free)
            ctx.rng.shuffle(rest)
            for j in rest:
                room = [g for g in groups if len(g) < most_dims]
                (room[0].append(j) if room else groups.append([j]))
            free.clear()
            break
        _, gi, j = max(live)
        groups[-gi].append(j)
        free.discard(j)
        offers.pop(-gi)
    out = [sorted(g) for g in groups]
    check_partition(out, d)
    return out


def _proposals(ctx: Context, groups: Groups, ties, n: int, near_share: float, two_hop_share: float, power: float) -> list[tuple[int, int]]:
    """Pairs of groups to merge: tied by correlation, two ties away, and far ones at random by size."""
    of = {i: g for g, dims in enumerate(groups) for i in dims}
    adjacent: dict[int, dict[int, float]] = {g: {} for g in range(len(groups))}
    for i, ns in enumerate(ties):
        for j, w in ns:
            a, b = of[i], of[j]
            if a != b:
                adjacent[a][b] = adjacent[a].get(b, 0.0) + w
    near = sorted(((w, a, b) for a, ns in adjacent.items() for b, w in ns.items() if a < b), key=lambda e: (-e[0], e[1:]))
    pool = [(a, b) for _, a, b in near[: int(n * near_share)]]
    hops = []
    for a in adjacent:
        count: dict[int, int] = {}
        for mid in adjacent[a]:
            for c in adjacent[mid]:
                if c != a and c not in adjacent[a]:
                    count[c] = count.get(c, 0) + 1
        hops += [(a, c) for c in sorted(count, key=lambda c: (-count[c], c))[:4]]
    ctx.rng.shuffle(hops)
    pool += [(min(e), max(e)) for e in hops[: int(n * (1 - near_share) * two_hop_share)]]
    m = len(groups)
    if m > 1:
        p = np.array([len(g) for g in groups], float) ** power
        p /= p.sum()
        for _ in range(4 * n):
            if len(set(pool)) >= min(n, m * (m - 1) // 2):
                break
            a, b = ctx.rng.choice(m, 2, replace=False, p=p)
            pool.append((int(min(a, b)), int(max(a, b))))
    return list(dict.fromkeys(pool))


def merge_beam(ctx: Context, groups: Groups, width: int = 8, children: int = 8, shortlist: int = 128, pool: int = 2048, quota: int = 12, score_bits: int = 4, tolerance: float = 1e-6, most_dims: int = 1024, near_share: float = 0.4, two_hop_share: float = 0.25, power: float = 0.5, k: int = 16) -> tuple[Groups, list[int], float]:
    """Merges groups while the solved cost falls, keeping the best few partitions of each depth."""
    ties = neighbour_lists(ctx.x, k)
    least = math.ceil(ctx.total / ctx.most)
    cost = ctx.cost
    order = lambda gs: sorted((sorted(g) for g in gs), key=lambda g: (len(g), g[0]))
    groups = order(groups)
    bits, j = ctx.solve(groups)
    beam, best = [(j, groups, bits)], (j, groups, bits)
    while True:
        found = {}
        for j, gs, bits in beam:
            if len(gs) <= least:
                continue
            pairs = [(a, b) for a, b in _proposals(ctx, gs, ties, min(pool, max(256, 16 * len(gs))), near_share, two_hop_share, power) if len(gs[a]) + len(gs[b]) <= most_dims]
            cost.need([(g, score_bits) for g in gs] + [(gs[a] + gs[b], score_bits) for a, b in pairs])
            rise = {(a, b): cost(gs[a] + gs[b], score_bits) - cost(gs[a], score_bits) - cost(gs[b], score_bits) for a, b in pairs}
            used, kept = [0] * len(gs), []
            for a, b in sorted(pairs, key=lambda e: (rise[e], e)):
                if used[a] < quota and used[b] < quota:
                    used[a] += 1
                    used[b] += 1
                    kept.append((a, b))
                    if len(kept) == shortlist:
                        break
            top = lambda a, b: min(ctx.most, bits[a] + bits[b])
            cost.need((gs[a] + gs[b], top(a, b)) for a, b in kept)
            gain = {(a, b): cost(gs[a] + gs[b], top(a, b)) - cost(gs[a], bits[a]) - cost(gs[b], bits[b]) for a, b in kept}
            for a, b in sorted((e for e in kept if gain[e] <= tolerance), key=lambda e: (gain[e], e))[:children]:
                child = order([g for i, g in enumerate(gs) if i not in (a, b)] + [gs[a] + gs[b]])
                found.setdefault(canonical(child), child)
        if not found:
            return best[1], best[2], best[0]
        cost.need((g, b) for gs in found.values() for g in gs for b in range(min(ctx.most, ctx.total) + 1))
        solved = []
        for key, gs in found.items():
            bits, j = ctx.solve(gs)
            solved.append((j, key, gs, bits))
        solved.sort(key=lambda s: s[:2])
        beam = [(j, gs, bits) for j, _, gs, bits in solved[:width]]
        if beam[0][0] >= best[0] - 1e-12:
            return best[1], best[2], best[0]
        best = beam[0]


def marginal_beam(ctx: Context, groups: Groups, rounds: int = 1000, patience: int = 30, width: int = 4, shortlist: int = 24, evaluate: int = 6, ends: int = 10, dims: int = 10, alpha: float = 1.0, moves: int = 128, swaps: int = 48, weight: float = 1.0, window: int = 5) -> tuple[Groups, list[int], float]:
    """Moves single places (and swaps pairs) from groups where bits gain little to groups where they gain much."""
    cost, rng = ctx.cost, ctx.rng
    bits, j = ctx.solve(groups)
    beam = [(j, canonical(groups), [list(g) for g in groups], bits)]
    best, since = beam[0], 0
    seen: deque[dict] = deque(maxlen=window)
    for _ in range(rounds):
        now: dict = {}
        made = {}
        for j, _, gs, bits in beam:
            top = min(ctx.most, ctx.total)
            rows = [[cost(g, b) for b in range(top + 1)] for g in gs]
            gain, loss = map(np.array, zip(*marginal(rows, bits)))
            donors = np.argsort(-(np.array(bits) / (gain + 1e-12)), kind="stable")[:ends].tolist()
            takers = np.argsort(-gain, kind="stable")[:ends].tolist()
            offers = []
            for a in donors:
                if len(gs[a]) < 2:
                    continue
                short = gs[a] if len(gs[a]) <= dims else sorted(rng.choice(gs[a], dims, replace=False).tolist())
                cost.need(([i for i in gs[a] if i != v], bits[a]) for v in short)
                harm = np.array([cost([i for i in gs[a] if i != v], bits[a]) for v in short])
                harm = rows[a][bits[a]] - harm
                p = (harm - harm.min() + 1e-12) ** alpha
                offers.append((a, short, p / p.sum()))
            tried = set()
            for _ in range(moves if offers else 0):
                a, short, p = offers[int(rng.integers(len(offers)))]
                b = takers[int(rng.integers(len(takers)))]
                if a != b:
                    tried.add((a, b, int(rng.choice(short, p=p)), None))
            for _ in range(swaps if offers and len(offers) > 1 else 0):
                x, y = rng.choice(len(offers), 2, replace=False)
                (a, sa, pa), (b, sb, pb) = offers[int(x)], offers[int(y)]
                tried.add((a, b, int(rng.choice(sa, p=pa)), int(rng.choice(sb, p=pb))))
            changed = {}
            for a, b, v, u in sorted(tried, key=str):
                changed[a, b, v, u] = ([i for i in gs[a] if i != v] + ([u] if u is not None else []), [i for i in gs[b] if i != u] + [v])
            cost.need(k for (a, b, _, _), (ga, gb) in changed.items() for k in ((ga, bits[a]), (gb, bits[b]), (ga, max(bits[a] - 1, 0)), (gb, min(bits[b] + 1, top))))
            scored = []
            for key, (ga, gb) in changed.items():
                a, b, _, u = key
                delta = cost(ga, bits[a]) + cost(gb, bits[b]) - rows[a][bits[a]] - rows[b][bits[b]]
                if u is None:
                    taken = cost(gb, bits[b]) - cost(gb, min(bits[b] + 1, top))
                    given = cost(ga, bits[a] - 1) - cost(ga, bits[a]) if bits[a] else float("inf")
                    delta -= weight * max(0.0, taken - given)
                scored.append((delta, str(key), key))
            done = 0
            for _, _, key in sorted(scored)[:shortlist]:
                if done == evaluate:
                    break
                a, b, _, _ = key
                child = [sorted(g) for g in gs]
                child[a], child[b] = map(sorted, changed[key])
                name = canonical(child)
                old = min((s[name] for s in seen if name in s), default=None)
                if name in made or name in now or old is not None and old <= j:
                    continue
                cbits, cj = ctx.solve(child)
                made[name] = (cj, name, child, cbits)
                now[name] = cj
                done += 1
        seen.append(now)
        every = {s[1]: s for s in [*beam, *made.values()]}
        beam = sorted(every.values(), key=lambda s: s[:2])[:width]
        if beam[0][0] < best[0] - 1e-12:
            best, since = beam[0], 0
        else:
            since += 1
            if since >= patience or not made:
                break
    return best[2], best[3], best[0]


STAGES = ("grow", "merge", "moves")


def parse_stages(text: str) -> tuple[str, ...]:
    """Names joined by commas or +, in their order; ``full`` for all, ``none`` for none."""
    words = re.findall(r"[a-z]+", text.lower())
    if words in (["full"], ["all"]):
        return STAGES
    if words == ["none"]:
        return ()
    if unknown := set(words) - set(STAGES):
        raise ValueError(f"no such stage: {', '.join(sorted(unknown))}")
    return tuple(s for s in STAGES if s in words)


def find(df: DataFrame, total: int, stages: tuple[str, ...] = STAGES, most_bits: int = 12, seed: int = 123, rows: int = 20_480, options: dict | None = None, id_col: str = "vec_id", vector: str = "embedding", **cost) -> Structure:
    """A structure for the vectors: without ``grow`` it starts from even groups; without any stage it is
    these with the best bits."""
    x = training_rows(df, rows, seed, id_col, vector)
    ctx = Context(x, total, most_bits, seed, spark=df.sparkSession, **cost)
    options = options or {}
    groups = grow(ctx, **options.get("grow", {})) if "grow" in stages else even_groups(ctx.d, total)[0]
    bits, j = ctx.solve(groups)
    if "merge" in stages:
        groups, bits, j = merge_beam(ctx, groups, **options.get("merge", {}))
    if "moves" in stages:
        groups, bits, j = marginal_beam(ctx, groups, **options.get("moves", {}))
    return Structure(ctx.d, total, [list(map(int, g)) for g in groups], bits, {"stages": list(stages), "cost": j}).check(most_bits)


def singleton_groups(ctx: Context) -> tuple[Groups, list[int]]:
    """Each place a group, with the best bits."""
    groups = [[i] for i in range(ctx.d)]
    return groups, ctx.solve(groups)[0]


def group_stats(name: str, space: str, groups: Groups, nbits: list[int], cost) -> list[tuple]:
    """(quantizer, space, group_id, ndims, bits, cost) of each group, and a last row (group_id None) of the whole."""
    rows = [(name, space, g, len(dims), int(b), float(cost(dims, b))) for g, (dims, b) in enumerate(zip(groups, nbits))]
    return rows + [(name, space, None, sum(len(g) for g in groups), int(sum(nbits)), sum(r[-1] for r in rows))]
