"""Bit budgets over groups."""

from __future__ import annotations

import numpy as np


def dp_bits(costs: list[list[float]], total: int, least: int = 0) -> tuple[list[int], float]:
    """Bits for each group, from ``least`` to its number of costs - 1, that sum to the total and cost least.
    Of equal sums the later group takes more bits. costs[g][b]."""
    m = len(costs)
    best = np.full((m + 1, total + 1), np.inf)
    best[0, 0] = 0.0
    pick = np.zeros((m + 1, total + 1), np.int64)
    for g, row in enumerate(costs, 1):
        for b in range(least, min(len(row) - 1, total) + 1):
            with_b = np.full(total + 1, np.inf)
            with_b[b:] = best[g - 1, : total + 1 - b] + row[b]
            better = (with_b <= best[g]) & np.isfinite(with_b)
            best[g, better] = with_b[better]
            pick[g, better] = b
    if not np.isfinite(best[m, total]):
        raise ValueError("the groups can't hold the budget")
    bits, t = [0] * m, total
    for g in range(m, 0, -1):
        bits[g - 1] = int(pick[g, t])
        t -= bits[g - 1]
    return bits, float(best[m, total])


def greedy_from_table(costs: list[list[float]], total: int) -> list[int]:
    """One bit at a time to the group whose cost it lowers most, the first of equals."""
    bits = [0] * len(costs)
    for _ in range(total):
        gains = [(costs[g][b + 1] - costs[g][b], g) for g, b in enumerate(bits) if b + 1 < len(costs[g])]
        if not gains:
            raise ValueError("the groups can't hold the budget")
        bits[min(gains)[1]] += 1
    return bits


def marginal(costs: list[list[float]], bits: list[int]) -> list[tuple[float, float]]:
    """For each group what one more bit gains (0 at its most) and one fewer loses (infinite at none)."""
    return [(row[b] - row[b + 1] if b + 1 < len(row) else 0.0, row[b - 1] - row[b] if b else float("inf")) for row, b in zip(costs, bits)]
