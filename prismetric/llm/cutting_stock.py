"""Column generation for the cutting-stock problem: how many sequences of which pattern of lengths."""

from __future__ import annotations

import numpy as np


def length_classes(capacity: int, fine: int = 16) -> np.ndarray:
    """Upper ends of length classes up to capacity - 1: each length up to ``fine``, then ``fine`` classes an octave."""
    ends, width, at = [], 1, 0
    while at < capacity - 1:
        for _ in range(fine):
            at += width
            if at >= capacity - 1:
                break
            ends.append(at)
        if at >= 2 * fine * width - 1 or at >= 2 * fine:
            width = max(1, at // fine)
    return np.array([*ends, capacity - 1])


def knapsack(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how often each weight is taken within the capacity. By dynamic programming over
    capacities; only positive values are taken."""
    use = np.flatnonzero(values > 1e-12)
    pattern = np.zeros(len(weights), np.int64)
    if not len(use):
        return 0.0, pattern
    w, v = weights[use], values[use]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(w)
    w, v, use = w[order], v[order], use[order]
    fit = np.searchsorted(w, np.arange(capacity + 1), side="right")
    for c in range(w[0], capacity + 1):
        n = fit[c]
        gain = best[c - w[:n]] + v[:n]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], pick[c] = gain[k], k
        else:
            best[c], pick[c] = best[c - 1], -1
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[use[pick[c]]] += 1
            c -= w[pick[c]]
    return float(best[capacity]), pattern


def solve(weights: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.002, rounds: int = 3000, smooth: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, number of sequences of each) of the linear program: fewest sequences that hold the demand.

    Revised simplex from patterns of one class each. The dual prices, drawn towards those that gave the best
    bound so far, go to the knapsack, whose pattern enters if it is worth more than a sequence at the prices
    themselves; a negative price lets that class be overfilled. Ends at the optimum, or as soon as the best
    bound is within ``gap`` of the value.
    """
    m = len(weights)
    columns = np.diag(capacity // weights).astype(float)
    cost = np.ones(m)
    inverse = np.diag(1.0 / np.diag(columns))
    amounts = inverse @ demand
    best, bound = np.array(weights / capacity), float(weights @ demand) / capacity
    for _ in range(rounds):
        prices = cost @ inverse
        value = float(cost @ amounts)
        if bound >= (1 - gap) * value:
            break
        low = int(prices.argmin())
        if prices[low] < -1e-9:
            column, price = np.zeros(m), 0.0
            column[low] = -1.0
        else:
            column = None
            for pull in (smooth, 0.0):
                tried = pull * best + (1 - pull) * prices
                worth, pattern = knapsack(weights, tried, capacity)
                if (proved := float(tried @ demand) / max(worth, 1.0)) > bound:
                    best, bound = tried / max(worth, 1.0), proved
                if float(prices @ pattern) > 1 + 1e-9:
                    column, price = pattern.astype(float), 1.0
                    break
            if column is None:
                break
        step = inverse @ column
        ratio = np.where(step > 1e-11, amounts / np.where(step > 1e-11, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out], cost[out], theta = column, price, ratio[out]
        amounts = np.maximum(amounts - theta * step, 0)
        amounts[out] = theta
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    use = cost > 0
    return columns.T[use].round().astype(np.int64), amounts[use]


def classes(lengths: dict[int, int], capacity: int, fine: int = 16, heavy: int = 100) -> dict[int, int]:
    """Each length's class, as the length that items of it count as: the largest that occurs in it. A length that holds
    one of ``heavy`` items or more is a class of its own."""
    total, ends = sum(lengths.values()), length_classes(capacity, fine)
    own = {x: x for x, n in lengths.items() if n * heavy >= total}
    together: dict[int, list[int]] = {}
    for x in lengths.keys() - own.keys():
        together.setdefault(int(np.searchsorted(ends, x)), []).append(x)
    return own | {x: max(found) for found in together.values() for x in found}


def plan(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern as length -> items, number of sequences) for items by length: every item is placed.

    Counts are the linear program's, rounded down; what that leaves (fewer items than the patterns have, however
    many there are in all) goes into patterns made largest first, used as long as they last.
    """
    weights = np.array(sorted(x for x, n in demand.items() if n))
    if not len(weights):
        return []
    left = np.array([demand[w] for w in weights.tolist()])
    patterns, amounts = solve(weights, left.astype(float), capacity)
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        left = left - times * pattern
        out.append(({w: a for w, a in zip(weights.tolist(), pattern.tolist(), strict=True) if a}, times))

    for pattern, x in sorted(zip(patterns.tolist(), amounts, strict=True), key=lambda p: -p[1]):
        pattern = np.array(pattern)
        some = pattern > 0
        times = min(int(x + 1e-6), int((left[some] // pattern[some]).min()))  # less where a class is overfilled
        if times > 0:
            use(pattern, times)
    while left.any():
        room, pattern = capacity, np.zeros(len(left), np.int64)
        for k in np.flatnonzero(left)[::-1]:
            pattern[k] = min(left[k], room // weights[k])
            room -= pattern[k] * weights[k]
        some = pattern > 0
        use(pattern, int((left[some] // pattern[some]).min()))
    return out


def wasteful(patterns: list[tuple[dict[int, int], int]], capacity: int, slack: int, supply: int) -> set[int]:
    """Places of the patterns to give up, the emptiest first, so that what is left free (``slack`` within classes, and
    what the patterns leave) can be filled by what may be cut: ``supply``, and the items of patterns given up."""
    used = [sum(w * a for w, a in p.items()) for p, _ in patterns]
    free, gone = slack + sum(t * (capacity - u) for (_, t), u in zip(patterns, used, strict=True)), set()
    for k in sorted(range(len(patterns)), key=lambda k: used[k]):
        if free <= 0.9 * supply:
            break
        times = patterns[k][1]
        free -= times * (capacity - used[k])
        supply += times * used[k]
        gone.add(k)
    return gone
