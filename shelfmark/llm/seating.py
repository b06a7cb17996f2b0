"""Chinese-restaurant seating of many dishes at once: Gibbs moves of single customers, and whole dishes drawn from their odds.

A dish of a restaurant has `c` customers at tables of its own. One that is taken out comes back to a table of n others with
weight n - d, or to a new table with weight (strength + d * tables of the restaurant) * probability of the dish in the
parent. Restaurants of one level are shared out to many tasks, so the number of a restaurant's tables and the parent's
probabilities are those of the round before. A sweep moves every customer of a dish of at most SEATED once. What endless
sweeps lead to is known: t tables with odds weight**t times a generalised Stirling number of c and t. Dishes of more than
SEATED customers keep no seats, as all their customers are moved at once by drawing t from these odds: by the numbers'
recursion up to EXACT customers, by their contour integral above. `drawn` moves dishes of any size in this way, and needs no
seats of the sweep before.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

SEATED = 16
EXACT = 1_024
CELLS = 1 << 20  # odds held at once
FAINT = 25.0  # odds of less than exp(-FAINT) of the largest end a range
NODES, FINE = ((np.arange(n) + 0.5) * (5 / n) for n in (64, 256))


@lru_cache(4)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: of c customers (row) at t tables (column), seats weighted by n - d."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, most):
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - d * np.arange(1, c + 1))
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


def _saddle(c: int, t: float, d: float) -> tuple[float, float]:
    """Where exp(p) * (1 - (1 - exp(-p / c))**d)**t is least on the real axis, and how sharply it falls off across."""

    def slope(p: float) -> float:
        x = -math.expm1(-p / c)
        rest = -math.expm1(d * math.log(x))
        return 1 - t * d * x ** (d - 1) * math.exp(-p / c) / (rest * c) if rest else 1 - t / c

    low, high = -30.0, math.log(30.0 * c)
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(math.exp(middle)) < 0 else (low, middle)
    p = max(math.exp(high), 2.0)  # no nearer to the branch point
    return p, max((slope(p * 1.001) - slope(p * 0.999)) / (0.002 * p), 1e-300)


def log_odds(c: int, weight: float, d: float, t: np.ndarray, middle: float) -> np.ndarray:
    """Logarithms of the odds of t tables, up to a constant, by the integral of [z**c] ((1 - (1 - z)**d) * weight / d)**t / t!.

    z = exp(-p / c) runs around 0 inside the cut from 1 on; p passes the saddle of `middle` tables on a parabola or a line.
    """
    p, sharp = _saddle(c, min(middle, c - 0.25), d)
    if p > c / 20 and sharp * c * c < 100:  # t is nearly c: the whole circle counts, in equal steps
        at = p + 1j * math.pi * c * (np.arange(len(FINE)) + 0.5) / len(FINE)
        step = np.full(len(at), 1j * c)
    elif p > c / 20:  # t is no small share of c: once around, on a circle within the cut
        wide = 3 / math.sqrt(sharp)
        at, step = p + 1j * wide * np.sinh(FINE), 1j * wide * np.cosh(FINE)
    else:
        wide = min(0.5, 1.5 / (p * math.sqrt(sharp)))
        y = wide * np.sinh(NODES)
        at, step = p * (1 + 1j * y) ** 2, 2j * p * (1 + 1j * y) * wide * np.cosh(NODES)
    held = (at.real - p > -60) & (np.abs(at.imag) < math.pi * c)
    at, step = at[held], step[held]
    logs = np.log1p(-((-np.expm1(-at / c)) ** d))
    base = math.log1p(-((-math.expm1(-p / c)) ** d))
    out = []
    for some in np.array_split(t, max(1, len(t) * len(at) // CELLS)):
        if -base * some[-1] < 0.5:  # the integral of exp(p) alone is 0
            parts, scale = np.expm1(some[:, None] * logs), 0.0
        else:
            parts, scale = np.exp(some[:, None] * (logs - base)), base
        parts *= np.exp(at - p) * step
        values = parts.sum(axis=1).imag
        values[values < 1e-13 * np.abs(parts).sum(axis=1)] = 0  # rounding, far from `middle`
        with np.errstate(divide="ignore"):
            out.append(some * scale + np.log(values))
    factorial = np.cumsum(np.log(t)) - math.log(t[0])
    return np.concatenate(out) + (t - t[0]) * math.log(weight / d) - factorial


def _typical(c: int, weight: float, d: float) -> tuple[float, float]:
    """Mean and spread that the number of tables has where c is large.

    Tables are a Poisson number of sizes with weights d * (1 - d) ... (n - 1 - d) / n! * z**n, given that they sum up to c; z is
    where they do so on average: weight * z * (1 - z)**(d - 1) = c. log_odds is only good around this mean, where its contour
    passes; elsewhere rounding outweighs the odds.
    """
    want, low, high = math.log(c) - math.log(weight), -80.0, math.log(1e3 / (1 - d))
    for _ in range(80):  # of s = -log(1 - z)
        middle = (low + high) / 2
        s = math.exp(middle)
        low, high = (middle, high) if math.log(-math.expm1(-s)) + (1 - d) * s < want else (low, middle)
    z, rest = -math.expm1(-s), math.exp(-s)
    mean = -math.expm1(-d * s) * weight / d
    return min(max(mean, 1.0), float(c)), math.sqrt(max(mean - c * rest / (rest + z * (1 - d)), 0.0))


def _large(c: int, weight: float, d: float, rng: np.random.Generator) -> int:
    """Tables of one dish, from the odds of all numbers of tables that count: a range around their mean, widened until it ends in faint odds."""
    middle, spread = _typical(c, weight, d)
    reach = 8 * spread + 16
    while True:
        t = np.arange(max(1, int(middle - reach)), min(c, int(middle + reach)) + 1)
        log = log_odds(c, weight, d, t, middle)
        best = int(np.argmax(log))
        if (t[0] == 1 or log[0] < log[best] - FAINT) and (t[-1] == c or log[-1] < log[best] - FAINT):
            break
        reach *= 2
    odds = np.cumsum(np.exp(log - log[best]))
    return int(t[min(np.searchsorted(odds, rng.random() * odds[-1], side="right"), len(t) - 1)])


def _few(n: int, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of n customers each, few enough for the odds themselves: one number of tables after another."""
    odds = np.exp(stirling(d, SEATED)[n, 1 : n + 1])
    total = np.full(len(weight), odds[-1])
    for x in odds[-2::-1]:
        total *= weight
        total += x
    u = rng.random(len(weight)) * total
    out, power, below = np.ones(len(weight), np.int64), np.ones(len(weight)), np.full(len(weight), odds[0])
    for x in odds[1:]:
        out += below <= u
        power *= weight
        below += x * power
    return out


def drawn(c: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn from their odds given the weight: all of its customers are moved at once."""
    out = (c > 0).astype(np.int64)
    several = np.flatnonzero(c > 1)
    short = np.minimum(c[several], 0xFFFF).astype(np.uint16)  # short numbers sort faster; longer ones are sorted among themselves
    order = np.argsort(short, kind="stable")
    tail = order[int(np.searchsorted(short[order], 0xFFFF)) :]
    tail[:] = tail[np.argsort(c[several[tail]], kind="stable")]
    order = several[order]
    sizes, first = np.unique(c[order], return_index=True)
    for n, a, b in zip(sizes.tolist(), first, [*first[1:], len(order)]):
        rows = order[a:b]
        if n <= SEATED and 1e-15 < weight[rows].min() and weight[rows].max() < 1e15:  # no power is too small or too large
            out[rows] = _few(n, weight[rows], d, rng)
            continue
        if n > EXACT:
            out[rows] = [_large(n, w, d, rng) for w in weight[rows].tolist()]
            continue
        t, log = np.arange(1, n + 1), stirling(d)[n, 1 : n + 1]
        for some in np.array_split(rows, -(-len(rows) * n // CELLS)):
            odds = log + np.log(weight[some])[:, None] * t
            odds = np.cumsum(np.exp(odds - odds.max(axis=1, keepdims=True)), axis=1)
            out[some] = np.minimum(1 + (odds <= (rng.random(len(some)) * odds[:, -1])[:, None]).sum(axis=1), n)
    return out


def _begun(c: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Seats (customer by customer, dish by dish): the first t of a dish open tables, each later one joins an earlier customer."""
    first = np.cumsum(c) - c
    within = np.arange(int(c.sum())) - np.repeat(first, c)
    to = (rng.random(len(within)) * within).astype(np.int64)
    opens = within < np.repeat(t, c)
    to[opens] = within[opens]
    base = np.repeat(first, c)
    while True:  # customers follow customers until one that opened a table
        further = to[base + to]
        if np.array_equal(further, to):
            return to
        to = further


def seats_of(c: np.ndarray, t: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Seats from the sizes of the tables of each dish."""
    first = np.cumsum(t) - t
    within = np.arange(len(sizes)) - np.repeat(first, t)
    return np.repeat(within, sizes)


def seated(c: np.ndarray, weight: np.ndarray, discount: float, state: tuple[np.ndarray, np.ndarray] | None, rng: np.random.Generator) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Tables of each dish after a sweep, and the state: tables and their sizes of the dishes that keep seats, in order.

    weight: (strength + d * tables) * parent's probability, per dish; state: of the sweep before, or None at the start.
    """
    tables = (c > 0).astype(np.int64)
    many = np.flatnonzero(c > SEATED)
    tables[many] = drawn(c[many], weight[many], discount, rng)
    own = np.flatnonzero((c > 1) & (c <= SEATED))
    n, a = c[own].astype(np.int64), weight[own]
    if state is None:
        t = drawn(n, a, discount, rng)
        seat = _begun(n, t, rng)
    else:
        t = state[0].astype(np.int64)
        seat = seats_of(n, t, state[1].astype(np.int64))
    first = np.cumsum(n) - n
    base = np.repeat(first, n)
    size = np.bincount(base + seat, minlength=len(seat)) if len(seat) else np.zeros(0, np.int64)
    # free numbers of tables of a dish, as a stack from its first place on
    free_at = np.flatnonzero(size == 0)
    dish = np.searchsorted(first, free_at, side="right") - 1
    free = np.cumsum(np.ones(len(free_at), np.int64)) - 1 - (np.searchsorted(dish, dish) if len(dish) else 0)
    stack = np.zeros(len(seat), np.int64)
    stack[first[dish] + free] = free_at - first[dish]
    order = np.argsort(-n, kind="stable")
    for move in range(SEATED):  # the customer of that number, of every dish that has one
        rows = order[: int(np.searchsorted(-n[order], -move, side="left"))]  # dishes of more than `move` customers
        if not len(rows):
            break
        f, m = first[rows], n[rows]
        i = move
        old = seat[f + i]
        size[f + old] -= 1
        gone = size[f + old] == 0
        stack[(f + m - t[rows])[gone]] = old[gone]
        t[rows] -= gone
        now = t[rows]
        new = rng.random(len(rows)) * (a[rows] + (m - 1) - discount * now) < a[rows]
        to = np.empty(len(rows), np.int64)
        top = f + m - now - 1
        to[new] = stack[top[new]]
        t[rows[new]] += 1
        left = np.flatnonzero(~new)
        while len(left):  # another customer's table, taken with (n - d) / n
            j = (rng.random(len(left)) * (m[left] - 1)).astype(np.int64)
            j += j >= i
            at = seat[f[left] + j]
            held = size[f[left] + at]
            sure = rng.random(len(left)) * held < held - discount
            to[left[sure]] = at[sure]
            left = left[~sure]
        seat[f + i] = to
        size[f + to] += 1
    tables[own] = t
    return tables, (t.astype(np.uint32), size[size > 0].astype(np.uint32))
