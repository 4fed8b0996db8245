"""Dense kernels in NumPy that Spark has no expression for."""

from __future__ import annotations

import math

import numpy as np


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column assigned to each row of a square or wide matrix at the least total cost."""
    return assignment(cost)[0]


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column assigned to each row at the least total cost, and the columns' potentials, which prove it.

    Shortest augmenting paths with dual potentials, one row at a time.
    """
    n, m = cost.shape
    row_pot, col_pot = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            done[at] = True
            slack = cost[owner[at] - 1] - row_pot[owner[at]] - col_pot[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            step = np.where(done[1:], np.inf, least[1:])
            to = int(step.argmin()) + 1
            row_pot[owner[done]] += step[to - 1]
            col_pot[done] -= step[to - 1]
            least[~done] -= step[to - 1]
            at = to
        while at:
            owner[at], at = owner[back[at]], back[at]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out, col_pot[1:]


def _ways(cost: np.ndarray, match: np.ndarray, room: float) -> np.ndarray:
    """The shortest way from each column to each other by changes of a row's column, each change made cheaper by ``room``; below zero on the diagonal if some exchange of columns then pays."""
    way = np.empty_like(cost)
    way[match] = cost - cost[np.arange(len(cost)), match][:, None] - room
    way[np.arange(len(way)), np.arange(len(way))] += room
    for k in range(len(way)):
        way = np.minimum(way, way[:, k : k + 1] + way[k])
    return way


def central_potentials(cost: np.ndarray, match: np.ndarray) -> np.ndarray:
    """Column potentials that prove an optimal assignment of a square matrix with room to spare: the mean of the shortest ways from each column."""
    return _ways(cost, match, 0.0).mean(0)


def even_potentials(cost: np.ndarray, match: np.ndarray) -> np.ndarray:
    """As ``central_potentials``, and nearly as far from each other choice of a row as potentials can be from all of them."""
    least, most = 0.0, 2 * float(np.ptp(cost))
    for _ in range(40):
        room = (least + most) / 2
        least, most = (least, room) if (_ways(cost, match, room).diagonal() < 0).any() else (room, most)
    return _ways(cost, match, 0.98 * least).mean(0)


def mended(costs: np.ndarray, potential: np.ndarray, match: np.ndarray) -> np.ndarray:
    """Optimal assignments of square matrices ``[matrix, row, column]`` that are near to one with these potentials and this assignment.

    Rows whose column is still the cheapest keep it, if no other claims it; the
    others get shortest augmenting paths, a step of all matrices at a time.
    """
    many, k, _ = costs.shape
    cols = np.tile(potential, (many, 1))
    reduced = costs - cols[:, None]
    rows = reduced.min(2)
    column = np.where(reduced.argmin(2) == match, match, -1)  # of each row
    owner = np.full((many, k), -1)  # of each column
    m, i = np.nonzero(column >= 0)
    owner[m, column[m, i]] = i
    while len(open_ := np.flatnonzero((column < 0).any(1))):
        start = (column[open_] < 0).argmax(1)
        here, reach = start.copy(), np.zeros(len(open_))
        least, back, done, sink = np.full((len(open_), k), np.inf), np.zeros((len(open_), k), int), np.zeros((len(open_), k), bool), np.full(len(open_), -1)
        while len(go := np.flatnonzero(sink < 0)):
            at, row = open_[go], here[go]
            way = reach[go, None] + costs[at, row] - rows[at, row][:, None] - cols[at]
            better = ~done[go] & (way < least[go])
            least[go] = np.where(better, way, least[go])
            back[go] = np.where(better, row[:, None], back[go])
            to = np.where(done[go], np.inf, least[go]).argmin(1)
            reach[go], done[go, to] = least[go, to], True
            held = owner[at, to]
            sink[go] = np.where(held < 0, to, -1)
            here[go] = np.where(held < 0, row, held)
        shift = np.where(done, reach[:, None] - least, 0)
        cols[open_] -= shift
        rows[open_, start] += reach
        x, j = np.nonzero(done & (owner[open_] >= 0))
        rows[open_[x], owner[open_[x], j]] += shift[x, j]
        for x, m in enumerate(open_.tolist()):
            j = int(sink[x])
            while True:
                i = int(back[x, j])
                owner[m, j] = i
                j, column[m, i] = int(column[m, i]), j
                if i == start[x]:
                    break
    return column


def symmetric_eigen(a: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Top eigenpairs in descending order; each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(sign == 0, 1, sign)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(1 - x, b, a) / b
    return front * _fraction(x, a, b) / a


def _fraction(x: float, a: float, b: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d or tiny), c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def correlation_p(r: float, n: int) -> float:
    """Two-sided p value of a Pearson correlation, from the t distribution."""
    if n < 3 or not math.isfinite(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    return beta_cdf(1 - r * r, (n - 2) / 2, 0.5)


def sym_nmf(s: np.ndarray, rank: int, *, seed: int, rho: float = 0.3, outer: int = 200, inner: int = 1, tol: float = 1e-6, low: float = -np.inf, high: float = np.inf, root_start: bool = True) -> tuple[np.ndarray, int]:
    """Non-negative W with W W^T near to the finite entries of ``s``; and the outer steps taken.

    Alternating directions on V = W W^T with V within bounds; W by exact
    coordinate minimisation, each entry a root of a cubic.  Without missing
    entries V is ``s`` itself.
    """
    rng = np.random.default_rng(seed)
    n, seen = len(s), np.isfinite(s)
    data = np.where(seen, s, 0.0)
    mean = data[seen].mean() if seen.any() else 0.0
    w = rng.random((n, rank)) * (math.sqrt(max(mean, 1e-12) / rank) if root_start else 1.0)
    whole = bool(seen.all())
    v, dual, last = data.copy(), np.zeros_like(data), np.inf
    for step in range(1, outer + 1):
        target = v + dual / rho if not whole else data
        for _ in range(inner):
            _sweep(w, target)
        product = w @ w.T
        if not whole:
            v = np.clip((data + rho * product - dual) / (seen + rho), low, high)
            dual += rho * (v - product)
        loss = float(np.square((data - product)[seen]).sum())
        if tol and abs(last - loss) <= tol * max(last, 1e-12) and step > 1:
            return w, step
        last = loss
    return w, outer


def _sweep(w: np.ndarray, target: np.ndarray) -> None:
    """One pass of coordinate minimisation of |T - W W^T| over W >= 0, row by row.

    With the other entries fixed, the objective in x = w[i, r] is, up to a
    factor, x^4/4 + p x^2/2 + q x; its minimum is a root of x^3 + p x + q.
    """
    for i in range(len(w)):
        row = w[i].copy()
        w[i] = 0.0
        gram = w.T @ w  # of the other rows
        pull = target[i] @ w
        for r in range(len(row)):
            x = row[r]
            rest = row @ row - x * x
            row[r] = 0.0
            p = gram[r, r] - target[i, i] + rest
            q = float(gram[r] @ row) - pull[r]
            row[r] = _cubic_root(p, q)
        w[i] = row


def _cubic_root(p: float, q: float) -> float:
    """Non-negative x that minimises x^4/4 + p x^2/2 + q x."""
    half, disc = q / 2, q * q / 4 + p * p * p / 27
    if disc >= 0:
        root = math.sqrt(disc)
        return max(0.0, math.cbrt(-half + root) + math.cbrt(-half - root))
    size = 2 * math.sqrt(-p / 3)
    x = size * math.cos(math.acos(max(-1.0, min(1.0, -half / math.sqrt(-p * p * p / 27)))) / 3)
    return x if x > 0 and x**3 / 4 + p * x / 2 + q < 0 else 0.0
