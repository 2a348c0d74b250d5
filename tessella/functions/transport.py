"""Transport problems on small dense costs: earth mover's distance by two solvers, and assignment.

Both distances are partial: the smaller total weight is moved, and the cost is divided by it. ``emd`` augments along
shortest paths (successive shortest paths with potentials); ``myemd`` starts from Vogel's approximation on the problem
balanced by a free dummy and improves it by stepping stones with multipliers (MODI). The optimum is the same.
"""

from __future__ import annotations

import numpy as np

#: The value that stands for objects that aren't compared (fixed value), and the number of regions above which that is so; none by default.
UNCOMPARED = 1e20
MOST_REGIONS: int | None = None
_EPS = 1e-12
#: Totals that differ by at most this share are equal but for rounding.
BALANCE = 1e-9
#: Rounds of the dual bound, and softness of its minima in the first and the last one as shares of the mean cost.
DUAL_ROUNDS, SOFTNESS = 10, (0.3, 0.02)
#: The same for the few pairs that are left before they are solved.
LAST_ROUNDS, LAST_SOFTNESS = 40, (0.3, 0.005)


def emd(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray, most_regions: int | None = MOST_REGIONS) -> float:
    """Least cost of moving min(total supply, total demand), divided by it; 0 if nothing is to be moved."""
    if most_regions is not None and max(len(supply), len(demand)) > most_regions:
        return UNCOMPARED
    total = float(min(supply.sum(), demand.sum()))
    if total <= 0:
        return 0.0
    n, m = cost.shape
    low = min(float(cost.min()), 0.0)  # the same amount is moved in any case, so costs are taken from the least one if that is negative
    c = (cost - low).tolist()  # on lists: some ten regions a set are too few for array operations
    left, room = supply.astype(float).tolist(), demand.astype(float).tolist()
    flow: list[dict[int, float]] = [{} for _ in range(m)]
    pot_s, pot_d = [0.0] * n, [0.0] * m
    moved, value = 0.0, 0.0
    while moved < total - 1e-9 * total - _EPS:
        # Dijkstra with reduced costs up to the nearest sink with room; arcs with flow cost nothing on the way back
        dist_s, dist_d = [np.inf] * n, [np.inf] * m
        from_s, from_d = [-1] * n, [-1] * m
        opened = list(range(m))
        reached, reach, end = [i for i in range(n) if left[i] > _EPS], 0.0, -1
        while True:
            for i in reached:
                dist_s[i], row, base = reach, c[i], reach + pot_s[i]
                for j in opened:
                    through = max(base + row[j] - pot_d[j], reach)
                    if through < dist_d[j] - _EPS:
                        dist_d[j], from_d[j] = through, i
            j = min(opened, key=dist_d.__getitem__, default=-1)
            if j < 0 or not dist_d[j] < np.inf:
                break
            reach = dist_d[j]
            if room[j] > _EPS:
                end = j
                break
            opened.remove(j)
            reached = [i for i, x in flow[j].items() if x > _EPS and dist_s[i] == np.inf]
            for i in reached:
                from_s[i] = j
        if end < 0:
            break
        path, j = [], end
        while True:
            i = from_d[j]
            path.append((i, j, 1))
            if from_s[i] < 0:
                break
            j = from_s[i]
            path.append((i, j, -1))
        start = path[-1][0]
        step = min(left[start], room[end], total - moved, *[flow[b][a] for a, b, s in path if s < 0])
        for a, b, s in path:
            flow[b][a] = flow[b].get(a, 0.0) + s * step
            value += s * step * (c[a][b] + low)
        left[start] -= step
        room[end] -= step
        moved += step
        pot_s = [p + min(d, reach) for p, d in zip(pot_s, dist_s, strict=True)]
        pot_d = [p + min(d, reach) for p, d in zip(pot_d, dist_d, strict=True)]
    return float(max(value, 0.0) / total)


def _cheapest(cost: np.ndarray, amount: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """For each row the mean cost of moving ``moved`` by the cheapest of its cells, each of which takes an amount at most."""
    order = np.argsort(cost, axis=1)
    cost, amount = np.take_along_axis(cost, order, axis=1), np.take_along_axis(amount, order, axis=1)
    taken = np.clip(moved[:, None] - (np.cumsum(amount, axis=1) - amount), 0, amount)
    return (np.where(taken > 0, cost, 0) * taken).sum(axis=1) / moved


def relaxed(supply: np.ndarray, demand: np.ndarray, near: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Lower bounds of emd for one supply (n) and many demands (many, m), from the least costs of each region: near (many, n) and back (many, m).

    One side's limits are left out, so that each region sends what it has to its nearest one; the larger of both sides'
    costs. Totals that differ by rounding alone count as equal, less what the difference may cost.
    """
    total, totals = supply.sum(), demand.sum(axis=1)
    moved = np.minimum(total, totals)
    out = np.zeros(len(demand))
    rest = np.abs(totals - total)
    same = (moved > 0) & (rest <= BALANCE * moved)
    some = slice(None) if same.all() else np.flatnonzero(same)
    if same.any():
        x, y, b = near[some], back[some], demand[some]
        sent, got = x @ supply - rest[some] * np.abs(x).max(axis=1), (y * b).sum(axis=1) - rest[some] * np.where(b > 0, np.abs(y), 0).max(axis=1)
        out[some] = np.maximum(sent, got) / moved[some]
    some = np.flatnonzero((moved > 0) & ~same)
    if len(some):
        out[some] = np.maximum(_cheapest(near[some], np.broadcast_to(supply, near[some].shape), moved[some]), _cheapest(back[some], demand[some], moved[some]))
    return out


def _balanced(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """supply (n, 1, many), demand (1, m, many) and costs (n, m, many) of the same problems with a free region that takes what one side has more, unless that is by rounding alone; and what is then left over."""
    rest = demand.sum(axis=0) - supply.sum()
    a = supply[:, None, None]
    if (np.abs(rest) <= BALANCE * supply.sum()).all():
        return a, demand[None], cost, np.abs(rest)
    a, b = np.concatenate((np.broadcast_to(a, (len(supply), 1, len(rest))), np.maximum(rest, 0)[None, None])), np.concatenate((demand, np.maximum(-rest, 0)[None]))
    return a, b[None], np.pad(cost, ((0, 1), (0, 1), (0, 0))), np.zeros(len(rest))


def _least(values: np.ndarray, there: np.ndarray, axis: int) -> np.ndarray:
    return (values if there.all() else np.where(there, values, np.inf)).min(axis=axis, keepdims=True)


def _worth(a: np.ndarray, b: np.ndarray, c: np.ndarray, u: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What the best prices are worth that keep all costs' limits, from prices u of the supply."""
    v = np.where(b > 0, _least(c - u, a > 0, 0), 0)
    u = np.where(a > 0, _least(c - v, b > 0, 1), 0)
    return (a * u).sum(axis=(0, 1)) + (b * v).sum(axis=(0, 1)) - rest * np.maximum(np.abs(u).max(axis=(0, 1)), np.abs(v).max(axis=(0, 1)))


def dual(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray, rounds: int = DUAL_ROUNDS, softness: tuple[float, float] = SOFTNESS) -> np.ndarray:
    """Lower bounds of emd for one supply (n) and many demands (many, m) with costs (many, n, m), a few per cent below it.

    Prices of regions come from soft minima over the costs, which get harder each round (Sinkhorn's iteration in logs); at
    the end hard minima make them keep all costs' limits, and by duality what such prices are worth is a lower bound, so
    the rounds may be in single precision. Without rounds the prices are each region's least cost. The problems lie side
    by side on the last axis, so that all minima and sums run over whole rows.
    """
    moved = np.minimum(supply.sum(), demand.sum(axis=1))
    some = np.flatnonzero(moved > 0)
    out = np.zeros(len(demand))
    if not len(some):
        return out
    at = slice(None) if len(some) == len(out) else some
    a, b, c, rest = _balanced(supply, np.ascontiguousarray(demand[at].T), np.ascontiguousarray(np.moveaxis(cost[at], 0, -1)))
    if not rounds:
        flip = (1, 0, 2)
        first, second = _least(c, b > 0, 1), _least(c, a > 0, 0)
        both = _worth(a, b, c, np.where(a > 0, first, 0), rest), _worth(*(x.transpose(flip) for x in (b, a, c)), np.where(b > 0, second, 0).transpose(flip), rest)
        out[at] = np.maximum(*both) / moved[at]
        return out
    with np.errstate(divide="ignore"):
        log_a, log_b = np.log(a).astype(np.float32), np.log(b).astype(np.float32)
    scale = (np.abs(c) * a * b).sum(axis=(0, 1), keepdims=True) / (a.sum(axis=0, keepdims=True) * b.sum(axis=1, keepdims=True)) + _EPS
    near = (c / scale).astype(np.float32)
    z = np.empty_like(near)
    u = np.zeros((len(near), 1, near.shape[2]), np.float32)

    def soft(prices: np.ndarray, logs: np.ndarray, e: np.float32, axis: int) -> np.ndarray:
        np.subtract(prices, near, out=z)
        np.multiply(z, 1 / e, out=z)
        np.add(z, logs, out=z)
        top = z.max(axis=axis, keepdims=True)
        np.subtract(z, top, out=z)
        np.exp(z, out=z)
        return -e * (top + np.log(z.sum(axis=axis, keepdims=True)))

    for e in np.geomspace(*softness, rounds).astype(np.float32):
        v = soft(u, log_a, e, 0)
        u = soft(v, log_b, e, 1)
    out[at] = _worth(a, b, c, u * scale, rest) / moved[at]
    return out


def _vogel(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> list[tuple[int, int, float]]:
    """A basic solution: the row or column with the largest regret gets its cheapest cell filled first."""
    s, d = supply.copy(), demand.copy()
    rows, cols, basis = list(range(len(s))), list(range(len(d))), []
    while rows and cols:
        sub = cost[np.ix_(rows, cols)]
        regret = lambda a: (a[:, 1] - a[:, 0]) if a.shape[1] > 1 else a[:, 0] * 0
        by_row, by_col = regret(np.sort(sub, axis=1)), regret(np.sort(sub.T, axis=1))
        if by_row.max() >= by_col.max():
            i = int(by_row.argmax())
            j = int(sub[i].argmin())
        else:
            j = int(by_col.argmax())
            i = int(sub[:, j].argmin())
        a, b = rows[i], cols[j]
        step = min(s[a], d[b])
        basis.append((a, b, step))
        s[a] -= step
        d[b] -= step
        if len(rows) > 1 and (s[a] <= d[b] or len(cols) == 1):
            rows.remove(a)
        else:
            cols.remove(b)
    return basis


def myemd(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray, most: int | None = None, most_regions: int | None = MOST_REGIONS) -> float:
    """The same quantity by the transportation simplex; it raises if it isn't done after ``most`` steps (by default a hundred for each region, 5,000 at least)."""
    if most_regions is not None and max(len(supply), len(demand)) > most_regions:
        return UNCOMPARED
    most = max(5000, 100 * (len(supply) + len(demand))) if most is None else most
    s, d = supply.astype(float), demand.astype(float)
    total = float(min(s.sum(), d.sum()))
    if total <= 0:
        return 0.0
    c = cost.astype(float)
    if s.sum() > d.sum():
        d, c = np.append(d, s.sum() - d.sum()), np.hstack((c, np.zeros((len(s), 1))))
    elif d.sum() > s.sum():
        s, c = np.append(s, d.sum() - s.sum()), np.vstack((c, np.zeros((1, len(d)))))
    n, m = c.shape
    basis = {(i, j): x for i, j, x in _vogel(s, d, c)}
    scale = 1e-10 * max(1.0, float(np.abs(c).max()))
    for _ in range(most):
        u, v = np.full(n, np.nan), np.full(m, np.nan)
        near: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for i, j in basis:
            near.setdefault(("r", i), []).append((i, j))
            near.setdefault(("c", j), []).append((i, j))
        u[0] = 0.0
        stack = [("r", 0)]
        while stack:
            side, k = stack.pop()
            for i, j in near.get((side, k), []):
                if side == "r" and np.isnan(v[j]):
                    v[j] = c[i, j] - u[i]
                    stack.append(("c", j))
                elif side == "c" and np.isnan(u[i]):
                    u[i] = c[i, j] - v[j]
                    stack.append(("r", i))
        if np.isnan(u).any() or np.isnan(v).any():
            # a degenerate start is a forest: join two trees by an empty cell
            i, j = next((i, j) for i in range(n) for j in range(m) if np.isnan(u[i]) != np.isnan(v[j]))
            basis[i, j] = 0.0
            continue
        reduced = c - u[:, None] - v[None, :]
        i, j = np.unravel_index(int(reduced.argmin()), reduced.shape)
        if reduced[i, j] >= -scale:
            break
        loop = _loop(near, int(i), int(j))
        out = min(loop[1::2], key=lambda cell: basis[cell])
        step = basis[out]
        basis[int(i), int(j)] = 0.0
        for k, cell in enumerate(loop):
            basis[cell] += step if k % 2 == 0 else -step
        del basis[out]
    else:
        raise RuntimeError(f"the transportation simplex isn't done after {most} steps")
    return float(max(0.0, sum(x * c[cell] for cell, x in basis.items())) / total)


def _loop(near: dict[tuple[str, int], list[tuple[int, int]]], i: int, j: int) -> list[tuple[int, int]]:
    """The cells of the loop that the new cell (i, j) closes, from it on: the path in the basis tree from column j to row i."""
    parent: dict[tuple[str, int], tuple[tuple[str, int], tuple[int, int]] | None] = {("c", j): None}
    stack = [("c", j)]
    while stack:
        at = stack.pop()
        if at == ("r", i):
            break
        for cell in near.get(at, []):
            to = ("r", cell[0]) if at[0] == "c" else ("c", cell[1])
            if to not in parent:
                parent[to] = (at, cell)
                stack.append(to)
    cells, at = [], ("r", i)
    while parent[at] is not None:
        at, cell = parent[at]
        cells.append(cell)
    return [(i, j), *cells[::-1]]


def assign(cost: np.ndarray) -> tuple[float, list[int]]:
    """Least total cost of a one-to-one assignment of rows to columns (square), and the column of each row."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner, way = np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            slack = np.full(n + 1, np.inf)
            slack[1:] = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used & (slack < least)
            least[better], way[better] = slack[better], j0
            j1 = int(np.where(used, np.inf, least).argmin())
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    columns = [0] * n
    for j in range(1, n + 1):
        columns[owner[j] - 1] = j - 1
    return float(sum(cost[i, columns[i]] for i in range(n))), columns
