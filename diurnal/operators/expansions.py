"""Exponential kernel sums between two sets of points inside a task, in time that grows with their number.

A fast multipole method in NumPy. Both sets are cut into one quadtree. Two cells of a level that are at least a cell apart
act on each other through Chebyshev nodes (the kernel is smooth there), pairs of close cells are cut further, and
only few points that stay close, or that would be fewer than the nodes, meet one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Finest cells, pairs of points that two close cells have at most when they meet, and those below which cells apart meet too.
DEPTH, NEAR, FAR = 20, 1 << 16, 1 << 14
#: Most nodes to a side: more gain nothing in doubles.
MOST_NODES = 24
#: Distances made at once.
AT_ONCE = 1 << 15


def chebyshev(p: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(p) + 0.5) / p)


def basis(x: np.ndarray, p: int) -> np.ndarray:
    """Values at ``x`` of the polynomials that are 1 at one of ``p`` Chebyshev nodes of [-1, 1] and 0 at the others."""
    k = np.arange(p)
    gap = x[:, None] - chebyshev(p)
    hit = gap == 0
    gap[hit] = 1
    b = (-1.0) ** k * np.sin(np.pi * (k + 0.5) / p) / gap
    b[hit.any(1)] = 0
    b[hit] = 1
    return b / b.sum(1, keepdims=True)


@lru_cache
def nodes_for(error: float) -> int | None:
    """Nodes to a side with which a sum is off by at most ``error`` for each unit of its weights; None where doubles cannot.

    Measured for cells one cell apart, the closest that act through nodes, over the widths of cells in units of the
    kernel's decay. The nodes of both cells, and weights at nodes that stand for points again, each add up to the square of
    the Lebesgue constant, hence the allowance.
    """
    grid = np.linspace(-1, 1, 25)
    apart = [(3.0, u) for u in np.linspace(-3, 3, 13)] + [(4.0, u) for u in np.linspace(-4, 4, 9)]
    for p in range(2, MOST_NODES + 1):
        at, n = basis(grid, p), chebyshev(p)
        room = (1 + np.abs(basis(np.linspace(-1, 1, 500), p)).sum(1).max() ** 2) ** 2
        kernel = lambda x, y, a, b, w: np.exp(-w * np.hypot(a - x[:, None], b - y))
        off = [np.abs(at @ kernel(n, n, a, b, w) @ at.T - kernel(grid, grid, a, b, w)).max() for a, b in apart for w in (0.3, 1.0, 1.5, 2.0, 3.0)]
        if max(off) * room <= error:
            return p
    return None


def node_places(low_x: float, low_y: float, side: float, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The p x p nodes of a cell, the second coordinate running faster."""
    n = (chebyshev(p) + 1) / 2 * side
    return np.repeat(low_x + n, p), np.tile(low_y + n, p)


def weights_at_nodes(x: np.ndarray, y: np.ndarray, held: np.ndarray, low_x: float, low_y: float, side: float, p: int) -> np.ndarray:
    """Weights at a cell's nodes (rows) that act from afar like those held at places inside it."""
    bx, by = (basis((v - low) / side * 2 - 1, p) for v, low in ((x, low_x), (y, low_y)))
    return (bx.T @ (by[:, :, None] * held[:, None, :]).reshape(len(x), -1)).reshape(p * p, held.shape[1])


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(s))) & np.uint64(m)
    return v


class _Level:
    """Occupied cells of a level: where their points begin and end, how many, and which cells they are."""

    def __init__(self, cells: _Cells, level: int):
        code = cells.code >> np.uint64(2 * (DEPTH - level))
        self.start = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1]
        self.end = np.r_[self.start[1:], len(code)]
        self.size = self.end - self.start
        self.cx, self.cy = (v[self.start] >> (DEPTH - level) for v in (cells.ix, cells.iy))


class _Cells:
    """Points in the order of their cells, so that those of every cell are a stretch of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, low_x: float, low_y: float, side: float):
        slot = lambda v, low: np.clip(((v - low) / side * 2**DEPTH).astype(np.int64), 0, 2**DEPTH - 1)
        ix, iy = slot(x, low_x), slot(y, low_y)
        code = _spread(ix) << np.uint64(1) | _spread(iy)
        self.order = np.argsort(code, kind="stable")
        self.code, self.ix, self.iy, self.x, self.y = (v[self.order] for v in (code, ix, iy, x, y))
        self._levels: dict[int, _Level] = {}

    def level(self, level: int) -> _Level:
        if level not in self._levels:
            self._levels[level] = _Level(self, level)
        return self._levels[level]

    def children(self, level: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child of each cell and the number of its children."""
        own, below = self.level(level), self.level(level + 1)
        first = np.searchsorted(below.start, own.start[which])
        return first, np.searchsorted(below.start, own.end[which]) - first


def _meet(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, held: np.ndarray, beta: float, out: np.ndarray) -> None:
    """Add the sums over all pairs to ``out``."""
    finite = bool(np.isfinite(held).all())
    step = max(1, AT_ONCE // max(1, len(qx)))
    for k in range(0, len(px), step):
        d = px[k : k + step, None] - qx
        d *= d
        e = py[k : k + step, None] - qy
        e *= e
        d += e
        np.sqrt(d, out=d)
        d *= -beta
        phi = np.exp(d, out=d)
        out[k : k + step] += phi @ held if finite else np.where((phi > 0)[..., None], phi[..., None] * held, 0).sum(1)


def _halves(p: int) -> list[np.ndarray]:
    """A cell's polynomials at the nodes of its lower and upper half."""
    n = chebyshev(p)
    return [basis((n - 1) / 2, p), basis((n + 1) / 2, p)]


def _family(cells: _Cells, level: int, which: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Children of cells by the quarter they are: halves of x and y, the child, and its parent's place in ``which``."""
    first, n = cells.children(level, which)
    child, parent = _runs(first, n), np.repeat(np.arange(len(which)), n)
    below = cells.level(level + 1)
    quarter = (below.cx[child] & 1) * 2 + (below.cy[child] & 1)
    return [(q >> 1, q & 1, child[quarter == q], parent[quarter == q]) for q in range(4)]


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The whole numbers of all runs of ``n`` from ``first`` on."""
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


class _Marked:
    """Cells of levels that carry weights or sums at their nodes."""

    def __init__(self, cells: _Cells, wanted: dict[int, np.ndarray], p: int, columns: int):
        self.cells, self.few = cells, 4 * p * p
        self.which: dict[int, np.ndarray] = {}
        level, handed = 0, np.zeros(0, int)
        while level <= max(wanted, default=-1) or len(handed):  # cells of many points leave them to their children
            own = self.which[level] = np.union1d(wanted.get(level, np.zeros(0, int)), handed).astype(int)
            many = self.many(level)
            handed = _runs(*cells.children(level, own[many])) if many.any() else np.zeros(0, int)
            level += 1
        self.values = {level: np.zeros((columns, len(own), p, p)) for level, own in self.which.items()}

    def many(self, level: int) -> np.ndarray:
        return (self.cells.level(level).size[self.which[level]] > self.few) & (level < DEPTH)

    def at(self, level: int, cells: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.which[level], cells)


def sums(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, held: np.ndarray, beta: float, error: float) -> np.ndarray:
    """Sums of ``held`` (rows at places q) times ``exp(-beta distance)`` at places p.

    Off by at most ``error`` times the sum of the absolute weights of a column. Places must be finite; where weights are not, all pairs meet.
    """
    out = np.zeros((len(px), held.shape[1]))
    if not len(px) or not len(qx):
        return out
    p = nodes_for(error) if np.isfinite(held).all() else None
    if p is None or len(px) * len(qx) <= NEAR:
        _meet(px, py, qx, qy, held, beta, out)
        return out
    low_x, low_y = min(px.min(), qx.min()), min(py.min(), qy.min())
    side = max(px.max() - low_x, qx.max() - low_x, py.max() - low_y, qy.max() - low_y) or 1.0
    asked, sources = _Cells(px, py, low_x, low_y, side), _Cells(qx, qy, low_x, low_y, side)
    held, found = held[sources.order], out[asked.order]
    acts = _walk(asked, sources, held, found, beta, p)
    wanted = lambda k: {level: np.unique(np.concatenate([own[k] for own in some])) for level, some in acts.items() if some}
    there = _Marked(sources, wanted(2), p, held.shape[1])
    here = _Marked(asked, wanted(1), p, held.shape[1])
    _gather(there, held, low_x, low_y, side, p)
    n = chebyshev(p)
    for level, some in acts.items():
        half = side / 2**level / 2
        for (dx, dy), a, b in some:
            gx, gy = ((n[:, None] - n - 2 * d) ** 2 for d in (dx, dy))
            kernel = np.exp(-beta * half * np.sqrt(gx[:, None, :, None] + gy[None, :, None, :])).reshape(p * p, p * p)
            own, theirs = here.at(level, a), there.at(level, b)
            for k in range(0, len(a), 512):
                given = there.values[level][:, theirs[k : k + 512]].reshape(-1, p * p)
                here.values[level][:, own[k : k + 512]] += (given @ kernel.T).reshape(held.shape[1], -1, p, p)
    _hand_out(here, found, low_x, low_y, side, p)
    out[asked.order] = found
    return out


def _walk(asked: _Cells, sources: _Cells, held: np.ndarray, found: np.ndarray, beta: float, p: int) -> dict[int, list]:
    """Let close points meet, and list the cells that act on each other through nodes, by level and offset."""
    acts: dict[int, list] = {}
    a = b = np.zeros(1, int)
    level = 0
    while len(a):
        here, there = asked.level(level), sources.level(level)
        pairs = here.size[a] * there.size[b]
        dx, dy = there.cx[b] - here.cx[a], there.cy[b] - here.cy[a]
        apart = np.maximum(np.abs(dx), np.abs(dy)) >= 2
        offset = (dx + 3) * 7 + dy + 3
        by_nodes = apart & (pairs > FAR)
        worth = np.bincount(offset[by_nodes], pairs[by_nodes], 49) > 2 * p**4  # pairs of nodes are made once for an offset
        by_nodes[by_nodes] = worth[offset[by_nodes]]
        acts[level] = [((k // 7 - 3, k % 7 - 3), a[some], b[some]) for k in np.flatnonzero(worth) for some in [by_nodes & (offset == k)]]
        meet = ~by_nodes & (apart | (pairs <= NEAR) | (level == DEPTH))
        first = np.flatnonzero(meet)[np.argsort(a[meet], kind="stable")]
        for some in np.split(first, np.flatnonzero(np.diff(a[first])) + 1):
            if len(some):
                s, e = here.start[a[some[0]]], here.end[a[some[0]]]
                q = _runs(there.start[b[some]], there.size[b[some]])
                _meet(asked.x[s:e], asked.y[s:e], sources.x[q], sources.y[q], held[q], beta, found[s:e])
        cut = ~by_nodes & ~meet
        a, b = a[cut], b[cut]
        if len(a):
            (fa, na), (fb, nb) = asked.children(level, a), sources.children(level, b)
            n = na * nb
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = np.repeat(fa, n) + k // np.repeat(nb, n), np.repeat(fb, n) + k % np.repeat(nb, n)
        level += 1
    return acts


def _corner(level: _Level, cell: int, width: float, low_x: float, low_y: float) -> tuple[float, float]:
    return low_x + level.cx[cell] * width, low_y + level.cy[cell] * width


def _gather(there: _Marked, held: np.ndarray, low_x: float, low_y: float, side: float, p: int) -> None:
    """Weights at nodes: from points, or from the nodes of children, which gives the same."""
    halves = _halves(p)
    for level in sorted(there.which, reverse=True):
        own, many, cells = there.which[level], there.many(level), there.cells.level(level)
        width = side / 2**level
        for k in np.flatnonzero(~many):
            s, e = cells.start[own[k]], cells.end[own[k]]
            w = weights_at_nodes(there.cells.x[s:e], there.cells.y[s:e], held[s:e], *_corner(cells, own[k], width, low_x, low_y), width, p)
            there.values[level][:, k] = w.T.reshape(-1, p, p)
        if many.any():
            at = np.flatnonzero(many)
            for hx, hy, child, parent in _family(there.cells, level, own[many]):
                below = there.values[level + 1][:, there.at(level + 1, child)]
                there.values[level][:, at[parent]] += halves[hx].T @ below @ halves[hy]


def _hand_out(here: _Marked, found: np.ndarray, low_x: float, low_y: float, side: float, p: int) -> None:
    """Sums at nodes, to points or to the nodes of children."""
    halves = _halves(p)
    for level in sorted(here.which):
        own, many, cells = here.which[level], here.many(level), here.cells.level(level)
        width = side / 2**level
        for k in np.flatnonzero(~many):
            s, e = cells.start[own[k]], cells.end[own[k]]
            corner = _corner(cells, own[k], width, low_x, low_y)
            bx, by = (basis((v[s:e] - low) / width * 2 - 1, p) for v, low in zip((here.cells.x, here.cells.y), corner))
            at = (bx @ here.values[level][:, k].transpose(1, 0, 2).reshape(p, -1)).reshape(len(bx), -1, p)
            found[s:e] += np.einsum("ncp,np->nc", at, by)
        if many.any():
            at = np.flatnonzero(many)
            for hx, hy, child, parent in _family(here.cells, level, own[many]):
                above = here.values[level][:, at[parent]]
                here.values[level + 1][:, here.at(level + 1, child)] += halves[hx] @ above @ halves[hy].T
