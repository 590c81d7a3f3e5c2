"""Nearest points in the plane inside a task: pairs are thinned out where they are formed, so what moves grows with rows and not with pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Rows that a kernel looks at together, and pairs that it forms at once (a single query may have more).
CHUNK, PAIRS = 65_536, 1_000_000


class Points:
    """Points in cells of a few points each; only occupied rows and columns of cells count, so lone far points cost nothing."""

    def __init__(self, x: np.ndarray, y: np.ndarray, radius: float, per_cell: float = 3.0):
        self.x, self.y, self.radius = x, y, radius
        (x0, x1), (y0, y1) = (np.quantile(v, (0.05, 0.95)) if len(v) else (0.0, 0.0) for v in (x, y))
        self.share = max((x1 - x0) * (y1 - y0) / 0.81, 1e-12) / max(1, len(x))
        self.side = float(np.clip(np.sqrt(per_cell * self.share), radius / 256, radius))
        self.columns, at_x = np.unique(np.floor(x / self.side), return_inverse=True)
        self.rows, at_y = np.unique(np.floor(y / self.side), return_inverse=True)
        cells = at_y.astype(np.int64) * len(self.columns) + at_x
        self.order = np.argsort(cells, kind="stable")
        self.cells = cells[self.order]

    def start(self, k: int) -> float:
        """A distance within which a few more than ``k`` points lie where they are as dense as on average."""
        return float(np.clip(np.sqrt(1.5 * k * self.share / np.pi), self.radius / 256, self.radius))

    def _span(self, cells: np.ndarray, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pad = reach * (1 + 1e-9) + np.abs(at) * 1e-15
        return np.searchsorted(cells, np.floor((at - pad) / self.side), "left"), np.searchsorted(cells, np.floor((at + pad) / self.side), "right")

    def ranges(self, x: np.ndarray, y: np.ndarray, reach: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(query, first, number) of the points in the cells that each query's square touches; None if rows of cells are more than ``limit``."""
        (y0, y1), (x0, x1) = self._span(self.rows, y, reach), self._span(self.columns, x, reach)
        n = y1 - y0
        if n.sum() > limit:
            return None
        q = np.repeat(np.arange(len(x)), n)
        row = (y0[q] + _places(n)) * len(self.columns)
        first = np.searchsorted(self.cells, row + x0[q], "left")
        return q, first, np.searchsorted(self.cells, row + x1[q], "left") - first


def _places(n: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def nearest(points: Points, owner: np.ndarray, x: np.ndarray, y: np.ndarray, reach: np.ndarray, k: int | None, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray], order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """For each owner of queries the ``k`` nearest allowed points within ``reach`` of one (all without ``k``): parts of (query, point, distance, place).

    ``owner`` numbers the owners of the queries from 0 in rising order, without gaps; an owner's rows stand
    in one part. Equally near points stand in the order of ``order``, else of their index. An owner is looked
    at within a small distance first, which doubles until it has ``k`` points.
    """
    if not len(x) or not len(points.x):
        return
    bounds = np.searchsorted(owner, np.arange(owner[-1] + 2))
    furthest = np.maximum.reduceat(reach, bounds[:-1])
    rank = np.arange(len(points.x)) if order is None else order

    def split(owners: np.ndarray, near: float) -> Iterator[tuple[np.ndarray, ...]]:
        n = bounds[owners + 1] - bounds[owners]
        q = np.repeat(bounds[owners], n) + _places(n)
        within = np.minimum(reach[q], near)
        got = points.ranges(x[q], y[q], within, PAIRS if len(owners) > 1 else 1 << 62)
        if got is None or (got[2].sum() > PAIRS and len(owners) > 1):
            for half in np.array_split(owners, 2):
                yield from split(half, near)
            return
        at, first, m = got
        of, p = np.repeat(at, m), points.order[np.repeat(first, m) + _places(m)]
        dx, dy = x[q][of] - points.x[p], y[q][of] - points.y[p]
        d = np.sqrt(dx * dx + dy * dy)
        some = np.flatnonzero(d <= within[of])
        some = some[allowed(q[of[some]], p[some])]
        yield owners, q[of[some]], p[some], d[some]

    open_, near = np.arange(owner[-1] + 1), points.radius if k is None else points.start(k)
    while len(open_):
        later = []
        for owners, q, p, d in split(open_, near):
            if k is None or near >= points.radius:
                ready = np.ones(len(owners), bool)
            else:
                # no query of the owner reaches further, or there are enough
                ready = (np.bincount(owner[q] - owners[0], minlength=owners[-1] - owners[0] + 1)[owners - owners[0]] >= k) | (furthest[owners] <= near)
                later.append(owners[~ready])
            keep = np.zeros(owners[-1] - owners[0] + 1, bool)
            keep[owners[ready] - owners[0]] = True
            keep = keep[owner[q] - owners[0]]
            q, p, d = q[keep], p[keep], d[keep]
            by = np.lexsort((rank[p], d, owner[q]))
            q, p, d = q[by], p[by], d[by]
            _, n = np.unique(owner[q], return_counts=True)
            place = _places(n)
            best = slice(None) if k is None else place < k
            yield q[best], p[best], d[best], place[best]
        open_ = np.concatenate(later) if later else open_[:0]
        near = min(2 * near, points.radius)


def chunks(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.Table]:
    """Batches put together to tables of ``rows`` rows or a batch more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= (rows or CHUNK):
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
