"""A tree of boxes over the points of one task.

Space is cut across tasks into blocks of a few thousand points; a task cuts its block
again into leaves of a few dozen, and looks only into leaves that a bound does not rule
out. All distances are squared and added up axis by axis in one order, so that the
distance of a box never exceeds that of a point in it, rounding included.
"""

from __future__ import annotations

import numpy as np

LEAF = 32
TILE = 1 << 15  # numbers worked on at a time, which stay in a core's cache
WIDER = 8  # times the points asked for are looked at for a first bound


def gaps2(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of every point from every box."""
    out = np.zeros((len(y), len(lo)))
    step = max(1, TILE // max(1, len(lo)))
    for start in range(0, len(y), step):
        part, total = y[start : start + step], out[start : start + step]
        gap, above = np.empty_like(total), np.empty_like(total)
        for j in range(y.shape[1]):
            np.subtract(lo[None, :, j], part[:, j, None], out=gap)
            np.subtract(part[:, j, None], hi[None, :, j], out=above)
            np.maximum(gap, above, out=gap)
            np.maximum(gap, 0.0, out=gap)
            np.multiply(gap, gap, out=gap)
            total += gap
    return out


def box_gaps2(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Squared distance of every box from every other box."""
    out = np.zeros((len(lo), len(other_lo)))
    for j in range(lo.shape[1]):
        gap = np.maximum(other_lo[None, :, j] - hi[:, j, None], lo[:, j, None] - other_hi[None, :, j])
        np.maximum(gap, 0.0, out=gap)
        out += gap * gap
    return out


def box_reaches2(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Squared distance of the farthest corners of every two boxes."""
    out = np.zeros((len(lo), len(other_lo)))
    for j in range(lo.shape[1]):
        gap = np.maximum(hi[:, j, None] - other_lo[None, :, j], other_hi[None, :, j] - lo[:, j, None])
        out += gap * gap
    return out


def distances2(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distance of every ``y`` from every ``x``."""
    out = np.zeros((len(y), len(x)))
    for j in range(y.shape[1]):
        gap = y[:, j, None] - x[None, :, j]
        out += gap * gap
    return out


def pair_distances2(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distance of each ``y`` from the ``x`` beside it, to the last bit that of ``distances2``."""
    out = np.zeros(len(y))
    for j in range(y.shape[1]):
        gap = y[:, j] - x[:, j]
        out += gap * gap
    return out


class Rough:
    """Squared distances as one product of matrices, not to the last bit: for leaving pairs out.

    ``left @ right`` of rows ``y`` and points ``x`` differs from the distances by less than
    ``slack``, one number a row. Infinite where the squares of the coordinates may overflow.
    """

    def __init__(self, y: np.ndarray, x: np.ndarray):
        centre = x[len(x) // 2] if len(x) else np.zeros(y.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            y, x = y - centre, x - centre
            y2, x2 = (y * y).sum(axis=1), (x * x).sum(axis=1)
            self.left = np.column_stack([y, y2, np.ones(len(y))])
            self.right = np.vstack([-2.0 * x.T, np.ones(len(x)), x2])
            most = y2 + x2.max(initial=0.0)
            self.slack = (y.shape[1] + 16) * 1e-15 * most
        self.safe = bool((most < 1e300).all())


class Leaves:
    """Points halved at the median of their widest axis until no part has more than ``size``.

    ``order`` lists the points leaf by leaf, those of leaf ``i`` at ``edges[i]:edges[i + 1]``.
    ``seen`` counts the distances that searches have computed.
    """

    def __init__(self, x: np.ndarray, size: int = LEAF):
        n, self.seen = len(x), 0
        order, edges = np.arange(n), np.array([0, n])
        while n and np.diff(edges).max() > size:
            sizes = np.diff(edges)
            y = x[order]
            widest = (np.maximum.reduceat(y, edges[:-1], axis=0) - np.minimum.reduceat(y, edges[:-1], axis=0)).argmax(axis=1)
            part = np.repeat(np.arange(len(sizes)), sizes)
            order = order[np.lexsort((y[np.arange(n), widest[part]], part))]
            edges = np.unique(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2]))
        self.order, self.edges, self.x = order, edges, x[order]
        self.lo = np.minimum.reduceat(self.x, edges[:-1], axis=0) if n else np.zeros((0, x.shape[1]))
        self.hi = np.maximum.reduceat(self.x, edges[:-1], axis=0) if n else np.zeros((0, x.shape[1]))

    def __len__(self) -> int:
        return len(self.lo)

    def points(self, leaf: int) -> slice:
        return slice(self.edges[leaf], self.edges[leaf + 1])

    def bound(self, y: np.ndarray, own: np.ndarray, k: int, gaps: np.ndarray | None = None) -> np.ndarray:
        """No less than the distance of each ``y`` to its k-th point, found in the leaves nearest to it.

        ``own`` is the place of ``y`` among the points, -1 if it is none of them; infinite
        if there are fewer points.
        """
        gaps = gaps2(y, self.lo, self.hi) if gaps is None else gaps
        sizes = np.diff(self.edges)
        take = min(len(sizes), -(-WIDER * (k + 1) // int(sizes.min())))
        near = np.argpartition(gaps, take - 1, axis=1)[:, :take]
        widest = int(sizes.max())
        place = self.edges[near][:, :, None] + np.arange(widest)
        real = place < self.edges[near + 1][:, :, None]
        place, real = place.reshape(len(y), -1), real.reshape(len(y), -1)
        place = np.minimum(place, len(self.x) - 1)
        d2 = np.zeros(place.shape)
        for j in range(y.shape[1]):
            gap = y[:, j, None] - self.x[place, j]
            d2 += gap * gap
        d2[~real | (self.order[place] == own[:, None])] = np.inf
        self.seen += int(real.sum())
        return np.partition(d2, k - 1, axis=1)[:, k - 1] if d2.shape[1] >= k else np.full(len(y), np.inf)

    def within(self, y: np.ndarray, own: np.ndarray, limit: np.ndarray, gaps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, point, distance`` of all points within ``limit`` of each ``y``, ``y`` itself left out."""
        near = np.ascontiguousarray(((gaps2(y, self.lo, self.hi) if gaps is None else gaps) <= limit[:, None]).T)
        rough = Rough(y, self.x)
        reach = limit + rough.slack
        rows, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for leaf in np.flatnonzero(near.any(axis=1)):
            asking, here = np.flatnonzero(near[leaf]), self.points(leaf)
            size = int(here.stop - here.start)
            self.seen += len(asking) * size
            if rough.safe:
                found = np.flatnonzero(rough.left[asking] @ rough.right[:, here] <= reach[asking, None])
            else:
                found = np.flatnonzero(distances2(y[asking], self.x[here]) <= limit[asking, None])
            row, col = np.divmod(found, size)
            rows.append(asking[row])
            places.append(here.start + col)
        row, place = np.concatenate(rows), np.concatenate(places)
        d2, point = pair_distances2(y[row], self.x[place]), self.order[place]
        keep = (d2 <= limit[row]) & (point != own[row]) & np.isfinite(d2)
        return row[keep], point[keep], d2[keep]
