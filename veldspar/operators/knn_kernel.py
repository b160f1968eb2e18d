"""NumPy kernels over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs whose distances are computed at once.
PAIRS = 1 << 20


def squared(x: np.ndarray, q: np.ndarray, integer: bool) -> np.ndarray:
    """[row, query] squared distances; whole numbers stay exact, as all terms are under 2**53."""
    if integer:
        x, q = np.asarray(x, np.float64), np.asarray(q, np.float64)
        out = x @ q.T
        out *= -2
        out += (x * x).sum(1)[:, None]
        out += (q * q).sum(1)[None, :]
        return out
    out = np.zeros((len(x), len(q)))
    for d in range(x.shape[1]):
        diff = x[:, d, None].astype(np.float64) - q[None, :, d].astype(np.float64)
        out += diff * diff
    return out


def absolute(x: np.ndarray, q: np.ndarray, integer: bool) -> np.ndarray:
    out = np.zeros((len(x), len(q)))
    for d in range(x.shape[1]):
        out += np.abs(x[:, d, None].astype(np.float64) - q[None, :, d].astype(np.float64))
    return out


def one_less_cosine(x: np.ndarray, q: np.ndarray, integer: bool) -> np.ndarray:
    """Sums go in order of the dimensions; 1 where a vector is zero."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    dot, own, other = np.zeros((len(x), len(q))), np.zeros(len(x)), np.zeros(len(q))
    for d in range(x.shape[1]):
        dot += x[:, d, None] * q[None, :, d]
        own += x[:, d] * x[:, d]
        other += q[:, d] * q[:, d]
    norm = np.sqrt(own[:, None] * other[None, :])
    return np.where(norm > 0, 1 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0), 1.0)


DISTANCES = {"l2": squared, "l1": absolute, "cosine": one_less_cosine}


def box_bound(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[query] least squared distance to a point of the box."""
    q = q.astype(np.int64)
    out = np.maximum(np.maximum(low.astype(np.int64) - q, q - high.astype(np.int64)), 0)
    return (out * out).sum(axis=1)


def matrix(col) -> np.ndarray:
    """A list column whose lists have one length, as rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


class Nearest:
    """The k nearest rows of each of n queries, ties by the lower reference id, as batches of rows come by."""

    def __init__(self, n: int, k: int, at_most: np.ndarray | None = None):
        """at_most: distances above which a query needs nothing."""
        self.n, self.k = n, k
        self.bound = np.full(n, np.inf) if at_most is None else at_most.astype(np.float64)
        self.held: list[tuple] = []
        self.size = 0

    def add(self, dist: np.ndarray, queries: np.ndarray, ref: np.ndarray, fraud: np.ndarray) -> None:
        """dist: [row, query] for some of the queries."""
        near = dist <= self.bound[queries]
        many = np.flatnonzero(near.sum(axis=0) > 2 * self.k)
        if len(many):
            kth = np.partition(dist[:, many].T, self.k - 1, axis=1)[:, self.k - 1]
            self.bound[queries[many]] = np.minimum(self.bound[queries[many]], kth)
            near[:, many] = dist[:, many] <= self.bound[queries[many]]
        row, query = np.nonzero(near)
        if not len(row):
            return
        self.held.append((queries[query], dist[row, query], ref[row], fraud[row]))
        self.size += len(row)
        if self.size > 4 * self.n * self.k + PAIRS:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """query, distance, ref_id, is_fraud of the nearest so far."""
        if not self.held:
            none = np.zeros(0, np.int64)
            return none, none.astype(np.float64), none, none.astype(bool)
        query, dist, ref, fraud = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ref, dist, query))
        query, dist, ref, fraud = query[order], dist[order], ref[order], fraud[order]
        start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        keep = rank < self.k
        last = np.flatnonzero(rank == self.k - 1)
        self.bound[query[last]] = np.minimum(self.bound[query[last]], dist[last])
        self.held = [(query[keep], dist[keep], ref[keep], fraud[keep])]
        self.size = int(keep.sum())
        return self.held[0]
