"""Numpy helpers that run inside Spark tasks on one Arrow batch at a time.

Feature values enter the kernels relative to the noise mean.  A fully masked value equals the noise
mean exactly, so its relative value is zero and second moments stay sparse.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Kinds of moment cells.
COUNT, SUM_Y, SUM_W, SUM_CORR, GRAM, STEP = 0, 1, 2, 3, 4, 5
#: Sums of a step under STEP: parameter counts, own scores, losses if deleted, points that moved here, scores computed.
STEP_SUMS = 5

# A cell is one sum.  Its class, kind and two positions share one 64-bit key, which keeps the rows
# that are shuffled and hashed small: 30 bits of class, 3 of kind, 15 for each position plus one.
CELL_SCHEMA = "cell BIGINT, v DOUBLE"
CLASS_BITS, POSITION_BITS, STAT_BITS = 30, 15, 3


def cell_key(c: int, stat, i, j) -> np.ndarray:
    """Packs one class with arrays of kinds and positions; raises where one does not fit its bits."""
    if not 0 <= c < 1 << CLASS_BITS:
        raise OverflowError(f"class {c} needs more than {CLASS_BITS} bits")
    if max(np.max(i, initial=-1), np.max(j, initial=-1)) + 1 >= 1 << POSITION_BITS:
        raise OverflowError(f"more than {(1 << POSITION_BITS) - 2} dimensions")
    head = (c << STAT_BITS) + np.asarray(stat, dtype=np.int64)
    return (((head << POSITION_BITS) + i + 1) << POSITION_BITS) + j + 1


# Open sums of one task are handed on when they pass this size.
FLUSH_BYTES = 192 * 1024 * 1024
# Points per matrix product; keeps the operands in the processor cache.
ROWS_AT_ONCE = 1024


def matrix(column: pa.Array) -> np.ndarray:
    """A list column with equally long rows as a 2-d array, without copying through Python."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def list_column(values: np.ndarray) -> pa.Array:
    """The rows of a 2-d array as a list column."""
    n, d = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), np.ascontiguousarray(values).ravel())


class Expectation:
    """Turns raw values and soft masks into expectations and corrections."""

    def __init__(self, mean, variance, low=None, inverse_span=None):
        self.mean = np.asarray(mean, dtype=float)
        self.second = self.mean**2 + np.asarray(variance, dtype=float)
        self.low = None if low is None else np.asarray(low, dtype=float)
        self.inverse_span = None if inverse_span is None else np.asarray(inverse_span, dtype=float)

    def __call__(self, x, w):
        if self.low is not None:
            x = (x - self.low) * self.inverse_span
        y = w * x + (1 - w) * self.mean
        return y, w * x * x + (1 - w) * self.second - y * y

    def of(self, batch):
        """Expectations, corrections and masks of an Arrow batch with columns ``x`` and ``w``."""
        w = matrix(batch.column("w"))
        return *self(matrix(batch.column("x")), w), w


class MomentSums:
    """Running per-class sums of a task; every ``stride``-th class is the noise class of another fit.
    Without ``products`` only counts and sums are kept, no second moments."""

    def __init__(self, dims: int, gram_for_noise: bool = False, stride: int | None = None, products: bool = True):
        self.dims = dims
        self.products = products
        self.stride = stride
        self.gram_for_noise = gram_for_noise
        self.vectors: dict[int, np.ndarray] = {}
        self.counts: dict[int, int] = {}
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.steps: dict[int, np.ndarray] = {}
        self.bytes = 0

    def add(self, classes, rel, weights, corr):
        order = np.argsort(classes, kind="stable")
        ids, starts = np.unique(classes[order], return_index=True)
        bounds = np.append(starts, len(order))
        for c, a, b in zip(ids.tolist(), bounds[:-1], bounds[1:]):
            rows = order[a:b]
            if c not in self.counts:
                self.counts[c] = 0
                self.vectors[c] = np.zeros((3, self.dims))
                self.bytes += 24 * self.dims
            self.counts[c] += len(rows)
            r = rel[rows]
            sums = self.vectors[c]
            sums[0] += r.sum(axis=0)
            sums[1] += weights[rows].sum(axis=0)
            sums[2] += corr[rows].sum(axis=0)
            if self.products and ((c % self.stride if self.stride else c) != 0 or self.gram_for_noise):
                self._add_gram(c, r)

    def add_step(self, classes, sums):
        """What a step found per point, in columns, for classes of added points."""
        for c in np.unique(classes).tolist():
            self.steps[c] = self.steps.get(c, np.zeros(STEP_SUMS)) + sums[classes == c].sum(axis=0)

    def _add_gram(self, c, r):
        support = np.flatnonzero(r.any(axis=0))
        held = self.grams.get(c)
        if held is None:
            dims, gram = support, np.zeros((len(support), len(support)))
            self.bytes += gram.nbytes
        else:
            dims, gram = held
            if not np.isin(support, dims).all():
                wider = np.union1d(dims, support)
                at = np.searchsorted(wider, dims)
                grown = np.zeros((len(wider), len(wider)))
                grown[np.ix_(at, at)] = gram
                self.bytes += grown.nbytes - gram.nbytes
                dims, gram = wider, grown
        part = r[:, dims]
        gram += part.T @ part
        self.grams[c] = (dims, gram)

    def cells(self):
        """Arrow batches with the sums, one class after another, so output stays small too."""
        axis = np.arange(self.dims)
        for c in sorted(self.counts):
            stat = [np.array([COUNT])]
            row = [np.array([-1])]
            col = [np.array([-1])]
            val = [np.array([float(self.counts[c])])]
            for k, kind in enumerate((SUM_Y, SUM_W, SUM_CORR)):
                stat.append(np.full(self.dims, kind))
                row.append(axis)
                col.append(np.full(self.dims, -1))
                val.append(self.vectors[c][k])
            if c in self.grams:
                dims, gram = self.grams[c]
                a, b = np.triu_indices(len(dims))
                v = gram[a, b]
                a, b, v = a[v != 0], b[v != 0], v[v != 0]
                stat.append(np.full(len(v), GRAM))
                row.append(dims[a])
                col.append(dims[b])
                val.append(v)
            if c in self.steps:
                stat.append(np.full(STEP_SUMS, STEP))
                row.append(np.arange(STEP_SUMS))
                col.append(np.full(STEP_SUMS, -1))
                val.append(self.steps[c])
            values = np.concatenate(val)
            keys = cell_key(c, np.concatenate(stat), np.concatenate(row), np.concatenate(col))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], names=["cell", "v"])


def covariance_from_moments(cells, nu, sigma2, prior, mask_points):
    """Mean, cluster mask and scaled covariance (block and diagonal) of one class."""
    nu, sigma2 = np.asarray(nu), np.asarray(sigma2)
    d = len(nu)
    stat, i, j, v = cells
    n = float(v[stat == COUNT].sum())
    vectors = {}
    for kind in (SUM_Y, SUM_W, SUM_CORR):
        out = np.zeros(d)
        at = stat == kind
        out[i[at]] = v[at]
        vectors[kind] = out
    shift = vectors[SUM_Y] / n
    unmasked = np.flatnonzero(vectors[SUM_W] >= mask_points)
    place = np.full(d, -1)
    place[unmasked] = np.arange(len(unmasked))

    at = stat == GRAM
    gi, gj, gv = i[at], j[at], v[at]
    scatter = np.zeros(d)
    on_diagonal = gi == gj
    scatter[gi[on_diagonal]] = gv[on_diagonal]
    block = np.zeros((len(unmasked), len(unmasked)))
    inside = (place[gi] >= 0) & (place[gj] >= 0)
    a, b = place[gi[inside]], place[gj[inside]]
    block[a, b] = gv[inside]
    block[b, a] = gv[inside]
    block -= n * np.outer(shift[unmasked], shift[unmasked])

    # A masked dimension keeps only the correction and the prior; its residuals are not counted.
    extra = vectors[SUM_CORR] + prior * sigma2
    scale = n + prior - 1
    factor = 1.0 / scale if scale else math.inf
    u = len(unmasked)
    block[np.arange(u), np.arange(u)] += extra[unmasked]
    with np.errstate(invalid="ignore"):
        return n, nu + shift, unmasked, block * factor, extra * factor


@dataclass(frozen=True)
class Factor:
    """Cholesky-based quantities the score of one cluster needs."""

    ok: bool
    root_inverse: np.ndarray
    inv_diag: np.ndarray
    log_root_det: float


def factorise(unmasked, block, diagonal) -> Factor:
    """Factor the block-plus-diagonal covariance; ``ok`` is false if it is not positive definite."""
    d, u = len(diagonal), len(unmasked)
    masked = np.setdiff1d(np.arange(d), unmasked)
    failed = Factor(False, np.zeros((u, u)), np.zeros(d), math.nan)
    diag = diagonal[masked]
    if not (np.all(np.isfinite(diag)) and np.all(diag > 0) and np.all(np.isfinite(block))):
        return failed
    try:
        root = np.linalg.cholesky(block) if u else np.zeros((0, 0))
    except np.linalg.LinAlgError:
        return failed
    pivots = np.diagonal(root)
    if not np.all(pivots > 0):
        return failed
    inverse = np.linalg.solve(root, np.eye(u)) if u else root
    inv_diag = np.zeros(d)
    inv_diag[unmasked] = (inverse**2).sum(axis=0)
    inv_diag[masked] = 1.0 / diag
    return Factor(True, inverse, inv_diag, float(np.log(pivots).sum() + 0.5 * np.log(diag).sum()))


class Scorer:
    """Scores batches of points against a slice of the cluster model; lower is better."""

    def __init__(self, clusters: list[dict], nu, huge: float = 1e30):
        self.nu = np.asarray(nu, dtype=float)
        self.huge = huge
        self.clusters = sorted(clusters, key=lambda m: m["cluster_id"])
        self.ids = np.array([m["cluster_id"] for m in self.clusters], dtype=np.int64)
        d = len(self.nu)
        shape = (len(self.clusters), d)
        self.inv_diag = np.zeros(shape)
        shift = np.zeros(shape)
        masked_inverse = np.zeros(shape)
        const = np.zeros(len(self.clusters))
        self.blocks = []
        for k, m in enumerate(self.clusters):
            unmasked = np.asarray(m["unmasked"], dtype=int)
            self.inv_diag[k] = m["inv_diag"]
            shift[k] = np.asarray(m["mean"]) - self.nu
            masked_inverse[k] = self.inv_diag[k]
            masked_inverse[k, unmasked] = 0.0
            u = len(unmasked)
            root_inverse = np.asarray(m["root_inverse"], dtype=float).reshape(u, u)
            self.blocks.append((unmasked, root_inverse @ shift[k, unmasked, None], root_inverse))
            const[k] = m["log_root_det"] + 0.5 * math.log(2 * math.pi) * d - math.log(m["weight"])
        self.linear = -2.0 * (masked_inverse * shift).T
        self.quadratic = masked_inverse.T.copy()
        self.offset = (masked_inverse * shift**2).sum(axis=1)
        self.const = const

    def mahalanobis(self, rel) -> np.ndarray:
        """Squared distances, points by clusters."""
        out = np.maximum((rel**2) @ self.quadratic + rel @ self.linear + self.offset, 0.0)
        by_dim = np.ascontiguousarray(rel.T)
        for k, (unmasked, shift, root) in enumerate(self.blocks):
            if len(unmasked):
                r = root @ by_dim[unmasked]
                r -= shift
                out[:, k] += np.einsum("ij,ij->j", r, r)
        return out

    def variance_term(self, corr) -> np.ndarray:
        return corr @ self.inv_diag.T

    def scores(self, y, corr) -> np.ndarray:
        return 0.5 * (self.mahalanobis(y - self.nu) + self.variance_term(corr)) + self.const

    def known(self, ids: np.ndarray, allow_noise: bool = True) -> np.ndarray:
        """Which of these classes can be scored: usable clusters, and the noise class if it is allowed."""
        return np.isin(ids, self.ids) | ((ids == 0) & allow_noise)

    def own(self, rel, corr, ids: np.ndarray, noise_score: float) -> np.ndarray:
        """The score of one named class per point."""
        out = np.full(len(ids), noise_score)
        for c in np.unique(ids[ids != 0]).tolist():
            k, at = int(np.searchsorted(self.ids, c)), np.flatnonzero(ids == c)
            r = rel[at]
            mahal = np.maximum((r**2) @ self.quadratic[:, k] + r @ self.linear[:, k] + self.offset[k], 0.0)
            unmasked, shift, root = self.blocks[k]
            if len(unmasked):
                residual = root @ r[:, unmasked].T - shift
                mahal += np.einsum("ij,ij->j", residual, residual)
            out[at] = 0.5 * (mahal + corr[at] @ self.inv_diag[k]) + self.const[k]
        return out

    def overlap(self, weights) -> np.ndarray:
        """Soft mask mass of each point on each cluster's unmasked dimensions."""
        member = np.zeros((len(self.nu), len(self.clusters)))
        for k, (unmasked, _, _) in enumerate(self.blocks):
            member[unmasked, k] = 1.0
        return weights @ member

    def best_two(self, y, corr, held_ids, held, weights=None, floor: float = 0.0):
        """Two lowest of the scores held so far and this slice's; a cluster that overlaps a point
        less than ``floor`` is not scored for it."""
        parts = []
        for a in range(0, len(y), ROWS_AT_ONCE):
            at = slice(a, a + ROWS_AT_ONCE)
            scores = self.scores(y[at], corr[at])
            if floor > 0:
                scores[self.overlap(weights[at]) < floor] = math.inf
            ids = np.concatenate([held_ids[at], np.broadcast_to(self.ids, scores.shape)], axis=1)
            parts.append(two_lowest(np.concatenate([held[at], scores], axis=1), ids, self.huge))
        return [np.concatenate(column) for column in zip(*parts)]


def lowest(scores: np.ndarray, ids: np.ndarray, huge: float, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the ``k`` lowest columns in order; ties go to the earlier column, none is -1."""
    n = len(scores)
    rows = np.arange(n)
    found = []
    left = np.where(np.isfinite(scores) & (scores < huge), scores, np.inf)
    for _ in range(k):
        if left.shape[1] == 0:
            found.append((np.full(n, -1), np.full(n, np.inf)))
            continue
        at = left.argmin(axis=1)
        value = left[rows, at]
        found.append((np.where(np.isfinite(value), ids[at] if ids.ndim == 1 else ids[rows, at], -1), value))
        left[rows, at] = np.inf
    return found


def two_lowest(scores: np.ndarray, ids: np.ndarray, huge: float):
    """Ids and scores of the best and second-best column."""
    one, two = lowest(scores, ids, huge, 2)
    return one + two
