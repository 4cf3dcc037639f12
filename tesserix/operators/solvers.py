"""Linear solves by preconditioned conjugate gradients, and trace estimates.

Vectors are NumPy arrays on the driver; a step costs one or two products on the cluster.  Several
right-hand sides are solved together, so that they share each scan of the matrix.
"""

from __future__ import annotations

import numpy as np

from .matrix import MarkerMatrix


def normal_operator(matrix: MarkerMatrix, tau: float, gamma: float):
    """v -> tau A'A v + gamma v."""

    def apply(v: np.ndarray) -> np.ndarray:
        if not v.any():
            return np.zeros_like(v)
        return tau * matrix.transpose_times(matrix.times(v)) + gamma * v

    return apply


def sample_operator(matrix: MarkerMatrix, tau: float, gamma: float):
    """u -> tau A A'u + gamma u."""

    def apply(u: np.ndarray) -> np.ndarray:
        if not u.any():
            return np.zeros_like(u)
        return tau * matrix.times(matrix.transpose_times(u)) + gamma * u

    return apply


def conjugate_gradient(apply, b: np.ndarray, diagonal, start: np.ndarray | None = None, rounds: int = 60, tolerance: float = 1e-5):
    """x with apply(x) = b, and the rounds used; columns of ``b`` are separate systems that stop
    by themselves once their residual is below ``tolerance`` of b."""
    x = np.zeros_like(b) if start is None else start.copy()
    r = b - apply(x)
    d = np.asarray(diagonal, float).reshape(-1, *[1] * (b.ndim - 1))
    z = r / d
    p, rz = z.copy(), (r * z).sum(axis=0)
    size = np.sqrt((b * b).sum(axis=0))
    used = 0
    for used in range(1, rounds + 1):
        if np.all(np.sqrt((r * r).sum(axis=0)) <= tolerance * size):
            return x, used - 1
        ap = apply(p)
        pap = (p * ap).sum(axis=0)
        step = np.where(pap > 0, rz / np.where(pap > 0, pap, 1), 0.0)
        x, r = x + step * p, r - step * ap
        z = r / d
        new = (r * z).sum(axis=0)
        p, rz = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0) * p, new
    return x, used


def marker_diagonal_value(matrix: MarkerMatrix, tau: float, gamma: float) -> float:
    """The diagonal of tau A'A + gamma, whose entries are the same for all markers."""
    return tau * (matrix.n_samples - 1) / matrix.n_samples + gamma


def marker_diagonal(matrix: MarkerMatrix, tau: float, gamma: float) -> np.ndarray:
    return np.full(matrix.n_markers, marker_diagonal_value(matrix, tau, gamma))


def signs(n: int, seed: int = 1, index: np.ndarray | None = None) -> np.ndarray:
    """n signs over sqrt(n), each a function of its index and the seed alone; or those at ``index``."""
    k = (np.arange(n) if index is None else index).astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    k = (k ^ (k >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    k = (k ^ (k >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (1.0 - 2.0 * ((k >> np.uint64(40)) & np.uint64(1)).astype(float)) / np.sqrt(n)


def lmmse(matrix: MarkerMatrix, tau: float, gamma: float, target: np.ndarray, r2: np.ndarray, start=None, rounds: int = 60, seed: int = 1):
    """(x, alpha, probe, solved probe) of (tau A'A + gamma) x = tau A' target + gamma r2.

    ``alpha``, gamma times the mean of the inverse's diagonal, is estimated with a random sign
    vector, whose system is solved along with the other.
    """
    probe = signs(matrix.n_markers, seed)
    b = np.stack([tau * matrix.transpose_times(target) + gamma * r2, probe], axis=1)
    begin = None if start is None else np.stack([start, np.zeros_like(start)], axis=1)
    solved, _ = conjugate_gradient(normal_operator(matrix, tau, gamma), b, marker_diagonal(matrix, tau, gamma), begin, rounds)
    return solved[:, 0], gamma * float(probe @ solved[:, 1]), probe, solved[:, 1]


#: Markers up to which A'A is put together and decomposed on the driver: 32 MB of doubles.
GRAM_MARKERS = 2048


class Gram:
    """A'A of few markers, decomposed once: its eigenvectors solve for any tau and gamma, and for any
    number of right-hand sides, without another pass over the matrix."""

    def __init__(self, matrix: MarkerMatrix):
        rows, m = matrix.gram().toArrow(), matrix.n_markers
        self.matrix, whole = matrix, np.zeros((m, m))
        whole[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["value"].to_numpy()
        self.whole = whole + np.triu(whole, 1).T
        self.values, self.vectors = np.linalg.eigh(self.whole)

    def solve(self, tau: float, gamma: float, b: np.ndarray) -> np.ndarray:
        """x of (tau A'A + gamma) x = b."""
        return self.vectors @ ((self.vectors.T @ b).T / (tau * np.maximum(self.values, 0.0) + gamma)).T

    def lmmse(self, tau: float, gamma: float, target: np.ndarray, r2: np.ndarray, seed: int = 1):
        """As :func:`lmmse`, but exact."""
        probe = signs(self.matrix.n_markers, seed)
        solved = self.solve(tau, gamma, np.stack([tau * self.matrix.transpose_times(target) + gamma * r2, probe], axis=1))
        return solved[:, 0], gamma * float(probe @ solved[:, 1]), probe, solved[:, 1]


def probe_trace(matrix: MarkerMatrix, tau: float, gamma: float, rounds: int = 60, seed: int = 1, gram: Gram | None = None):
    """(alpha, probe, solved probe) as :func:`lmmse` has them, without the other system.  With ``gram``
    the same rounds multiply by A'A and pass over no samples."""
    probe = signs(matrix.n_markers, seed)
    apply = normal_operator(matrix, tau, gamma) if gram is None else lambda v: tau * (gram.whole @ v) + gamma * v
    solved, _ = conjugate_gradient(apply, probe, marker_diagonal(matrix, tau, gamma), None, rounds)
    return gamma * float(probe @ solved), probe, solved


def conjugate_gradient_by_segments(matrix: MarkerMatrix, tau: float, gamma: float, b: np.ndarray, diagonal: np.ndarray, start=None, rounds: int = 60, tolerance: float = 1e-5):
    """As :func:`conjugate_gradient` of :func:`sample_operator`, with one pass a round over a matrix whose
    tasks have whole segments: A'p of the next direction follows from what the pass adds up."""
    x = np.zeros_like(b) if start is None else start.copy()
    r = b - sample_operator(matrix, tau, gamma)(x)
    z = r / diagonal
    p, rz, size = z.copy(), float(r @ z), np.sqrt(float(b @ b))
    back = w = None
    used = 0
    for used in range(1, rounds + 1):
        if np.sqrt(float(r @ r)) <= tolerance * size:
            return x, used - 1
        if w is None:
            back = w = matrix.transpose_times(p)
        q, moved = matrix.samples_step(p, diagonal, w, tau, gamma)
        pq = float(p @ q)
        step = rz / pq if pq > 0 else 0.0
        x, r, back = x + step * p, r - step * q, back - step * moved
        z = r / diagonal
        new = float(r @ z)
        beta = new / rz if rz > 0 else 0.0
        p, w, rz = z + beta * p, back + beta * w, new
    return x, used


def lmmse_by_samples(matrix: MarkerMatrix, tau: float, gamma: float, target: np.ndarray, r2: np.ndarray, start=None, rounds: int = 60):
    """The same x by way of (tau A A' + gamma) u = target - A r2; smaller if N < M.  Also u."""
    b, diagonal = target - matrix.times(r2), tau * matrix.sample_diagonal() + gamma
    if getattr(matrix, "by_segment", False):
        u, _ = conjugate_gradient_by_segments(matrix, tau, gamma, b, diagonal, start, rounds, 1e-4)
    else:
        u, _ = conjugate_gradient(sample_operator(matrix, tau, gamma), b, diagonal, start, rounds, 1e-4)
    return r2 + tau * matrix.transpose_times(u), u
