"""Largest eigenpairs of a symmetric matrix by contour integration (FEAST) with inertia counts.

An interval's eigenvectors are what is left of a random block after a quadrature, along a circle through the ends of the
interval, of the solutions of (z I - V) X = Y at complex shifts z. Rayleigh-Ritz in that block extracts the pairs, and the
block is filtered again until their residuals are at rounding level. The number of eigenvalues above a shift is known
beforehand, from the signs of the pivots of V - shift (by Sylvester's law those of its tridiagonal form), so the intervals
are chosen to hold few eigenvalues each and none can be missed.

Everything here is about one matrix with as many rows as a vector has entries, whatever the number of vectors.
"""

import numpy as np

NODES = 8  # quadrature points on the upper half circle; the lower half are their conjugates
PER_INTERVAL = 8
ROUNDS = 10  # filterings before the block is widened
RESIDUAL = 1e-13  # relative to the largest eigenvalue
APART = 1e-9  # an end of an interval keeps this distance, relative to the largest eigenvalue, from any eigenvalue


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of an orthogonally similar tridiagonal matrix (Householder reflections)."""
    a = np.array(matrix, np.float64)
    for k in range(len(a) - 2):
        column = a[k + 1 :, k]
        if not np.any(column[1:]):
            continue
        v = column.copy()
        v[0] += np.copysign(np.linalg.norm(column), column[0])
        v /= np.linalg.norm(v)
        inner = a[k + 1 :, k + 1 :]
        p = inner @ v
        w = p - (v @ p) * v
        inner -= 2 * np.outer(v, w) + 2 * np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ column)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Inertia:
    """How many eigenvalues of a symmetric matrix lie above a shift."""

    def __init__(self, matrix: np.ndarray):
        self.diagonal, side = tridiagonal(matrix)
        self.squares = np.concatenate([[0.0], side * side])
        largest = max(np.abs(self.diagonal).max(), np.sqrt(self.squares.max()), np.finfo(float).tiny)
        self.least = np.finfo(float).eps ** 2 * largest

    def above(self, shift: float) -> int:
        count, pivot = 0, 1.0
        for a, b2 in zip(self.diagonal.tolist(), self.squares.tolist()):
            pivot = a - shift - b2 / pivot
            if abs(pivot) < self.least:
                pivot = -self.least
            count += pivot > 0
        return count

    def clear_end(self, shift: float, step: float) -> float:
        """The first of shift, shift - 3 steps, ... that no eigenvalue is within a step of."""
        for _ in range(4 * len(self.diagonal)):
            if self.above(shift - step) == self.above(shift + step):
                break
            shift -= 3 * step
        return shift


def interval_pairs(matrix: np.ndarray, low: float, high: float, count: int, scale: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs between low and high."""
    size = len(matrix)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (points + 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    shifted = [(centre + radius * turn) * np.eye(size) - matrix for turn in turns]
    rng = np.random.default_rng(seed)
    block = min(size, count + count // 2 + 4)
    vectors = rng.normal(size=(size, block))
    while True:
        best = np.inf
        for _ in range(ROUNDS):
            filtered = np.zeros((size, block))
            for turn, weight, system in zip(turns, weights, shifted):
                filtered += (weight / 2) * (radius * turn * np.linalg.solve(system, vectors.astype(complex))).real
            basis, _ = np.linalg.qr(filtered)
            values, mixed = np.linalg.eigh(basis.T @ matrix @ basis)
            vectors = basis @ mixed
            inside = (values > low) & (values <= high)
            if inside.sum() != count:
                continue
            rest = matrix @ vectors[:, inside] - vectors[:, inside] * values[inside]
            worst = np.linalg.norm(rest, axis=0).max(initial=0.0)
            if worst <= RESIDUAL * scale and worst >= best / 2:  # no longer getting better
                return values[inside], vectors[:, inside]
            best = min(best, worst)
        if block == size:
            raise ArithmeticError(f"{inside.sum()} of {count} eigenvalues between {low} and {high}, residual {best / scale}")
        # Many eigenvalues just outside: a wider block takes them in. One as wide as the matrix finds all there are.
        wider = min(size, 2 * block)
        vectors, block = np.hstack([vectors, rng.normal(size=(size, wider - block))]), wider


def largest_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Eigenvalues at rounding level below the largest one count as they come out; a zero matrix has zeros and unit vectors.
    """
    size = len(matrix)
    wanted = min(wanted, size)
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if scale == 0 or wanted == 0:
        return np.zeros(wanted), np.eye(size)[:, :wanted]
    counts = Inertia(matrix)
    top, step = scale * (1 + 1e-6), APART * scale
    low, high = -scale * 1e-6, top
    while high - low > 8 * step and counts.above(low) > wanted + 4:
        middle = (low + high) / 2
        low, high = (middle, high) if counts.above(middle) >= wanted else (low, middle)
    ends = [counts.clear_end(low, step), top]
    found = []
    while len(ends) > 1:  # the lowest interval first; crowded ones are halved
        low, high = ends[0], ends[1]
        count = counts.above(low) - counts.above(high)
        middle = counts.clear_end((low + high) / 2, step)
        if count > PER_INTERVAL and middle - low > 8 * step and high - low > 64 * step:
            ends.insert(1, middle)
            continue
        if count:
            found.append(interval_pairs(matrix, low, high, count, scale))
        ends.pop(0)
    # Rayleigh-Ritz over all intervals makes vectors of close intervals orthogonal to rounding level as well.
    basis, _ = np.linalg.qr(np.hstack([vectors for _, vectors in found]))
    values, mixed = np.linalg.eigh(basis.T @ matrix @ basis)
    if len(values) < wanted:
        raise ArithmeticError(f"{len(values)} of {wanted} eigenvalues found")
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = basis @ mixed[:, order]
    return values[order], vectors / np.linalg.norm(vectors, axis=0)
