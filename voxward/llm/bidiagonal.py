"""Singular values and right singular vectors of a small matrix: Householder bidiagonals, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues closer than this, relative to the larger one, get their vectors together.
_CLOSE = 1e-3


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right reflections V with matrix = U B V'. The matrix is square."""
    a = np.array(matrix, np.float64)
    n = len(a)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """Unit vector whose reflection leaves only the first entry of ``x``."""
        largest = np.abs(x).max(initial=0.0)
        if largest == 0 or not x[1:].any():
            return None
        v = x / largest
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1 :])
            if v is not None:
                a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference transform; also its d's, which are negative where the shift was too large."""
    n = len(q)
    new_q, new_e, ds = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    d = q[0] - shift
    for i in range(n - 1):
        ds[i] = d
        total = d + e[i]
        new_q[i] = total
        if total == 0:
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / total
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
    ds[-1] = new_q[-1] = d
    return new_q, new_e, ds


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, descending, each to high relative accuracy.

    Shifts are below the smallest value: one over the trace of the inverse, which the d's of a transform without shift
    give, so that no transform fails but by rounding.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    parts = [([float(x) for x in (diagonal / scale) ** 2], [float(x) for x in (above / scale) ** 2], 0.0)]
    found: list[float] = []
    while parts:
        q, e, moved = parts.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(moved + q[0])
                break
            # Entries too small to move any value by a rounding end a block.
            cut = next((i for i in reversed(range(n - 1)) if e[i] <= _EPS * _EPS * (moved + q[i]) or e[i] <= _EPS**2 * (moved + q[i + 1])), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:
                # The other end first: the same matrix read backwards.
                q, e = q[::-1], e[::-1]
            q, e, ds = _dqds_step(q, e, 0.0)
            if min(ds) <= 0:
                continue
            shift = 1 / sum(1 / d for d in ds)
            while shift > _EPS * moved:
                moved_q, moved_e, ds = _dqds_step(q, e, shift)
                if min(ds) >= 0:
                    q, e, moved = moved_q, moved_e, moved + shift
                    break
                shift *= 0.5
    return np.sort(np.array(found) * scale**2)[::-1]


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of B'B - value from both ends: multipliers down, multipliers up, and the twist pivots."""
    n = len(diagonal)
    q, e = diagonal**2, above**2
    off = diagonal[:-1] * above
    tiny = _EPS * _EPS * max(q.max(initial=0.0), e.max(initial=0.0), abs(value), np.finfo(np.float64).tiny)

    def safe(x: float) -> float:
        return x if abs(x) > tiny else np.copysign(tiny, x)

    down, up = np.zeros(n), np.zeros(n)
    lower, upper, pivot = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n)
    # Differential stationary form, from the top.
    s = -value
    for i in range(n - 1):
        down[i] = s
        d = safe(q[i] + s)
        lower[i] = off[i] / d
        s = s * (e[i] / d) - value
    down[-1] = s
    # Differential progressive form, from the bottom.
    p = q[-1] - value
    for i in reversed(range(n - 1)):
        up[i + 1] = p
        d = safe(e[i] + p)
        upper[i] = off[i] / d
        p = p * (q[i] / d) - value
    up[0] = p
    pivot[:] = down + up + value
    return lower, upper, pivot


def _solve(lower: np.ndarray, upper: np.ndarray, twist: int) -> np.ndarray:
    """The vector that the factorisation with this twist takes to a multiple of the twist's unit vector."""
    z = np.zeros(len(lower) + 1)
    z[twist] = 1.0
    for i in reversed(range(twist)):
        z[i] = -lower[i] * z[i + 1]
        if abs(z[i]) > 1e100:
            z /= abs(z[i])
    for i in range(twist, len(lower)):
        z[i + 1] = -upper[i] * z[i]
        if abs(z[i + 1]) > 1e100:
            z /= abs(z[i + 1])
    return z / np.linalg.norm(z)


def _vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors of B'B for its largest ``values``, descending, as rows.

    A value with no close neighbour gets the vector of its best twist. Close ones take different twists and are rotated to
    the eigenvectors of what they span. All are made orthogonal to those before.
    """
    n = len(diagonal)

    def product(z: np.ndarray) -> np.ndarray:
        y = diagonal * z
        y[:-1] += above * z[1:]
        out = diagonal * y
        out[1:] += above * y[:-1]
        return out

    out: list[np.ndarray] = []
    at = 0
    while at < len(values):
        end = at + 1
        while end < len(values) and values[end - 1] - values[end] <= _CLOSE * values[end - 1]:
            end += 1
        group: list[np.ndarray] = []
        used: set[int] = set()
        for value in values[at:end]:
            lower, upper, pivot = _twisted(diagonal, above, value)
            for twist in np.argsort(np.abs(pivot), kind="stable"):
                if int(twist) in used:
                    continue
                z = _solve(lower, upper, int(twist))
                for _ in range(3):
                    for other in (*out, *group):
                        z = z - (z @ other) * other
                    norm = np.linalg.norm(z)
                    if norm < 1e-6:
                        break
                    z /= norm
                if norm >= 1e-6:
                    used.add(int(twist))
                    group.append(z)
                    break
        if len(group) > 1:
            basis = np.array(group).T
            small = basis.T @ np.column_stack([product(z) for z in basis.T])
            _, turn = np.linalg.eigh((small + small.T) / 2)
            group = list((basis @ turn[:, ::-1]).T)
        out += group
        at = end
    return np.array(out).reshape(-1, n)


def right_singular(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of a square matrix, descending, and the right singular vectors of the largest, as rows.

    Vectors are unit, orthogonal, at most ``count``, and only for values that are not zero to rounding; of each vector
    the largest entry is positive.
    """
    diagonal, above, right = bidiagonalise(matrix)
    values = dqds(diagonal, above)
    floor = (len(values) * _EPS) ** 2 * values.max(initial=0.0)
    some = int((values[:count] > floor).sum())
    # Values close to the last one wanted belong to its group.
    end = some
    while end and end < len(values) and values[end] > floor and values[end - 1] - values[end] <= _CLOSE * values[end - 1]:
        end += 1
    if not some:
        return values, np.zeros((0, len(values)))
    vectors = (_vectors(diagonal, above, values[:end]) @ right.T)[:some]
    largest = np.abs(vectors).argmax(axis=1)
    return values, vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]
