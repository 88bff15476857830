"""Eigenvalues and eigenvectors under rank-one updates.

A spectrum is a symmetric matrix as eigenvalues ``d`` (ascending) and eigenvectors ``q`` (columns). Adding ``rho * v v'`` turns
it into ``q (diag(d) + rho z z') q'`` with ``z = q' v``. The new eigenvalues are the roots of the secular equation
``1 + rho * sum z_i^2 / (d_i - x) = 0``, one in each gap of ``d`` and one above. Entries of ``z`` that vanish, and all but
one of equal ``d``, leave their eigenvalue as it is and are taken out first (deflation). The vectors come from the ``z`` for
which the computed roots are exact (Gu and Eisenstat 1994), so they stay orthogonal however close the roots lie.

A ``Scatter`` is the spectrum of a set of vectors around their own mean, with their number and mean: it takes one more
vector as one update, and another scatter as one update for each of its eigenvectors and one for the distance of the means.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
ROUNDS = 80


def _secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """For strictly ascending ``d``: the differences d_i - root_j, and the roots.

    Each root is held as an offset from its nearer pole, so a root next to a pole keeps all its digits.
    """
    k = len(d)
    # The last root lies at most rho z'z above the last pole, and there if it is the only one: leave it inside the bracket.
    above = np.append(d[1:], d[-1] + 1.25 * rho * z2.sum())
    gap = above - d
    # The sign in the middle of the gap tells which pole is nearer.
    middle = 1 + rho * (z2 / (d - (d + gap / 2)[:, None])).sum(axis=1)
    left = middle >= 0
    left[-1] = True
    origin = np.where(left, d, above)
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    pole = d - origin[:, None]
    at = (low + high) / 2
    before = np.arange(k)[None, :] <= np.arange(k)[:, None]
    open_ = np.arange(k)
    rz2 = rho * z2
    near, far = d - origin, above - origin
    for _ in range(ROUNDS):
        x = at[open_]
        t = pole[open_] - x[:, None]
        w = rz2 / t
        f = 1 + w.sum(axis=1)
        slope = w / t
        a_slope = (slope * before[open_]).sum(axis=1)
        b_slope = slope.sum(axis=1) - a_slope
        low[open_] = np.where(f < 0, x, low[open_])
        high[open_] = np.where(f > 0, x, high[open_])
        lo, hi = low[open_], high[open_]
        # One rational step on each side's poles (the middle way of Li 1994), bisection where it leaves the bracket.
        da, db = near[open_] - x, far[open_] - x
        c = f - da * a_slope - db * b_slope
        a = (da + db) * f - da * db * (a_slope + b_slope)
        b = da * db * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        bad = ~np.isfinite(new) | (new <= lo) | (new >= hi)
        new[bad] = (lo[bad] + hi[bad]) / 2
        small = (np.abs(f) <= 4 * EPS * k * (1 + np.abs(w).sum(axis=1))) | (hi - lo <= 4 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        at[open_] = np.where(small, x, new)
        open_ = open_[~small]
        if not len(open_):
            break
    return pole.T - at[None, :], origin + at


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``q diag(d) q' + rho v v'`` for ``rho >= 0``; ``d`` ascending."""
    z = q.T @ v
    size = float(np.sqrt(z @ z))
    if rho * size * size <= 0 or not len(d):
        return d, q
    scale = max(abs(float(d[-1])), rho * size * size)
    tiny = 8 * EPS * scale
    near = np.diff(d) <= tiny
    if near.any():
        # Equal eigenvalues span a space in which any basis will do: one that has all of z in its last vector.
        q, z, start = q.copy(), z.copy(), 0
        for end in range(1, len(d) + 1):
            if end < len(d) and near[end - 1]:
                continue
            if end - start > 1:
                part = z[start:end]
                length = float(np.sqrt(part @ part))
                if length > 0:
                    w = part.copy()
                    w[-1] += length if w[-1] >= 0 else -length
                    w /= np.sqrt(w @ w)
                    block = q[:, start:end]
                    q[:, start:end] = block - 2 * np.outer(block @ w, w)
                    last = part[-1] - 2 * w[-1] * (w @ part)
                    z[start:end] = 0.0
                    z[end - 1] = last
            start = end
    active = rho * np.abs(z) * size > tiny
    at = np.flatnonzero(active)
    if not len(at):
        return d, q
    da, za = d[at], z[at]
    diff, roots = _secular_roots(da, za * za, rho)
    # The z for which these roots are exact: products of ratios that stay near one.
    apart = da[:, None] - da[None, :]
    np.fill_diagonal(apart, 1.0)
    exact = np.sqrt(np.abs(np.prod(diff / apart, axis=1)) / rho)
    w = np.copysign(exact, za)[:, None] / diff
    w /= np.sqrt((w * w).sum(axis=0))
    d, q = d.copy(), q.copy()
    d[at] = roots
    q[:, at] = q[:, at] @ w
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Scatter:
    """Number, mean, and spectrum of the sum of (x - mean)(x - mean)'."""

    def __init__(self, dims: int):
        self.n, self.mean = 0, np.zeros(dims)
        self.d, self.q = np.zeros(dims), np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.n += 1
        if self.n > 1:
            self.d, self.q = rank_one(self.d, self.q, away, (self.n - 1) / self.n)
        self.mean = self.mean + away / self.n

    def join(self, other: Scatter) -> None:
        """Take in another set's scatter, one of its eigenvectors after the other."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.d, self.q = other.n, other.mean, other.d, other.q
            return
        for value, vector in zip(other.d, other.q.T, strict=True):
            if value > 0:
                self.d, self.q = rank_one(self.d, self.q, vector, float(value))
        away, n = other.mean - self.mean, self.n + other.n
        self.d, self.q = rank_one(self.d, self.q, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.n = n

    def packed(self) -> tuple[int, bytes, bytes, bytes]:
        return self.n, self.mean.tobytes(), self.d.tobytes(), np.ascontiguousarray(self.q).tobytes()

    @classmethod
    def unpacked(cls, n: int, mean: bytes, d: bytes, q: bytes) -> Scatter:
        dims = len(mean) // 8
        out = cls(0)
        out.n, out.mean, out.d = n, np.frombuffer(mean, float), np.frombuffer(d, float)
        out.q = np.frombuffer(q, float).reshape(dims, dims)
        return out
