"""Alternating least squares for factor models whose loadings are linear in characteristics.

The model of a date's moments is x_t = w_t G f_t. All steps are batched over dates; T x L x L numbers are all they need.
Factors are rows of (T, K + M) arrays: K latent ones, then M that are given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Estimate:
    gamma: np.ndarray  # (L, K + M)
    factors: np.ndarray  # (T, K + M)
    tol: float
    iters: int


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Batched a \\ b; least squares where a matrix is singular."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(a) @ b[..., None])[..., 0]


def initial(x: np.ndarray, k: int, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular vectors of the moments; loadings on given factors start at 0."""
    size, m = x.shape[1], given.shape[1]
    u, s, vt = np.linalg.svd(x.T, full_matrices=False)
    gamma = np.hstack([u[:, :k], np.zeros((size, m))])
    return gamma, np.hstack([(s[:k, None] * vt[:k]).T, given])


EPS = 16 * np.finfo(float).eps  # of the numbers that a sum is made of: below that it is rounding


def shortest(a: np.ndarray, b: np.ndarray, least: np.ndarray | float) -> np.ndarray:
    """The shortest least-squares solutions of batched symmetric a \\ b; eigenvalues up to ``least`` count as 0."""
    val, vec = np.linalg.eigh(a)
    known = val > np.asarray(least)[..., None]
    part = (vec.swapaxes(-1, -2) @ b[..., None])[..., 0]
    return (vec @ (np.where(known, part, 0) / np.where(known, val, 1))[..., None])[..., 0]


def factor_step(gamma: np.ndarray, x: np.ndarray, w: np.ndarray, given: np.ndarray, k: int) -> np.ndarray:
    """The latent factors of every date for loadings ``gamma``: regress what given factors leave of x on w gamma.

    Where that is singular, as on dates with fewer entities than factors, the shortest solution counts; elimination would
    divide one rounding error by another there.
    """
    if k == 0:
        return given
    latent, fixed = gamma[:, :k], gamma[:, k:]
    left = x - np.einsum("tlm,mj,tj->tl", w, fixed, given) if given.shape[1] else x
    a, b = np.einsum("lk,tlj->tkj", latent, w @ latent), left @ latent
    if k == 1:
        return np.hstack([solve(a, b), given])
    least = EPS * np.einsum("tll->t", w) * (latent**2).sum()
    low = np.flatnonzero(np.linalg.eigvalsh(a)[:, 0] <= least)
    few = shortest(a[low], b[low], least[low])
    a[low] = np.eye(k)
    out = solve(a, b)
    out[low] = few
    return np.hstack([out, given])


def normal_equations(factors: np.ndarray, x: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the regression of all dates' moments on their factors, each date weighted with its number of entities."""
    size, km = x.shape[1], factors.shape[1]
    outer = (n[:, None, None] * factors[:, :, None] * factors[:, None, :]).reshape(len(n), -1)
    a = (w.reshape(len(n), -1).T @ outer).reshape(size, size, km, km).transpose(0, 2, 1, 3).reshape(size * km, size * km)
    return a, (x.T @ (n[:, None] * factors)).ravel()


def loading_step(factors: np.ndarray, x: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The loadings for given factors. Where there are as many factors as characteristics, or more, the shortest solution counts."""
    a, b = normal_equations(factors, x, w, n)
    if factors.shape[1] >= x.shape[1]:
        return (np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b).reshape(x.shape[1], -1)
    least = EPS * np.trace(a)
    singular = np.isfinite(a).all() and np.linalg.eigvalsh(a)[0] <= least
    return (shortest(a, b, least) if singular else solve(a, b)).reshape(x.shape[1], -1)


def positive_means(gamma: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sign = np.where(factors.mean(axis=0) < 0, -1.0, 1.0)
    return gamma * sign, factors * sign


def normalise(gamma: np.ndarray, factors: np.ndarray, k: int, rows: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pick one of the equivalent pairs (gamma, factors).

    Default: orthonormal latent loadings, orthogonal latent factors in descending order of size with means not below 0.
    ``rows``: those characteristics load on one latent factor each, with 1. Either way loadings on given factors are made
    orthogonal to the latent ones and the latent factors take up the difference.
    """
    lf, gf, lg, gg = gamma[:, :k], gamma[:, k:], factors[:, :k], factors[:, k:]
    if rows is None:
        q, r = np.linalg.qr(lf)
        u, s, vt = np.linalg.svd(r @ lg.T, full_matrices=False)
        lf, lg = positive_means(q @ u, (s[:, None] * vt).T)
    else:
        turn = lf[rows]
        lf, lg = np.linalg.solve(turn.T, lf.T).T, lg @ turn.T
    if gf.shape[1]:
        shared = lf.T @ gf
        gf, lg = gf - lf @ shared, lg + gg @ shared.T
    if rows is None:
        lf, lg = positive_means(lf, lg)
    return np.hstack([lf, gf]), np.hstack([lg, gg])


def estimate(
    x: np.ndarray, w: np.ndarray, n: np.ndarray, k: int, given: np.ndarray | None = None, min_tol: float = 1e-4, max_iters: int = 5000,
    start: tuple[np.ndarray, np.ndarray] | None = None, rows: list[int] | None = None, gamma_only: bool = False,
) -> Estimate:
    """Alternate until neither loadings nor factors (``gamma_only``: loadings) change by more than ``min_tol``."""
    given = np.zeros((len(x), 0)) if given is None else given
    if k + given.shape[1] == 0:
        raise ValueError("there must be at least one factor")
    gamma, factors = start or initial(x, k, given)
    tol, iters = np.inf, 0
    while iters < max_iters and tol > min_tol:
        iters += 1
        new_f = factor_step(gamma, x, w, given, k)
        new_g = loading_step(new_f, x, w, n)
        if k:
            new_g, new_f = normalise(new_g, new_f, k, rows)
        tol = float(np.abs(new_g - gamma).max())
        if not gamma_only and factors.shape == new_f.shape:
            tol = max(tol, float(np.abs(new_f - factors).max()))
        gamma, factors = new_g, new_f
    return Estimate(gamma, factors, tol, iters)


TOGETHER = 80  # estimates whose next step is made in the same matrix products


def estimate_many(
    x: np.ndarray, w: np.ndarray, n: np.ndarray, k: int, given: np.ndarray | None = None, min_tol: float = 1e-4, max_iters: int = 5000,
) -> list[Estimate | None]:
    """``estimate`` for many moments ``x`` (B, T, L) that share w and n: the same steps, as matrix products over ``TOGETHER`` of them.

    One that comes to rest makes room for the next. None stands for one that is singular. Of symmetric products the upper
    half is made, dates come last in memory, and factors get their normal form where the loadings have come to rest, as no
    step needs it.
    """
    b_all, t_all, size = x.shape
    given = np.zeros((t_all, 0)) if given is None else given
    m = given.shape[1]
    km = k + m
    if k == 0:
        return [estimate(v, w, n, k, given, min_tol, max_iters) for v in x]
    out: list[Estimate | None] = [None] * b_all
    waiting = np.flatnonzero(np.isfinite(x).all(axis=(1, 2))).tolist()
    if not max_iters:
        for i in waiting:
            out[i] = Estimate(*initial(x[i], k, given), np.inf, 0)
        return out

    up, down = np.triu_indices(size)  # pairs of characteristics
    place = np.empty((size, size), dtype=int)
    place[up, down] = place[down, up] = np.arange(len(up))
    both = np.where(up == down, 0.5, 1.0)
    one, two = np.triu_indices(km)  # pairs of factors, those with a latent one first
    pair = np.empty((km, km), dtype=int)
    pair[one, two] = pair[two, one] = np.arange(len(one))
    needed = int((one < k).sum())
    half = w[:, up, down]
    flat = np.ascontiguousarray(half.T)
    weighted = np.column_stack([n[:, None] * half, np.ones(t_all)])  # the last column is for the second moments
    fixed = np.ascontiguousarray(given.T)
    traces = np.einsum("tll->t", w)

    slots = min(TOGETHER, len(waiting))
    xs, gamma = np.empty((slots, size, t_all)), np.empty((slots, size, km))
    raw, turn = np.empty((slots, km, t_all)), np.empty((slots, km, k))  # turned by ``turn``, the factors of the last step
    at, iters, moved = (np.zeros(slots, dtype=int) for _ in range(3))
    free = list(range(slots))
    while len(at):
        for i in free:
            at[i] = waiting.pop(0)
            gamma[i], f = initial(x[at[i]], k, given)
            xs[i], raw[i], turn[i], iters[i] = x[at[i]].T, f.T, np.eye(km, k), 0
        with np.errstate(all="ignore"):
            # factor_step: latent' w [latent, fixed] of all dates in one product
            gt = gamma.transpose(0, 2, 1)
            p, q = gt[:, one[:needed]], gt[:, two[:needed]]
            products = (p[..., up] * q[..., down] + p[..., down] * q[..., up]) * both
            a = (products.reshape(-1, len(up)) @ flat).reshape(-1, needed, t_all)
            right = gt[:, :k] @ xs
            for i in range(k):
                for j in range(m):
                    right[:, i] -= a[:, pair[i, k + j]] * fixed[j]
            new_f = np.empty((len(at), km, t_all))
            new_f[:, k:] = fixed
            _latent(a, right, pair[:k, :k], EPS * traces * (gt[:, :k] ** 2).sum(axis=(1, 2))[:, None], new_f[:, :k])
            # loading_step
            outer = np.empty((len(at), len(one), t_all))
            for c, (i, j) in enumerate(zip(one, two)):
                np.multiply(new_f[:, i], new_f[:, j], out=outer[:, c])
            sums = (outer.reshape(-1, t_all) @ weighted).reshape(-1, len(one), len(up) + 1)
            a = sums[:, pair[None, :, None, :], place[:, None, :, None]].reshape(-1, size * km, size * km)
            second, means = sums[:, pair[:k, :k], -1], new_f.mean(axis=2)
            peak = np.stack([outer[:, pair[i, i]].max(axis=1) for i in range(k)], axis=1)
            alone = ~(peak <= ALONE * (second.diagonal(axis1=1, axis2=2) - peak)).all(axis=1)
            new_g = _loadings(a, (xs @ (new_f * n).transpose(0, 2, 1)).reshape(-1, size * km), alone).reshape(-1, size, km)
            bad = ~(np.isfinite(new_g).all(axis=(1, 2)) & np.isfinite(second).all(axis=(1, 2)))
            if bad.any():
                new_g[bad], second[bad], means[bad] = np.eye(size, km), np.eye(k), 1.0
            new_g, new_turn = _normal_form(new_g, second, means, k)
        iters += 1
        tol = np.abs(new_g - gamma).max(axis=(1, 2))
        bad |= ~np.isfinite(tol)
        done = bad | (iters >= max_iters)
        # Where the loadings are at rest: the factors, first those of the date that was the last to move.
        rest = np.flatnonzero((tol <= min_tol) & ~bad)
        now, last = ((f[rest, :, moved[rest]][:, None] @ by[rest])[:, 0] for f, by in ((new_f, new_turn), (raw, turn)))
        rest = rest[(np.abs(now - last) <= min_tol).all(axis=1)]
        for i in np.union1d(rest, np.flatnonzero(done & ~bad)):
            factors = new_f[i].T @ new_turn[i]
            change = np.abs(factors - raw[i].T @ turn[i]).max(axis=1)
            moved[i] = change.argmax()
            tol[i] = max(tol[i], change[moved[i]])
            if tol[i] <= min_tol or done[i]:
                done[i] = True
                out[at[i]] = Estimate(new_g[i].copy(), np.hstack([factors, given]), float(tol[i]), int(iters[i]))
        gamma, raw, turn = new_g, new_f, new_turn
        free = np.flatnonzero(done).tolist()
        if len(free) > len(waiting):  # no more to come for some of them
            keep = np.ones(len(at), dtype=bool)
            keep[free[len(waiting) :]] = False
            xs, gamma, raw, turn, at, iters, moved = (v[keep] for v in (xs, gamma, raw, turn, at, iters, moved))
            free = free[: len(waiting)]  # the first ones stay where they are
    return out


def _latent(a: np.ndarray, b: np.ndarray, pair: np.ndarray, least: np.ndarray, out: np.ndarray) -> None:
    """Put the solutions (B, K, T) of all dates' equations, ``a`` (B, pairs, T), into ``out``; written out for one and two unknowns."""
    k = len(pair)
    if k == 1:
        whole = a[:, :1]
        out[:] = b / whole if whole.all() else np.where(whole == 0, 0.0, b / whole)
        return
    if k == 2:
        p, q, r = (a[:, pair[i, j]] for i, j in ((0, 0), (0, 1), (1, 1)))
        det = p * r - q * q
        low = np.flatnonzero(~(det > least * (p + r)))  # the product of the eigenvalues, of which the greater one is about the sum
        np.divide(r * b[:, 0] - q * b[:, 1], det, out=out[:, 0])
        np.divide(p * b[:, 1] - q * b[:, 0], det, out=out[:, 1])
    else:
        square = a[:, pair].transpose(0, 3, 1, 2)
        low = np.flatnonzero(~(np.linalg.eigvalsh(square)[..., 0] > least))
        square[np.unravel_index(low, least.shape)] = np.eye(k)
        out[:] = np.linalg.solve(square, b.transpose(0, 2, 1)[..., None])[..., 0].transpose(0, 2, 1)
    if len(low):
        which, date = np.divmod(low, least.shape[1])
        few, rest, least = a[which, :, date], b[which, :, date], least[which, date]
        if k == 2:
            p, q, r = (few[:, pair[i, j]] for i, j in ((0, 0), (0, 1), (1, 1)))
            found = np.stack([p * rest[:, 0] + q * rest[:, 1], q * rest[:, 0] + r * rest[:, 1]], axis=1) / ((p + r) ** 2)[:, None]
            found[p + r <= least] = 0.0
        else:
            found = shortest(few[:, pair], rest, least)
        out[which, :, date] = found


#: Where a date's factor squared is more than so many times the sum of all others, the loadings' equations may be singular.
ALONE = 1e6


def _loadings(a: np.ndarray, b: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """``a`` \\ ``b`` for each of the first axis, the shortest solutions where ``a`` is singular; NaN where it isn't finite."""
    out = np.full(b.shape, np.nan)
    whole = np.isfinite(a).all(axis=(1, 2))
    plain = np.flatnonzero(whole & ~alone)
    try:
        out[plain] = np.linalg.solve(a[plain], b[plain, :, None])[..., 0]
    except np.linalg.LinAlgError:
        alone = whole
    rest = np.flatnonzero(whole & alone)
    if len(rest):
        out[rest] = shortest(a[rest], b[rest], EPS * np.einsum("bii->b", a[rest]))
    return out


def _normal_form(gamma: np.ndarray, second: np.ndarray, means: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``normalise`` without ``rows`` for loadings (B, L, K + M) and the second moments of the latent factors and all factors' means.

    Returns the loadings and the (K + M, K) matrices by which the factors are to be multiplied to get the latent ones.
    """
    lf, gf = gamma[..., :k], gamma[..., k:]
    if k == 1:
        turn = np.sqrt((lf * lf).sum(axis=1, keepdims=True))
        lf = lf / turn
    else:
        q, r = np.linalg.qr(lf)
        rt = r.transpose(0, 2, 1)
        u = np.linalg.eigh(r @ second @ rt)[1][..., ::-1]
        lf, turn = q @ u, rt @ u

    def positive(loadings: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sign = np.where(means[:, None, : turn.shape[1]] @ turn < 0, -1.0, 1.0)
        return loadings * sign, turn * sign

    lf, turn = positive(lf, turn)
    if gf.shape[2]:
        shared = lf.transpose(0, 2, 1) @ gf
        gf = gf - lf @ shared
        lf, turn = positive(lf, np.concatenate([turn, shared.transpose(0, 2, 1)], axis=1))
    return np.concatenate([lf, gf], axis=2), turn


def var1(factors: np.ndarray) -> np.ndarray:
    """(K + M, K + M + 1): coefficients of factors on their previous values, the constant last."""
    past = np.hstack([factors[:-1], np.ones((len(factors) - 1, 1))])
    return np.linalg.lstsq(past, factors[1:], rcond=None)[0].T


def r2(real: np.ndarray, fit: np.ndarray, bench: np.ndarray | float = 0.0) -> float:
    return float(1 - ((real - fit) ** 2).sum() / ((real - bench) ** 2).sum())
