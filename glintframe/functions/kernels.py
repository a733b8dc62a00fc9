"""Numpy kernels for what has no sensible relational form: transforms and solvers.

Traces are rows of a matrix, images two-dimensional arrays.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)


# --- traces ---------------------------------------------------------------


def fft_filter(x: np.ndarray, freq: float, kind: str) -> np.ndarray:
    """Without the frequencies from freq on ("low") or below it ("high")."""
    f, cut = np.fft.rfft(x, axis=1), int(freq * x.shape[1])
    f[:, cut:] = 0 if kind == "low" else f[:, cut:]
    if kind == "high":
        f[:, :cut] = 0
    return np.fft.irfft(f, x.shape[1], axis=1)


def butterworth(freq: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Second-order coefficients by the bilinear transform; freq 0.5 is Nyquist's."""
    k = math.tan(math.pi * freq)
    scale = 1 + math.sqrt(2) * k + k * k
    b = np.array([k * k, 2 * k * k, k * k]) if kind == "low" else np.array([1.0, -2.0, 1.0])
    return b / scale, np.array([1.0, 2 * (k * k - 1) / scale, (1 - math.sqrt(2) * k + k * k) / scale])


def causal_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The rational filter b / a, all rows at once, from rest."""
    y, n = np.zeros_like(x, dtype=float), len(b)
    for t in range(x.shape[1]):
        for k in range(min(n, t + 1)):
            y[:, t] += b[k] * x[:, t - k] - (a[k] * y[:, t - k] if k else 0)
    return y


def butter_filter(x: np.ndarray, freq: float, kind: str) -> np.ndarray:
    return causal_filter(*butterworth(freq, kind), x)


def smooth(x: np.ndarray, freq: float, method: str = "fft", kind: str = "low") -> np.ndarray:
    if method not in ("fft", "butter"):
        raise ValueError(f"unknown smoothing {method}")
    return (fft_filter if method == "fft" else butter_filter)(x, freq, kind)


def _summary(p: np.ndarray, method: str, eps: float = 0.0) -> np.ndarray:
    if not p.shape[1]:
        return np.full(len(p), np.nan)
    if method == "logmexp":
        return np.sqrt(np.exp(np.log(p + eps).mean(1)))
    return np.sqrt({"mean": p.mean, "median": lambda axis: np.median(p, axis=axis), "sum": p.sum}[method](axis=1))


def noise_fft(x: np.ndarray, low: float, high: float, method: str = "logmexp") -> np.ndarray:
    """Noise level from the power in a band of frequencies."""
    t = x.shape[1]
    a, b = (int(np.around(r * t)) for r in (low, high))
    return _summary(np.abs(np.fft.rfft(x, axis=1)[:, a:b]) ** 2 / t, method, EPS)


def noise_welch(x: np.ndarray, low: float, high: float, method: str = "logmexp", segment: int = 256) -> np.ndarray:
    """The same from a one-sided Welch density: Hann windows, half overlapping, means removed."""
    n = min(segment, x.shape[1])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.stack([x[:, s : s + n] for s in range(0, x.shape[1] - n + 1, max(n - n // 2, 1))])
    p = (np.abs(np.fft.rfft((parts - parts.mean(2, keepdims=True)) * w, axis=2)) ** 2).mean(0) / (w * w).sum()
    p[:, 1 : -1 if n % 2 == 0 else None] *= 2
    f = np.arange(n // 2 + 1) / n
    return _summary(p[:, (f > low) & (f < high)] / 2, method)


def ptp(x: np.ndarray, q: tuple[float, float]) -> np.ndarray:
    """Distance of two percentiles."""
    return np.percentile(x, q[1], axis=1) - np.percentile(x, q[0], axis=1)


def peak_to_noise(x: np.ndarray, freq: float, q: tuple[float, float] = (0.1, 99.9)) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return ptp(x, q) / ptp(fft_filter(x, freq, "high"), q)


def _one_sided(n: int, d: float) -> float:
    """P(D+ >= d) of n uniform values, by Smirnov's sum; all terms are positive."""
    j = np.arange(int(n * (1 - d)) + 1)
    rest = 1 - d - j / n
    j, rest = j[rest > 0], rest[rest > 0]
    log = np.vectorize(math.lgamma)
    terms = log(n + 1) - log(j + 1) - log(n - j + 1) + (j - 1) * np.log(d + j / n) + (n - j) * np.log(rest)
    return float(d * np.exp(terms).sum())


def kolmogorov(n: int, d: float) -> float:
    """P(D >= d) of the Kolmogorov-Smirnov statistic of n values, both sides.

    By Durbin's matrix power: with k = ceil(nd), the numbers of values in cells of
    width 1 / n are walked through n times; nothing is subtracted, so that the
    distribution is right to rounding. Far out (n d^2 >= 4), where both sides can't
    be exceeded together to ten digits of the rest, it is twice the one-sided sum."""
    if not d > 0.5 / n:
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d >= 4 or d >= 0.5:
        return min(1.0, 2 * _one_sided(n, d))
    k = int(n * d) + 1
    h, m = k - n * d, 2 * k - 1
    step = np.subtract.outer(np.arange(m), np.arange(m)) + 1  # cells left, less those entered
    walk = np.where(step >= 0, 1.0, 0.0)
    ends = h ** np.arange(1.0, m + 1)
    walk[:, 0] -= ends
    walk[-1, :] -= ends[::-1]
    walk[-1, 0] += max(2 * h - 1, 0.0) ** m
    walk = walk * np.exp(-np.array([math.lgamma(max(x, 0) + 1) for x in range(-m, m + 2)])[step + m])
    out, power, shift, left = np.eye(m)[k - 1], 0.0, 0.0, n  # the row of the walk's start; logarithms of scales taken out
    while left:
        if left & 1:
            out, power = out @ walk, power + shift
            top = out.max()
            out, power = out / top, power + math.log(top)
        left >>= 1
        if left:
            walk, shift = walk @ walk, 2 * shift
            top = walk.max()
            walk, shift = walk / top, shift + math.log(top)
    return float(np.clip(1 - out[k - 1] * math.exp(power + math.lgamma(n + 1) - n * math.log(n)), 0.0, 1.0))


def normality(x: np.ndarray) -> np.ndarray:
    """Exact p-value of the Kolmogorov-Smirnov test of each standardised row against the
    normal distribution."""
    n = x.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.sort((x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True), axis=1)
    cdf = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    at = np.arange(n)
    d = np.maximum((cdf - at / n).max(1), ((at + 1) / n - cdf).max(1))
    return np.array([np.nan if np.isnan(v) else kolmogorov(n, float(v)) for v in d])


def above_baseline(x: np.ndarray, window: int) -> np.ndarray:
    """What exceeds a running median (an even window takes the upper of the middle
    values and lies further back), edges reflected."""
    padded = np.pad(x, ((0, 0), (window // 2, (window - 1) // 2)), mode="symmetric")
    middle = np.partition(np.lib.stride_tricks.sliding_window_view(padded, window, axis=1), window // 2, axis=2)[..., window // 2]
    return np.maximum(x - middle, 0)


def autocovariance(x: np.ndarray, lags: int) -> np.ndarray:
    """Biased, of centred rows, for lags 0 to `lags`."""
    c, t = x - x.mean(1, keepdims=True), x.shape[1]
    return np.stack([(c[:, : t - k] * c[:, k:]).sum(1) / t if k < t else np.zeros(len(x)) for k in range(lags + 1)], axis=1)


def ar_coefficients(x: np.ndarray, sn: np.ndarray, p: int, add_lag: int | str = "p") -> np.ndarray:
    """Autoregressive coefficients by least squares on lagged covariances, the noise
    variance taken off lag 0."""
    lags = 2 * p if add_lag == "p" else p + int(add_lag)
    cov, out = autocovariance(x, lags), np.zeros((len(x), p))
    i, j = np.arange(lags)[:, None], np.arange(p)[None]
    for r in range(len(x)):
        m = cov[r][np.abs(i - j)] - sn[r] ** 2 * np.eye(lags, p)
        out[r] = np.linalg.lstsq(m, cov[r, 1 : lags + 1], rcond=None)[0]
    return out


# --- solvers --------------------------------------------------------------


def lsqr(a: np.ndarray, y: np.ndarray, iterations: int = 10) -> np.ndarray:
    """Conjugate gradients on the normal equations from 0, all columns of y at once;
    in exact arithmetic the iterates of LSQR."""
    x = np.zeros((a.shape[1], y.shape[1]))
    r = y.copy()
    s = a.T @ r
    d, norm = s.copy(), (s * s).sum(0)
    for _ in range(iterations):
        q = a @ d
        size = (q * q).sum(0)
        step = np.divide(norm, size, out=np.zeros_like(norm), where=size > 1e-300)
        x, r = x + step * d, r - step * q
        s = a.T @ r
        new = (s * s).sum(0)
        d = s + np.divide(new, norm, out=np.zeros_like(new), where=norm > 1e-300) * d
        norm = new
        if norm.max(initial=0) < 1e-24:
            break
    return x


def positive_lasso(x: np.ndarray, y: np.ndarray, alpha: float, sweeps: int = 500, tol: float = 1e-9) -> np.ndarray:
    """w >= 0 that minimises |y - xw - c|^2 / 2T + alpha * sum(w), with intercept c:
    coordinate descent on centred data."""
    x, y = x - x.mean(0), y - y.mean()
    return positive_lasso_of(x.T @ x / len(y), x.T @ y / len(y), alpha, sweeps, tol)


def positive_lasso_of(gram: np.ndarray, want: np.ndarray, alpha: float, sweeps: int = 500, tol: float = 1e-9) -> np.ndarray:
    """The same from the covariances of x and those of x with y."""
    w, grad = np.zeros(len(want)), -want.copy()
    for _ in range(sweeps):
        most = 0.0
        for k in range(len(w)):
            if gram[k, k] <= 0:
                continue
            new = max(0.0, w[k] - (grad[k] + alpha) / gram[k, k])
            if new != w[k]:
                grad += gram[:, k] * (new - w[k])
                most = max(most, abs(new - w[k]))
                w[k] = new
        if most < tol * max(1.0, np.abs(w).max()):
            break
    return w


def _apply(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """s = Gc: what the autoregression doesn't explain."""
    s = c.copy()
    for k, gk in enumerate(g, 1):
        s[k:] -= gk * c[:-k]
    return s


def _generate(g: np.ndarray, s: np.ndarray) -> np.ndarray:
    c = s.copy()
    for t in range(1, len(c)):
        for k, gk in enumerate(g, 1):
            if t >= k:
                c[t] += gk * c[t - k]
    return c


def _generate_back(g: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Transpose of _generate."""
    return _generate(g, r[::-1])[::-1]


def _rows_generate(g: np.ndarray, s: np.ndarray, back: bool = False) -> np.ndarray:
    """Rows c with Gc = s, each with its coefficients g; back: by G's transpose."""
    c = s[:, ::-1].copy() if back else s.copy()
    for t in range(1, c.shape[1]):
        for k in range(1, min(g.shape[1], t) + 1):
            c[:, t] += g[:, k - 1] * c[:, t - k]
    return c[:, ::-1] if back else c


def _rows_apply(g: np.ndarray, c: np.ndarray, back: bool = False) -> np.ndarray:
    """Rows Gc, or of G's transpose."""
    x = c[:, ::-1] if back else c
    s = x.copy()
    for k in range(1, g.shape[1] + 1):
        s[:, k:] -= g[:, k - 1 : k] * x[:, :-k]
    return s[:, ::-1] if back else s


def solve_banded(diagonals: list[np.ndarray], rhs: np.ndarray) -> np.ndarray:
    """Solutions of n symmetric positive definite systems of bandwidth p, as (n, t, m) for
    m right-hand sides each; diagonals[k][:, i] is the entry (i, i + k). An LDL
    factorisation, row after row, of all systems at once."""
    n, t = diagonals[0].shape
    p = len(diagonals) - 1
    d, low = np.zeros((t, n)), np.zeros((p, t, n))  # low[k - 1][i]: the factor's entry (i, i - k)
    a, x = [np.ascontiguousarray(v.T) for v in diagonals], np.ascontiguousarray(rhs.transpose(1, 0, 2))
    for i in range(t):
        most = min(p, i)
        for k in range(most, 0, -1):
            v = a[k][i - k].copy()
            for j in range(k + 1, most + 1):
                v -= low[j - 1, i] * low[j - k - 1, i - k] * d[i - j]
            low[k - 1, i] = v / d[i - k]
        here = a[0][i].copy()
        for k in range(1, most + 1):
            here -= low[k - 1, i] ** 2 * d[i - k]
            x[i] -= low[k - 1, i][:, None] * x[i - k]
        d[i] = here
    x /= d[:, :, None]
    for i in range(t - 1, -1, -1):
        for k in range(1, min(p, t - 1 - i) + 1):
            x[i] -= low[k - 1, i + k][:, None] * x[i + k]
    return x.transpose(1, 0, 2)


def decays(g: np.ndarray, t: int) -> np.ndarray:
    """Rows of the decay of a start that lies before the first frame: the powers of the
    largest real part of the autoregression's roots, between 0 and 1."""
    top = [float(np.clip(np.roots(np.concatenate(([1.0], -x))).real.max(initial=0.0), 0.0, 0.999999)) for x in g]
    return np.array(top)[:, None] ** np.arange(t)


def deconvolve_rows(y: np.ndarray, g: np.ndarray, lam: np.ndarray, segments: np.ndarray | None = None, zero: float | None = 1e-8, steps: int = 80, gap: float = 1e-11) -> tuple[np.ndarray, ...]:
    """(c, s, b, c0, u) for each row of y: the calcium trace with non-negative spikes s = Gc, a
    baseline b >= min(y), one value for each of the segments (numbers of frames; none:
    one), and a decaying start c0 >= 0, that minimise |y - c - b - c0| + lam * sum(s),
    the norm not squared; and u, which proves it (see deconvolution_bound).

    A primal-dual interior-point method over a second-order cone, |y - c - b - c0| <= top, in the
    scaling of Nesterov and Todd, with Mehrotra's corrections: where nothing of y stays
    unexplained, the norm has no gradient, but the cone has its dual. In c, the system
    of a step is banded, as G is, beside a few dense columns (baseline, start) and a
    rank-one part of the cone, so that a step's work is linear in the frames; all rows
    take their steps together. u is the cone's dual variable. What is below `zero` is returned as 0,
    baselines and traces too; with None the solution comes as it is. Rows that
    aren't finite, or of under 3 frames, give zeros, flat ones their baseline alone.
    """
    n, t = y.shape
    part = np.zeros(t, dtype=int) if segments is None else np.asarray(segments, dtype=int)
    m = int(part.max(initial=0)) + 1
    out = [np.zeros((n, t)) for _ in range(5)]
    good = np.isfinite(y).all(axis=1) & np.isfinite(g).all(axis=1) & np.isfinite(lam) & (t >= 3)
    flat = good & (np.ptp(np.where(good[:, None], y, 0.0), axis=1) <= 1e-12 * np.abs(np.where(good[:, None], y, 0.0)).max(axis=1))
    clean = lambda v: v if zero is None else np.where(v > zero, v, 0.0)
    out[2][flat] = clean(y[flat])
    todo = np.flatnonzero(good & ~flat)
    if not len(todo):
        return tuple(out)
    y, g, lam = y[todo], g[todo], np.maximum(lam[todo], 1e-12)
    n, low = len(todo), y.min(axis=1)
    more = np.zeros((n, t, m + 1))  # the baseline's columns, and the start's
    more[:, np.arange(t), part], more[:, :, m] = 1.0, decays(g, t)
    size = np.linalg.norm(y - low[:, None], axis=1)[:, None]
    goal, weight = (y - low[:, None]) / size, lam[:, None]  # of length 1; the objective is in units of it
    taps = np.concatenate((np.ones((n, 1)), -g), axis=1)
    across, along = (lambda x: np.einsum("ntm,nm->nt", more, x)), (lambda r: np.einsum("ntm,nt->nm", more, r))
    unit = 1 / np.sqrt(t)
    s, x = np.full((n, t), 0.1 * unit), np.full((n, m + 1), 0.5 * unit)
    z, zx = np.repeat(0.5 * weight, t, axis=1) + 1e-3, np.full((n, m + 1), 0.1)
    c = _rows_generate(g, s)
    r, u = goal - c - across(x), np.zeros((n, t))
    top = 1.1 * np.linalg.norm(r, axis=1) + 0.1  # (top, r) is in the cone, and (1, -u) in its dual
    dot = lambda v, w: (v * w).sum(1)
    inside = lambda v0, v1: np.maximum((v0 - (l := np.linalg.norm(v1, axis=1))) * (v0 + l), 1e-300)
    best, whole = [v.copy() for v in (s, x, u)], (g, more)  # each row's best point so far; what all rows have
    mine, idle, least = np.arange(n), np.zeros(n, dtype=int), np.full(n, np.inf)
    old = np.seterr(all="ignore")
    for _ in range(steps):
        slack = dot(s, z) + dot(x, zx) + top - dot(r, u)
        off = np.maximum(np.abs(_rows_apply(g, weight - z, back=True) - u).max(1), np.abs(along(u) + zx).max(1))
        far = np.nan_to_num(np.maximum(slack / gap, off / 1e-10), nan=np.inf)
        better, idle = far < least, np.where(far < 0.9 * least, 0, idle + 1)
        least = np.minimum(least, far)
        for b, v in zip(best, (s, x, u)):
            b[mine[better]] = v[better]
        live = (far > 1) & ((idle < 6) | (least > 1e4))  # rows at the end of their digits stop, too
        if not live.any():
            break
        if not live.all():
            s, x, z, zx, u, c, r, top, g, goal, weight, taps, more, slack, mine, idle, least = (v[live] for v in (s, x, z, zx, u, c, r, top, g, goal, weight, taps, more, slack, mine, idle, least))
            n = len(mine)
        mu = slack / (t + m + 2)
        # the point (q0, q1) of the cone that scales both sides to (l0, l1)
        jw, jz = np.sqrt(inside(top, r)), np.sqrt(inside(np.ones(n), u))
        q0, q1 = top / jw + 1 / jz, r / jw[:, None] + u / jz[:, None]
        length = np.sqrt(2 * (1 + (top - dot(r, u)) / (jw * jz)))
        q0, q1, eta = q0 / length, q1 / length[:, None], np.sqrt(jw / jz)

        def scaled(v0: np.ndarray, v1: np.ndarray, sign: float) -> tuple[np.ndarray, np.ndarray]:
            """W v, or, with sign -1, its inverse's."""
            k, by = dot(q1, v1), eta**sign
            return by * (q0 * v0 + sign * k), by[:, None] * (v1 + q1 * (sign * v0 + k / (1 + q0))[:, None])

        l0, l1 = scaled(np.ones(n), -u, 1.0)
        heavy, diagonals = z / s, []
        for j in range(g.shape[1] + 1):
            line = np.zeros((n, t))
            for k in range(g.shape[1] - j + 1):
                line[:, : t - j - k] += taps[:, j + k, None] * taps[:, k, None] * heavy[:, j + k :]
            diagonals.append(line)
        wide, bend = eta[:, None, None] ** 2, 2 / (2 * q0**2 - 1)
        diagonals[0] = diagonals[0] + 1 / wide[:, :, 0]
        pull = along(q1)
        lean = lambda dc, dx: dot(q1, dc) + dot(pull, dx)
        cols = bent = None

        def direction(aim: np.ndarray, fix: np.ndarray, fixx: np.ndarray, f0: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, ...]:
            """The step to where products are aim, once fix (and fixx, f0 and f1) are taken off."""
            nonlocal cols, bent, dense, bentx
            d0, d1 = aim - l0**2 - dot(l1, l1) - f0, -2 * l0[:, None] * l1 - f1
            p0 = (l0 * d0 - dot(l1, d1)) / inside(l0, l1)
            h0, h1 = scaled(p0, (d1 - p0[:, None] * l1) / l0[:, None], -1.0)
            h1 = h1 + (bend * q0 * h0)[:, None] * q1 - u
            new, newx = (aim[:, None] - fix) / s, (aim[:, None] - fixx) / x
            want, wantx = -_rows_apply(g, weight - new, back=True) - h1, newx - along(h1)
            solved = solve_banded(diagonals, want[:, :, None] if cols is not None else np.concatenate((want[:, :, None], more / wide, q1[:, :, None]), axis=2))
            if cols is None:
                cols = solved[:, :, 1:-1]
                dense = (np.einsum("ntm,ntk->nmk", more, more) - np.einsum("ntm,ntk->nmk", more, cols)) / wide + np.eye(m + 1) * (zx / x + 1e-14 / wide[:, :, 0])[:, :, None]
                bent, bentx = both(solved[:, :, -1], pull)
            dc, dx = both(solved[:, :, 0], wantx)
            k = (lean(dc, dx) / (wide[:, 0, 0] / bend - lean(bent, bentx)))[:, None]
            dc, dx = dc + k * bent, dx + k * bentx
            ds, dr = _rows_apply(g, dc), -dc - across(dx)
            near = dot(q1, dr)
            dtop = (wide[:, 0, 0] * h0 + 2 * q0 * near) * bend / 2
            du = -(h1 + u) + (dr - (bend * near)[:, None] * q1) / wide[:, :, 0]
            return dc, dx, ds, dr, dtop, du, new - z - heavy * ds, newx - zx - zx / x * dx

        def both(first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            dx = np.linalg.solve(dense, (rest - along(first) / wide[:, :, 0])[:, :, None])[:, :, 0]
            return first - np.einsum("ntm,nm->nt", cols, dx), dx

        room = lambda v, dv: np.where(dv < 0, -v / np.where(dv < 0, dv, -1.0), np.inf).min(axis=1)

        def until(v0: np.ndarray, v1: np.ndarray, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
            """How far v may go by d inside the cone."""
            own, mid, far = inside(v0, v1), v0 * d0 - dot(v1, d1), d0**2 - dot(d1, d1)
            rate = (np.sqrt(np.maximum(mid**2 - own * far, 0.0)) - mid) / own
            return np.where((rate > 0) & (mid**2 >= own * far), 1 / np.where(rate > 0, rate, 1.0), np.inf)

        def most(d: tuple[np.ndarray, ...]) -> np.ndarray:
            _, dx, ds, dr, dtop, du, dz, dzx = d
            return np.minimum.reduce([room(s, ds), room(x, dx), room(z, dz), room(zx, dzx), until(top, r, dtop, dr), until(np.ones(n), u, np.zeros(n), du)])

        dense = bentx = None
        none = np.zeros(n)
        first = direction(none, np.zeros_like(s), np.zeros_like(x), none, np.zeros_like(s))
        _, dx, ds, dr, dtop, du, dz, dzx = first
        aim = mu * np.clip(1 - np.minimum(1.0, most(first)), 1e-3, 1.0) ** 3
        (a0, a1), (b0, b1) = scaled(dtop, dr, -1.0), scaled(none, -du, 1.0)
        dc, dx, ds, dr, dtop, du, dz, dzx = last = direction(aim, ds * dz, dx * dzx, a0 * b0 + dot(a1, b1), a0[:, None] * b1 + b0[:, None] * a1)
        step = np.minimum(1.0, 0.99 * most(last))
        step = np.where(np.logical_and.reduce([np.isfinite(v).reshape(n, -1).all(1) for v in last]), step, 0.0)[:, None]
        take = lambda v, dv: np.where(step > 0, v + step * dv, v)
        s, x, z, zx, u, top = take(s, ds), take(x, dx), take(z, dz), take(zx, dzx), take(u, du), take(top[:, None], dtop[:, None])[:, 0]
        c = _rows_generate(g, s)
        r = goal - c - across(x)
        top = np.maximum(top, np.linalg.norm(r, axis=1) * (1 + 1e-15))
    np.seterr(**old)
    (s, x, u), (g, more) = best, whole
    s = clean(s * size) / size
    c = _rows_generate(g, s)
    for o, v in zip(out, (clean(c * size), s * size, clean(x[:, :m][:, part] * size + low[:, None]), clean(x[:, m:] * more[:, :, m] * size), u)):
        o[todo] = v
    return tuple(out)


def deconvolution_bound(y: np.ndarray, g: np.ndarray, lam: float, u: np.ndarray, segments: np.ndarray | None = None) -> float:
    """A lower bound of what any (s, b, c0) can reach, from any vector u: made feasible for
    the dual problem (length 1 at most, no response to a spike above lam, and none
    to a baseline or start above 0), its product with y - min(y) is one."""
    part = np.zeros(len(y), dtype=int) if segments is None else np.asarray(segments, dtype=int)
    decay = decays(g[None], len(y))[0]
    count = np.bincount(part)
    above = max(0.0, float((np.bincount(part, u) / np.maximum(count, 1)).max()), float(decay @ u / decay.sum()))
    u = u - above
    u = u / max(1.0, float(np.linalg.norm(u)), float(_generate_back(g, u).max()) / lam if lam > 0 else 1.0)
    return float(u @ (y - y.min()))


def deconvolve(y: np.ndarray, g: np.ndarray, sn: float, penalty: float = 1.0, zero: float = 1e-8, segments: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """deconvolve_rows of one trace, at lam = sn * penalty: (c, s, b, c0, u)."""
    return tuple(v[0] for v in deconvolve_rows(y[None], g[None], np.array([sn * penalty]), segments, zero))


def deconvolution_objective(y: np.ndarray, g: np.ndarray, sn: float, penalty: float, s: np.ndarray, b: np.ndarray | float, c0: np.ndarray) -> float:
    return float(np.linalg.norm(y - _generate(g, s) - b - c0) + sn * penalty * s.sum())


# --- images ---------------------------------------------------------------


def bilateral(im: np.ndarray, size: int = 5, sigma_color: float = 75.0, sigma_space: float = 75.0) -> np.ndarray:
    """Means weighted by distance and by likeness, over a disk, edges as reflect101."""
    r = max(size // 2, 1)
    p, total, weight = np.pad(im.astype(float), r, mode="reflect" if min(im.shape) > r else "symmetric"), np.zeros(im.shape), np.zeros(im.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                v = p[r + dy : r + dy + im.shape[0], r + dx : r + dx + im.shape[1]]
                w = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - (v - im) ** 2 / (2 * sigma_color**2))
                total, weight = total + w * v, weight + w
    return total / weight


def anisotropic(im: np.ndarray, steps: int = 1, kappa: float = 50.0, gamma: float = 0.1) -> np.ndarray:
    """Diffusion that stops at edges (Perona and Malik's exponential conductance)."""
    out = im.astype(float).copy()
    for _ in range(steps):
        change = np.zeros_like(out)
        for axis in (0, 1):
            d = np.diff(out, axis=axis)
            flow = np.exp(-((d / kappa) ** 2)) * d
            ends = [(0, 0), (0, 0)]
            ends[axis] = (1, 1)
            change += np.diff(np.pad(flow, ends), axis=axis)
        out += gamma * change
    return out


def translate(im: np.ndarray, dy: float, dx: float, fill: float = 0.0) -> np.ndarray:
    """The image moved by (dy, dx), between pixels linearly; beyond the edges, fill."""
    h, w = im.shape
    fy, fx = math.floor(dy), math.floor(dx)
    ay, ax = dy - fy, dx - fx
    p = np.full((h, w), 0.0)
    out, inside = p, np.ones((h, w), dtype=bool)
    y, x = np.arange(h)[:, None], np.arange(w)[None]
    for oy, wy in ((fy, 1 - ay), (fy + 1, ay)):
        for ox, wx in ((fx, 1 - ax), (fx + 1, ax)):
            if wy * wx == 0:
                continue
            sy, sx = y - oy, x - ox
            there = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
            inside &= there
            out = out + wy * wx * im[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)]
    return np.where(inside, out, fill)


def registration(src: np.ndarray, dst: np.ndarray, upsample: int = 100) -> np.ndarray:
    """(dy, dx) by which dst is moved against src, from the phase of their spectra:
    the nearest pixel first, then a matrix-multiplied transform of its surroundings
    at 1 / upsample of a pixel."""
    cross = np.fft.fft2(src) * np.conj(np.fft.fft2(dst))
    size = np.abs(cross)
    cross /= np.maximum(size, max(1e-3 * size[1:, 1:].max(initial=0.0), 100 * EPS))  # frequencies that hold next to nothing count for less
    peak = np.abs(np.fft.ifft2(cross))
    shape = np.array(src.shape)
    shift = np.array(np.unravel_index(peak.argmax(), peak.shape), dtype=float)
    shift = np.where(shift > shape // 2, shift - shape, shift)
    if upsample > 1:
        shift = np.round(shift * upsample) / upsample
        n = math.ceil(upsample * 1.5)
        centre = n // 2
        offset = centre - shift * upsample
        kernels = []
        for size, o in zip(shape, offset):
            f = np.fft.fftfreq(size, upsample)
            kernels.append(np.exp(-2j * np.pi * (np.arange(n)[:, None] - o) * f))
        fine = np.abs(kernels[0] @ np.conj(cross) @ kernels[1].T)
        shift += (np.array(np.unravel_index(fine.argmax(), fine.shape)) - centre) / upsample
    shift[shape == 1] = 0
    return -shift


def template_shift(src: np.ndarray, dst: np.ndarray, most: int, local: bool = False, subpixel: bool = False) -> np.ndarray:
    """The shift at which the normalised correlation coefficient of src, padded by
    `most`, with dst is greatest; with local, its nearest local maximum to none; with
    subpixel, the vertices of parabolas through the peak. (0, 0) if nothing varies."""
    p, d = np.pad(src.astype(float), most), dst - dst.mean()
    windows = np.lib.stride_tricks.sliding_window_view(p, dst.shape)
    mean = windows.mean((2, 3), keepdims=True)
    scale = np.sqrt(((windows - mean) ** 2).sum((2, 3)) * (d * d).sum())
    cor = np.divide(((windows - mean) * d).sum((2, 3)), scale, out=np.zeros(scale.shape), where=scale > 1e-12)
    centre = np.array(cor.shape) // 2
    if not np.ptp(cor):
        return np.zeros(2)
    if local:
        q = np.pad(cor, 1, constant_values=-np.inf)
        best = np.max([q[i : i + cor.shape[0], j : j + cor.shape[1]] for i in range(3) for j in range(3)], axis=0)
        peaks = np.argwhere(cor == best)
        at = peaks[((peaks - centre) ** 2).sum(1).argmin()].astype(float)
    else:
        at = np.array(np.unravel_index(cor.argmax(), cor.shape), dtype=float)
    if subpixel:
        fine = []
        for axis in (0, 1):
            line = cor[:, int(at[1])] if axis == 0 else cor[int(at[0])]
            x = np.arange(max(int(at[axis]) - 5, 0), min(int(at[axis]) + 6, len(line)))
            a, b, _ = np.polyfit(x, line[x], 2)
            fine.append(-b / (2 * a) if a else at[axis])
        at = np.array(fine)
    return centre - at


def _outline(mask: np.ndarray) -> list[tuple[int, int]]:
    """The border pixels of the only region of a mask, in order (Moore's tracing)."""
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    m = np.pad(mask, 1)
    start = tuple(np.argwhere(m)[0])
    out, at, back = [start], start, 0
    for _ in range(4 * m.size):
        for k in range(1, 9):
            d = (back + k) % 8
            nxt = (at[0] + ring[d][0], at[1] + ring[d][1])
            if m[nxt]:
                back, at = (d + 5) % 8 if d % 2 else (d + 6) % 8, nxt
                break
        else:
            return out
        if at == start:
            return out
        out.append(at)
    return out


#: The eight places around a pixel, clockwise from its left.
AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def borders(mask: np.ndarray) -> list[tuple[bool, list[tuple[int, int]]]]:
    """(whether it is a hole's, its pixels in order) for each border of a mask's regions, by
    Suzuki and Abe's border following; regions are joined by corners, too, and the
    mask is surrounded by nothing. In the order in which a scan by rows meets them: outer
    borders at their first pixel, borders of holes at the pixel left of the hole's
    first one. A pixel where a border passes twice is there twice."""
    f, out = np.pad(mask.astype(np.int32), 1).tolist(), []
    for i, j in (np.argwhere(mask) + 1).tolist():
        if f[i][j] == 1 and f[i][j - 1] == 0:
            hole, turn = False, 0
        elif f[i][j] >= 1 and f[i][j + 1] == 0:
            hole, turn = True, 4
        else:
            continue
        mark, found = len(out) + 2, []
        out.append((hole, found))
        first = next((k for k in ((turn + n) % 8 for n in range(1, 8)) if f[i + AROUND[k][0]][j + AROUND[k][1]]), None)
        if first is None:
            f[i][j] = -mark
            found.append((i - 1, j - 1))
            continue
        y, x, back = i, j, first  # back: the way to the pixel before
        while True:
            right = False  # whether the pixel to the right was seen to be empty
            for n in range(1, 9):
                k = (back - n) % 8
                if f[y + AROUND[k][0]][x + AROUND[k][1]]:
                    break
                right |= k == 4
            found.append((y - 1, x - 1))
            if right:
                f[y][x] = -mark
            elif f[y][x] == 1:
                f[y][x] = mark
            ny, nx = y + AROUND[k][0], x + AROUND[k][1]
            if (ny, nx) == (i, j) and (y, x) == (i + AROUND[first][0], j + AROUND[first][1]):
                break
            y, x, back = ny, nx, (k + 4) % 8
    return out


def label_pixels(y: list[int], x: list[int], diagonal: bool = True) -> list[int]:
    """Numbers from 1 of the regions that pixels, given in row-major order, lie in."""
    at = {p: i for i, p in enumerate(zip(y, x))}
    out, n = [0] * len(at), 0
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not i or not j)]
    for start, i in at.items():
        if out[i]:
            continue
        n += 1
        out[i], todo = n, [start]
        while todo:
            py, px = todo.pop()
            for dy, dx in near:
                k = at.get((py + dy, px + dx))
                if k is not None and not out[k]:
                    out[k] = n
                    todo.append((py + dy, px + dx))
    return out


def regions(mask: np.ndarray) -> int:
    """Number of 8-connected regions."""
    return max(label_pixels(*np.nonzero(mask)), default=0)


def circularity(im: np.ndarray, most: int) -> float:
    """How round the region is within which an image resembles itself when moved:
    4 pi area / perimeter^2 of where the normalised squared difference is below 1;
    0 if there are several regions."""
    im = im.astype(float)
    p, (h, w), own = np.pad(im, most), im.shape, float((im * im).sum())
    # sums over the windows: of squares by prefix sums, of products with the image by the spectrum
    total = np.pad((p * p).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    squares = np.maximum(total[h:, w:] - total[:-h, w:] - total[h:, :-w] + total[:-h, :-w], 0.0)
    alike = np.fft.irfft2(np.fft.rfft2(p) * np.conj(np.fft.rfft2(im, p.shape)), p.shape)[: 2 * most + 1, : 2 * most + 1]
    if (im == np.rint(im)).all() and own < 2.0**50:
        alike = np.rint(alike)  # as exact as whole numbers are
    scale, diff = np.sqrt(squares * own), squares - 2 * alike + own
    near = np.divide(diff, scale, out=np.ones_like(diff), where=scale > 0) < 1
    if not near.any() or regions(near) != 1:
        return 0.0
    y, x = np.array(_outline(near), dtype=float).T
    dy, dx = np.roll(y, -1) - y, np.roll(x, -1) - x
    length = np.hypot(dy, dx).sum()
    return float(4 * np.pi * abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2 / length**2) if length else 0.0


def spline_basis(n: int, mesh: int) -> np.ndarray:
    """Cubic B-splines of `mesh` intervals over n pixels: n x (mesh + 3)."""
    u = np.arange(n) / max(n - 1, 1) * mesh
    cell = np.minimum(u.astype(int), mesh - 1)
    t = u - cell
    w = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], axis=1) / 6
    out = np.zeros((n, mesh + 3))
    for k in range(4):
        out[np.arange(n), cell + k] += w[:, k]
    return out


def mesh_size(shape: tuple[int, int]) -> tuple[int, int]:
    """About one interval per 100 pixels."""
    return tuple(max(int(np.around(n / 100)), 1) for n in shape)


def warp(im: np.ndarray, coef: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """The image moved by a field of cubic splines, coef (2, rows, columns)."""
    h, w = im.shape
    by, bx = spline_basis(h, coef.shape[1] - 3), spline_basis(w, coef.shape[2] - 3)
    sy, sx = np.arange(h)[:, None] - by @ coef[0] @ bx.T, np.arange(w)[None] - by @ coef[1] @ bx.T
    return _sample(im, sy, sx, fill)


def _sample(im: np.ndarray, sy: np.ndarray, sx: np.ndarray, fill: float) -> np.ndarray:
    h, w = im.shape
    inside = (sy >= 0) & (sy <= h - 1) & (sx >= 0) & (sx <= w - 1)
    y, x = np.clip(np.floor(sy).astype(int), 0, max(h - 2, 0)), np.clip(np.floor(sx).astype(int), 0, max(w - 2, 0))
    ay, ax, y1, x1 = sy - y, sx - x, np.minimum(y + 1, h - 1), np.minimum(x + 1, w - 1)
    v = im[y, x] * (1 - ay) * (1 - ax) + im[y1, x] * ay * (1 - ax) + im[y, x1] * (1 - ay) * ax + im[y1, x1] * ay * ax
    return np.where(inside, v, fill)


def elastic_registration(src: np.ndarray, dst: np.ndarray, mesh: tuple[int, int], steps: int = 100, rate: float = 0.5) -> np.ndarray:
    """Spline coefficients (2, mesh + 3, mesh + 3) that move dst onto src: the rigid
    shift, then gradient ascent of the correlation coefficient, as long as it grows."""
    shift = -registration(src, dst, 20)
    h, w = src.shape
    by, bx = spline_basis(h, mesh[0]), spline_basis(w, mesh[1])
    coef = np.stack([np.full((by.shape[1], bx.shape[1]), s) for s in shift]).astype(float)
    a = src - src.mean()
    norm_a, best, best_coef, step = np.linalg.norm(a), -np.inf, coef, rate
    gy, gx = np.gradient(dst.astype(float))
    for _ in range(steps):
        sy, sx = np.arange(h)[:, None] - by @ coef[0] @ bx.T, np.arange(w)[None] - by @ coef[1] @ bx.T
        m = _sample(dst.astype(float), sy, sx, float(dst.mean()))
        b = m - m.mean()
        norm_b = np.linalg.norm(b)
        if not norm_a or not norm_b:
            break
        score = float((a * b).sum() / norm_a / norm_b)
        if score <= best + 1e-7:
            step /= 2
            coef = best_coef.copy()
            if step < 1e-3:
                break
        else:
            best, best_coef = score, coef.copy()
        slope = a / norm_a / norm_b - score * b / norm_b**2
        grad = np.stack([-(by.T @ (slope * _sample(g, sy, sx, 0.0)) @ bx) for g in (gy, gx)])
        size = np.abs(grad).max()
        if not size:
            break
        coef = coef + step * grad / size
    return -best_coef
