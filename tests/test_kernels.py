"""Numpy kernels against plain definitions, known answers and optimality conditions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glintframe.functions import kernels as K

RNG = np.random.default_rng(0)


@given(st.integers(5, 40), st.sampled_from([0.1, 0.25, 0.4]))
@settings(max_examples=25, deadline=None)
def test_low_and_high_are_the_whole(n, freq):
    x = np.random.default_rng(n).standard_normal((3, n))
    assert np.allclose(K.fft_filter(x, freq, "low") + K.fft_filter(x, freq, "high"), x)


def test_butterworth():
    b, a = K.butterworth(0.1, "low")
    assert b.sum() / a.sum() == pytest.approx(1) and abs((b * [1, -1, 1]).sum()) < 1e-12
    gain = lambda f: abs(np.polyval(b[::-1], np.exp(-2j * np.pi * f)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f)))
    assert gain(0.1) == pytest.approx(1 / math.sqrt(2))
    b, a = K.butterworth(0.1, "high")
    assert abs(b.sum()) < 1e-12
    assert np.allclose(K.causal_filter(np.array([1.0]), np.array([1.0]), np.eye(4)), np.eye(4))


def test_noise_levels():
    x = RNG.normal(0, 2, (20, 4000))
    for fn in (K.noise_fft, K.noise_welch):
        for method in ("mean", "median", "logmexp"):
            level = fn(x, 0.25, 0.5, method).mean()
            assert 1.2 < level < 2.2, (fn, method)
    assert K.noise_fft(x, 0.25, 0.5, "sum")[0] > K.noise_fft(x, 0.25, 0.5, "mean")[0]


def test_peak_to_noise_of_flat_trace():
    assert np.isinf(K.peak_to_noise(np.concatenate([np.zeros(50), np.ones(50)])[None] * 0 + np.linspace(0, 0, 100), 0.5)).any() or np.isnan(K.peak_to_noise(np.zeros((1, 100)), 0.25)).all()


def test_normality():
    x = RNG.standard_normal((200, 300))
    p = K.normality(x)
    assert (p < 0.01).mean() < 0.05
    assert K.normality(np.where(RNG.random((5, 300)) < 0.05, 50.0, 0.0) + RNG.standard_normal((5, 300))).max() < 1e-3


def test_running_median():
    x = RNG.standard_normal((2, 30))
    for w in (3, 4, 7):
        for r in range(2):
            p = np.pad(x[r], (w // 2, (w - 1) // 2), mode="symmetric")
            want = [max(x[r, t] - sorted(p[t : t + w])[w // 2], 0) for t in range(30)]
            assert np.allclose(K.above_baseline(x, w)[r], want)


def test_autoregression_is_found():
    e = RNG.standard_normal((3, 20000))
    x = K.causal_filter(np.array([1.0, 0, 0]), np.array([1.0, -1.2, 0.4]), e)
    assert np.allclose(K.ar_coefficients(x, np.zeros(3), 2), [1.2, -0.4], atol=0.05)


def test_lsqr_reaches_least_squares():
    a, y = RNG.standard_normal((50, 8)), RNG.standard_normal((50, 5))
    assert np.allclose(K.lsqr(a, y, 20), np.linalg.lstsq(a, y, rcond=None)[0])
    from glintframe.operators.units import _normal_equations

    assert np.allclose(_normal_equations(lambda d: a.T @ (a @ d), a.T @ y, 10), K.lsqr(a, y, 10))


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.5])
def test_positive_lasso_is_optimal(alpha):
    x, t = RNG.standard_normal((80, 6)), 80
    y = x @ np.array([1, 0, 0.5, 0, -1, 0]) + 3 + RNG.normal(0, 0.1, 80)
    w = K.positive_lasso(x, y, alpha)
    xc, yc = x - x.mean(0), y - y.mean()
    grad = -xc.T @ (yc - xc @ w) / t + alpha
    assert (w >= 0).all() and (grad > -1e-6).all() and np.abs(grad[w > 0]).max(initial=0) < 1e-6


def test_positive_lasso_of_one_has_its_closed_form():
    x, y = RNG.standard_normal(50), RNG.standard_normal(50)
    cov, var = np.cov(x, y, bias=True)[0, 1], x.var()
    assert K.positive_lasso(x[:, None], y, 0.01)[0] == pytest.approx(max(0, cov - 0.01) / var)


def test_deconvolution():
    g, t = np.array([0.9]), 200
    s = np.where(np.random.default_rng(1).random(t) < 0.05, 10.0, 0.0)
    c = K._generate(g, s)
    y = c + 5 + np.random.default_rng(2).normal(0, 0.3, t)
    got_c, got_s, b, c0, _ = K.deconvolve(y, g, 0.3)
    assert np.corrcoef(got_c, c)[0, 1] > 0.98 and (got_s >= 0).all() and (b >= y.min()).all()
    best = K.deconvolution_objective(y, g, 0.3, 1.0, got_s, b, c0)
    assert best <= K.deconvolution_objective(y, g, 0.3, 1.0, s, 5.0, np.zeros(t)) * 1.001
    rng = np.random.default_rng(3)
    for _ in range(50):  # no small step leads lower
        other = np.maximum(got_s + rng.normal(0, 0.05, t), 0)
        assert K.deconvolution_objective(y, g, 0.3, 1.0, other, np.maximum(b + rng.normal(0, 0.05), y.min()), c0) >= best - 1e-3
    assert not K.deconvolve(np.full(10, np.nan), g, 1.0)[0].any()
    step = np.repeat([0, 1], t // 2)
    warm = K.deconvolve(y + 20 * step, g, 0.3, segments=step)
    assert np.corrcoef(warm[0], c)[0, 1] > 0.95 and warm[2][-1] - warm[2][0] == pytest.approx(20, abs=1.5)


def exact_kolmogorov(n, d):
    """P(D < d) by Steck's determinant, in fractions; Hessenberg, so a recursion."""
    from fractions import Fraction as Q
    from math import factorial

    d = Q(d)
    up = [min(Q(1), Q(i, n) + d) for i in range(n)]  # upper ends of the i-th value, and lower ones
    low = [max(Q(0), Q(i + 1, n) - d) for i in range(n)]
    entry = lambda i, j: max(up[i] - low[j], Q(0)) ** (j - i + 1) / factorial(j - i + 1) if j - i + 1 >= 0 else Q(0)
    det = [Q(1)]
    for j in range(n):
        total, sign = Q(0), 1
        for i in range(j, -1, -1):
            total += sign * entry(i, j) * det[i]
            sign = -sign
        det.append(total)
    return float(det[n] * factorial(n))


def test_kolmogorov_is_exact():
    for n, ds in ((1, (0.6, 0.9)), (10, (0.06, 0.12, 0.274, 0.4, 0.55, 0.8)), (40, (0.05, 0.1, 0.2, 0.316, 0.34)), (83, (0.04, 0.09, 0.15, 0.21, 0.23))):
        for d in ds:
            assert K.kolmogorov(n, d) == pytest.approx(1 - exact_kolmogorov(n, d), abs=1e-10), (n, d)
    # values in print (Marsaglia, Tsang and Wang 2003; Simard and L'Ecuyer 2011)
    assert 1 - K.kolmogorov(10, 0.274) == pytest.approx(0.6284796154565043, abs=1e-12)
    assert 1 - K.kolmogorov(2000, 0.04) == pytest.approx(0.9967694319171368, abs=1e-10)
    assert K.kolmogorov(1000, 0.0632) == pytest.approx(K.kolmogorov(1000, 0.06325), rel=0.02)  # no step where the way to find it changes
    assert K.kolmogorov(50, 0.0) == 1.0 and K.kolmogorov(50, 1.0) == 0.0 and K.kolmogorov(3, 0.999) < 1e-8
    fine = [K.kolmogorov(1000, d) for d in np.linspace(0.001, 0.12, 60)]
    assert all(a >= b for a, b in zip(fine, fine[1:]))


def test_circularity_by_the_spectrum():
    """Where an image resembles itself when moved: as all windows written out tell; and a large one needs no room for them."""

    def near(im, most):
        p = np.pad(im.astype(float), most)
        windows = np.lib.stride_tricks.sliding_window_view(p, im.shape)
        scale = np.sqrt((windows**2).sum((2, 3)) * (im.astype(float) ** 2).sum())
        return np.divide(((windows - im) ** 2).sum((2, 3)), scale, out=np.ones_like(scale), where=scale > 0) < 1

    def plain(im, most):
        m = near(im, most)
        if not m.any() or K.regions(m) != 1:
            return 0.0
        y, x = np.array(K._outline(m), dtype=float).T
        dy, dx = np.roll(y, -1) - y, np.roll(x, -1) - x
        length = np.hypot(dy, dx).sum()
        return 4 * np.pi * abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2 / length**2 if length else 0.0

    rng = np.random.default_rng(4)
    yy, xx = np.mgrid[:21, :25]
    disk = 200.0 * ((yy - 10) ** 2 + (xx - 12) ** 2 <= 36)
    for im in (disk, disk + rng.integers(0, 30, disk.shape), rng.integers(0, 50, (9, 14)), rng.random((11, 7)) + 1, np.zeros((5, 6)), 100.0 * (abs(yy - 10) < 2)):
        for most in (1, 3, 6):
            assert K.circularity(im, most) == pytest.approx(plain(np.asarray(im), most), abs=1e-12)
    assert K.circularity(disk, 8) > 0.7
    big = np.zeros((480, 752))
    big[200:260, 300:380] = 90.0
    assert 0 < K.circularity(big, 100) <= 1


def test_borders():
    """Of a ring: outside and hole; of a dot, a line and a blob in the hole: theirs. Every border pixel, and no other, is on one."""
    ring = np.ones((7, 9), dtype=bool)
    ring[2:5, 2:7] = False
    got = K.borders(ring)
    assert [h for h, _ in got] == [False, True] and got[0][1][0] == (0, 0) and got[1][1][0] == (2, 1)
    assert len(got[0][1]) == len(set(got[0][1])) == 2 * (7 + 9) - 4 and len(set(got[1][1])) == 2 * (3 + 5)
    ring[3, 4] = True
    assert [(h, len(p)) for h, p in K.borders(ring)][2] == (False, 1)
    line = np.zeros((3, 6), dtype=bool)
    line[1, 1:5] = True
    assert K.borders(line) == [(False, [(1, 1), (1, 2), (1, 3), (1, 4), (1, 3), (1, 2)])]
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8):
        for _ in range(20):
            m = rng.random((12, 11)) < share
            found = K.borders(m)
            p = np.pad(m, 1)
            inner = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
            assert {x for _, b in found for x in b} == set(map(tuple, np.argwhere(m & ~inner).tolist()))
            y, x = np.nonzero(m)
            assert sum(not h for h, _ in found) == max(K.label_pixels(y.tolist(), x.tolist(), True), default=0)
            y, x = np.nonzero(~p)
            assert sum(h for h, _ in found) == max(K.label_pixels(y.tolist(), x.tolist(), False)) - 1
            for _, b in found:
                steps = np.abs(np.diff([*b, b[0]], axis=0)).max(axis=1)
                assert (steps <= 1).all() and (len(b) == 1 or (steps > 0).all())
    assert K.borders(np.zeros((3, 3), dtype=bool)) == []


def test_deconvolution_is_proved_exact():
    """Objective and dual bound agree to ten digits, for one and two coefficients, segments, noise of any size, many rows at once."""
    rng = np.random.default_rng(7)
    for g0 in ([0.9], [1.5, -0.55], [0.3, 0.2]):
        for scale in (1.0, 1e4, 1e-3):
            g = np.repeat([g0], 4, 0)
            s = (rng.random((4, 150)) < 0.06) * rng.gamma(3, 1, (4, 150))
            y = scale * (np.stack([K._generate(g[0], x) for x in s]) + 4 + 0.3 * rng.normal(size=s.shape))
            lam = np.array([0.3, 0.05, 1.0, 4.0])
            for segments in (None, np.arange(150) // 60):
                c, s_, b, c0, u = K.deconvolve_rows(y, g, lam, segments, 1e-8 * scale)
                for i in range(4):
                    goal = np.linalg.norm(y[i] - c[i] - b[i] - c0[i]) + lam[i] * s_[i].sum()
                    assert 0 <= goal - K.deconvolution_bound(y[i], g[i], lam[i], u[i], segments) + 1e-9 * goal <= 2e-8 * goal
                    assert (s_[i] >= 0).all() and np.allclose(K._apply(g[i], c[i]), s_[i], atol=1e-7 * scale)


def test_deconvolution_without_a_rest_is_proved():
    """Of these, with roots that aren't real, nothing stays unexplained, so that the norm has no gradient."""
    x = np.array(
        [
            [477, 338, 11, 3, 103, 4, 51, 92, 286, 85, 182, 178, 123, 287, 143, 153, 164, 76, 86, 52, 74, 16, 0, 143, 175, 277, 9, 0, 151, 325],
            [0, 122, 0, 71, 225, 130, 255, 50, 68, 49, 23, 255, 110, 141, 281, 25, 69, 17, 49, 120, 77, 290, 250, 245, 50, 25, 248, 66, 95, 25],
        ]
    )
    y = x / x.mean(axis=1, keepdims=True)
    lam, y = 0.1 * K.noise_fft(y, 0.25, 1.0), K.fft_filter(y, 0.25, "low")
    g = K.ar_coefficients(y, K.noise_fft(y, 0.25, 1.0), 2)
    assert all(np.iscomplex(np.roots([1, *-v])).all() for v in g)
    _, s, b, c0, u = K.deconvolve_rows(y, g, lam, zero=None)
    for i in range(2):
        got = K.deconvolution_objective(y[i], g[i], lam[i], 1.0, s[i], b[i], c0[i])
        assert got - K.deconvolution_bound(y[i], g[i], lam[i], u[i]) <= 1e-6 * got


def test_deconvolution_of_a_long_trace_that_is_zero_but_for_its_end():
    rng = np.random.default_rng(3)
    y = np.concatenate((np.zeros(900), rng.exponential(60.0, 30)))[None]
    for g in ([[0.85]], [[0.92, -0.03]]):
        _, s, b, c0, u = (v[0] for v in K.deconvolve_rows(y, np.array(g), np.array([0.4]), zero=None))
        got = K.deconvolution_objective(y[0], np.array(g[0]), 0.4, 1.0, s, b, c0)
        assert got - K.deconvolution_bound(y[0], np.array(g[0]), 0.4, u) <= 1e-6 * got


def test_deconvolution_of_odd_rows():
    g = np.repeat([[0.9]], 5, 0)
    y = np.stack([np.full(40, 3.0), np.arange(40.0), np.full(40, np.nan), np.zeros(40), np.where(np.arange(40) == 20, 50.0, 1.0)])
    c, s, b, c0, _ = K.deconvolve_rows(y, g, np.array([0.1, 0.0, 0.1, 0.1, 0.1]))
    assert all(np.isfinite(v).all() for v in (c, s, b, c0)) and not c[[0, 2, 3]].any() and (b[0] == 3).all() and s[4].argmax() == 20
    assert K.deconvolve(np.array([1.0, 2.0]), np.array([0.5]), 1.0)[0].tolist() == [0, 0]


def scene(n=48):
    y, x = np.mgrid[:n, :n]
    r = np.random.default_rng(5)
    return sum(r.uniform(1, 3) * np.exp(-((y - r.uniform(8, n - 8)) ** 2 + (x - r.uniform(8, n - 8)) ** 2) / r.uniform(6, 30)) for _ in range(14))


@pytest.mark.parametrize("shift", [(0, 0), (3, -2), (0.5, 1.25), (-4.2, 2.7)])
def test_registration(shift):
    im = scene()
    f = np.fft.fft2(im) * np.exp(-2j * np.pi * (np.fft.fftfreq(48)[:, None] * shift[0] + np.fft.fftfreq(48)[None] * shift[1]))
    moved = np.fft.ifft2(f).real
    assert np.abs(K.registration(im, moved, 100) - shift).max() < 0.1


def test_translate_there_and_back():
    im = scene()
    back = K.translate(K.translate(im, 3, -2), -3, 2)
    assert np.allclose(back[4:-4, 4:-4], im[4:-4, 4:-4])
    half = K.translate(im, 0.5, 0.0)
    assert np.allclose(half[1:], (im[1:] + im[:-1]) / 2) and (half[0] == 0).all()
    assert (K.translate(im, 100, 0, 7.0) == 7).all()


def test_template_shift():
    im = scene()
    moved = K.translate(im, 2, -3)
    assert np.allclose(K.template_shift(im, moved, 6), (2, -3)) or np.allclose(K.template_shift(im, moved, 6), (-2, 3))
    a, b = K.template_shift(im, moved, 6, subpixel=True), K.template_shift(im, moved, 6, local=True)
    assert np.abs(np.abs(a) - (2, 3)).max() < 0.5 and b.shape == (2,)
    assert (K.template_shift(np.ones((9, 9)), np.ones((9, 9)), 3) == 0).all()


def test_circularity():
    y, x = np.mgrid[:31, :31]
    disk = ((y - 15) ** 2 + (x - 15) ** 2 <= 64).astype(float)
    bar = ((abs(y - 15) <= 1) & (abs(x - 15) <= 12)).astype(float)
    assert K.circularity(disk, 12) > K.circularity(bar, 12) > 0
    assert K.circularity(np.zeros((9, 9)), 4) == 0
    assert K.regions(np.array([[1, 0, 1], [0, 0, 0], [1, 1, 0]], dtype=bool)) == 3


def test_elastic_registration_helps():
    im = scene()
    field = np.zeros((2, 4, 4))
    field[0, :2], field[1, :, 2:] = 1.5, -1.0
    moved = K.warp(im, field)
    coef = K.elastic_registration(im, moved, (1, 1), 80)
    back = K.warp(moved, -coef, 0.0)
    inner = np.s_[6:-6, 6:-6]
    assert np.corrcoef(back[inner].ravel(), im[inner].ravel())[0, 1] > np.corrcoef(moved[inner].ravel(), im[inner].ravel())[0, 1]
    assert np.allclose(K.spline_basis(20, 3).sum(1), 1) and K.mesh_size((480, 752)) == (5, 8)


def test_smoothing_keeps_flat_images():
    flat = np.full((12, 9), 5.0)
    assert np.allclose(K.bilateral(flat), 5) and np.allclose(K.anisotropic(flat, 3), 5)
    im = scene()
    assert K.anisotropic(im, 2).sum() == pytest.approx(im.sum())
