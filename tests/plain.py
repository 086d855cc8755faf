"""Series operators in plain loops and arrays, to test against."""

import hashlib
import math

import numpy as np


def flat(x):
    x = np.asarray(x, dtype=float)
    t = np.arange(len(x))
    return x - np.polyval(np.polyfit(t, x, 1), t)


def acf(x, k):
    d = np.asarray(x) - np.mean(x)
    return float((d[k:] * d[:-k]).sum() / (d * d).sum())


def pacf(x, lags):
    r = [1.0, *[acf(x, k) for k in range(1, lags + 1)]]
    out = []
    for k in range(1, lags + 1):
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(float(np.linalg.solve(system, np.array(r[1 : k + 1]))[-1]))
    return out


def information(x, lag):
    u, v = np.asarray(x)[:-lag], np.asarray(x)[lag:]
    bins = max(math.ceil(math.sqrt(len(u))), 2)
    level = lambda w: np.minimum(np.floor((w - w.min()) / (w.max() - w.min()) * (bins - 1) + 0.5), bins - 1)
    table = np.zeros((bins, bins))
    np.add.at(table, (level(u).astype(int), level(v).astype(int)), 1 / len(u))
    alone = table.sum(axis=1)[:, None] * table.sum(axis=0)[None, :]
    return max(float((table[table > 0] * np.log(table[table > 0] / alone[table > 0])).sum()), 0.0)


def bds(x, m, eps):
    x = flat(x)
    near = np.abs(x[:, None] - x[None, :]) < eps
    n = len(x)
    vectors = n - m + 1
    both = np.logical_and.reduce([near[d : d + vectors, d : d + vectors] for d in range(m)])
    c, cm = (near.sum() - n) / (n * (n - 1)), (both.sum() - vectors) / (vectors * (vectors - 1))
    k = float((near.sum(axis=1).astype(float) ** 2).sum() / n**3)
    spread = k**m + 2 * sum(k ** (m - j) * c ** (2 * j) for j in range(1, m)) + (m - 1) ** 2 * c ** (2 * m) - m * m * k * c ** (2 * m - 2)
    statistic = math.sqrt(vectors) * (cm - c**m) / math.sqrt(4 * spread)
    return c, cm, k, statistic, math.erfc(abs(statistic) / math.sqrt(2))


def vectors(x, dim, tau):
    count = len(x) - (dim - 1) * tau
    return np.stack([np.asarray(x, dtype=float)[k * tau : k * tau + count] for k in range(dim)], axis=1)


def neighbours(x, dim, tau):
    v, out = vectors(x, dim, tau), {}
    for i in range(len(v)):
        d = np.sqrt(((v[i] - v) ** 2).sum(axis=1))
        d[(d == 0) | (np.abs(np.arange(len(v)) - i) < (dim - 1) * tau + 1)] = np.inf
        if np.isfinite(d.min()):
            out[i] = int(d.argmin())
    return out


def lyapunov(x, dim, tau):
    v, pairs = vectors(x, dim, tau), neighbours(x, dim, tau)
    n = len(v)
    curve = []
    for step in range(min(max(n // 4 // 10, 5), n // 4)):
        gaps = [np.linalg.norm(v[i + step] - v[j + step]) for i, j in pairs.items() if max(i, j) + step < n]
        logs = [math.log(g) for g in gaps if g > 0]
        if logs:
            curve.append((step, sum(logs) / len(logs)))
    return float(np.polyfit(*zip(*curve), 1)[0])


def delay(x, longest=50):
    mi = {k: information(x, k) for k in range(1, min(len(x) // 4, longest) + 1)}
    return next((k for k in mi if k - 1 in mi and k + 1 in mi and mi[k] < mi[k - 1] and mi[k] <= mi[k + 1]), 1)


def dimension(x, tau, max_dim):
    x, tried = np.asarray(x, dtype=float), []
    for dim in range(1, max_dim + 1):
        count = len(x) - dim * tau
        if count < 20:
            break
        v, wrong, seen = vectors(x, dim, tau)[:count], 0, 0
        for i in range(0, count, max(count // min(count, 200), 1)):
            d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
            d[d == 0] = np.inf
            j = int(d.argmin())
            if np.isfinite(d[j]):
                seen += 1
                wrong += abs(x[i + dim * tau] - x[j + dim * tau]) / d[j] > 15
        tried.append(dim)
        if not seen or wrong / seen < 0.01:
            return dim
    return tried[-1]


def asymmetry(x):
    return float(np.mean(x[1:] ** 2 * x[:-1] - x[1:] * x[:-1] ** 2))


def surrogates(x, count, seed=12345):
    """Asymmetry of the detrended series, and of AR(1) series driven by its residuals in the order of a hash."""
    x = flat(x)
    mu = x.mean()
    d = x - mu
    phi = (d[1:] * d[:-1]).sum() / (d[:-1] ** 2).sum()
    e = d[1:] - phi * d[:-1]
    runs = []
    for b in range(count):
        y, made = 0.0, []
        for t in sorted(range(1, len(x)), key=lambda t: hashlib.md5(f"{seed}:{b}:{t}".encode()).hexdigest()[:15]):
            y = phi * y + e[t - 1]
            made.append(mu + y)
        runs.append(asymmetry(np.array(made)))
    return asymmetry(x), float(np.mean(runs)), float(np.std(runs, ddof=1))
