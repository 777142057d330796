"""Linear and kernel learners, each fitted from sums of products over the rows.

A pass adds up a matrix as wide as the attributes; solving is the driver's. Kernel learners stand on
landmarks: rows drawn by hash, at most ``landmarks`` of them. With no more rows than that they are exact,
beyond it they are the best that the landmarks' span holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.learn.base import Model, Table, class_values, frame, gather, normalised, one_hot, softmax
from millrace.learn.trees import coding

# Features ------------------------------------------------------------------------------------


class Design:
    """Rows as arrays with a leading 1: numbers, filled by their means and optionally scaled, and values as columns."""

    def __init__(self, df: DataFrame, attributes: list[str], scaled: bool = False):
        self.table = Table.of(df, attributes)
        n = self.table.numbers
        found = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, a in enumerate(n) for x in (F.avg(F.col(a).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(a).cast("double")).alias(f"s{i}"))]).first()
        self.mean = np.array([found[f"m{i}"] or 0.0 for i in range(len(n))])
        deviation = np.array([found[f"s{i}"] or 0.0 for i in range(len(n))])
        self.shift = np.zeros(0)
        extra = len(self.table.names()) - len(n)
        self.shift = np.concatenate([self.mean if scaled else np.zeros(len(n)), np.zeros(extra)])
        self.scale = np.concatenate([np.where(deviation > 0, deviation, 1.0) if scaled else np.ones(len(n)), np.ones(extra)])
        self.names = self.table.names()

    def __call__(self, x: pd.DataFrame) -> np.ndarray:
        flat = (self.table.flat(x, self.mean) - self.shift) / self.scale
        return np.hstack([np.ones((len(x), 1)), flat])


class Linear(Model):
    """``design(x) @ weights``: one column for a number, one a class for scores."""

    def __init__(self, design, weights: np.ndarray, attributes: list[str], classes=None, link: Callable | None = None):
        self.design, self.weights, self.attributes, self.classes, self.link = design, weights, attributes, classes, link

    def scores(self, x):
        s = self.design(x) @ self.weights
        return self.link(s) if self.link else s


def products(rows: DataFrame, design, group=None, target=None) -> dict[str, np.ndarray]:
    """Of each group the sums of products of the design's columns and the target, weighted; also the number of rows."""

    def add(t: pd.DataFrame):
        z = np.column_stack([design(t), (t["_y"].to_numpy(float) if target is None else target(t))])
        at = np.zeros(len(t), int) if group is None else group(t)
        for g in np.unique(at).tolist():
            here = at == g
            w = t["_w"].to_numpy()[here][:, None]
            yield str(g), np.vstack([z[here].T @ (z[here] * w), np.full(z.shape[1], float(here.sum()))])

    return gather(rows, add)


def solve(m: np.ndarray, columns: int, ridge: float) -> np.ndarray:
    a = m[:columns, :columns] + ridge * np.diag([0.0] + [1.0] * (columns - 1))
    return np.linalg.lstsq(a, m[:columns, columns:-1] if m.shape[1] > columns + 1 else m[:columns, columns], rcond=None)[0]


def _rss(m: np.ndarray, kept: list[int], ridge: float) -> tuple[float, np.ndarray]:
    p = m.shape[1] - 1
    a, b = m[np.ix_(kept, kept)] + ridge * np.diag([0.0] + [1.0] * (len(kept) - 1)), m[kept, p]
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    return max(m[p, p] - 2 * w @ b + w @ m[np.ix_(kept, kept)] @ w, 0.0), w


def linear_regression(df, target, attributes, weight=None, ridge: float = 1e-8, select: str = "m5") -> Linear:
    """Least squares with a ridge. ``select``: ``m5`` leaves out the least coefficient while Akaike's criterion falls,
    ``greedy`` the attribute without which it falls most, ``none`` keeps all. One pass."""
    rows = frame(df, target, attributes, weight)
    design = Design(rows, attributes)
    m = products(rows, design).get("0")
    p = len(design.names) + 1
    if m is None:
        return Linear(design, np.zeros(p), attributes)
    n, kept = m[-1, 0], list(range(p))
    body = m[:-1]

    def aic(kept):
        rss, w = _rss(body, kept, ridge)
        full = _rss(body, list(range(p)), ridge)[0]
        return rss / max(full, 1e-12) * (n - p) + 2 * len(kept), w

    score, w = aic(kept)
    spread = np.sqrt(np.maximum(np.diag(body)[:p] / max(body[0, 0], 1e-12) - (body[0, :p] / max(body[0, 0], 1e-12)) ** 2, 0))
    while select != "none" and len(kept) > 1 and n > p:
        if select == "greedy":
            tried = [(aic([k for k in kept if k != j])[0], j) for j in kept[1:]]
            best, gone = min(tried)
        else:
            gone = kept[1:][int(np.argmin(np.abs(w[1:] * spread[kept[1:]])))]
            best = aic([k for k in kept if k != gone])[0]
        if best >= score:
            break
        kept = [k for k in kept if k != gone]
        score, w = aic(kept)
    weights = np.zeros(p)
    weights[kept] = w
    return Linear(design, weights, attributes)


def simple_linear_regression(df, target, attributes, weight=None) -> Linear:
    """The one number of the least squared error."""
    rows = frame(df, target, attributes, weight)
    design = Design(rows, attributes)
    m = products(rows, design)["0"][:-1]
    tried = [(_rss(m, [0, j], 0.0), j) for j in range(1, len(design.table.numbers) + 1)]
    (_, w), j = min(tried, key=lambda t: (t[0][0], t[1]))
    weights = np.zeros(len(design.names) + 1)
    weights[[0, j]] = w
    return Linear(design, weights, attributes)


def pace_regression(df, target, attributes, weight=None, estimator: str = "bic") -> Linear:
    """Least squares on orthogonal dimensions of which those go whose effect is below a threshold: ``ols`` keeps all,
    ``aic`` those above 2, ``bic`` above the logarithm of the rows, ``ric`` above twice that of the dimensions; ``eb``
    shrinks each by an empirical Bayes mixture fitted to all effects."""
    rows = frame(df, target, attributes, weight)
    design = Design(rows, attributes)
    m = products(rows, design)["0"]
    n, body, p = m[-1, 0], m[:-1], len(design.names) + 1
    centred = body[1:p, 1:p] - np.outer(body[0, 1:p], body[0, 1:p]) / body[0, 0]
    cross = body[1:p, p] - body[0, 1:p] * body[0, p] / body[0, 0]
    order = np.argsort(-np.abs(cross) / np.sqrt(np.maximum(np.diag(centred), 1e-12)))
    lower = np.linalg.cholesky(centred[np.ix_(order, order)] + 1e-12 * np.diag(np.diag(centred)[order])) if p > 1 else np.zeros((0, 0))
    effect = np.linalg.solve(lower, cross[order]) if p > 1 else np.zeros(0)
    total = body[p, p] - body[0, p] ** 2 / body[0, 0]
    sigma = max((total - (effect**2).sum()) / max(n - p, 1), 1e-12)
    a = effect / math.sqrt(sigma)
    if estimator == "eb":
        grid = np.unique(np.concatenate([[0.0], a]))
        density = np.exp(-((a[:, None] - grid[None]) ** 2) / 2)
        share = np.full(len(grid), 1 / len(grid))
        for _ in range(200):
            post = density * share
            post /= post.sum(1, keepdims=True)
            share = post.mean(0)
        post = density * share
        a = (post / post.sum(1, keepdims=True)) @ grid
    else:
        limit = {"ols": 0.0, "aic": 2.0, "bic": math.log(max(n, 2)), "ric": 2 * math.log(max(p - 1, 2))}[estimator]
        a = np.where(a**2 > limit, a, 0.0)
    w = np.zeros(p)
    if p > 1:
        w[1:][order] = np.linalg.solve(lower.T, a * math.sqrt(sigma))
    w[0] = (body[0, p] - body[0, 1:p] @ w[1:]) / body[0, 0]
    return Linear(design, w, attributes)


def least_median_squares(df, target, attributes, weight=None, tries: int = 50, sample_rows: int = 1000, seed: int = 1) -> Linear:
    """Of lines through few rows drawn by hash, the one whose median squared error over all rows is least."""
    rows = frame(df, target, attributes, weight)
    design = Design(rows, attributes)
    p = len(design.names) + 1
    sample = rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns).limit(sample_rows).toPandas()
    x, y, rng = design(sample), sample["_y"].to_numpy(float), np.random.default_rng(seed)
    tried = np.column_stack([np.linalg.lstsq(x[i], y[i], rcond=None)[0] for i in (rng.choice(len(x), min(len(x), p + 1), replace=False) for _ in range(tries))])

    @F.pandas_udf("array<double>")
    def errors(t: pd.DataFrame) -> pd.Series:
        return pd.Series([r.tolist() for r in (design(t) @ tried - t["_y"].to_numpy(float)[:, None]) ** 2])

    held = rows.select(errors(F.struct(*rows.columns)).alias("e"))
    medians = held.agg(*[F.percentile_approx(F.get("e", F.lit(k)), 0.5, 10_000).alias(f"m{k}") for k in range(tries)]).first()
    return Linear(design, tried[:, int(np.argmin([medians[f"m{k}"] for k in range(tries)]))], attributes)


class Steps(Model):
    """A step function of one number."""

    def __init__(self, c, place: int, values: np.ndarray, attributes: list[str]):
        self.coding, self.place, self.values, self.attributes = c, place, values, attributes

    def scores(self, x):
        at = self.coding.codes(x)[:, self.place]
        return np.where(at < 0, np.average(self.values), self.values[np.maximum(at, 0)])


def pooled(sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to the means, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for s, w in zip(sums, weights):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * max(blocks[-1][1], 1e-12) >= blocks[-1][0] * max(blocks[-2][1], 1e-12):
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    return np.concatenate([np.full(int(n), s / max(w, 1e-12)) for s, w, n in blocks]) if blocks else np.zeros(0)


def isotonic_regression(df, target, attributes, weight=None, bins: int = 1024) -> Steps:
    """The rising or falling step function of the number that fits best."""
    rows = frame(df, target, attributes, weight)
    c = coding(rows, [a for a in attributes if dict(rows.dtypes)[a] == "double"], bins)

    def add(t: pd.DataFrame):
        codes, y, w = c.codes(t), t["_y"].to_numpy(float), t["_w"].to_numpy()
        for a in range(len(c.cuts)):
            h, known = np.zeros((len(c.cuts[a]) + 1, 3)), codes[:, a] >= 0
            np.add.at(h, codes[known, a], np.column_stack([w, w * y, w * y * y])[known])
            yield str(a), h

    found, best = gather(rows, add), None
    for a in range(len(c.cuts)):
        h = found[str(a)]
        for sign in (1, -1):
            fit = sign * pooled(sign * h[:, 1], h[:, 0])
            error = (h[:, 2] - 2 * fit * h[:, 1] + fit**2 * h[:, 0]).sum()
            if best is None or error < best[0] - 1e-9:
                best = (error, a, fit)
    return Steps(c, best[1], best[2], list(c.table.numbers))


# Logistic and margin learners ----------------------------------------------------------------


def _newton(rows: DataFrame, design, classes: list[str], ridge: float, steps: int, group=None, groups: int = 1, prior: str = "gaussian") -> list[np.ndarray]:
    """Weights of multinomial logistic regressions, one a group, all in the same passes; the first class is the base."""
    p, k = None, len(classes) - 1
    weights: list[np.ndarray] | None = None
    for _ in range(steps):

        def add(t: pd.DataFrame, weights=weights):
            x, y, w = design(t), one_hot(t["_y"], classes)[:, 1:], t["_w"].to_numpy()
            at = np.zeros(len(t), int) if group is None else group(t)
            for g in np.unique(at).tolist():
                here = at == g
                s = x[here] @ (weights[g] if weights is not None else np.zeros((x.shape[1], k)))
                q = softmax(np.hstack([np.zeros((here.sum(), 1)), s]))[:, 1:]
                grad = x[here].T @ ((y[here] - q) * w[here][:, None])
                hess = np.zeros((k, k, x.shape[1], x.shape[1]))
                for i in range(k):
                    for j in range(k):
                        v = w[here] * q[:, i] * ((i == j) - q[:, j])
                        hess[i, j] = x[here].T @ (x[here] * v[:, None])
                yield str(g), np.concatenate([grad.T.ravel(), hess.transpose(0, 2, 1, 3).ravel()])

        found = gather(rows, add)
        if not found:
            break
        if p is None:
            size = len(next(iter(found.values())))
            p = int((-1 + math.sqrt(1 + 4 * size)) / 2) // k
            weights = [np.zeros((p, k)) for _ in range(groups)]
        moved = 0.0
        after = []
        for g in range(groups):
            flat = found.get(str(g))
            if flat is None:
                after.append(weights[g])
                continue
            b = weights[g].T.ravel()
            penalty = np.tile([0.0] + [ridge] * (p - 1), k)
            if prior == "laplace":
                penalty = penalty / np.maximum(np.abs(b), 1e-3)
            grad = flat[: p * k] - penalty * b
            hess = flat[p * k :].reshape(p * k, p * k) + np.diag(penalty + 1e-9)
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
            step *= min(1.0, 10 / max(np.abs(step).max(), 1e-12))
            moved = max(moved, float(np.abs(step).max()))
            after.append((b + step).reshape(k, p).T)
        weights = after
        if moved < 1e-7:
            break
    return weights if weights is not None else []


def _shares(s: np.ndarray) -> np.ndarray:
    return softmax(np.hstack([np.zeros((len(s), 1)), s]))


def logistic(df, target, attributes, weight=None, ridge: float = 1e-4, steps: int = 30, prior: str = "gaussian") -> Linear:
    """Multinomial logistic regression by Newton's method, one pass a step; ``prior`` gaussian or laplace."""
    rows = frame(df, target, attributes, weight)
    classes = class_values(rows, "_y")
    design = Design(rows, attributes, True)
    w = _newton(rows, design, classes, ridge, steps, prior=prior)[0] if len(classes) > 1 else np.zeros((len(design.names) + 1, 0))
    return Linear(design, w, attributes, classes, _shares)


def bayesian_logistic(df, target, attributes, weight=None, variance: float = 1.0, prior: str = "gaussian") -> Linear:
    """Logistic regression under a normal or double exponential prior of the given variance."""
    return logistic(df, target, attributes, weight, 1 / variance if prior == "gaussian" else math.sqrt(2 / variance), 40, prior)


def _squared_hinge(rows: DataFrame, design, sign, cost: float, steps: int, epsilon: float | None = None) -> np.ndarray:
    """Weights of least ``w'w / 2 + cost * squared slack`` by Newton's method. ``epsilon``: for numbers."""
    w = None
    for _ in range(steps):

        def add(t: pd.DataFrame, w=w):
            x, y, m = design(t), sign(t), t["_w"].to_numpy()
            s = x @ (w if w is not None else np.zeros(x.shape[1]))
            slack = 1 - y * s if epsilon is None else np.abs(y - s) - epsilon
            on = slack > 0
            back = y if epsilon is None else np.sign(y - s)
            yield "g", x[on].T @ (2 * cost * m[on] * back[on] * slack[on])
            yield "h", x[on].T @ (x[on] * (2 * cost * m[on])[:, None])

        found = gather(rows, add)
        w = np.zeros(len(found["g"])) if w is None else w
        free_ = np.array([1e-6] + [1.0] * (len(w) - 1))
        step = np.linalg.solve(found["h"] + np.diag(free_), found["g"] - free_ * w)
        w = w + step
        if np.abs(step).max() < 1e-8 * max(1.0, np.abs(w).max()):
            break
    return w


def _margin_shares(s: np.ndarray) -> np.ndarray:
    return normalised(1 / (1 + np.exp(-2 * s)))


def linear_svm(df, target, attributes, weight=None, cost: float = 1.0, steps: int = 30, design=None) -> Linear:
    """Large margins with squared slack, each class against the rest."""
    rows = frame(df, target, attributes, weight)
    classes = class_values(rows, "_y")
    design = design or Design(rows, attributes, True)
    own = [lambda t, c=c: np.where(t["_y"] == c, 1.0, -1.0) for c in (classes if len(classes) > 2 else classes[1:])]
    w = [_squared_hinge(rows, design, s, cost, steps) for s in own]
    if len(classes) == 2:
        w = [-w[0], w[0]]
    return Linear(design, np.column_stack(w), attributes, classes, _margin_shares)


def svm_regression(df, target, attributes, weight=None, cost: float = 1.0, epsilon: float = 1e-3, steps: int = 40, kernel=None, landmarks: int = 500) -> Linear:
    """The flattest function whose errors beyond ``epsilon`` are small, with squared slack; linear, or over a kernel's landmarks."""
    rows = frame(df, target, attributes, weight)
    design = Landmarks(rows, attributes, kernel, landmarks) if kernel else Design(rows, attributes, True)
    w = _squared_hinge(rows, design, lambda t: t["_y"].to_numpy(float), cost, steps, epsilon)
    return Linear(design, w, attributes)


# Kernels -------------------------------------------------------------------------------------


def poly_kernel(exponent: float = 1.0, lower: bool = False) -> Callable:
    return lambda a, b: (a @ b.T + (1.0 if lower else 0.0)) ** exponent


def normalised_poly_kernel(exponent: float = 2.0, lower: bool = False) -> Callable:
    k = poly_kernel(exponent, lower)
    own = lambda a: ((a * a).sum(1) + (1.0 if lower else 0.0)) ** exponent
    return lambda a, b: k(a, b) / np.sqrt(np.maximum(np.outer(own(a), own(b)), 1e-300))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def rbf_kernel(gamma: float = 0.01) -> Callable:
    return lambda a, b: np.exp(-gamma * _squares(a, b))


def puk_kernel(omega: float = 1.0, sigma: float = 1.0) -> Callable:
    """Pearson's universal kernel."""
    return lambda a, b: (1 + (2 * np.sqrt(_squares(a, b)) * math.sqrt(2 ** (1 / omega) - 1) / sigma) ** 2) ** -omega


def precomputed_kernel(matrix: np.ndarray) -> Callable:
    """Rows have one number, their place in the matrix."""
    return lambda a, b: matrix[a[:, 0].astype(int)][:, b[:, 0].astype(int)]


class Landmarks:
    """Features whose products are the kernel's as far as the landmarks tell: an exact copy for rows among them."""

    def __init__(self, rows: DataFrame, attributes: list[str], kernel, count: int, scaled: bool = True):
        self.inner, self.kernel = Design(rows, attributes, scaled), kernel
        some = rows.select(*attributes).distinct().orderBy(F.xxhash64(*attributes), *attributes).limit(count).toPandas()
        self.points = self.inner(some)[:, 1:]
        values, vectors = np.linalg.eigh(kernel(self.points, self.points))
        good = values > max(values.max(), 1e-300) * 1e-10
        self.root = vectors[:, good] / np.sqrt(values[good])

    def __call__(self, x: pd.DataFrame) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), self.kernel(self.inner(x)[:, 1:], self.points) @ self.root])


def gaussian_process(df, target, attributes, weight=None, kernel=None, noise: float = 1.0, landmarks: int = 500) -> Linear:
    """The mean of a Gaussian process with the target's mean as its own, one pass over the rows."""
    rows = frame(df, target, attributes, weight)
    design = Landmarks(rows, attributes, kernel or rbf_kernel(1.0), landmarks)
    m = products(rows, design)["0"][:-1]
    p = m.shape[1] - 1
    mean = m[0, p] / m[0, 0]
    a = m[1:p, 1:p] + noise**2 * np.eye(p - 1)
    w = np.linalg.solve(a, m[1:p, p] - mean * m[1:p, 0])
    return Linear(design, np.concatenate([[mean], w]), attributes)


def kernel_columns(df: DataFrame, train: DataFrame, attributes: list[str], kernel, most: int = 1000) -> DataFrame:
    """``df`` with its attributes replaced by ``kernel``: an array of its values with each row of ``train``, of which there may be ``most``."""
    design = Design(train, attributes, True)
    some = train.select(*attributes).limit(most + 1).toPandas()
    if len(some) > most:
        raise ValueError(f"more than {most} training rows")
    points = design(some)[:, 1:]

    @F.pandas_udf("array<double>")
    def values(x: pd.DataFrame) -> pd.Series:
        return pd.Series([r.tolist() for r in kernel(design(x)[:, 1:], points)])

    return df.select(*[c for c in df.columns if c not in attributes], values(F.struct(*attributes)).alias("kernel"))


# Others --------------------------------------------------------------------------------------


class RadialBases:
    def __init__(self, inner: Design, centres: np.ndarray, widths: np.ndarray):
        self.inner, self.centres, self.widths = inner, centres, widths

    def __call__(self, x: pd.DataFrame) -> np.ndarray:
        z = np.exp(-_squares(self.inner(x)[:, 1:], self.centres) / (2 * self.widths[None] ** 2))
        return np.hstack([np.ones((len(x), 1)), z])


def rbf_network(df, target, attributes, weight=None, clusters: int = 2, least: float = 0.1, ridge: float = 1e-4, steps: int = 15):
    """Normal bumps at the k-means centres of each class (of all rows, for numbers), under a logistic or linear layer."""
    rows = frame(df, target, attributes, weight)
    number = dict(rows.dtypes)["_y"] == "double"
    classes, inner = None if number else class_values(rows, "_y"), Design(rows, attributes, True)
    centres, widths = [], []
    for c in classes or [None]:
        part = rows if c is None else rows.where(F.col("_y") == c)
        found, spread = _plain_k_means(part, inner, clusters)
        centres.append(found)
        widths.append(np.maximum(spread, least))
    design = RadialBases(inner, np.vstack(centres), np.concatenate(widths))
    if number:
        m = products(rows, design)["0"][:-1]
        return Linear(design, solve(np.vstack([m, m[:1]]), m.shape[1] - 1, ridge), attributes)
    return Linear(design, _newton(rows, design, classes, ridge, steps)[0], attributes, classes, _shares)


def _plain_k_means(rows: DataFrame, design, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    some = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(200).toPandas()
    x = design(some)[:, 1:]
    chosen = [x[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[_squares(x, np.array(chosen)).min(1).argmax()])
    centres = np.array(chosen)
    for _ in range(rounds):

        def add(t: pd.DataFrame, centres=centres):
            z = design(t)[:, 1:]
            d = _squares(z, centres)
            at = d.argmin(1)
            out = np.zeros((len(centres), z.shape[1] + 2))
            np.add.at(out, at, np.column_stack([np.ones(len(z)), d.min(1), z]))
            yield "s", out

        s = gather(rows, add)["s"]
        after = np.where(s[:, :1] > 0, s[:, 2:] / np.maximum(s[:, :1], 1), centres)
        if np.abs(after - centres).max() < 1e-9:
            break
        centres = after
    return centres, np.sqrt(s[:, 1] / np.maximum(s[:, 0], 1) / max(centres.shape[1], 1))


def _mixed(rows: DataFrame, design, update, start: np.ndarray, epochs: int) -> np.ndarray:
    """Online learning on every partition from the same weights, then the mean of the partitions' weights by their rows,
    again for each epoch. On one partition this is the plain sequential learner; rows are taken in order of their hash."""
    w = start
    ordered = rows.withColumn("_o", F.xxhash64(*rows.columns)).sortWithinPartitions("_o", *rows.columns).drop("_o")
    for _ in range(epochs):

        def part(tables, w=w):
            own, mean, n = w.copy(), np.zeros_like(w), 0
            for t in tables:
                x, y = design(t), t["_y"]
                for i in range(len(t)):
                    own = update(own, x[i], y.iloc[i])
                    mean, n = mean + own, n + 1
            if n:
                yield pd.DataFrame({"n": [n], "w": [own.tobytes()], "m": [mean.tobytes()]})

        got = ordered.mapInPandas(part, "n long, w binary, m binary").toPandas()
        total = got["n"].sum()
        w = sum(np.frombuffer(b).reshape(w.shape) * n for b, n in zip(got["w"], got["n"])) / total
        mean = sum(np.frombuffer(b).reshape(w.shape) for b in got["m"]) / total
    return mean


def voted_perceptron(df, target, attributes, weight=None, epochs: int = 3) -> Linear:
    """Perceptron updates; every state of the weights votes as long as it lasted, which a linear one does as their mean."""
    rows = frame(df, target, attributes, weight)
    classes, design = class_values(rows, "_y"), Design(rows, attributes, True)
    if len(classes) != 2:
        raise ValueError("two classes are needed")
    update = lambda w, x, y: w if (1 if y == classes[1] else -1) * (x @ w) > 0 else w + (1 if y == classes[1] else -1) * x
    w = _mixed(rows, design, update, np.zeros(len(design.names) + 1), epochs)
    return Linear(design, np.column_stack([-w, w]), attributes, classes, _margin_shares)


class _Doubled:
    """0 or 1 a value of nominal attributes, and their complements."""

    def __init__(self, table: Table):
        self.table = table

    def __call__(self, x):
        f = self.table.flat(x, np.zeros(len(self.table.numbers)))
        return np.hstack([f, 1 - f])


def winnow(df, target, attributes, weight=None, epochs: int = 5, factor: float = 2.0, balanced: bool = True) -> Linear:
    """Multiplies or divides the weights of present features at each error; ``balanced`` also looks at absent ones."""
    rows = frame(df, target, attributes, weight)
    classes, table = class_values(rows, "_y"), Table.of(rows, attributes)
    if len(classes) != 2 or table.numbers:
        raise ValueError("two classes and nominal attributes are needed")
    design = _Doubled(table) if balanced else (lambda x, d=_Doubled(table): d(x)[:, : len(table.names())])
    n = len(table.names()) * (2 if balanced else 1)
    limit = n / 2

    def update(w, x, y):
        right = (x @ w > limit) == (y == classes[1])
        return w if right else w * np.where(x > 0, factor if y == classes[1] else 1 / factor, 1.0)

    w = _mixed(rows, design, update, np.ones(n), epochs)
    return Linear(design, np.column_stack([-w, w]), attributes, classes, lambda s: _margin_shares((s + np.array([limit, -limit])) / limit))


def simple_logistic(df, target, attributes, weight=None, rounds: int = 20) -> Linear:
    """Additive logistic regression: at each round every class adds the one attribute whose line fits its working response best."""
    rows = frame(df, target, attributes, weight)
    classes, design = class_values(rows, "_y"), Design(rows, attributes, True)
    k, w = len(classes), np.zeros((len(design.names) + 1, len(classes)))
    for _ in range(rounds):

        def add(t: pd.DataFrame, w=w):
            x, y, m = design(t), one_hot(t["_y"], classes), t["_w"].to_numpy()
            q = softmax(x @ w)
            for c in range(k):
                v = np.maximum(q[:, c] * (1 - q[:, c]), 1e-10)
                z = np.clip((y[:, c] - q[:, c]) / v, -3, 3)
                v = v * m
                yield str(c), np.column_stack([np.repeat(v.sum(), x.shape[1]), x.T @ v, (x * x).T @ v, np.repeat((v * z).sum(), x.shape[1]), x.T @ (v * z)])

        found, step = gather(rows, add), np.zeros_like(w)
        for c in range(k):
            n, sx, sxx, sz, sxz = found[str(c)].T
            spread = sxx - sx**2 / n
            slope = np.where(spread > 1e-9, (sxz - sx * sz / n) / np.where(spread > 1e-9, spread, 1), 0)
            best = int(np.argmax(slope**2 * spread))
            step[best, c] += slope[best]
            step[0, c] += (sz[0] - slope[best] * sx[best]) / n[0]
        w = w + (k - 1) / k * (step - step.mean(1, keepdims=True))
    return Linear(design, w, attributes, classes, softmax)


def pls_weights(m: np.ndarray, p: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """SIMPLS on sums of products: a projection of the centred columns, and the coefficients of the components."""
    n = m[0, 0]
    xx = m[1:p, 1:p] - np.outer(m[0, 1:p], m[0, 1:p]) / n
    s = (m[1:p, p] - m[0, 1:p] * m[0, p] / n)[:, None]
    r, v, q = [], [], []
    for _ in range(min(components, p - 1)):
        w = s[:, 0].copy()
        length = math.sqrt(max(w @ xx @ w, 0))
        if length < 1e-9:
            break
        w /= length
        load = xx @ w
        q.append(float((m[1:p, p] - m[0, 1:p] * m[0, p] / n) @ w))
        base = load.copy()
        for u in v:
            base -= u * (u @ load)
        base /= max(np.linalg.norm(base), 1e-12)
        s = s - np.outer(base, base @ s)
        r.append(w)
        v.append(base)
    return np.column_stack(r) if r else np.zeros((p - 1, 0)), np.array(q)


def pls_filter(df: DataFrame, attributes: list[str], target: str, components: int = 20):
    """``fit`` of partial least squares: gives what replaces the attributes by ``PLS_1 ..``."""
    rows = frame(df, target, attributes)
    design = Design(rows, attributes, True)
    m = products(rows, design)["0"][:-1]
    project = pls_weights(m, m.shape[1] - 1, components)[0]
    mean = m[0, 1:-1] / m[0, 0]

    def apply(table: DataFrame) -> DataFrame:
        @F.pandas_udf("array<double>")
        def parts(x: pd.DataFrame) -> pd.Series:
            return pd.Series([r.tolist() for r in (design(x)[:, 1:] - mean) @ project])

        held = table.withColumn("_pls", parts(F.struct(*attributes)))
        return held.select(*[c for c in table.columns if c not in attributes], *[F.get("_pls", F.lit(i)).alias(f"PLS_{i + 1}") for i in range(project.shape[1])])

    return apply


def pls_regression(df, target, attributes, weight=None, components: int = 20) -> Linear:
    rows = frame(df, target, attributes, weight)
    design = Design(rows, attributes, True)
    m = products(rows, design)["0"][:-1]
    p = m.shape[1] - 1
    project, q = pls_weights(m, p, components)
    b = project @ q
    return Linear(design, np.concatenate([[m[0, p] / m[0, 0] - m[0, 1:p] / m[0, 0] @ b], b]), attributes)
