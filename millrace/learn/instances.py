"""Learners of bags: a table has a row an instance, with its bag and the bag's class. A bag is positive for the second class.

Bags meet by their key in Spark where each is worked on alone. Learners that compare every bag with every
instance hold at most ``MOST_KEPT`` instances.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.learn.base import Model, Scheme, class_values, gather, is_number
from millrace.learn.functions import linear_svm
from millrace.plans.storage import stored

MOST_KEPT = 20_000


class BagModel:
    """``transform(df)``: ``bag, prediction, distribution``, a row a bag. ``score`` is given a bag's instances."""

    classes: list[str]

    def __init__(self, classes, columns, score):
        self.classes, self.columns, self.score = classes, columns, score

    def transform(self, df: DataFrame, bag: str) -> DataFrame:
        held = self

        def one(t: pd.DataFrame) -> pd.DataFrame:
            s = np.asarray(held.score(t), float)
            return pd.DataFrame({bag: [t[bag].iloc[0]], "prediction": [held.classes[int(s.argmax())]], "distribution": [s.tolist()]})

        return df.select(bag, *self.columns).groupBy(bag).applyInPandas(one, f"{bag} {dict(df.dtypes)[bag]}, prediction string, distribution array<double>")


class _Two:
    """Instances and bags of two classes as arrays."""

    def __init__(self, df: DataFrame, bag: str, target: str, columns: list[str]):
        held = df.select(bag, F.col(target).cast("string").alias("_y"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop().orderBy(bag, *columns).limit(MOST_KEPT + 1).toPandas()
        if len(held) > MOST_KEPT:
            raise ValueError(f"more than {MOST_KEPT} instances")
        self.classes = sorted(held["_y"].unique())
        if len(self.classes) != 2:
            raise ValueError("two classes are needed")
        x = held[columns].to_numpy(float)
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        self.columns, self.x = columns, (x - self.mean) / self.scale
        self.bags, first = np.unique(held[bag].to_numpy(), return_inverse=True)
        self.of = first
        self.y = np.array([held["_y"][first == i].iloc[0] == self.classes[1] for i in range(len(self.bags))])

    def unit(self, t: pd.DataFrame) -> np.ndarray:
        return (t[self.columns].astype(float).fillna(0.0).to_numpy() - self.mean) / self.scale

    def model(self, positive) -> BagModel:
        def score(t):
            p = float(np.clip(positive(self.unit(t)), 0, 1))
            return [1 - p, p]

        return BagModel(self.classes, self.columns, score)


def simple_mi(df: DataFrame, bag: str, target: str, columns: list[str], scheme: Scheme, method: str = "mean") -> tuple:
    """A row a bag, then a plain scheme: means and commonest values, ``midrange``, or ``ends`` with both least and largest."""
    held = propositional(df, bag, columns, method, target)
    names = [c for c in held.columns if c not in (bag, target)]
    model = scheme(held, target, names, None)
    return model, lambda rows: model.transform(propositional(rows, bag, columns, method), distribution=None).select(bag, "prediction")


def propositional(df: DataFrame, bag: str, columns: list[str], method: str = "mean", target: str | None = None) -> DataFrame:
    kinds = dict(df.dtypes)
    numbers, texts = [c for c in columns if is_number(kinds[c])], [c for c in columns if not is_number(kinds[c])]
    if method == "ends":
        made = [x for c in numbers for x in (F.min(c).cast("double").alias(f"min_{c}"), F.max(c).cast("double").alias(f"max_{c}"))]
    else:
        made = [(F.avg(c) if method == "mean" else (F.min(c) + F.max(c)) / 2).alias(c) for c in numbers]
    first = [F.min(target).alias(target)] if target else []
    found = df.groupBy(bag).agg(*made, *first, F.count(F.lit(1)).alias("_n")).drop("_n")
    for c in texts:
        n = df.where(F.col(c).isNotNull()).groupBy(bag, c).count()
        top = n.groupBy(bag).agg(F.min(F.struct((-F.col("count")).alias("n"), c)).alias("_top")).select(bag, F.col(f"_top.{c}").alias(c))
        found = found.join(top, bag, "left")
    return found


def mi_wrapper(df: DataFrame, bag: str, target: str, columns: list[str], scheme: Scheme, method: str = "mean"):
    """A plain scheme on instances, each bag weighing the same; ``apply`` averages its instances' shares: ``mean``, ``geometric`` or
    ``max``."""
    sizes = df.groupBy(bag).agg((1.0 / F.count("*")).alias("_share"))
    model = scheme(stored(df.join(sizes, bag), "wrapped"), target, columns, "_share")

    def apply(rows: DataFrame) -> DataFrame:
        held = model.transform(rows, "_g", "_d")
        f = {"mean": F.avg, "geometric": lambda c: F.exp(F.avg(F.log(F.greatest(c, F.lit(1e-12))))), "max": F.max}[method]
        s = held.groupBy(bag).agg(F.array(*[f(F.get("_d", F.lit(i))) for i in range(len(model.classes))]).alias("s"))
        return s.select(bag, F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("s", F.array_max("s")).cast("int")).alias("prediction"))

    return model, apply


def _hausdorff(a: np.ndarray, b: np.ndarray, rank: int) -> float:
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    k = lambda m: np.sort(m)[min(rank, len(m)) - 1]
    return max(k(d.min(1)), k(d.min(0)))


def citation_knn(df: DataFrame, bag: str, target: str, columns: list[str], references: int = 2, citers: int = 2, rank: int = 1) -> BagModel:
    """Votes of the bags nearest to a bag, and of those to which it is among the nearest; a bag is as far as the instance of the
    given rank is from its nearest in the other."""
    t = _Two(df, bag, target, columns)
    parts = [t.x[t.of == i] for i in range(len(t.bags))]
    between = np.array([[_hausdorff(a, b, rank) if i != j else np.inf for j, b in enumerate(parts)] for i, a in enumerate(parts)])
    reach = np.sort(between, 1)[:, min(citers, len(parts) - 1) - 1] if len(parts) > 1 else np.zeros(1)

    def positive(z):
        d = np.array([_hausdorff(z, p, rank) for p in parts])
        votes = np.concatenate([t.y[np.argsort(d, kind="stable")[:references]], t.y[d <= reach]])
        return votes.mean() if len(votes) else t.y.mean()

    return t.model(positive)


def optimal_ball(df: DataFrame, bag: str, target: str, columns: list[str]) -> BagModel:
    """The ball around an instance of a positive bag that parts the bags best by whether they reach into it."""
    t = _Two(df, bag, target, columns)
    best = (-1, None, 0.0)
    for i in np.flatnonzero(t.y[t.of]):
        d = np.sqrt(((t.x - t.x[i]) ** 2).sum(1))
        near = np.full(len(t.bags), np.inf)
        np.minimum.at(near, t.of, d)
        order = np.sort(near)
        cuts = np.append((order[1:] + order[:-1]) / 2, order[-1] + 1e-9)
        hits = ((near[None] <= cuts[:, None]) == t.y[None]).sum(1)
        if hits.max() > best[0]:
            best = (hits.max(), t.x[i], cuts[int(hits.argmax())])
    return t.model(lambda z: float(np.sqrt(((z - best[1]) ** 2).sum(1)).min() <= best[2]))


def _descend(f, start: np.ndarray, steps: int = 200) -> tuple[float, np.ndarray]:
    """Least value by Adam from a start; ``f`` gives value and slope."""
    x, m, v, best = start.copy(), np.zeros_like(start), np.zeros_like(start), (np.inf, start)
    for k in range(1, steps + 1):
        value, g = f(x)
        best = (value, x.copy()) if value < best[0] else best
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return best


def _bag_chance(p: np.ndarray, of: np.ndarray, n: int, how: str) -> np.ndarray:
    if how == "any":
        logs = np.zeros(n)
        np.add.at(logs, of, np.log1p(-np.clip(p, 0, 1 - 1e-9)))
        return 1 - np.exp(logs)
    s, c = np.zeros(n), np.bincount(of, minlength=n)
    np.add.at(s, of, p)
    return s / c


def _likelihood(t: _Two, instance, how: str):
    """Of bags, for chances of instances ``instance(x, w) -> (p, dp/dw)``."""
    n = len(t.bags)

    def f(w):
        p, slope = instance(t.x, w)
        q = np.clip(_bag_chance(p, t.of, n, how), 1e-9, 1 - 1e-9)
        value = -(np.where(t.y, np.log(q), np.log(1 - q))).sum()
        dq = np.where(t.y, -1 / q, 1 / (1 - q))
        if how == "any":
            dp = dq[t.of] * (1 - q[t.of]) / np.maximum(1 - p, 1e-9)
        else:
            dp = dq[t.of] / np.bincount(t.of, minlength=n)[t.of]
        return value / n, (slope.T @ dp) / n

    return f


def logistic_mi(df: DataFrame, bag: str, target: str, columns: list[str], how: str = "any", ridge: float = 1e-3, steps: int = 300) -> BagModel:
    """Instances positive by a logistic line; a bag if ``any`` is, or as their ``mean`` is. Bags are summed where they lie, one
    pass a step."""
    t = _Two(df, bag, target, columns)

    def instance(x, w):
        z = np.hstack([np.ones((len(x), 1)), x])
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        return p, z * (p * (1 - p))[:, None]

    inner = _likelihood(t, instance, how)

    def f(w):
        value, slope = inner(w)
        return value + ridge * (w[1:] ** 2).sum(), slope + 2 * ridge * np.append([0.0], w[1:])

    w = _descend(f, np.zeros(t.x.shape[1] + 1), steps)[1]
    return t.model(lambda z: float(_bag_chance(instance(z, w)[0], np.zeros(len(z), int), 1, how)[0]))


def diverse_density(df: DataFrame, bag: str, target: str, columns: list[str], how: str = "any", starts: int = 10, steps: int = 150) -> BagModel:
    """A point and scales such that every positive bag, and no negative one, has an instance near it; the best of descents from
    instances of positive bags. ``mean``: bags are as near as their instances on average."""
    t = _Two(df, bag, target, columns)
    d = t.x.shape[1]

    def instance(x, w):
        point, scale = w[:d], w[d:]
        gap = x - point
        p = np.exp(-np.minimum((gap**2 * scale**2).sum(1), 50))
        return p, np.hstack([2 * gap * scale**2, -2 * gap**2 * scale]) * p[:, None]

    f = _likelihood(t, instance, how)
    seeds = np.flatnonzero(t.y[t.of])[:: max(1, int(t.y[t.of].sum()) // starts)]
    w = min((_descend(f, np.concatenate([t.x[i], np.ones(d)]), steps) for i in seeds), key=lambda r: r[0])[1]
    return t.model(lambda z: float(_bag_chance(instance(z, w)[0], np.zeros(len(z), int), 1, how)[0]))


def em_diverse_density(df: DataFrame, bag: str, target: str, columns: list[str], starts: int = 5, rounds: int = 5, steps: int = 100) -> BagModel:
    """Diverse density in which each bag stands for its most likely instance, chosen anew after each descent."""
    t = _Two(df, bag, target, columns)
    d = t.x.shape[1]
    best = (np.inf, None)
    for i in np.flatnonzero(t.y[t.of])[:: max(1, int(t.y[t.of].sum()) // starts)]:
        w, before = np.concatenate([t.x[i], np.ones(d)]), np.inf
        for _ in range(rounds):
            near = ((t.x - w[:d]) ** 2 * w[d:] ** 2).sum(1)
            chosen = np.array([np.flatnonzero(t.of == b)[near[t.of == b].argmin()] for b in range(len(t.bags))])
            x = t.x[chosen]

            def f(w, x=x):
                gap = x - w[:d]
                p = np.clip(np.exp(-np.minimum((gap**2 * w[d:] ** 2).sum(1), 50)), 1e-9, 1 - 1e-9)
                dp = np.where(t.y, -1 / p, 1 / (1 - p)) * p
                return -np.where(t.y, np.log(p), np.log(1 - p)).mean(), np.concatenate([(2 * gap * w[d:] ** 2 * dp[:, None]).mean(0), (-2 * gap**2 * w[d:] * dp[:, None]).mean(0)])

            value, w2 = _descend(f, w, steps)
            if value >= before - 1e-6:
                break
            w, before = w2, value
        if before < best[0]:
            best = (before, w)
    w = best[1]
    return t.model(lambda z: float(np.exp(-((z - w[:d]) ** 2 * w[d:] ** 2).sum(1).min())))


def mi_boost(df: DataFrame, bag: str, target: str, columns: list[str], scheme: Scheme, rounds: int = 5) -> BagModel:
    """Boosting of bags: a member's error in a bag is the share of its instances that it answers wrongly."""
    classes = class_values(df, target)
    sizes = df.groupBy(bag).agg(F.count("*").alias("_n"))
    rows = stored(df.join(sizes, bag).withColumn("_w", 1.0 / F.col("_n")), "mi-boost")
    members, votes = [], []
    for _ in range(rounds):
        m = scheme(rows, target, columns, "_w")
        judged = m.transform(rows, "_g", None).withColumn("_wrong", F.when(F.col("_g") == F.col(target).cast("string"), 0.0).otherwise(1.0))
        by = judged.groupBy(bag).agg(F.avg("_wrong").alias("e"), F.sum("_w").alias("w"))
        e, w = (np.array(v, float) for v in zip(*[(r["e"], r["w"]) for r in by.select("e", "w").collect()]))
        if (e < 0.5).all() or (e > 0.5).all():
            members.append(m)
            votes.append(1.0 if (e < 0.5).all() else -1.0)
            break
        c = 0.0
        for _ in range(50):  # Newton on the expected loss
            g = (w * (2 * e - 1) * np.exp((2 * e - 1) * c)).sum()
            h = (w * (2 * e - 1) ** 2 * np.exp((2 * e - 1) * c)).sum()
            c -= max(min(g / max(h, 1e-12), 1), -1)
        if c <= 1e-9:
            break
        members.append(m)
        votes.append(c)
        factor = by.select(F.col(bag).alias("_b"), F.exp((2 * F.col("e") - 1) * c).alias("_f"))
        grown = rows.join(factor, rows[bag] == F.col("_b")).withColumn("_w", F.col("_w") * F.col("_f")).select(rows.columns)
        total = grown.agg(F.sum("_w")).first()[0]
        rows = stored(grown.withColumn("_w", F.col("_w") * (len(e) / total)), "mi-boost")

    def score(t: pd.DataFrame):
        s = sum(v * (np.eye(len(classes))[[classes.index(m.classes[i]) for i in m.scores(t).argmax(1)]] * 2 - 1).mean(0) for m, v in zip(members, votes)) if members else np.zeros(len(classes))
        p = np.exp(s - s.max())
        return p / p.sum()

    return BagModel(classes, columns, score)


def mi_svm(df: DataFrame, bag: str, target: str, columns: list[str], rounds: int = 10, cost: float = 1.0) -> BagModel:
    """A margin learner whose instances of positive bags are labelled by itself, at least one positive a bag, until none changes."""
    classes = class_values(df, target)
    rows = stored(df.select(bag, *columns, (F.col(target).cast("string") == classes[1]).alias("_bag")).withColumn("_l", F.when(F.col("_bag"), "1").otherwise("0")), "mi-svm")
    for _ in range(rounds):
        model = linear_svm(rows, "_l", columns, None, cost)
        judged = model.transform(rows, "_g", "_d").withColumn("_s", F.get("_d", F.lit(1))).drop("_d")
        top = judged.where("_bag").groupBy(bag).agg(F.max("_s").alias("_top")).withColumnRenamed(bag, "_b")
        after = judged.join(top, F.col(bag) == F.col("_b"), "left").withColumn("_new", F.when(F.col("_bag") & ((F.col("_g") == "1") | (F.col("_s") == F.col("_top"))), "1").otherwise("0"))
        after = stored(after.select(bag, *columns, "_bag", "_l", "_new"), "mi-svm")
        moved = after.where("_new <> _l").limit(1).count()
        rows = after.select(bag, *columns, "_bag", F.col("_new").alias("_l"))
        if not moved:
            break

    def score(t: pd.DataFrame):
        p = model.scores(t)[:, 1].max()
        return [1 - p, p]

    return BagModel(classes, columns, score)


def nearest_distribution(df: DataFrame, bag: str, target: str, columns: list[str], k: int = 1) -> BagModel:
    """The classes of the ``k`` bags whose normal distributions are nearest, by divergence."""
    t = _Two(df, bag, target, columns)

    def moments(z):
        return z.mean(0), z.var(0) + 1e-2

    held = [moments(t.x[t.of == i]) for i in range(len(t.bags))]
    gap = lambda a, b: (0.5 * (a[1] / b[1] + (a[0] - b[0]) ** 2 / b[1] - 1 + np.log(b[1] / a[1]))).sum()

    def positive(z):
        own = moments(z)
        d = np.array([gap(own, h) + gap(h, own) for h in held])
        return t.y[np.argsort(d, kind="stable")[:k]].mean()

    return t.model(positive)


def two_level(df: DataFrame, bag: str, target: str, columns: list[str], simple: bool = True) -> BagModel:
    """Bags whose means are normal in each class, around instances that are normal in each bag; ``simple`` takes one spread within
    bags for a class, else every bag has its own, drawn towards it. Moments come from one aggregation by bag and one by class."""
    classes = class_values(df, target)
    by = df.groupBy(bag, F.col(target).cast("string").alias("_y")).agg(F.count("*").alias("n"), *[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"m{i}"), F.coalesce(F.var_samp(c), F.lit(0.0)).alias(f"v{i}"))])
    d = range(len(columns))
    within = [x for i in d for x in (F.avg(f"m{i}").alias(f"mu{i}"), F.coalesce(F.var_samp(f"m{i}"), F.lit(0.0)).alias(f"b{i}"), (F.sum(F.col(f"v{i}") * (F.col("n") - 1)) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))).alias(f"s{i}"))]
    found = {r["_y"]: r for r in by.groupBy("_y").agg(F.count("*").alias("bags"), F.avg(1 / F.col("n")).alias("small"), *within).collect()}
    total = sum(r["bags"] for r in found.values())

    def score(t: pd.DataFrame):
        logs = []
        z = t[columns].astype(float)
        mean, n, own = z.mean().to_numpy(), len(z), z.var(ddof=1).fillna(0.0).to_numpy()
        for c in classes:
            r = found[c]
            inner = np.array([max(r[f"s{i}"], 1e-6) for i in d])
            if not simple:
                inner = (inner * 5 + own * (n - 1)) / (5 + n - 1) + 1e-9
            outer = np.array([max(r[f"b{i}"] - r["small"] * r[f"s{i}"], 1e-6) for i in d])
            spread = outer + inner / n
            mu = np.array([r[f"mu{i}"] for i in d])
            logs.append(math.log(r["bags"] / total) - (0.5 * np.log(spread) + (mean - mu) ** 2 / (2 * spread)).sum())
        p = np.exp(np.array(logs) - max(logs))
        return p / p.sum()

    return BagModel(classes, columns, score)


def accuracy(model, df: DataFrame, bag: str, target: str) -> float:
    """The share of bags answered rightly."""
    got = (model.transform(df, bag) if isinstance(model, BagModel) else model(df)).select(F.col(bag).alias("_b"), "prediction")
    truth = df.groupBy(bag).agg(F.min(F.col(target).cast("string")).alias("_t"))
    return truth.join(got, truth[bag] == got["_b"]).agg(F.avg(F.when(F.col("prediction") == F.col("_t"), 1.0).otherwise(0.0))).first()[0]




def instance_sums(df: DataFrame, bag: str, columns: list[str]) -> dict:
    """Of each bag's instances the number and the sums, for models of one's own."""
    return gather(df.select(F.col(bag).cast("string").alias("_b"), *columns), lambda t: ((b, np.concatenate([[len(p)], p[columns].to_numpy(float).sum(0)])) for b, p in t.groupby("_b")))
