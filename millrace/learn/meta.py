"""Committees and wrappers around schemes. A member is fitted by passes over the rows; a committee scores in one.

Rows are drawn by hash: a draw is a weight, and rows of weight 0 are filtered before a member sees them.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.learn import trees
from millrace.learn.base import Constant, Model, Scheme, class_values, frame, gather, is_number, majority, normalised, one_hot, softmax
from millrace.operators.evaluation import assignment
from millrace.plans.naming import free
from millrace.plans.storage import stored

W = "_millrace_w"


def uniform(seed: int, *columns: str, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def drawn(df: DataFrame, seed: int, member: int, weight: str | None = None) -> DataFrame:
    """Rows with their count in a sample with replacement, a Poisson draw by hash, as weight ``W``."""
    u, times, at = uniform(seed, *df.columns, salt=member), F.lit(0.0), math.exp(-1)
    for k in range(1, 8):
        times = times + F.when(u >= at, 1.0).otherwise(0.0)
        at += math.exp(-1) / math.factorial(k)
    return df.withColumn(W, _weight(weight) * times).where(F.col(W) > 0)


def number_target(df: DataFrame, target: str) -> bool:
    return is_number(dict(df.dtypes)[target])


def aligned(model: Model, x: pd.DataFrame, classes: list[str]) -> np.ndarray:
    """A member's shares over all classes, of which it may know fewer."""
    s = model.scores(x)
    if model.classes == classes:
        return s
    out = np.zeros((len(x), len(classes)))
    for i, c in enumerate(model.classes):
        if c in classes:
            out[:, classes.index(c)] = s[:, i]
    return out


class Committee(Model):
    """``rule``: mean, product, majority, min, max or median of the members' shares; mean or median of numbers."""

    def __init__(self, members: list[Model], classes: list[str] | None, weights: list[float] | None = None, rule: str = "mean", attributes: list[str] | None = None):
        self.members, self.classes, self.rule = members, classes, rule
        self.weights = np.array(weights if weights is not None else [1.0] * len(members), float)
        self.attributes = attributes or list(dict.fromkeys(a for m in members for a in m.attributes))

    def scores(self, x):
        if self.classes is None:
            s = np.array([m.scores(x) for m in self.members])
            return np.median(s, 0) if self.rule == "median" else np.average(s, 0, self.weights)
        s = np.array([aligned(m, x, self.classes) for m in self.members])
        if self.rule == "majority":
            s = np.eye(len(self.classes))[s.argmax(2)]
        if self.rule == "product":
            logs = np.log(np.maximum(s, 1e-300)).sum(0)
            return softmax(logs)
        if self.rule in ("min", "max", "median"):
            return normalised(getattr(np, self.rule)(s, 0))
        return normalised(np.tensordot(self.weights, s, 1))


def vote(df, target, attributes, weight=None, schemes: list[Scheme] = (), rule: str = "mean") -> Committee:
    classes = None if number_target(df, target) else class_values(df, target)
    return Committee([s(df, target, attributes, weight) for s in schemes], classes, rule=rule, attributes=attributes)


def bagging(df, target, attributes, weight=None, base: Scheme = trees.rep_tree, members: int = 10, seed: int = 1) -> Committee:
    classes = None if number_target(df, target) else class_values(df, target)
    return Committee([base(drawn(df, seed, k, weight), target, attributes, W) for k in range(members)], classes, attributes=attributes)


def random_committee(df, target, attributes, weight=None, base: Scheme = trees.random_tree, members: int = 10, seed: int = 1) -> Committee:
    """The same rows, other seeds."""
    classes = None if number_target(df, target) else class_values(df, target)
    return Committee([base(df, target, attributes, weight, seed=seed + k) for k in range(members)], classes, attributes=attributes)


def random_subspace(df, target, attributes, weight=None, base: Scheme = trees.rep_tree, members: int = 10, share: float = 0.5, seed: int = 1) -> Committee:
    """The same rows, some of the attributes."""
    r, n = random.Random(seed), max(1, int(share * len(attributes) + 0.5))
    classes = None if number_target(df, target) else class_values(df, target)
    return Committee([base(df, target, sorted(r.sample(attributes, n), key=attributes.index), weight) for _ in range(members)], classes, attributes=attributes)


def _dealt(df: DataFrame, target: str, parts: int, seed: int) -> DataFrame:
    """A column ``_part``, dealt by hash within each class: even by expectation, without a sort of the table."""
    return df.withColumn("_part", F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(parts)).cast("int"))


def dagging(df, target, attributes, weight=None, base: Scheme = trees.rep_tree, members: int = 10, seed: int = 1) -> Committee:
    """Each member gets a part of the rows of its own."""
    held = stored(_dealt(df, target, members, seed), "dagging")
    classes = None if number_target(df, target) else class_values(df, target)
    parts = [held.where(F.col("_part") == k) for k in range(members)]
    return Committee([base(p, target, attributes, weight) for p in parts if p.limit(1).count()], classes, attributes=attributes)


# Boosting ------------------------------------------------------------------------------------


def adaboost_m1(df, target, attributes, weight=None, base: Scheme = trees.decision_stump, members: int = 10, seed: int = 1, groups: int = 0) -> Committee:
    """Rows answered wrongly weigh more for the next member, whose vote is the logarithm of its odds to be right. ``groups``:
    after each such number of members the weights start anew from draws by hash (multiple boosting)."""
    classes = class_values(df, target)
    rows, found, votes = stored(df.withColumn(W, _weight(weight)), "boost"), [], []
    for k in range(members):
        if groups and k and k % groups == 0:
            rows = stored(rows.withColumn(W, -F.log(1 - uniform(seed, *df.columns, salt=k))), "boost")
        model = base(rows, target, attributes, W)
        judged = model.transform(rows, "_guess", None).withColumn("_right", F.coalesce(F.col("_guess") == F.col(target).cast("string"), F.lit(False)))
        s = judged.where(F.col(target).isNotNull()).agg(F.sum(F.when(~F.col("_right"), F.col(W))).alias("e"), F.sum(W).alias("w"), F.count("*").alias("n")).first()
        error = (s["e"] or 0.0) / s["w"]
        if error >= 0.5 or error <= 1e-12:
            if not found:
                found, votes = [model], [1.0]
            elif error <= 1e-12:
                found.append(model)
                votes.append(10.0)
            if not groups:
                break
            continue
        beta = error / (1 - error)
        found.append(model)
        votes.append(math.log(1 / beta))
        grown = F.col(W) * F.when(F.col("_right"), 1.0).otherwise((1 - error) / error)
        total = s["w"] * (1 - error) + s["e"] * (1 - error) / error
        rows = stored(judged.withColumn(W, grown * (s["w"] / total)).select(*df.columns, W), "boost")
    return Committee(found, classes, votes, "majority", attributes)


def multiboost(df, target, attributes, weight=None, base: Scheme = trees.decision_stump, members: int = 9, seed: int = 1) -> Committee:
    return adaboost_m1(df, target, attributes, weight, base, members, seed, max(1, int(math.sqrt(members))))


def number_stump(df, target, attributes, weight=None) -> trees.TreeModel:
    """One split in two of least variance."""
    return trees.fit_tree(df, target, attributes, weight, trees.Rule("variance", False, 1e-9, depth=1))


class Additive(Model):
    """A sum of numbers, or of one for each class under the logistic link."""

    def __init__(self, start, rounds: list, rate: float, attributes: list[str], classes=None):
        self.start, self.rounds, self.rate, self.attributes, self.classes = start, rounds, rate, attributes, classes

    def raw(self, x: pd.DataFrame) -> np.ndarray:
        if self.classes is None:
            return self.start + self.rate * sum((m.scores(x) for m in self.rounds), np.zeros(len(x)))
        out, k = np.zeros((len(x), len(self.classes))), len(self.classes)
        for models in self.rounds:
            f = np.column_stack([m.scores(x) for m in models])
            out += self.rate * (k - 1) / k * (f - f.mean(1, keepdims=True))
        return out

    def scores(self, x):
        return self.raw(x) if self.classes is None else softmax(self.raw(x))


def additive_regression(df, target, attributes, weight=None, base: Scheme = number_stump, rounds: int = 10, rate: float = 1.0) -> Additive:
    """Each member is fitted to what the ones before leave."""
    held = df.withColumn(W, _weight(weight))
    start = held.where(F.col(target).isNotNull()).agg((F.sum(F.col(target) * F.col(W)) / F.sum(W)).alias("m")).first()["m"] or 0.0
    model = Additive(start, [], rate, attributes)
    rest = stored(held.withColumn("_rest", F.col(target).cast("double") - start), "additive")
    for _ in range(rounds):
        m = base(rest, "_rest", attributes, W)
        model.rounds.append(m)
        rest = stored(m.transform(rest, "_guess").withColumn("_rest", F.col("_rest") - rate * F.col("_guess")).drop("_guess"), "additive")
    return model


def logit_boost(df, target, attributes, weight=None, base: Scheme = number_stump, rounds: int = 10, rate: float = 1.0, start: Additive | None = None) -> Additive:
    """Additive logistic regression: each round fits, for every class, the working response of its present shares."""
    classes = class_values(df, target)
    k = len(classes)
    model = start or Additive(0.0, [], rate, attributes, classes)
    names = [f"_f{i}" for i in range(k)]
    rows = df.where(F.col(target).isNotNull()).withColumn(W, _weight(weight)).withColumns({n: F.lit(0.0) for n in names})
    rows = stored(rows, "logit")
    for _ in range(rounds):
        largest = F.greatest(*names) if k > 1 else F.col(names[0])
        total = sum((F.exp(F.col(n) - largest) for n in names), F.lit(0.0))
        members = []
        for n, c in zip(names, classes):
            p = F.exp(F.col(n) - largest) / total
            v = F.greatest(p * (1 - p), F.lit(1e-10))
            z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.when(F.col(target).cast("string") == c, 1.0).otherwise(0.0) - p) / v))
            members.append(base(rows.withColumns({"_z": z, "_v": F.col(W) * v}), "_z", attributes, "_v"))
        model.rounds.append(members)
        grown = rows
        for i, m in enumerate(members):
            grown = m.transform(grown, f"_g{i}")
        mean = sum((F.col(f"_g{i}") for i in range(k)), F.lit(0.0)) / k
        rows = stored(grown.withColumns({n: F.col(n) + rate * (k - 1) / k * (F.col(f"_g{i}") - mean) for i, n in enumerate(names)}).drop(*[f"_g{i}" for i in range(k)]), "logit")
    return model


def raced_logit_boost(df, target, attributes, weight=None, base: Scheme = number_stump, chunks: tuple[int, ...] = (2, 4), held: int = 10, seed: int = 1) -> Additive:
    """Committees that learn a round from each chunk of the rows in turn, for several numbers of chunks; the one of the
    largest likelihood on rows that none has seen is taken."""
    rows = stored(df.where(F.col(target).isNotNull()).withColumn("_u", uniform(seed, *df.columns)), "raced")
    test, train = rows.where(F.col("_u") < 1 / held), rows.where(F.col("_u") >= 1 / held)
    best = None
    for n in chunks:
        model = None
        for k in range(n):
            part = train.where((F.col("_u") >= 1 / held + (1 - 1 / held) * k / n) & (F.col("_u") < 1 / held + (1 - 1 / held) * (k + 1) / n))
            if not part.limit(1).count():
                continue
            own = logit_boost(part, target, attributes, weight, base, 1)
            model = own if model is None else Additive(0.0, [*model.rounds, *own.rounds], 1.0, attributes, own.classes)
        score = log_likelihood(model, test, target) if model else -math.inf
        if best is None or score > best[0]:
            best = (score, model)
    return best[1]


def log_likelihood(model: Model, rows: DataFrame, target: str) -> float:
    judged = model.transform(rows.where(F.col(target).isNotNull()), "_guess", "_d")
    place = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col(target).cast("string")).cast("int")
    p = F.coalesce(F.try_element_at("_d", place), F.lit(0.0))
    return judged.agg(F.avg(F.log(F.greatest(p, F.lit(1e-9)))).alias("l")).first()["l"] or -math.inf


def accuracy_of(model: Model, rows: DataFrame, target: str) -> float:
    """The share of right answers, or minus the mean squared error."""
    judged = model.transform(rows.where(F.col(target).isNotNull()), "_guess", None) if model.classes is not None else model.transform(rows.where(F.col(target).isNotNull()), "_guess")
    right = F.when(F.col("_guess") == F.col(target).cast("string"), 1.0).otherwise(0.0) if model.classes is not None else -F.pow(F.col("_guess") - F.col(target), 2)
    found = judged.agg(F.avg(right).alias("a")).first()["a"]
    return found if found is not None else -math.inf


def cross_accuracy(df: DataFrame, target: str, attributes: list[str], scheme: Scheme, weight: str | None = None, folds: int = 3, seed: int = 1) -> float:
    held = stored(_dealt(df, target, folds, seed), "crossed")
    got = []
    for k in range(folds):
        test = held.where(F.col("_part") == k)
        if test.limit(1).count():
            got.append(accuracy_of(scheme(held.where(F.col("_part") != k), target, attributes, weight), test, target))
    return sum(got) / max(len(got), 1)


# Stacks --------------------------------------------------------------------------------------


def _member_columns(model: Model, i: int, classes) -> list[str]:
    return [f"_m{i}_{k}" for k in range(len(classes))] if classes is not None else [f"_m{i}"]


def _with_shares(rows: DataFrame, model: Model, i: int, classes) -> DataFrame:
    if classes is None:
        return model.transform(rows, f"_m{i}")
    held = model.transform(rows, "_guess", "_d")
    place = {c: k for k, c in enumerate(model.classes)}
    return held.withColumns({n: F.get("_d", F.lit(place[c])) if c in place else F.lit(0.0) for n, c in zip(_member_columns(model, i, classes), classes)}).drop("_guess", "_d")


def _out_of_fold(df: DataFrame, target: str, attributes, weight, schemes, folds: int, seed: int, classes) -> DataFrame:
    """Every row with the shares that members give it which have not seen it."""
    held, out = stored(_dealt(df, target, folds, seed), "folds"), None
    for f in range(folds):
        train, test = held.where(F.col("_part") != f), held.where(F.col("_part") == f)
        if not test.limit(1).count():
            continue
        for i, s in enumerate(schemes):
            test = _with_shares(test, s(train, target, attributes, weight), i, classes)
        out = test if out is None else out.unionByName(test)
    return stored(out.drop("_part"), "level-1")


class Stack(Model):
    """Members' shares as the attributes of another model; ``keep`` says which of them a class's own model sees."""

    def __init__(self, members: list[Model], top: Model, classes, attributes):
        self.members, self.top, self.classes, self.attributes = members, top, classes, attributes

    def level(self, x: pd.DataFrame) -> pd.DataFrame:
        made = {}
        for i, m in enumerate(self.members):
            s = aligned(m, x, self.classes) if self.classes is not None else m.scores(x)[:, None]
            made |= {n: s[:, k] for k, n in enumerate(_member_columns(m, i, self.classes))}
        return pd.DataFrame(made, index=x.index)

    def scores(self, x):
        s = self.level(x)
        return aligned(self.top, s, self.classes) if self.classes is not None else self.top.scores(s)


def stacking(df, target, attributes, weight=None, schemes: list[Scheme] = (), top: Scheme = None, folds: int = 3, seed: int = 1) -> Stack:
    """Members fitted on all rows, under a model fitted on what members say of rows that they have not seen."""
    from millrace.learn.functions import linear_regression, logistic

    classes = None if number_target(df, target) else class_values(df, target)
    level = _out_of_fold(df, target, attributes, weight, schemes, folds, seed, classes)
    members = [s(df, target, attributes, weight) for s in schemes]
    names = [n for i, m in enumerate(members) for n in _member_columns(m, i, classes)]
    top = top or (linear_regression if classes is None else logistic)
    return Stack(members, top(level, target, names, weight), classes, attributes)


class _PerClass(Model):
    def __init__(self, models: list[Model], classes: list[str], attributes: list[str]):
        self.models, self.classes, self.attributes = models, classes, attributes

    def scores(self, x):
        return normalised(np.clip(np.column_stack([m.scores(x) for m in self.models]), 1e-9, None))


def stacking_c(df, target, attributes, weight=None, schemes: list[Scheme] = (), folds: int = 3, seed: int = 1) -> Stack:
    """Stacking in which a class's line sees the members' shares of that class alone."""
    from millrace.learn.functions import linear_regression

    classes = class_values(df, target)
    level = _out_of_fold(df, target, attributes, weight, schemes, folds, seed, classes)
    members = [s(df, target, attributes, weight) for s in schemes]
    models = []
    for k, c in enumerate(classes):
        own = level.withColumn("_is", F.when(F.col(target).cast("string") == c, 1.0).otherwise(0.0))
        models.append(linear_regression(own, "_is", [f"_m{i}_{k}" for i in range(len(members))], weight, select="none"))
    names = [n for i, m in enumerate(members) for n in _member_columns(m, i, classes)]
    return Stack(members, _PerClass(models, classes, names), classes, attributes)


class Graded(Model):
    def __init__(self, members: list[Model], graders: list[Model], classes, attributes):
        self.members, self.graders, self.classes, self.attributes = members, graders, classes, attributes

    def scores(self, x):
        out = np.zeros((len(x), len(self.classes)))
        for m, g in zip(self.members, self.graders):
            right = aligned(g, x, ["no", "yes"])[:, 1]
            out[np.arange(len(x)), aligned(m, x, self.classes).argmax(1)] += np.where(right > 0.5, right, 0)
        plain = sum(aligned(m, x, self.classes) for m in self.members)
        return normalised(np.where(out.sum(1, keepdims=True) > 0, out, plain))


def grading(df, target, attributes, weight=None, schemes: list[Scheme] = (), grader: Scheme = trees.j48, folds: int = 3, seed: int = 1) -> Graded:
    """For each member a model of where it is right; members vote where they are likely to be."""
    classes = class_values(df, target)
    level = _out_of_fold(df, target, attributes, weight, schemes, folds, seed, classes)
    members, graders = [s(df, target, attributes, weight) for s in schemes], []
    for i, m in enumerate(members):
        names = _member_columns(m, i, classes)
        at = F.array_position(F.array(*names), F.greatest(*names) if len(names) > 1 else F.col(names[0])).cast("int")
        right = F.element_at(F.array(*[F.lit(c) for c in classes]), at) == F.col(target).cast("string")
        graders.append(grader(level.withColumn("_right", F.when(right, "yes").otherwise("no")), "_right", attributes, weight))
    return Graded(members, graders, classes, attributes)


# Choices and wrappers ------------------------------------------------------------------------


def multi_scheme(df, target, attributes, weight=None, schemes: list[Scheme] = (), folds: int = 3, seed: int = 1) -> Model:
    """The scheme that does best on left-out folds, the first of equals, fitted on all rows."""
    scores = [cross_accuracy(df, target, attributes, s, weight, folds, seed) for s in schemes]
    return schemes[int(np.argmax(np.round(scores, 9)))](df, target, attributes, weight)


def parameter_selection(df, target, attributes, weight=None, scheme: Scheme = None, grid: dict[str, list] | None = None, folds: int = 3, seed: int = 1) -> Model:
    """The options of the grid that do best on left-out folds."""
    options = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    best = multi_scheme(df, target, attributes, weight, [lambda d, t, a, w=None, o=o: scheme(d, t, a, w, **o) for o in options], folds, seed)
    return best


def attribute_selected(df, target, attributes, weight=None, scheme: Scheme = None, choose: Callable[[DataFrame, str, list[str]], list[str]] = None) -> Model:
    return scheme(df, target, choose(df, target, attributes), weight)


class Filtered:
    """A filter that was fitted on the training rows before a model."""

    def __init__(self, apply, model: Model):
        self.filter, self.model, self.classes = apply, model, model.classes

    def transform(self, df: DataFrame, prediction: str = "prediction", distribution: str | None = "distribution") -> DataFrame:
        return self.model.transform(self.filter(df), prediction, distribution) if self.classes is not None else self.model.transform(self.filter(df), prediction)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.transform(df, distribution=None)


def filtered(df, target, attributes, weight=None, step=None, scheme: Scheme = None) -> Filtered:
    """``attributes`` are those after the filter; None takes all but the target."""
    apply = step.fit(df) if hasattr(step, "fit") else step
    held = apply(df)
    return Filtered(apply, scheme(held, target, attributes or [c for c in held.columns if c not in (target, weight)], weight))


class LeastCost(Model):
    """Shares all on the class of the least expected cost. ``cost[i][j]``: of answering j where i is right."""

    def __init__(self, inner: Model, cost: np.ndarray):
        self.inner, self.cost, self.classes, self.attributes = inner, cost, inner.classes, inner.attributes

    def scores(self, x):
        return np.eye(len(self.classes))[(self.inner.scores(x) @ self.cost).argmin(1)]


def cost_weights(df: DataFrame, target: str, classes: list[str], cost: np.ndarray, weight: str | None = None) -> DataFrame:
    """Rows weighted by what answering them wrongly costs, the weights' sum unchanged, as ``W``."""
    n = {r[0]: r[1] for r in df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string")).agg(F.sum(_weight(weight))).collect()}
    price = {c: float(cost[i].sum()) for i, c in enumerate(classes)}
    total, priced = sum(n.values()), sum(n.get(c, 0) * price[c] for c in classes)
    factor = F.coalesce(*[F.when(F.col(target).cast("string") == c, price[c] * total / priced if priced else 1.0) for c in classes], F.lit(1.0))
    return df.withColumn(W, _weight(weight) * factor)


def cost_sensitive(df, target, attributes, weight=None, scheme: Scheme = None, cost: list[list[float]] = (), expected: bool = False) -> Model:
    """Reweighted rows, or with ``expected`` the class of the least expected cost. ``cost`` is in order of the classes."""
    classes, c = class_values(df, target), np.array(cost, float)
    if expected:
        return LeastCost(scheme(df, target, attributes, weight), c)
    return scheme(cost_weights(df, target, classes, c, weight), target, attributes, W)


def meta_cost(df, target, attributes, weight=None, scheme: Scheme = None, cost: list[list[float]] = (), members: int = 10, seed: int = 1) -> Model:
    """The scheme on rows whose classes are those of the least expected cost by a bagged committee."""
    committee = LeastCost(bagging(df, target, attributes, weight, scheme, members, seed), np.array(cost, float))
    return scheme(stored(committee.transform(df, "_cheap", None).withColumn(target, F.col("_cheap")).drop("_cheap"), "metacost"), target, attributes, weight)


class Threshold(Model):
    def __init__(self, inner: Model, positive: str, at: float):
        self.inner, self.positive, self.at, self.classes, self.attributes = inner, positive, at, inner.classes, inner.attributes

    def scores(self, x):
        p = self.inner.scores(x)[:, self.classes.index(self.positive)]
        # A share at the threshold becomes one half, the first that counts as positive.
        moved = np.where(p >= self.at, 0.5 + (p - self.at) / max(1 - self.at, 1e-12) / 2 + 1e-9, p / max(self.at, 1e-12) / 2)
        out = np.zeros((len(x), 2))
        out[:, self.classes.index(self.positive)] = np.minimum(moved, 1)
        out[:, 1 - self.classes.index(self.positive)] = 1 - np.minimum(moved, 1)
        return out


def threshold_selector(df, target, attributes, weight=None, scheme: Scheme = None, positive: str | None = None, measure: str = "f", folds: int = 3, seed: int = 1) -> Threshold:
    """The share from which a class counts as positive that is best on left-out folds."""
    from millrace.operators.evaluation import best_threshold
    from millrace.operators.stats import threshold_curve

    classes = class_values(df, target)
    positive = positive or classes[0]
    level = _out_of_fold(df, target, attributes, weight, [scheme], folds, seed, classes)
    curve = threshold_curve(level.withColumn("_is", F.col(target).cast("string") == positive), f"_m0_{classes.index(positive)}", "_is")
    return Threshold(scheme(df, target, attributes, weight), positive, best_threshold(curve, measure))


class Coded(Model):
    """Models of two answers each; a class's score is how well its word of answers fits theirs."""

    def __init__(self, models: list[Model], words: np.ndarray, classes: list[str], attributes: list[str], pairs: bool = False):
        self.models, self.words, self.classes, self.attributes, self.pairs = models, words, classes, attributes, pairs

    def scores(self, x):
        out = np.zeros((len(x), len(self.classes)))
        for m, word in zip(self.models, self.words.T):
            one = aligned(m, x, ["0", "1"])[:, 1][:, None]
            out += np.where(word[None] == 1, one, np.where(word[None] == 0, 1 - one, 0))
        return normalised(out)


def _two(df: DataFrame, target: str, word: dict[str, int]) -> DataFrame:
    made = F.coalesce(*[F.when(F.col(target).cast("string") == c, F.lit(str(v))) for c, v in word.items()])
    return df.withColumn("_two", made).where("_two is not null")


def multi_class(df, target, attributes, weight=None, scheme: Scheme = None, method: str = "rest", width: float = 2.0, seed: int = 1) -> Coded:
    """``rest``: each class against the others; ``pairs``; ``random`` words of ``width`` answers a class; ``exhaustive`` words."""
    classes, r = class_values(df, target), random.Random(seed)
    k = len(classes)
    if method == "rest":
        words = np.eye(k, dtype=int)
    elif method == "pairs":
        words = np.full((k, k * (k - 1) // 2), -1)
        for c, (i, j) in enumerate(itertools.combinations(range(k), 2)):
            words[i, c], words[j, c] = 1, 0
    elif method == "exhaustive":
        words = np.array([[1 if i == 0 else (n >> (i - 1)) & 1 for n in range(2 ** (k - 1) - 1)] for i in range(k)])
    else:
        n = max(2, int(width * k))
        columns = set()
        while len(columns) < min(n, 2 ** (k - 1) - 1):
            c = tuple(r.randint(0, 1) for _ in range(k))
            if 0 < sum(c) < k and tuple(1 - v for v in c) not in columns:
                columns.add(c)
        words = np.array(sorted(columns)).T
    models = [scheme(_two(df, target, {c: int(w) for c, w in zip(classes, words[:, j]) if w >= 0}), "_two", attributes, weight) for j in range(words.shape[1])]
    return Coded(models, words, classes, attributes)


class Ordinal(Model):
    def __init__(self, models: list[Model], classes: list[str], attributes: list[str]):
        self.models, self.classes, self.attributes = models, classes, attributes

    def scores(self, x):
        above = np.column_stack([np.ones(len(x)), *[aligned(m, x, ["0", "1"])[:, 1] for m in self.models], np.zeros(len(x))])
        return normalised(np.maximum(above[:, :-1] - above[:, 1:], 0))


def ordinal(df, target, attributes, weight=None, scheme: Scheme = None, order: list[str] | None = None) -> Ordinal:
    """One model a step of the order: whether the class lies above it."""
    classes = order or class_values(df, target)
    models = [scheme(_two(df, target, {c: int(i > k) for i, c in enumerate(classes)}), "_two", attributes, weight) for k in range(len(classes) - 1)]
    return Ordinal(models, classes, attributes)


def via_regression(df, target, attributes, weight=None, scheme: Scheme = None) -> _PerClass:
    """A number a class: 1 where it is the row's."""
    from millrace.learn.rules import linear_model_tree

    classes = class_values(df, target)
    return _PerClass([(scheme or linear_model_tree)(df.withColumn("_is", F.when(F.col(target).cast("string") == c, 1.0).when(F.col(target).isNotNull(), 0.0)), "_is", attributes, weight) for c in classes], classes, attributes)


class Mapped(Model):
    """Clusters that stand for classes."""

    def __init__(self, inner: Model, of: list[int], classes: list[str]):
        self.inner, self.of, self.classes, self.attributes = inner, of, classes, inner.attributes

    def scores(self, x):
        s = self.inner.scores(x)
        out = np.zeros((len(x), len(self.classes)))
        for i, c in enumerate(self.of):
            if c < len(self.classes):
                out[:, c] += s[:, i]
        return normalised(out)


def via_clustering(df, target, attributes, weight=None, clusterer: Callable[[DataFrame, list[str], int], Model] = None) -> Mapped:
    """As many clusters as classes, each of which stands for one, so that the fewest rows are wrong."""
    from millrace.learn.cluster import k_means

    classes = class_values(df, target)
    model = (clusterer or k_means)(df, attributes, len(classes))
    counts = model.transform(df, "_cluster", None).groupBy("_cluster", F.col(target).cast("string").alias("y")).count().collect()
    size = max(len(model.classes), len(classes))
    cost = [[0] * size for _ in range(size)]
    for r in counts:
        if r["y"] is not None:
            cost[model.classes.index(r["_cluster"])][classes.index(r["y"])] = -r["count"]
    return Mapped(model, assignment(cost)[: len(model.classes)], classes)


class Means(Model):
    """The mean of a class's numbers, weighted by its share."""

    def __init__(self, inner: Model, means: dict[str, float]):
        self.inner, self.means, self.attributes = inner, np.array([means[c] for c in inner.classes]), inner.attributes

    def scores(self, x):
        return self.inner.scores(x) @ self.means


def by_discretization(df, target, attributes, weight=None, scheme: Scheme = trees.j48, bins: int = 10) -> Means:
    """A number as ranges of equal width, told apart by a classifier."""
    from millrace.operators.columns import equal_width_bins

    held = stored(equal_width_bins(df.where(F.col(target).isNotNull()), target, bins, "_bin").withColumn("_bin", F.col("_bin").cast("string")), "bins")
    means = {r["_bin"]: r["m"] for r in held.groupBy("_bin").agg(F.avg(target).alias("m")).collect()}
    return Means(scheme(held, "_bin", attributes, weight), means)


# Nested dichotomies --------------------------------------------------------------------------


class Dichotomy(Model):
    """A tree of models of two answers: which half of its classes a row belongs to."""

    def __init__(self, tree, classes: list[str], attributes: list[str]):
        self.tree, self.classes, self.attributes = tree, classes, attributes

    def scores(self, x):
        out = np.zeros((len(x), len(self.classes)))

        def walk(node, p):
            if isinstance(node, str):
                out[:, self.classes.index(node)] = p
                return
            model, first, second = node
            s = aligned(model, x, ["0", "1"])[:, 1]
            walk(first, p * (1 - s))
            walk(second, p * s)

        walk(self.tree, np.ones(len(x)))
        return out


def nested_dichotomy(df, target, attributes, weight=None, scheme: Scheme = trees.j48, seed: int = 1, balance: str = "none") -> Dichotomy:
    """``balance``: none for any split of the classes, classes for halves of them, rows for halves of like weight."""
    classes, r = class_values(df, target), random.Random(seed)
    n = {x[0]: x[1] for x in df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string")).agg(F.sum(_weight(weight))).collect()} if balance == "rows" else {}

    def build(some: list[str]):
        if len(some) == 1:
            return some[0]
        mixed = r.sample(some, len(some))
        if balance == "classes":
            first = mixed[: len(mixed) // 2]
        elif balance == "rows":
            half, first, at = sum(n[c] for c in some) / 2, [], 0.0
            for c in mixed[:-1]:
                if first and at >= half:
                    break
                first.append(c)
                at += n[c]
        else:
            first = mixed[: r.randint(1, len(mixed) - 1)]
        second = [c for c in some if c not in first]
        model = scheme(_two(df, target, {c: 0 for c in first} | {c: 1 for c in second}), "_two", attributes, weight)
        return model, build(first), build(second)

    return Dichotomy(build(classes), classes, attributes)


def nested_dichotomies(df, target, attributes, weight=None, scheme: Scheme = trees.j48, members: int = 10, seed: int = 1, balance: str = "none") -> Committee:
    return Committee([nested_dichotomy(df, target, attributes, weight, scheme, seed + k, balance) for k in range(members)], class_values(df, target), attributes=attributes)


# Diverse and active committees ---------------------------------------------------------------


def artificial(df: DataFrame, target: str, attributes: list[str], model: Model, rows: int, seed: int) -> DataFrame:
    """Rows drawn from the attributes' own distributions, whose class is the less likely the surer the model is of it; for
    numbers, the model's answer turned about its mean."""
    kinds = dict(df.dtypes)
    numbers = [a for a in attributes if is_number(kinds[a])]
    m = df.agg(*[x for i, a in enumerate(numbers) for x in (F.avg(a).alias(f"m{i}"), F.stddev_pop(a).alias(f"s{i}"))], F.count(F.lit(1)).alias("n")).first()
    made = df.sparkSession.range(rows)
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)
    for i, a in enumerate(attributes):
        if a in numbers:
            j = numbers.index(a)
            z = F.sqrt(-2 * F.log(1 - u(3 * i))) * F.cos(2 * math.pi * u(3 * i + 1))
            made = made.withColumn(a, ((m[f"m{j}"] or 0.0) + z * (m[f"s{j}"] or 0.0)).cast("double"))
        else:
            counts = df.where(F.col(a).isNotNull()).groupBy(a).count().orderBy(a).collect()
            total, upto, pick = sum(r["count"] for r in counts), 0.0, F.lit(None).cast("string")
            for r in counts[::-1]:
                upto += r["count"] / total
                pick = F.when(u(3 * i) < 1 - upto + r["count"] / total, F.lit(r[a])).otherwise(pick)
            made = made.withColumn(a, F.coalesce(pick, F.lit(counts[-1][a]) if counts else F.lit(None)))
    if model.classes is None:
        mean = df.agg(F.avg(target)).first()[0]
        return model.transform(made, "_g").withColumn(target, 2 * F.lit(mean) - F.col("_g")).select(*attributes, target)
    held = model.transform(made, "_g", "_d")
    odds = F.transform("_d", lambda p: 1 / F.greatest(p, F.lit(1e-6)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    at, pick = F.lit(0.0), F.lit(model.classes[-1])
    cumulated = []
    for i in range(len(model.classes)):
        at = at + F.get(odds, F.lit(i)) / total
        cumulated.append(at)
    for i in range(len(model.classes) - 1, -1, -1):
        pick = F.when(u(999) < cumulated[i], F.lit(model.classes[i])).otherwise(pick)
    return held.withColumn(target, pick).select(*attributes, target)


def decorate(df, target, attributes, weight=None, base: Scheme = trees.j48, members: int = 5, share: float = 0.5, tries: int = 10, seed: int = 1, unlabelled: DataFrame | None = None) -> Committee:
    """Members that also learn from artificial rows whose classes contradict the committee; one that makes it err more
    is left out. Numbers work the same. ``unlabelled`` rows join with the class that the committee gives them."""
    number = number_target(df, target)
    classes = None if number else class_values(df, target)
    rows = df.where(F.col(target).isNotNull()).select(*attributes, target, _weight(weight).alias(W))
    if not number:
        rows = rows.withColumn(target, F.col(target).cast("string"))
    rows = stored(rows, "decorate")
    n = max(1, int(rows.count() * share))
    committee = Committee([base(rows, target, attributes, W)], classes, attributes=attributes)
    best, tried = accuracy_of(committee, rows, target), 1
    while len(committee.members) < members and tried < tries:
        extra = artificial(rows, target, attributes, committee, n, seed + tried).withColumn(W, F.lit(1.0))
        more = rows.unionByName(extra.select(rows.columns))
        if unlabelled is not None:
            guessed = committee.transform(unlabelled.select(attributes), target, None) if not number else committee.transform(unlabelled.select(attributes), target)
            more = more.unionByName(guessed.withColumn(W, F.lit(1.0)).select(rows.columns))
        member = base(stored(more, "decorate"), target, attributes, W)
        grown = Committee([*committee.members, member], classes, attributes=attributes)
        score, tried = accuracy_of(grown, rows, target), tried + 1
        if score >= best - 1e-12:
            committee, best = grown, score
    return committee


def most_useful(committee: Model, pool: DataFrame, n: int, key: list[str], measure: str = "margin") -> DataFrame:
    """The rows whose label would help most: of the least margin between the two likeliest classes, the largest entropy, or
    the most disagreement among the members."""
    if measure == "disagreement":
        held = pool
        for i, m in enumerate(committee.members):
            held = m.transform(held, f"_v{i}", None)
        votes = F.array(*[f"_v{i}" for i in range(len(committee.members))])
        top = F.array_max(F.transform(F.array_distinct(votes), lambda v: F.size(F.filter(votes, lambda w: w == v))))
        value = F.lit(len(committee.members)) - top
    else:
        held = committee.transform(pool, "_g", "_d")
        ordered = F.sort_array("_d", asc=False)
        value = F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0)) if measure == "margin" else F.aggregate("_d", F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return held.withColumn("utility", value).orderBy(F.desc("utility"), *key).limit(n).select(*pool.columns, "utility")


def features_wanted(committee: Model, pool: DataFrame, n: int, key: list[str], target: str) -> DataFrame:
    """The labelled rows whose missing values would help most: of the least lead of their own class over the likeliest other,
    so that wrongly classified rows come first. A label that the committee does not know leads by minus the largest share;
    rows without a label are left out."""
    held, (g, d) = pool.where(F.col(target).isNotNull()), free(pool, "_g", "_d")
    own = F.array_position(F.array(*[F.lit(c) for c in committee.classes]), F.col(target).cast("string")).cast("int")
    others = F.array_max(F.transform(d, lambda p, i: F.when(i + 1 == own, 0.0).otherwise(p)))
    lead = F.coalesce(F.try_element_at(d, F.when(own > 0, own)), F.lit(0.0)) - others
    return committee.transform(held, g, d).withColumn("utility", -lead).orderBy(F.desc("utility"), *key).limit(n).select(*pool.columns, "utility")


def query_by_bagging(df, target, attributes, pool: DataFrame, n: int, key: list[str], base: Scheme = trees.j48, members: int = 5, seed: int = 1) -> DataFrame:
    return most_useful(bagging(df, target, attributes, None, base, members, seed), pool, n, key)


def query_by_boosting(df, target, attributes, pool: DataFrame, n: int, key: list[str], base: Scheme = trees.decision_stump, members: int = 5) -> DataFrame:
    return most_useful(adaboost_m1(df, target, attributes, None, base, members), pool, n, key)


def active_decorate(df, target, attributes, pool: DataFrame, n: int, key: list[str], base: Scheme = trees.j48, members: int = 5, seed: int = 1) -> DataFrame:
    return most_useful(decorate(df, target, attributes, None, base, members, seed=seed), pool, n, key)


def ensemble_selection(df, target, attributes, weight=None, library: list[Scheme] = (), held: float = 0.3, rounds: int = 10, bags: int = 1, seed: int = 1) -> Committee:
    """From a library of fitted models, again and again the one that makes the committee best on rows held out; models may
    be taken more than once. With several bags each chooses among half of the library."""
    classes = None if number_target(df, target) else class_values(df, target)
    rows = stored(df.where(F.col(target).isNotNull()).withColumn("_u", uniform(seed, *df.columns)), "library")
    train, test = rows.where(F.col("_u") >= held), rows.where(F.col("_u") < held)
    models = [s(train, target, attributes, weight) for s in library]
    judged = frame(test, target, attributes, weight)
    r, counts = random.Random(seed), np.zeros(len(models))
    for _ in range(bags):
        some = list(range(len(models))) if bags == 1 else r.sample(range(len(models)), max(1, len(models) // 2))
        own = np.zeros(len(models))
        for _ in range(rounds):

            def add(t: pd.DataFrame, own=own.copy()):
                each = [aligned(m, t, classes) if classes is not None else m.scores(t)[:, None] for m in models]
                base_ = sum(c * s for c, s in zip(own, each)) if own.any() else 0.0
                y = one_hot(t["_y"], classes) if classes is not None else t["_y"].to_numpy(float)[:, None]
                out = []
                for i in some:
                    s = (base_ + each[i]) / (own.sum() + 1)
                    out.append(float((s.argmax(1) == y.argmax(1)).sum()) if classes is not None else -float(((s - y) ** 2).sum()))
                yield "s", np.array(out)

            scores = gather(judged, add).get("s")
            if scores is None:
                break
            own[some[int(np.argmax(np.round(scores, 9)))]] += 1
        counts += own
    chosen = [i for i, c in enumerate(counts) if c]
    return Committee([models[i] for i in chosen] or models[:1], classes, [counts[i] for i in chosen] or [1.0], attributes=attributes)


def rotation_forest(df, target, attributes, weight=None, base: Scheme = trees.j48, members: int = 5, group: int = 3, seed: int = 1) -> Committee:
    """Trees over numbers turned by principal components of small groups of them, each from half of the rows."""
    r, classes = random.Random(seed), class_values(df, target)
    found = []
    for k in range(members):
        mixed = r.sample(attributes, len(attributes))
        groups = [mixed[i : i + group] for i in range(0, len(mixed), group)]
        part = frame(df.where(uniform(seed, *df.columns, salt=k) < 0.5), None, attributes).na.drop()
        turn = np.zeros((len(attributes), len(attributes)))

        def add(t: pd.DataFrame):
            x = np.column_stack([np.ones(len(t)), t[attributes].to_numpy(float)])
            yield "p", x.T @ x

        p = gather(part, add).get("p")
        mean = p[0, 1:] / p[0, 0] if p is not None else np.zeros(len(attributes))
        cov = p[1:, 1:] / p[0, 0] - np.outer(mean, mean) if p is not None else np.eye(len(attributes))
        at = 0
        for g in groups:
            i = [attributes.index(a) for a in g]
            turn[np.ix_(i, range(at, at + len(g)))] = np.linalg.eigh(cov[np.ix_(i, i)])[1]
            at += len(g)
        names = [f"_r{j}" for j in range(len(attributes))]
        turned = df.withColumns({n: sum((F.coalesce(F.col(a).cast("double"), F.lit(float(mean[i]))) * float(turn[i, j]) for i, a in enumerate(attributes)), F.lit(0.0)) for j, n in enumerate(names)})
        found.append(_Turned(base(turned, target, names, weight), attributes, turn, mean, names))
    return Committee(found, classes, attributes=attributes)


class _Turned(Model):
    def __init__(self, inner: Model, attributes, turn, mean, names):
        self.inner, self.attributes, self.turn, self.mean, self.names, self.classes = inner, attributes, turn, mean, names, inner.classes

    def scores(self, x):
        v = x[self.attributes].to_numpy(float, na_value=np.nan)
        z = np.where(np.isnan(v), self.mean[None], v) @ self.turn
        return self.inner.scores(pd.DataFrame({n: z[:, j] for j, n in enumerate(self.names)}))


class Certain(Model):
    """All of a model's share on its likeliest class."""

    def __init__(self, inner: Model):
        self.inner, self.classes, self.attributes = inner, inner.classes, inner.attributes

    def scores(self, x):
        return np.eye(len(self.classes))[self.inner.scores(x).argmax(1)]


def bias_and_variance(df: DataFrame, target: str, attributes: list[str], scheme: Scheme, key: list[str], rounds: int = 10, train: float = 0.5, seed: int = 1) -> DataFrame:
    """One row: error, squared bias and variance of a scheme, over fits on parts of the training half, at the other half."""
    rows = stored(df.where(F.col(target).isNotNull()).withColumn("_u", uniform(seed, *key)), "decompose")
    pool, test = rows.where("_u < 0.5"), rows.where("_u >= 0.5")
    every = None
    for k in range(rounds):
        model = scheme(pool.where(uniform(seed, *key, salt=k + 1) < train), target, attributes, None)
        got = model.transform(test, "_g", None).select(*key, F.col(target).cast("string").alias("y"), "_g")
        every = got if every is None else every.unionAll(got)
    n = stored(every, "guesses").groupBy(*key, "y", "_g").count()
    by = n.groupBy(*key, "y").agg(F.sum(F.pow(F.col("count") / rounds, 2)).alias("square"), F.coalesce(F.sum(F.when(F.col("_g") == F.col("y"), F.col("count") / rounds)), F.lit(0.0)).alias("hit"))
    return by.agg(F.avg(1 - F.col("hit")).alias("error"), F.avg((1 - 2 * F.col("hit") + F.col("square")) / 2).alias("bias"), F.avg((1 - F.col("square")) / 2).alias("variance"))
