"""Learners that keep their training rows, at most ``MOST_KEPT``. ``ib1`` and ``ibk`` keep equal rows once and answer over
any number of them, block by block; so does ``join``, by a neighbour join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.learn.base import Model, Table, class_values, frame, is_number, normalised, one_hot
from millrace.learn.bayes import NaiveBayes
from millrace.operators.similarity import nearest
from millrace.plans.naming import free
from millrace.plans.numbering import numbered
from millrace.plans.storage import discard, stored

MOST_KEPT = 50_000


class Kept:
    """Training rows as arrays: numbers on the range of the rows, values as places."""

    def __init__(self, df: DataFrame, target: str, attributes: list[str], weight: str | None):
        rows = frame(df, target, attributes, weight)
        held = rows.orderBy(*rows.columns).limit(MOST_KEPT + 1).toPandas()
        if len(held) > MOST_KEPT:
            raise ValueError(f"more than {MOST_KEPT} rows; use join, or a sample")
        self.table, self.attributes, self.rows = Table.of(rows, attributes), attributes, held
        self.number = dict(rows.dtypes)["_y"] == "double"
        self.classes = None if self.number else class_values(rows, "_y")
        v = self.table.values(held)
        low, high = (f(v, axis=0) if len(v) else np.zeros(v.shape[1]) for f in (np.nanmin, np.nanmax))
        self.low, self.width = low, np.where(high > low, high - low, 1.0)
        self.v, self.c = self._unit(held)
        self.y = held["_y"].to_numpy(float) if self.number else one_hot(held["_y"], self.classes)
        self.w = held["_w"].to_numpy()

    def _unit(self, x: pd.DataFrame):
        return (self.table.values(x) - self.low) / self.width, self.table.codes(x)

    def differences(self, x: pd.DataFrame):
        """Differences of each pair by attribute: numbers by range, a missing one as far as it can be; values 0 or 1."""
        v, c = self._unit(x)
        for i in range(v.shape[1]):
            a, b = v[:, i][:, None], self.v[:, i][None]
            far = np.where(np.isnan(a), np.where(np.isnan(b), 1.0, np.maximum(b, 1 - b)), np.where(np.isnan(b), np.maximum(a, 1 - a), np.abs(a - b)))
            yield far
        for i in range(c.shape[1]):
            a, b = c[:, i][:, None], self.c[:, i][None]
            yield ((a != b) | (a < 0) | (b < 0)).astype(float)

    def distances(self, x: pd.DataFrame) -> np.ndarray:
        return np.sqrt(sum((d * d for d in self.differences(x)), np.zeros((len(x), len(self.rows)))))


class Grouped(Kept):
    """Training rows that are equal, in their class as well where there are classes, kept once: ``n`` says how many there
    are, ``w`` what they weigh, ``y`` their class or mean. Beyond ``MOST_KEPT`` they lie in ``held``, to be had by ``block``."""

    def __init__(self, df: DataFrame, target: str, attributes: list[str], weight: str | None):
        rows = frame(df, target, attributes, weight)
        self.number = dict(rows.dtypes)["_y"] == "double"
        names = [f"`{a}`" for a in attributes]
        n, w = F.count("*").alias("_n"), F.sum("_w").alias("_w")
        equal = rows.groupBy(*names).agg(n, w, (F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).alias("_y")) if self.number else rows.groupBy(*names, "_y").agg(n, w)
        equal = stored(equal, "equal")
        self.table, self.attributes, self.held, self.order = Table.of(rows, attributes), attributes, None, [*names, "_y"]
        self.classes = None if self.number else class_values(equal, "_y")
        known = lambda a: F.when(~F.isnan(f"`{a}`"), F.col(f"`{a}`"))
        ends = equal.agg(F.count("*"), *[f(known(a)) for a in self.table.numbers for f in (F.min, F.max)]).first()
        low, high = (np.array([np.nan if v is None else v for v in ends[i::2]], float) for i in (1, 2))
        self.low, self.width = low, np.where(high > low, high - low, 1.0)
        if ends[0] > MOST_KEPT:
            self.held, self.last = stored(numbered(equal, self.order, "_place"), "kept"), ends[0]
        else:
            self._take(equal.orderBy(*self.order).toPandas())
        discard(equal)

    def _take(self, held: pd.DataFrame) -> None:
        self.rows, self.n, self.w = held, held["_n"].to_numpy(), held["_w"].to_numpy()
        self.v, self.c = self._unit(held)
        self.y = held["_y"].to_numpy(float) if self.number else one_hot(held["_y"], self.classes)

    def block(self, at: int) -> Grouped:
        """The rows with places from ``at`` on, without the table that they lie in."""
        some = object.__new__(Grouped)
        some.__dict__.update({k: v for k, v in self.__dict__.items() if k != "held"}, held=None)
        some._take(self.held.where(F.col("_place").between(at, at + MOST_KEPT - 1)).orderBy("_place").toPandas())
        return some

    def least(self, d: np.ndarray, k: int) -> np.ndarray:
        """Of each row of distances the ``k`` least, one of ``n`` equal rows as often as there are such rows; infinite ones fill up."""
        m = min(k, d.shape[1])
        at = np.argpartition(d, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(d, at, 1)
        order = np.argsort(near, axis=1, kind="stable")
        near, upto = np.take_along_axis(near, order, 1), np.cumsum(self.n[np.take_along_axis(at, order, 1)], 1)
        place = (upto[:, None] <= np.arange(k)[None, :, None]).sum(2)
        return np.where(place < m, np.take_along_axis(near, np.minimum(place, m - 1), 1), np.inf)


class Neighbours(Model):
    """The ``k`` nearest rows, with all ties at the last; their votes weigh 1, or by distance (``inverse``, ``similarity``)."""

    def __init__(self, kept: Grouped, k: int, weighting: str = "none", window: int = 0):
        self.kept, self.k, self.weighting, self.classes, self.attributes = kept, k, weighting, kept.classes, kept.attributes

    def _votes(self, kept: Grouped, d: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """What the rows within reach vote for each class, or for the number, and their weight."""
        w = (d <= reach[:, None] + 1e-12) * kept.w[None]
        if self.weighting == "inverse":
            w = w / (d + 0.001)
        elif self.weighting == "similarity":
            w = w * (1 - d / np.sqrt(max(len(self.attributes), 1)))
        return w @ kept.y if self.classes is not None else np.column_stack([w @ kept.y, w.sum(1)])

    def _said(self, votes: np.ndarray) -> np.ndarray:
        return normalised(votes) if self.classes is not None else votes[:, 0] / np.maximum(votes[:, 1], 1e-12)

    def _reach(self, near: np.ndarray) -> np.ndarray:
        """The distance of the ``k``-th row, or of the last of fewer."""
        return np.where(np.isfinite(near), near, -np.inf).max(1)

    def scores(self, x):
        kept, out = self.kept, []
        if kept.held is not None:
            raise ValueError(f"more than {MOST_KEPT} different rows are answered by transform alone")
        for at in range(0, len(x), 256):
            d = kept.distances(x.iloc[at : at + 256])
            out.append(self._said(self._votes(kept, d, self._reach(kept.least(d, self.k)))))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes))) if self.classes is not None else np.zeros(0)

    def transform(self, df, prediction="prediction", distribution="distribution"):
        if self.kept.held is None:
            return super().transform(df, prediction, distribution)
        kinds, kept = dict(df.dtypes), self.kept
        names = free(df, *[f"_a{i}" for i in range(len(self.attributes))], "_said")
        cells = [F.col(f"`{a}`").cast("double" if is_number(kinds[a]) else "string").alias(n) for a, n in zip(self.attributes, names)]
        fields = ", ".join(f"{n} {'double' if a in kept.table.numbers else 'string'}" for a, n in zip(self.attributes, names))
        state, back = stored(df.select(*cells).distinct().withColumns({"near": F.array().cast("array<double>"), "votes": F.array().cast("array<double>")}), "asked"), dict(zip(names, self.attributes))
        for voting in (False, True):  # first how far the k-th row is, then the votes up to there
            for at in range(1, kept.last + 1, MOST_KEPT):

                def visit(tables, block=kept.block(at), voting=voting):
                    for t in tables:
                        for i in range(0, len(t), 256):
                            x = t.iloc[i : i + 256].copy()
                            d = block.distances(x.rename(columns=back))
                            near = np.stack([np.pad(r, (0, self.k - len(r)), constant_values=np.inf) for r in x["near"]])
                            if voting:
                                votes = self._votes(block, d, self._reach(near))
                                x["votes"] = [(np.asarray(r) + v if len(r) else v).tolist() for r, v in zip(x["votes"], votes)]
                            else:
                                both = np.hstack([near, block.least(d, self.k)])
                                x["near"] = np.partition(both, self.k - 1, axis=1)[:, : self.k].tolist()
                            yield x

                before, state = state, stored(state.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInPandas(visit, f"{fields}, near array<double>, votes array<double>"), "asked")
                discard(before)

        @F.pandas_udf("array<double>" if self.classes is not None else "double")
        def said(votes: pd.Series) -> pd.Series:
            return pd.Series(list(self._said(np.stack(votes.tolist()))) if len(votes) else [])

        answers = state.select(*names[:-1], said("votes").alias(names[-1]))
        same = [c.eqNullSafe(answers[n]) for c, n in zip([F.col(f"`{a}`").cast("double" if is_number(kinds[a]) else "string") for a in self.attributes], names)]
        rows = df.join(answers, same, "left").drop(*names[:-1])
        return self._named(rows, names[-1], prediction, distribution) if self.classes is not None else rows.withColumnRenamed(names[-1], prediction)

    def __getstate__(self):
        held = self.kept.__dict__.get("held")
        if held is None:
            return self.__dict__
        bare = object.__new__(Grouped)
        bare.__dict__.update({k: v for k, v in self.kept.__dict__.items() if k != "held"})
        return self.__dict__ | {"kept": bare}


def ib1(df, target, attributes, weight=None) -> Neighbours:
    return Neighbours(Grouped(df, target, attributes, weight), 1)


def ibk(df, target, attributes, weight=None, k: int = 1, weighting: str = "none", choose: bool = False) -> Neighbours:
    """``choose``: the ``k`` up to the given one that errs least on rows answered by all others."""
    if choose:
        k = _chosen(Kept(df, target, attributes, weight), k)
    return Neighbours(Grouped(df, target, attributes, weight), k, weighting)


def _chosen(kept: Kept, k: int) -> int:
    if len(kept.rows) <= 1:
        return k
    errors = np.zeros(k)
    for at in range(0, len(kept.rows), 256):
        d = kept.distances(kept.rows.iloc[at : at + 256])
        n = len(d)
        d[np.arange(n), at + np.arange(n)] = np.inf
        order = np.sort(d, axis=1)
        for j in range(1, k + 1):
            w = (d <= order[:, min(j, d.shape[1] - 1) - 1][:, None] + 1e-12) * kept.w[None]
            own = kept.y[at : at + n]
            errors[j - 1] += ((w @ kept.y).argmax(1) != own.argmax(1)).sum() if kept.classes is not None else (((w @ kept.y) / w.sum(1) - own) ** 2).sum()
    return int(errors.argmin()) + 1


def join(df: DataFrame, train: DataFrame, target: str, numbers: list[str], k: int, key: str, train_key: str, index=None) -> DataFrame:
    """``df`` with the ``prediction`` of its ``k`` nearest training rows over numbers: the commonest class, the first of
    equals, or the mean. Neither table is held by any one task; ``index`` prunes."""
    found = nearest(df, train, numbers, k, key, train_key, index=index)
    names = free([*df.columns, *train.columns], "_t", "_n", "_y")
    votes = found.select(F.col("target").alias(names[0]), F.col("neighbour").alias(names[1])).join(train.select(F.col(train_key).alias(names[1]), F.col(target).alias(names[2])), names[1])
    if dict(train.dtypes)[target] in ("double", "float"):
        voted = votes.groupBy(names[0]).agg(F.avg(names[2]).alias("prediction"))
    else:
        n = votes.groupBy(names[0], names[2]).count()
        voted = n.groupBy(names[0]).agg(F.min(F.struct((-F.col("count")).alias("n"), names[2])).alias("b")).select(names[0], F.col(f"b.{names[2]}").alias("prediction"))
    return df.join(voted, df[key] == voted[names[0]], "left").select(*df.columns, "prediction")


class KStar(Model):
    """Chances that one row turns into another, attribute by attribute; the scale of each is such that a share ``blend`` of
    the rows is effectively in reach."""

    def __init__(self, kept: Kept, blend: float):
        self.kept, self.blend, self.classes, self.attributes = kept, blend, kept.classes, kept.attributes

    def _numeric(self, d: np.ndarray) -> np.ndarray:
        n = d.shape[1]
        near = np.maximum((d <= d.min(1, keepdims=True) + 1e-12).sum(1), 1)
        goal = near + self.blend * (n - near)
        low, high = np.full(len(d), 1e-6), np.full(len(d), 100.0)
        for _ in range(40):
            scale = np.sqrt(low * high)
            p = np.exp(-(d - d.min(1, keepdims=True)) / scale[:, None])
            reach = p.sum(1) ** 2 / (p * p).sum(1)
            low, high = np.where(reach < goal, scale, low), np.where(reach < goal, high, scale)
        return np.exp(-d / scale[:, None]) / scale[:, None]

    def _nominal(self, different: np.ndarray) -> np.ndarray:
        n = different.shape[1]
        same = np.maximum(n - different.sum(1), 0)
        stop = (1 - self.blend) * np.where(same > 0, 1 - 1 / n, 0)
        other = (1 - stop) / n
        return np.where(different == 0, stop[:, None] + other[:, None], other[:, None])

    def scores(self, x):
        kept, out = self.kept, []
        for at in range(0, len(x), 128):
            part, logs = x.iloc[at : at + 128], 0.0
            for i, d in enumerate(kept.differences(part)):
                p = self._numeric(d) if i < kept.v.shape[1] else self._nominal(d)
                logs = logs + np.log(np.maximum(p, 1e-300))
            w = np.exp(logs - logs.max(1, keepdims=True)) * kept.w[None]
            out.append(normalised(w @ kept.y) if self.classes is not None else (w @ kept.y) / w.sum(1))
        return np.concatenate(out)


def k_star(df, target, attributes, weight=None, blend: float = 0.2) -> KStar:
    return KStar(Kept(df, target, attributes, weight), blend)


class Local(Model):
    """A small model for each row, from the training rows weighted by how near they are: naive Bayes, or a line for numbers."""

    def __init__(self, kept: Kept, k: int, ridge: float = 1e-6):
        self.kept, self.k, self.ridge, self.classes, self.attributes = kept, k, ridge, kept.classes, kept.attributes

    def _weights(self, x: pd.DataFrame) -> np.ndarray:
        d = self.kept.distances(x)
        reach = np.partition(d, min(self.k, d.shape[1]) - 1, axis=1)[:, min(self.k, d.shape[1]) - 1] if self.k else d.max(1) * (1 + 1e-9)
        return np.maximum(1.0001 - d / np.maximum(reach, 1e-12)[:, None], 0) * self.kept.w[None]

    def scores(self, x):
        kept, w, out = self.kept, self._weights(x), []
        if self.classes is not None:
            for i in range(len(x)):
                own = w[i] > 0
                m = NaiveBayes(kept.table, kept.classes, kept.attributes)
                m._take(dict(m._add(kept.rows[own], kept.y[own] * w[i][own, None] * own.sum() / w[i].sum())))
                out.append(m.scores(x.iloc[[i]])[0])
            return np.array(out).reshape(len(x), len(self.classes))
        mean = np.nanmean(kept.table.values(kept.rows), 0) if kept.table.numbers else np.zeros(0)
        a, b = (np.hstack([np.ones((len(t), 1)), kept.table.flat(t, mean)]) for t in (kept.rows, x))
        for i in range(len(x)):
            z = a * w[i][:, None]
            out.append(float(b[i] @ np.linalg.lstsq(z.T @ a + self.ridge * np.eye(a.shape[1]), z.T @ kept.y, rcond=None)[0]))
        return np.array(out)


def locally_weighted(df, target, attributes, weight=None, k: int = 0) -> Local:
    """``k`` rows in reach, or all for 0."""
    return Local(Kept(df, target, attributes, weight), k)


class LazyRules(Model):
    """Naive Bayes on the training rows that share some of a row's values: values are added while fewer of the rows left
    are answered wrongly by the others."""

    def __init__(self, kept: Kept):
        if kept.table.numbers or kept.classes is None:
            raise ValueError("nominal attributes and classes are needed")
        self.kept, self.classes, self.attributes = kept, kept.classes, kept.attributes

    def _wrong(self, own: np.ndarray, names: list[int]) -> np.ndarray:
        """Which rows naive Bayes on the other rows of ``own`` answers wrongly."""
        kept = self.kept
        c, y = kept.c[own], kept.y[own]
        n = y.sum(0)
        logs = np.log((n[None] - y + 1) / (len(y) - 1 + y.shape[1]))
        for i in names:
            h = np.zeros((kept.table.sizes[i], y.shape[1]))
            np.add.at(h, c[:, i], y * (c[:, i] >= 0)[:, None])
            logs += np.where((c[:, i] >= 0)[:, None], np.log((h[c[:, i]] - y + 1) / (n[None] - y + h.shape[0])), 0)
        return logs.argmax(1) != y.argmax(1)

    def scores(self, x):
        kept, out = self.kept, []
        codes = kept.table.codes(x)
        for row in codes:
            own, names = np.arange(len(kept.rows)), list(range(len(row)))
            wrong = self._wrong(own, names)
            while len(names) > 1:
                best = None
                for i in names:
                    here = np.flatnonzero(kept.c[own, i] == row[i])
                    if row[i] < 0 or not 30 <= len(here) < len(own):
                        continue
                    less = self._wrong(own[here], [j for j in names if j != i])
                    lost, won = (less & ~wrong[here]).sum(), (wrong[here] & ~less).sum()
                    if won > lost and (best is None or won - lost > best[0]):
                        best = (won - lost, i, here, less)
                if best is None:
                    break
                names = [j for j in names if j != best[1]]
                own, wrong = own[best[2]], best[3]
            y = kept.y[own]
            logs = np.log((y.sum(0) + 1) / (len(y) + y.shape[1]))
            for i in names:
                if row[i] >= 0:
                    h = y[kept.c[own, i] == row[i]].sum(0)
                    logs = logs + np.log((h + 1) / (y.sum(0) + kept.table.sizes[i]))
            p = np.exp(logs - logs.max())
            out.append(p / p.sum())
        return np.array(out).reshape(len(x), len(self.classes))


def lazy_rules(df, target, attributes, weight=None) -> LazyRules:
    return LazyRules(Kept(df, target, attributes, weight))
