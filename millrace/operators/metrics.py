"""Distances with weights, learnt from pairs or labels, and entity resolution over blocked pairs.

Pairs are ``a, b, same``. What is learnt comes from sums over the pairs; one pass a step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.learn.base import Model, gather
from millrace.operators.records import components
from millrace.plans.numbering import stored

# Distances -----------------------------------------------------------------------------------


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _weights(w) -> Column:
    return F.array(*[F.lit(float(v)) for v in w])


def weighted_euclidean(x: Column, y: Column, w) -> Column:
    """Of two arrays of numbers."""
    return F.sqrt(_sum(F.zip_with(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), _weights(w), lambda d, v: d * v)))


def weighted_dot(x: Column, y: Column, w) -> Column:
    """The cosine under weights, as a similarity."""
    dot = lambda a, b: _sum(F.zip_with(F.zip_with(a, b, lambda p, q: p * q), _weights(w), lambda d, v: d * v))
    return F.when(dot(x, x) * dot(y, y) > 0, dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))).otherwise(F.lit(0.0))


def mahalanobis(x: Column, y: Column, matrix) -> Column:
    """The root of ``d' M d`` for the difference ``d``."""
    d = F.zip_with(x, y, lambda a, b: a - b)
    rows = [_sum(F.zip_with(d, _weights(r), lambda a, v: a * v)) for r in matrix]
    return F.sqrt(F.greatest(_sum(F.zip_with(d, F.array(*rows), lambda a, b: a * b)), F.lit(0.0)))


# Pairs ---------------------------------------------------------------------------------------


def training_pairs(df: DataFrame, key: str, target: str, positive: int, negative: int, how: str = "random", score=None, seed: int = 1) -> DataFrame:
    """``a, b, same``: rows of one group, and rows of different ones, by hash; ``hard`` takes the least similar of the first and the
    most similar of the second by ``score(a_row, b_row)`` among candidates that share a group or a hash cell."""
    rows = df.select(F.struct(*df.columns).alias("r"), F.col(key).alias("k"), F.col(target).alias("g")).where("g is not null")
    ordered = Window.partitionBy("g").orderBy(F.xxhash64(F.lit(seed), "k"), "k")
    follow = rows.withColumn("next", F.lead("k").over(ordered)).withColumn("s", F.lead("r").over(ordered)).where("next is not null")
    same = follow.select(F.col("k").alias("a"), F.col("next").alias("b"), F.lit(1).alias("same"), F.col("r").alias("ra"), F.col("s").alias("rb"))
    cell = F.pmod(F.xxhash64(F.lit(seed + 1), "k"), F.lit(max(1, -(-df.count() // 32))))
    dealt = rows.withColumn("cell", cell)
    left, right = (dealt.select("cell", F.col("k").alias(n), F.col("g").alias(f"g{n}"), F.col("r").alias(f"r{n}")) for n in "ab")
    other = left.join(right, "cell").where("a < b and ga <> gb").select("a", "b", F.lit(0).alias("same"), "ra", "rb")
    if how == "hard":
        value = score(F.col("ra"), F.col("rb"))
        return same.orderBy(value, "a", "b").limit(positive).unionAll(other.orderBy(value.desc(), "a", "b").limit(negative)).select("a", "b", "same")
    mixed = [F.xxhash64(F.lit(seed), "a", "b"), "a", "b"]
    return same.orderBy(*mixed).limit(positive).unionAll(other.orderBy(*mixed).limit(negative)).select("a", "b", "same")


def differences(df: DataFrame, pairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``same, d``: arrays of the differences of each pair."""
    side = lambda n: df.select(F.col(key).alias(n), F.array(*[F.col(c).cast("double") for c in columns]).alias(f"x{n}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    return held.select("same", F.zip_with("xa", "xb", lambda p, q: F.coalesce(p - q, F.lit(0.0))).alias("d"))


def _d(t: pd.DataFrame) -> np.ndarray:
    return np.array(t["d"].tolist(), float).reshape(len(t), -1)


def xing_weights(df: DataFrame, pairs: DataFrame, key: str, columns: list[str], rounds: int = 50) -> np.ndarray:
    """Weights of least squared distance of similar pairs while dissimilar ones stay apart: steps in proportion to each weight on a logarithm barrier."""
    rows = stored(differences(df, pairs, key, columns), "pairs")
    s = gather(rows.where("same = 1"), lambda t: [("s", (_d(t) ** 2).sum(0))])["s"]
    w = np.ones(len(columns))
    for _ in range(rounds):

        def add(t: pd.DataFrame, w=w):
            q = _d(t) ** 2
            r = np.sqrt(np.maximum(q @ w, 1e-12))
            yield "v", np.array([r.sum()])
            yield "g", (q / (2 * r)[:, None]).sum(0)

        f = gather(rows.where("same = 0"), add)
        slope = s - f["g"] / f["v"][0]
        after = w * np.exp(-0.3 * w * slope / max(np.abs(slope * w).max(), 1e-12))
        if np.abs(after - w).max() < 1e-6 * np.abs(w).max():
            break
        w = after
    return w


def chunklet_matrix(df: DataFrame, links: DataFrame, key: str, columns: list[str], ridge: float = 1e-6) -> np.ndarray:
    """The inverse of the covariance within components of must-links (relevant component analysis), from one aggregation."""
    of = components(links.where("link = 1"))
    rows = df.join(of, df[key] == of["node"]).select(F.col("component").alias("c"), *[F.col(x).cast("double").alias(x) for x in columns])
    means = rows.groupBy("c").agg(*[F.avg(x).alias(f"m_{x}") for x in columns])
    held = rows.join(means, "c").select(*[(F.col(x) - F.col(f"m_{x}")).alias(x) for x in columns])
    m = gather(held, lambda t: [("m", t.to_numpy(float).T @ t.to_numpy(float)), ("n", np.array([len(t)]))])
    return np.linalg.inv(m["m"] / m["n"][0] + ridge * np.eye(len(columns)))


def gradient_weights(df: DataFrame, pairs: DataFrame, key: str, columns: list[str], rounds: int = 100, rate: float = 0.5) -> np.ndarray:
    """Weights under which a logistic of the distance tells similar pairs: steps of descent, one pass each."""
    rows = stored(differences(df, pairs, key, columns), "pairs")
    w, b = np.ones(len(columns)), 1.0
    for _ in range(rounds):

        def add(t: pd.DataFrame, w=w, b=b):
            q, y = _d(t) ** 2, t["same"].to_numpy(float)
            e = 1 / (1 + np.exp(-np.clip(b - q @ w, -30, 30))) - y
            yield "g", np.concatenate([[e.sum()], -(q.T @ e), [len(t)]])

        g = gather(rows, add)["g"]
        step = rate * g[:-1] / g[-1]
        b, w = b - step[0], np.maximum(w - step[1:], 0.0)
    return w


def classifier_weights(df: DataFrame, pairs: DataFrame, key: str, columns: list[str], scheme=None) -> np.ndarray:
    """Weights from a linear classifier of pairs by their squared differences: what counts against being the same."""
    from millrace.learn.functions import linear_svm, logistic

    names = [f"d{i}" for i in range(len(columns))]
    rows = stored(differences(df, pairs, key, columns).select(F.when(F.col("same") == 1, "1").otherwise("0").alias("y"), *[F.pow(F.get("d", F.lit(i)), 2).alias(n) for i, n in enumerate(names)]), "pairs")
    model = (linear_svm if scheme == "svm" else logistic)(rows, "y", names)
    return np.maximum(-model.weights[1:, -1] / model.design.scale, 0.0)


def score_weights(scores: dict[str, float], columns: list[str]) -> np.ndarray:
    """Weights from attribute scores, none below zero, the largest 1."""
    w = np.maximum(np.array([scores.get(c, 0.0) for c in columns]), 0)
    return w / max(w.max(), 1e-12)


class WeightedNeighbours(Model):
    """Nearest rows under weights or a matrix, by majority or mean; or nearest class means (``prototypes``)."""

    def __init__(self, df: DataFrame, target: str, columns: list[str], k: int = 1, weights=None, matrix=None, prototypes: bool = False, most: int = 50_000):
        from millrace.learn.base import class_values, frame, is_number

        self.attributes, self.k = columns, k
        self.number = is_number(dict(df.dtypes)[target])
        rows = frame(df, target, columns).na.drop()
        self.classes = None if self.number else class_values(rows, "_y")
        if prototypes:
            held = rows.groupBy("_y").agg(*[F.avg(c).alias(c) for c in columns]).orderBy("_y").toPandas()
            self.k = 1
        else:
            held = rows.orderBy(*rows.columns).limit(most + 1).toPandas()
            if len(held) > most:
                raise ValueError(f"more than {most} rows")
        m = np.diag(np.ones(len(columns)) if weights is None else weights) if matrix is None else np.asarray(matrix)
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        self.root = vectors * np.sqrt(np.maximum(values, 0))
        self.x = held[columns].to_numpy(float) @ self.root
        self.y = held["_y"].to_numpy(float) if self.number else np.array([[c == v for c in self.classes] for v in held["_y"]], float)

    def scores(self, x):
        z = np.nan_to_num(x[self.attributes].to_numpy(float)) @ self.root
        out = []
        for at in range(0, len(z), 256):
            d = np.sqrt(((z[at : at + 256, None] - self.x[None]) ** 2).sum(2))
            k = min(self.k, d.shape[1])
            near = d <= np.partition(d, k - 1, axis=1)[:, k - 1][:, None] + 1e-12
            out.append(near @ self.y / (near.sum(1)[:, None] if self.classes is not None else near.sum(1)))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes or [1])))


# Texts ---------------------------------------------------------------------------------------


class AffineModel:
    """A chance model of how one text became another: match, change, and gaps that open and go on; fitted by expectation and
    maximisation over pairs of the same entity. ``letters`` learns a chance for each changed pair of signs as well."""

    def __init__(self, letters: bool = False):
        self.open, self.extend, self.end = 0.1, 0.3, 0.05
        self.letters = letters
        self.match, self.change = 0.9, 0.1
        self.emit: dict[tuple[str, str], float] = {}

    def _emission(self, a: str, b: str) -> float:
        if a == b:
            return self.match
        return self.emit.get((a, b), self.change / 60) if self.letters else self.change / 60

    def _tables(self, x: str, y: str):
        """Forward and backward chances of the three states, by prefix and suffix."""
        n, m = len(x), len(y)
        stay, gap = 1 - 2 * self.open - self.end, 1 / 30
        f = np.zeros((3, n + 1, m + 1))
        f[0, 0, 0] = 1
        for i in range(n + 1):
            for j in range(m + 1):
                if i and j:
                    f[0, i, j] = self._emission(x[i - 1], y[j - 1]) * (stay * f[0, i - 1, j - 1] + (1 - self.extend - self.end) * (f[1, i - 1, j - 1] + f[2, i - 1, j - 1]))
                if i:
                    f[1, i, j] = gap * (self.open * f[0, i - 1, j] + self.extend * f[1, i - 1, j])
                if j:
                    f[2, i, j] = gap * (self.open * f[0, i, j - 1] + self.extend * f[2, i, j - 1])
        b = np.zeros((3, n + 2, m + 2))
        b[:, n, m] = self.end
        for i in range(n, -1, -1):
            for j in range(m, -1, -1):
                if (i, j) == (n, m):
                    continue
                e = self._emission(x[i], y[j]) * b[0, i + 1, j + 1] if i < n and j < m else 0.0
                u = gap * b[1, i + 1, j] if i < n else 0.0
                v = gap * b[2, i, j + 1] if j < m else 0.0
                b[0, i, j] = stay * e + self.open * (u + v)
                b[1, i, j] = (1 - self.extend - self.end) * e + self.extend * u
                b[2, i, j] = (1 - self.extend - self.end) * e + self.extend * v
        return f, b

    def likelihood(self, x: str, y: str) -> float:
        f, _ = self._tables(x, y)
        return float(f[:, len(x), len(y)].sum() * self.end)

    def expected(self, x: str, y: str):
        """Counts ``[matches, changes, opens, extensions, steps from a match, steps from a gap]`` and those of changed signs."""
        f, b = self._tables(x, y)
        total = f[:, len(x), len(y)].sum() * self.end
        out, signs = np.zeros(6), {}
        if total <= 0:
            return out, signs
        gap, stay = 1 / 30, 1 - 2 * self.open - self.end
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                m, g1, g2 = f[0, i, j], f[1, i, j], f[2, i, j]
                if i < len(x) and j < len(y):
                    e = self._emission(x[i], y[j]) * b[0, i + 1, j + 1] / total
                    from_match, from_gap = m * stay * e, (g1 + g2) * (1 - self.extend - self.end) * e
                    out[0 if x[i] == y[j] else 1] += from_match + from_gap
                    out[4] += from_match
                    out[5] += from_gap
                    if x[i] != y[j]:
                        signs[x[i], y[j]] = signs.get((x[i], y[j]), 0.0) + from_match + from_gap
                for state, ok, to in ((1, i < len(x), (i + 1, j)), (2, j < len(y), (i, j + 1))):
                    if ok:
                        o = m * self.open * gap * b[state, to[0], to[1]] / total
                        x_ = f[state, i, j] * self.extend * gap * b[state, to[0], to[1]] / total
                        out[2] += o
                        out[3] += x_
                        out[4] += o
                        out[5] += x_
        return out, signs

    def fit(self, pairs: DataFrame, a: str, b: str, rounds: int = 5) -> AffineModel:
        """Each round adds up expected counts over all pairs, in one pass."""
        rows = pairs.select(F.lower(a).alias("a"), F.lower(b).alias("b")).where("a is not null and b is not null")
        for _ in range(rounds):
            model = self

            def add(t: pd.DataFrame, model=model):
                total, signs = np.zeros(6), {}
                for x, y in zip(t["a"], t["b"]):
                    c, s = model.expected(x, y)
                    total += c
                    for k, v in s.items():
                        signs[k] = signs.get(k, 0.0) + v
                yield "c", np.append(total, len(t))
                for (p, q), v in signs.items():
                    yield f"s{p}{q}", np.array([v])

            found = gather(rows, add)
            if "c" not in found:
                break
            c = found["c"]
            new = AffineModel(self.letters)
            steps = c[4] + c[6]
            new.open = float(np.clip(c[2] / max(2 * steps, 1e-9), 1e-3, 0.4))
            new.extend = float(np.clip(c[3] / max(c[5], 1e-9), 1e-3, 0.9))
            new.end = float(np.clip(c[6] / max(steps, 1e-9), 1e-3, 0.3))
            new.extend = min(new.extend, 0.95 - new.end)
            share = c[0] / max(c[0] + c[1], 1e-9)
            new.match, new.change = float(np.clip(share, 0.05, 0.999)), float(np.clip(1 - share, 0.001, 0.95))
            changed = {(k[1], k[2]): float(v[0]) for k, v in found.items() if k[0] == "s" and len(k) == 3}
            whole = sum(changed.values())
            new.emit = {k: new.change * (v + 1e-3) / (whole + 1e-3 * len(changed)) for k, v in changed.items()} if whole else {}
            self.__dict__.update(new.__dict__)
        return self

    def similarity(self, a: Column, b: Column) -> Column:
        """The mean logarithm of the chance a sign, moved to 0 to 1 by the exponential."""
        model = self

        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or q is None else math.exp(math.log(max(model.likelihood(p.lower(), q.lower()), 1e-300)) / max(len(p) + len(q), 1)) for p, q in zip(x, y)], dtype="float64")

        return run(a, b)


# Records -------------------------------------------------------------------------------------


def field_similarities(df: DataFrame, pairs: DataFrame, key: str, measures: dict[str, tuple[str, object]]) -> DataFrame:
    """``a, b`` and a column for each measure ``name: (column, f)`` of a pair's two cells."""
    columns = list(dict.fromkeys(c for c, _ in measures.values()))
    side = lambda n: df.select(F.col(key).alias(n), *[F.col(c).alias(f"{n}_{c}") for c in columns])
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    return held.select(*pairs.columns, *[f(F.col(f"a_{c}"), F.col(f"b_{c}")).alias(n) for n, (c, f) in measures.items()])


def summed(similar: DataFrame, names: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """``a, b, score``: the (weighted) sum of a pair's similarities."""
    return similar.withColumn("score", sum((F.coalesce(F.col(n), F.lit(0.0)) * float((weights or {}).get(n, 1.0)) for n in names), F.lit(0.0)))


def classified(similar: DataFrame, names: list[str], scheme) -> tuple[Model, object]:
    """A model of ``same`` over pairs' similarities, and ``apply`` that scores pairs by its share for 1."""
    model = scheme(similar.withColumn("_same", F.col("same").cast("string")), "_same", names, None)

    def apply(pairs: DataFrame) -> DataFrame:
        held = model.transform(pairs, "_g", "_d")
        return held.withColumn("score", F.get("_d", F.lit(model.classes.index("1")))).drop("_g", "_d")

    return model, apply


def token_kernel(df: DataFrame, pairs: DataFrame, key: str, text: str) -> tuple[np.ndarray, object]:
    """A learnt kernel over token vectors: a margin learner of pairs by what the commonest shared tokens contribute to their
    cosine. Gives the tokens' weights and ``apply`` for other pairs."""
    from millrace.learn.functions import linear_svm
    from millrace.operators.text import tf_idf

    vectors = stored(tf_idf(df, key, text).withColumnRenamed(key, "k"), "vectors")
    norms = vectors.groupBy("k").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = stored(vectors.join(norms, "k").select("k", "word", (F.col("weight") / F.col("norm")).alias("w")), "unit")

    def shared(p: DataFrame) -> DataFrame:
        left = p.select("a", "b").distinct().join(unit.select(F.col("k").alias("a"), "word", F.col("w").alias("x")), "a")
        return left.join(unit.select(F.col("k").alias("b"), "word", F.col("w").alias("y")), ["b", "word"]).select("a", "b", "word", (F.col("x") * F.col("y")).alias("part"))

    words = [r["word"] for r in shared(pairs).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100).collect()]
    names = [f"w{i}" for i in range(len(words))]

    def wide(p: DataFrame) -> DataFrame:
        cells = shared(p).groupBy("a", "b").agg(*[F.coalesce(F.sum(F.when(F.col("word") == w, F.col("part"))), F.lit(0.0)).alias(n) for w, n in zip(words, names)], F.sum("part").alias("cosine"))
        return p.join(cells, ["a", "b"], "left").na.fill(0.0, [*names, "cosine"])

    model = linear_svm(stored(wide(pairs).withColumn("_same", F.col("same").cast("string")), "kernel"), "_same", [*names, "cosine"])

    def apply(p: DataFrame) -> DataFrame:
        held = model.transform(wide(p), "_g", "_d")
        return held.select("a", "b", F.get("_d", F.lit(model.classes.index("1"))).alias("score"))

    return model.weights, apply


def resolved(df: DataFrame, key: str, scored: DataFrame, threshold: float) -> DataFrame:
    """``key, entity``: rows joined by pairs of at least ``threshold``, and by theirs; an entity is named by its smallest row."""
    links = scored.where(F.col("score") >= threshold).select("a", "b")
    if not links.limit(1).count():
        return df.select(key, F.col(key).alias("entity"))
    found = components(links).toDF("_millrace_n", "entity")
    return df.select(key).join(found, F.col(key) == F.col("_millrace_n"), "left").select(key, F.coalesce("entity", key).alias("entity"))


def merged_until(df: DataFrame, key: str, scored: DataFrame, n: int) -> DataFrame:
    """``key, entity`` for ``n`` entities: pairs are joined from the most similar on (single linkage) until so many are left.

    The score at which this happens is found by halving over the distinct scores, a resolution each.
    """
    scores = [r[0] for r in scored.select("score").distinct().orderBy(F.desc("score")).limit(100_000).collect()]
    low, high = 0, len(scores)
    while low < high:
        middle = (low + high) // 2
        if resolved(df, key, scored, scores[middle]).select("entity").distinct().count() <= n:
            high = middle
        else:
            low = middle + 1
    return resolved(df, key, scored, scores[low] if low < len(scores) else (scores[-1] if scores else math.inf))
