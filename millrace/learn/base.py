"""The contract of learners, and the sums over partitions that they are fitted from.

A scheme is ``fit(df, target, attributes, weight=None) -> Model``. A model scores a pandas table of its
attributes: one row of class probabilities a row, or one number. ``transform`` applies it to a DataFrame as
an Arrow batch function, so that a model of any kind, or a committee of models, is one narrow pass.

Fitting goes through ``gather``: every partition adds up arrays by key, and one array a key comes to the
driver. What is gathered is as large as the model, not as the data.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.naming import free

Scheme = Callable[..., "Model"]
#: A nominal attribute of more values is not taken apart into columns.
MOST_VALUES = 10_000


def gather(df: DataFrame, add: Callable[[pd.DataFrame], Iterable[tuple[str, np.ndarray]]]) -> dict[str, np.ndarray]:
    """Sums of arrays by key: ``add`` gives the arrays of a batch, tasks add them up, and so does one group a key."""

    def part(tables):
        total: dict[str, np.ndarray] = {}
        for t in tables:
            for k, a in add(t):
                total[k] = total[k] + a if k in total else np.asarray(a, float)
        if total:
            yield pd.DataFrame({"k": list(total), "shape": [list(a.shape) for a in total.values()], "a": [a.tobytes() for a in total.values()]})

    def whole(t: pd.DataFrame) -> pd.DataFrame:
        a = sum(np.frombuffer(b) for b in t["a"])
        return pd.DataFrame({"k": [t["k"].iloc[0]], "shape": [t["shape"].iloc[0]], "a": [np.ascontiguousarray(a).tobytes()]})

    kind = "k string, shape array<int>, a binary"
    rows = df.mapInPandas(part, kind).groupBy("k").applyInPandas(whole, kind).collect()
    return {r["k"]: np.frombuffer(r["a"]).reshape(r["shape"]) for r in rows}


def is_number(kind: str) -> bool:
    return kind.split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


def frame(df: DataFrame, target: str | None, attributes: list[str], weight: str | None = None) -> DataFrame:
    """Attributes as doubles and texts under their own names, with ``_y`` and ``_w``; rows of a missing target go."""
    kinds = dict(df.dtypes)
    made = [F.col(f"`{a}`").cast("double" if is_number(kinds[a]) else "string").alias(a) for a in attributes]
    y = [F.col(f"`{target}`").cast("double" if is_number(kinds[target]) else "string").alias("_y")] if target else []
    w = [(F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("_w")]
    rows = df.select(*made, *y, *w)
    return rows.where("_y is not null and _w > 0") if target else rows


def class_values(df: DataFrame, target: str) -> list[str]:
    return [r[0] for r in df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("y")).distinct().orderBy("y").collect()]  # one row a class


class Table:
    """How attributes become arrays: numbers as they are, with NaN for missing cells; texts as places in their domains,
    with -1 for missing and unknown ones."""

    def __init__(self, numbers: list[str], domains: dict[str, list[str]]):
        self.numbers, self.domains = numbers, domains
        self.places = {a: {v: i for i, v in enumerate(d)} for a, d in domains.items()}

    @classmethod
    def of(cls, df: DataFrame, attributes: list[str]) -> Table:
        kinds = dict(df.dtypes)
        numbers, domains = [a for a in attributes if is_number(kinds[a])], {}
        for a in attributes:
            if a not in numbers:
                known = (df.schema[a].metadata or {}).get("domain")
                found = known or [r[0] for r in df.where(F.col(f"`{a}`").isNotNull()).select(F.col(f"`{a}`").cast("string").alias("v")).distinct().orderBy("v").limit(MOST_VALUES + 1).collect()]
                if len(found) > MOST_VALUES:
                    raise ValueError(f"{a} has more than {MOST_VALUES} values")
                domains[a] = list(found)
        return cls(numbers, domains)

    def values(self, x: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.zeros((len(x), 0)), *[x[a].to_numpy(float, na_value=np.nan) for a in self.numbers]])

    def codes(self, x: pd.DataFrame) -> np.ndarray:
        made = [x[a].map(self.places[a]).fillna(-1).to_numpy(np.int64) for a in self.domains]
        return np.column_stack([np.zeros((len(x), 0), np.int64), *made])

    @property
    def sizes(self) -> list[int]:
        return [len(d) for d in self.domains.values()]

    def names(self) -> list[str]:
        """Of the columns that ``flat`` gives."""
        return [*self.numbers, *[f"{a}={v}" for a, d in self.domains.items() for v in (d[1:] if len(d) == 2 else d)]]

    def flat(self, x: pd.DataFrame, fill: np.ndarray | None = None) -> np.ndarray:
        """Numbers, with ``fill`` for missing ones, and a column of zeros and ones a value; two values make one column."""
        v = self.values(x)
        if fill is not None:
            v = np.where(np.isnan(v), fill[None], v)
        parts, c = [v], self.codes(x)
        for i, d in enumerate(self.domains.values()):
            parts += [(c[:, i] == k).astype(float)[:, None] for k in (range(1, 2) if len(d) == 2 else range(len(d)))]
        return np.hstack(parts)


class Model:
    """``classes`` in order, or None where a number is predicted."""

    classes: list[str] | None = None
    attributes: list[str] = []

    def scores(self, x: pd.DataFrame) -> np.ndarray:
        raise NotImplementedError

    def predict(self, x: pd.DataFrame) -> np.ndarray:
        s = self.scores(x)
        return np.array(self.classes, object)[s.argmax(1)] if self.classes is not None else s

    def transform(self, df: DataFrame, prediction: str = "prediction", distribution: str | None = "distribution") -> DataFrame:
        """``df`` with the predicted class, the first of equals, and the distribution over ``classes``; or the number."""
        kinds, held = dict(df.dtypes), self
        cells = F.struct(*[F.col(f"`{a}`").cast("double" if is_number(kinds[a]) else "string").alias(a) for a in self.attributes], F.lit(1).alias("_one"))
        if self.classes is None:

            @F.pandas_udf("double")
            def number(x: pd.DataFrame) -> pd.Series:
                return pd.Series(np.asarray(held.scores(x), float))

            return df.withColumn(prediction, number(cells))

        @F.pandas_udf("array<double>")
        def classes(x: pd.DataFrame) -> pd.Series:
            return pd.Series([r.tolist() for r in held.scores(x)])

        shares = free(df, "_shares")[0]
        return self._named(df.withColumn(shares, classes(cells)), shares, prediction, distribution)

    def _named(self, rows: DataFrame, shares: str, prediction: str, distribution: str | None) -> DataFrame:
        """The first class of the greatest share."""
        at = F.array_position(shares, F.array_max(shares)).cast("int")
        rows = rows.withColumn(prediction, F.try_element_at(F.array(*[F.lit(c) for c in self.classes]), at))
        return rows.withColumnRenamed(shares, distribution) if distribution else rows.drop(shares)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.transform(df, distribution=None)


class Constant(Model):
    """The same answer for every row."""

    def __init__(self, value, classes=None):
        self.value, self.classes, self.attributes = value, classes, []

    def scores(self, x):
        return np.repeat(np.atleast_1d(self.value)[None], len(x), 0) if self.classes is not None else np.full(len(x), float(self.value))


def normalised(s: np.ndarray) -> np.ndarray:
    """Rows that add up to 1; rows of nothing become even."""
    total = s.sum(1, keepdims=True)
    return np.where(total > 0, s / np.where(total > 0, total, 1), 1 / s.shape[1])


def softmax(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def one_hot(y: pd.Series, classes: list[str]) -> np.ndarray:
    out = np.zeros((len(y), len(classes)))
    out[np.arange(len(y)), pd.Series(y).map({c: i for i, c in enumerate(classes)}).to_numpy(np.int64)] = 1
    return out


def majority(df: DataFrame, target: str, attributes: list[str] = (), weight: str | None = None) -> Model:
    """The shares of the classes, each with one row more, or the mean."""
    rows = frame(df, target, [], weight)
    if dict(rows.dtypes)["_y"] == "double":
        r = rows.agg((F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).alias("m")).first()
        return Constant(r["m"] if r["m"] is not None else 0.0)
    n = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.sum("_w").alias("n")).collect()}
    classes = sorted(n)
    if not classes:
        raise ValueError("there is no row with a class")
    shares = np.array([n[c] + 1 for c in classes])
    return Constant(shares / shares.sum(), classes)


def save(model: Model, df: DataFrame, path: str) -> None:
    """A model as one binary row."""
    df.sparkSession.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.parquet(path)


def load(spark, path: str) -> Model:
    """A model that ``save`` wrote. It is unpickled: read no file that you do not trust."""
    return pickle.loads(bytes(spark.read.parquet(path).first()["model"]))


class Python(Model):
    """A model of one's own: ``score(x)`` on a pandas table of the attributes."""

    def __init__(self, score: Callable[[pd.DataFrame], np.ndarray], attributes: list[str], classes: list[str] | None = None):
        self._score, self.attributes, self.classes = score, attributes, classes

    def scores(self, x):
        return self._score(x)
