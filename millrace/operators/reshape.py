"""Bags, transposition and linear maps of columns."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.naming import Apply, fitted, free
from millrace.plans.numbering import numbered


def to_bags(df: DataFrame, bag: str, target: str, order: list[str]) -> DataFrame:
    """One row a bag: its id, its members in order, and the class of the first.

    A bag is one cell and so must fit in memory; ``relaggs`` aggregates bags without building them.
    """
    members = [c for c in df.columns if c not in (bag, target)]
    held = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*members).alias("m"), F.col(target).alias("t"))))
    return df.groupBy(bag).agg(held.alias("h")).select(bag, F.transform("h", lambda x: x["m"]).alias("bag"), F.get("h", F.lit(0))["t"].alias(target))


def from_bags(df: DataFrame, bag: str, members: str, target: str, weighting: str = "one") -> DataFrame:
    """Bags unrolled with ``_weight``: ``one``, ``bag`` (1 / size) or ``total`` (members / (bags * size))."""
    size = F.size(members)
    if weighting == "total":
        n = df.agg(F.sum(size).alias("n"), F.count("*").alias("b")).first()
        weight = F.lit(n["n"] / n["b"] if n["b"] else 0.0) / size
    else:
        weight = F.lit(1.0) if weighting == "one" else F.lit(1.0) / size
    return df.select(bag, F.explode(members).alias("m"), target, weight.alias("_weight")).select(bag, "m.*", target, "_weight")


def transpose(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Numeric columns as rows with one cell an input row. In long form, ``name, row, value``: a wide
    form would have as many columns as the table has rows."""
    place, *made = free(df, "_i", *[f"v{i}" for i in range(len(columns))])
    rows = numbered(df.select(*order, *[F.col(c).cast("double").alias(m) for m, c in zip(made, columns)]), order, place)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(m).alias("value")) for m, c in zip(made, columns)])
    return rows.select(F.col(place).alias("row"), F.explode(cells).alias("x")).select("x.name", "row", "x.value")


def wavelet(df: DataFrame, columns: list[str]) -> DataFrame:
    """Haar coefficients: all averages, then all differences, again on the averages; divided by the root
    of two. Columns are padded with zeros to a power of two, at least 4."""
    n = 4
    while n < len(columns):
        n *= 2
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns] + [F.lit(0.0)] * (n - len(columns))
    names = free(df, *[f"_w{i}" for i in range(n)])
    root, width, held = math.sqrt(2), n, df.select("*", *[c.alias(names[i]) for i, c in enumerate(cells)])
    while width > 1:
        pairs = [(F.col(names[2 * i]), F.col(names[2 * i + 1])) for i in range(width // 2)]
        made = [(a + b) / root for a, b in pairs] + [(a - b) / root for a, b in pairs]
        held = held.select(*df.columns, *[c.alias(names[i]) for i, c in enumerate(made)], *names[width:])
        width //= 2
    return held.select(*[c for c in df.columns if c not in columns], *[F.col(names[i]).alias(f"wavelet_{i}") for i in range(n)])


def project(df: DataFrame, columns: list[str], matrix: list[list[float]], prefix: str = "K") -> DataFrame:
    """Dot products with the rows of ``matrix``; missing cells count as zero."""
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    made = [sum((c * F.lit(w) for c, w in zip(cells, row) if w), F.lit(0.0)).alias(f"{prefix}{i + 1}") for i, row in enumerate(matrix)]
    return df.select(*[c for c in df.columns if c not in columns], *made)


def random_projection(df: DataFrame, columns: list[str], n: int, seed: int, kind: str = "sparse") -> DataFrame:
    """``sparse``: roots of 3 with signs, two thirds zero; ``signs``: plus or minus one; ``gaussian``."""
    r = random.Random(seed)
    draw = {"sparse": lambda: r.choice([1, 0, 0, 0, 0, -1]) * math.sqrt(3), "signs": lambda: r.choice([1.0, -1.0]), "gaussian": lambda: r.gauss(0, 1)}[kind]
    return project(df, columns, [[draw() for _ in columns] for _ in range(n)])


@fitted
def principal_components(df: DataFrame, columns: list[str], keep: float = 0.95) -> Apply:
    """Standardised columns mapped to the components that hold ``keep`` of the variance.

    The moments are one aggregation over the rows; only the matrix of columns is solved on the driver.
    Signs are set so that the largest weight is positive.
    """
    import numpy as np

    rows = df.select([F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = rows.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in pairs],
    ).first()
    r = np.eye(len(columns))
    for i, j in pairs:
        if i != j and found[f"r{i}_{j}"] is not None and np.isfinite(found[f"r{i}_{j}"]):
            r[i, j] = r[j, i] = found[f"r{i}_{j}"]
    values, vectors = np.linalg.eigh(r)
    values, vectors = values[::-1], vectors[:, ::-1]
    n = int(np.searchsorted(np.cumsum(values) / values.sum(), keep - 1e-12) + 1)
    weights = [(v * (1 if v[np.abs(v).argmax()] > 0 else -1)).tolist() for v in vectors.T[:n]]
    scaled = {c: (F.col(c) - F.lit(found[f"m{i}"])) / F.lit(found[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    return lambda table: project(table.withColumns(scaled), columns, weights, "PC")
