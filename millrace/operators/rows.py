"""Row filters and samplers. Where row order matters, an explicit order is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.predicates import compile_predicate
from millrace.plans.naming import free
from millrace.plans.numbering import numbered, numbered_within, stored


def subset_by_expression(df: DataFrame, expression: str, class_column: str | None = None) -> DataFrame:
    return df.where(compile_predicate(expression, df.columns, class_column))


def remove_with_values(df: DataFrame, column: str, split: float | None = None, values: list | None = None, invert: bool = False, match_missing: bool = False) -> DataFrame:
    """Keeps numbers below ``split`` (at or above it, inverted) or rows outside ``values``; missing
    cells stay unless matched."""
    c = F.col(column)
    keep = (c < split) if split is not None else ~c.isin(values)
    keep = ~keep if invert else keep
    return df.where(F.coalesce(keep, F.lit(not match_missing)))


def keep_frequent_values(df: DataFrame, column: str, n: int, least: bool = False) -> DataFrame:
    """Rows of the ``n`` most (least) frequent values; equal counts go to the first in order."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    top = counts.orderBy(F.asc("count") if least else F.desc("count"), column).limit(n).select(column)
    return df.join(top, column, "left_semi").select(df.columns)


def remove_range(df: DataFrame, first: int, last: int, order: list[str], invert: bool = False) -> DataFrame:
    place = free(df, "_i")[0]
    inside = F.col(place).between(first, last)
    return numbered(df, order, place).where(inside if invert else ~inside).drop(place)


def remove_percentage(df: DataFrame, percent: float, order: list[str], invert: bool = False) -> DataFrame:
    place, cut = free(df, "_i")[0], int(df.count() * percent / 100 + 0.5)
    return numbered(df, order, place).where((F.col(place) <= cut) == F.lit(invert)).drop(place)


def fold(df: DataFrame, k: int, n: int, order: list[str], by: str | None = None, invert: bool = False) -> DataFrame:
    """Fold ``k`` of ``n`` by order; within each class of ``by`` where given."""
    place = free(df, "_i")[0]
    rows = numbered(df, order, place) if by is None else numbered_within(df, by, order, place)
    inside = (F.col(place) - 1) % n == k - 1
    return rows.where(~inside if invert else inside).drop(place)


def _shuffled(df: DataFrame, seed: int, key: list[str], place: str) -> DataFrame:
    """Rows numbered in an order drawn by hash of ``key``: the same on any cluster."""
    return numbered(df, [F.xxhash64(F.lit(seed), *key), *key], place)


def resample(df: DataFrame, percent: float, seed: int, key: list[str], invert: bool = False) -> DataFrame:
    """A sample of exactly ``int(n * p / 100)`` rows without replacement, by hash of ``key``; inverted, the others."""
    place, cut = free(df, "_i")[0], int(df.count() * percent / 100)
    return _shuffled(df, seed, key, place).where((F.col(place) <= cut) != F.lit(invert)).drop(place)


def resample_again(df: DataFrame, percent: float, seed: int, by: str | None = None, bias: float = 0.0) -> DataFrame:
    """``int(n * p / 100)`` draws with replacement. Each is of a class drawn evenly with probability ``bias``,
    else of any row; rows of a missing class are drawn in the second way alone.

    Rows are numbered within their class. Draws come from a hash of their own number and meet their
    row in an equi-join, so that none of it passes the driver.
    """
    n = df.count()
    draws = int(n * percent / 100)
    place = free(df, "_i")[0]
    column = F.col(by) if by else F.lit(0)
    label = free([*df.columns, place], "_class")[0]
    rows = numbered_within(df.withColumn(label, column), label, [F.xxhash64(F.lit(seed), *df.columns)], place)
    rows = stored(rows, "drawn-from")
    sizes = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).collect()  # one row a class
    even = [(r[label], r["n"]) for r in sizes if r[label] is not None]
    uniform = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)
    any_row = (uniform(2) * n).cast("long")  # a place among all rows, class after class
    starts, at = [], 0
    for r in sizes:
        starts.append((at, r[label], r["n"]))
        at += r["n"]
    pick, within = F.lit(None), F.lit(None).cast("long")
    for start, value, size in starts:
        inside = any_row.between(start, start + size - 1)
        pick, within = F.when(inside, F.lit(value)).otherwise(pick), F.when(inside, any_row - start + 1).otherwise(within)
    k = (uniform(3) * len(even)).cast("int")
    biased, biased_at = F.lit(None), F.lit(None).cast("long")
    for i, (value, size) in enumerate(even):
        biased, biased_at = F.when(k == i, F.lit(value)).otherwise(biased), F.when(k == i, (uniform(4) * size).cast("long") + 1).otherwise(biased_at)
    use = (uniform(1) < bias) & F.lit(bool(even))
    c, w = free(rows, "_c", "_w")
    wanted = df.sparkSession.range(draws).select(F.when(use, biased).otherwise(pick).alias(c), F.when(use, biased_at).otherwise(within).alias(w))
    kind = dict(rows.dtypes)[label]
    return rows.join(wanted, F.col(label).eqNullSafe(F.col(c).cast(kind)) & (F.col(place) == F.col(w))).select(df.columns)


def spread_subsample(df: DataFrame, by: str, spread: float, order: list[str], most: int | None = None) -> DataFrame:
    """At most ``spread`` times the rarest class's rows of each class, and at most ``most``; a spread of 0 keeps all."""
    if not spread and most is None:
        return df
    place = free(df, "_i")[0]
    least = df.where(F.col(by).isNotNull()).groupBy(by).count().agg(F.min("count")).first()[0] or 0
    limit = min([*([int(least * spread)] if spread else []), *([most] if most is not None else [])])
    return numbered_within(df, by, order, place).where(F.col(place) <= limit).drop(place)


def randomize(df: DataFrame, seed: int, key: list[str], name: str = "place") -> DataFrame:
    """All rows with their ``name``, from 1, in a random order drawn by hash of ``key``."""
    return _shuffled(df, seed, key, name)


def reservoir_sample(df: DataFrame, k: int, seed: int, key: list[str]) -> DataFrame:
    """``k`` rows, or all of fewer, by hash of ``key``: each task keeps ``k`` in a heap, and one merges the heaps."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(k)


def train_test_split(df: DataFrame, percent: float, seed: int, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first ``round(n * p / 100)`` rows by hash of ``key``, and the rest."""
    place = free(df, "_i")[0]
    rows = stored(_shuffled(df, seed, key, place), "split")
    cut = int(df.count() * percent / 100 + 0.5)
    return rows.where(F.col(place) <= cut).drop(place), rows.where(F.col(place) > cut).drop(place)


def smote(df: DataFrame, target: str, key: str, numbers: list[str], nominals: list[str] = (), k: int = 5, percent: float = 100.0, seed: int = 1, value=None) -> DataFrame:
    """``df`` and new rows of the rarest class (or ``value``): ``percent`` of its number, each between a row and one
    of its ``k`` nearest of the class; a nominal cell is the commonest of the row and its neighbours.

    A new row's neighbour and place on the line are drawn by hash. Whole hundreds are made of every
    row, the rest of the first rows by hash. The new rows' keys are missing. Nominal cells differ
    by 0 or 1 in the distance. The neighbours of all rows come from boxes, see ``all_nearest``.
    """
    from millrace.operators.neighbours import all_nearest

    if value is None:
        rarest = df.where(F.col(target).isNotNull()).groupBy(target).count().orderBy("count", target).first()
        if rarest is None:
            return df
        value = rarest[target]
    rows = df.where(F.col(target) == value)
    codes = {c: free(df, f"_{c}_code")[0] for c in nominals}
    domains = {c: [r[0] for r in rows.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect()] for c in nominals}
    hot = {c: [free(df, f"_{c}_{i}")[0] for i in range(len(domains[c]))] for c in nominals}
    flat = rows.select(key, *numbers, *[F.when(F.col(c) == v, 2**-0.5).otherwise(0.0).alias(h) for c in nominals for h, v in zip(hot[c], domains[c])])
    near = stored(all_nearest(flat, [*numbers, *[h for c in nominals for h in hot[c]]], k, key).where(F.size("near") > 0), "near")
    n = rows.count()
    whole, rest = int(percent // 100), int(n * (percent % 100) / 100)
    numbered_rows = _shuffled(rows, seed, [key], "_millrace_place")
    times = F.lit(whole) + F.when(F.col("_millrace_place") <= rest, 1).otherwise(0)
    draws = numbered_rows.withColumn("_millrace_draw", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    draws = draws.join(near, draws[key] == near["target"])
    u = lambda salt: F.pmod(F.xxhash64(F.col(key), "_millrace_draw", F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)
    chosen = F.get("near", (u(1) * F.size("near")).cast("int"))
    other = rows.select(F.col(key).alias("_millrace_other"), *[F.col(c).alias(f"_millrace_{c}") for c in numbers])
    made = draws.withColumn("_millrace_chosen", chosen).join(other, F.col("_millrace_chosen") == F.col("_millrace_other"))
    between = {c: (F.col(c) + (F.col(f"_millrace_{c}") - F.col(c)) * u(2)).cast(dict(df.dtypes)[c]) for c in numbers}
    made = made.withColumns(between)
    for c in nominals:  # votes of the row and its neighbours
        votes = draws.where("_millrace_draw = 1").select(key, F.explode(F.concat(F.array(F.col(key)), "near")).alias("v")).join(rows.select(F.col(key).alias("v"), F.col(c).alias("_x")), "v")
        top = votes.groupBy(key, "_x").count().groupBy(key).agg(F.min(F.struct((-F.col("count")).alias("n"), "_x")).alias("b")).select(F.col(key).alias("_k"), F.col("b._x").alias(codes[c]))
        made = made.join(top, F.col(key) == F.col("_k")).drop("_k").withColumn(c, F.col(codes[c]))
    made = made.withColumn(key, F.lit(None).cast(dict(df.dtypes)[key]))
    return df.unionByName(made.select(df.columns))


def to_sparse(df: DataFrame, columns: list[str], name: str = "cells") -> DataFrame:
    """Numeric columns as a map from their place to their value, without zeros; a missing cell is a null in the map."""
    entries = F.array(*[F.struct(F.lit(i).alias("key"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    kept = F.filter(entries, lambda e: e["value"].isNull() | (e["value"] != 0))
    return df.select(*[c for c in df.columns if c not in columns], F.map_from_entries(kept).alias(name))


def to_dense(df: DataFrame, columns: list[str], name: str = "cells") -> DataFrame:
    """The other way round: what the map leaves out is 0."""
    cell = lambda i: F.when(F.map_contains_key(name, F.lit(i)), F.try_element_at(F.col(name), F.lit(i))).otherwise(F.lit(0.0))
    return df.select(*[c for c in df.columns if c != name], *[cell(i).alias(c) for i, c in enumerate(columns)])


def null_filter(df: DataFrame) -> DataFrame:
    """The columns without rows."""
    return df.limit(0)


def all_filter(df: DataFrame) -> DataFrame:
    return df


def split_by_labels(df: DataFrame, labels: DataFrame, order: list[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Rows that ``labels(row, label)`` names by their place from 1 get that class and come first; the others second."""
    place = free(df, "_row")[0]
    rows = stored(numbered(df, order, place), "rows")
    named = labels.select(F.col("row").alias(place), F.col("label").alias("_millrace_label"))
    train = rows.join(named, place).withColumn(target, F.col("_millrace_label")).select(df.columns)
    return train, rows.join(named, place, "left_anti").select(df.columns)


def zip_rows(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows side by side by their places; rows without a partner go. A shared name is kept from ``a``."""
    place = free([*a.columns, *b.columns], "_i")[0]
    right = numbered(b, order_b, place).select(place, *[c for c in b.columns if c not in a.columns])
    return numbered(a, order_a, place).join(right, place).drop(place)


def remove_misclassified(df: DataFrame, fit, target: str, most: int = 10, within: float | None = None, invert: bool = False) -> DataFrame:
    """Fits and drops the rows that are predicted wrongly (numbers: farther off than ``within``) until none
    is or after ``most`` rounds; ``fit(rows)`` gives a function that adds ``prediction``. Inverted, the dropped rows."""
    rows, gone, columns = df, None, df.columns
    for _ in range(most):
        y, p = F.col(target), F.col("prediction")
        right = F.coalesce((F.abs(y - p) <= within) if within is not None else (y == p), F.lit(False))
        judged = stored(fit(rows)(rows).withColumn("_millrace_right", right), "judged")
        wrong = judged.where("not _millrace_right").select(columns)
        rows = judged.where("_millrace_right").select(columns)
        gone = wrong if gone is None else gone.unionAll(wrong)
        if not wrong.limit(1).count():
            break
    return gone if invert else rows
