"""Cut points of numeric columns by frequency and by class entropy.

Values are first counted. Only one row a distinct value is sorted; the rows themselves are binned by
literal cuts in a narrow pass.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.columns import domain_of
from millrace.plans.naming import Apply, fitted
from millrace.plans.numbering import numbered, running, stored


def bin_number(c: Column, cuts: list[float]) -> Column:
    """Cuts below a value: a value at a cut belongs to the lower bin; missing cells stay missing. Many cuts are
    searched by halves."""
    if not cuts:
        return F.when(c.isNotNull(), 0)
    if len(cuts) <= 64:
        below = F.aggregate(F.array(*[F.lit(float(x)) for x in cuts]), F.lit(0), lambda n, x: n + F.when(c > x, 1).otherwise(0))
        return F.when(c.isNotNull(), below)
    edges = np.array(cuts, float)

    @F.pandas_udf("int")
    def search(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(float), "left").astype(np.int32))

    return F.when(c.isNotNull(), search(F.coalesce(c.cast("double"), F.lit(0.0))))


def _scan(values, state: dict, bins: int, total: int) -> list[float]:
    """Goes on with the cuts over ``(value, rows up to it)`` in order; the state is carried from part to part."""
    cuts = []
    for v, upto in values:
        if state["v"] is not None and state["cuts"] < bins - 1:
            here = ((state["v"] + v) / 2, state["upto"])
            goal = state["start"] + (total - state["start"]) / (bins - state["cuts"])
            if here[1] < goal:
                state["earlier"] = here
            elif state["earlier"] and goal - state["earlier"][1] < here[1] - goal:
                cuts.append(state["earlier"][0])
                state.update(start=state["earlier"][1], earlier=here, cuts=state["cuts"] + 1)
            else:
                cuts.append(here[0])
                state.update(start=here[1], earlier=None, cuts=state["cuts"] + 1)
        state.update(v=v, upto=upto)
    return cuts


def frequency_cuts(df: DataFrame, column: str, bins: int) -> list[float]:
    """At most ``bins - 1`` cuts between distinct values, each where the count of rows comes nearest to
    an equal share of what is left; equal values are never parted.

    The counts are cut where they lie: one range of values after the other, each by the task that
    reads it, with what the one before came to. Cuts alone come to the driver.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counted = stored(running(values, ["v"], {"upto": "n"}).orderBy("v").withColumn("part", F.spark_partition_id()), "upto")
    parts = counted.groupBy("part").agg(F.min("v").alias("v"), F.max("upto").alias("upto")).orderBy("v").collect()
    if not parts:
        return []
    total, cuts = parts[-1]["upto"], []
    state: dict = {"start": 0, "earlier": None, "v": None, "upto": None, "cuts": 0}
    for p in parts:
        if len(cuts) >= bins - 1:
            break

        def run(tables, state=dict(state)):
            for t in tables:
                for c in _scan(zip(t["v"], t["upto"]), state, bins, total):
                    yield pd.DataFrame({"cut": [c], "early": [None], "upto": [None], "start": [None], "last": [None], "seen": [None]})
            early = state["earlier"] or (None, None)
            yield pd.DataFrame({"cut": [None], "early": [early[0]], "upto": [early[1]], "start": [state["start"]], "last": [state["v"]], "seen": [state["upto"]]})

        rows = counted.where(F.col("part") == p["part"]).select("v", "upto").coalesce(1).sortWithinPartitions("v")
        got = rows.mapInPandas(run, "cut double, early double, upto long, start long, last double, seen long").collect()
        cuts += [r["cut"] for r in got if r["cut"] is not None]
        end = next(r for r in got if r["start"] is not None)
        state = {"start": end["start"], "earlier": (end["early"], end["upto"]) if end["early"] is not None else None, "v": end["last"], "upto": end["seen"], "cuts": len(cuts)}
    return cuts


@fitted
def equal_frequency_bins(df: DataFrame, column: str, bins: int = 10, name: str | None = None) -> Apply:
    number = bin_number(F.col(column), frequency_cuts(df, column, bins))
    return lambda rows: rows.withColumn(name or column, number)


@fitted
def root_frequency_bins(df: DataFrame, column: str, name: str | None = None) -> Apply:
    """As many bins of equal frequency as the root of the number of known cells."""
    n = df.where(F.col(column).isNotNull()).count()
    return equal_frequency_bins.fit(df, column, max(1, math.isqrt(n)), name)


def _entropy(counts: list[Column], n: Column) -> Column:
    return sum((F.when(c > 0, -c / n * F.log2(c / n)).otherwise(0.0) for c in counts), F.lit(0.0))


def _ln_factorial(x: Column) -> Column:
    """By Stirling's series from 8 on, exactly below."""
    small = F.log(F.get(F.array(*[F.lit(float(math.factorial(i))) for i in range(8)]), F.least(x, F.lit(7.0)).cast("int")))
    large = (x + 0.5) * F.log(F.greatest(x, F.lit(8.0))) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * F.greatest(x, F.lit(8.0))) - 1 / (360 * F.pow(F.greatest(x, F.lit(8.0)), 3))
    return F.when(x < 8, small).otherwise(large)


def _log2_ways(n: Column, parts: list[Column]) -> Column:
    return (_ln_factorial(n) - sum((_ln_factorial(p) for p in parts), F.lit(0.0))) / math.log(2)


def _log2_choose(n: Column, k: Column) -> Column:
    return _log2_ways(n, [k, n - k])


def entropy_cuts(df: DataFrame, column: str, target: str, kononenko: bool = False) -> list[float]:
    """Cuts by minimum description length: an interval is parted at the value boundary of least class
    entropy while the gain exceeds ``(log2(boundaries) + log2(3^k - 2) - (k H - k1 H1 - k2 H2)) / n``.

    One aggregation a level parts all of its intervals at once. ``kononenko``: a cut is taken while the
    description of the classes before it is longer than that after it and of the cut's own place.
    """
    classes = domain_of(df, target)
    rows = df.where(F.col(column).isNotNull() & F.col(target).isNotNull())
    each = [F.sum(F.when(F.col(target).cast("string") == str(c), 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(classes)]
    values = rows.groupBy(F.col(column).cast("double").alias("v")).agg(*each)
    places = [f"c{i}" for i in range(len(classes))]
    up = stored(numbered(running(values, ["v"], {f"u{c}": c for c in places}), ["v"]), "upto")
    following = up.select((F.col("_i") - 1).alias("_i"), F.col("v").alias("next"))
    up = stored(up.join(following, "_i", "left"), "upto")
    cuts: list[float] = []
    live: set[int] | None = None
    while True:
        cell = up.withColumn("b", bin_number(F.col("v"), sorted(cuts)))
        ends = cell.groupBy("b").agg(F.count("*").alias("values"), F.max("next").alias("last"), *[F.sum(c).alias(f"t{c}") for c in places], *[F.min(F.col(f"u{c}") - F.col(c)).alias(f"o{c}") for c in places], F.max("v").alias("top"))
        if live is not None:
            ends = ends.where(F.col("b").isin(sorted(live)))
        held = cell.join(F.broadcast(ends), "b").where("v < top")
        left = [(F.col(f"u{c}") - F.col(f"o{c}")).cast("double") for c in places]
        whole = [F.col(f"t{c}").cast("double") for c in places]
        right = [w - x for w, x in zip(whole, left)]
        n, n1, n2 = (sum(x, F.lit(0.0)) for x in (whole, left, right))
        h, h1, h2 = _entropy(whole, n), _entropy(left, n1), _entropy(right, n2)
        k, k1, k2 = (sum((F.when(c > 0, 1).otherwise(0) for c in x), F.lit(0)) for x in (whole, left, right))
        rest = (n1 * h1 + n2 * h2) / n
        price = (F.log2((F.col("values") - 1).cast("double")) + F.log2(F.pow(F.lit(3.0), k) - 2) - (k * h - k1 * h1 - k2 * h2)) / n
        good = (h - rest) > price
        if kononenko:
            ways = lambda x, m: _log2_ways(m, x) + _log2_choose(m + len(places) - 1, F.lit(float(len(places) - 1)))
            before, after = ways(whole, n), ways(left, n1) + ways(right, n2)
            good = before > F.log2((F.col("values") - 1).cast("double") * 1.0) + after
        best = held.select("b", F.struct(rest.alias("e"), ((F.col("v") + F.col("next")) / 2).alias("cut"), good.alias("good")).alias("s")).groupBy("b").agg(F.min("s").alias("s"))
        found = {r["b"]: r["s"]["cut"] for r in best.collect() if r["s"]["good"]}
        if not found:
            return sorted(cuts)
        cuts = sorted([*cuts, *found.values()])
        new = set(found.values())
        live = {i for i in range(len(cuts) + 1) if (i < len(cuts) and cuts[i] in new) or (i > 0 and cuts[i - 1] in new)}


@fitted
def entropy_bins(df: DataFrame, column: str, target: str, name: str | None = None, kononenko: bool = False) -> Apply:
    number = bin_number(F.col(column), entropy_cuts(df, column, target, kononenko))
    return lambda rows: rows.withColumn(name or column, number)
