"""Aggregates: profiles, contingency statistics, evaluation curves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.numbering import running


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column its rows, missing cells, distinct values and values that occur once."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    values = cells.groupBy("name", "v").agg(F.count("*").alias("n"))
    return values.groupBy("name").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("v").alias("distinct"),
        F.count(F.when(F.col("v").isNotNull() & (F.col("n") == 1), 1)).alias("unique"),
    )


def _cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts ``n`` of the pairs of known values, with the totals of their rows and columns and of all: joins of
    aggregates, so that no one task holds the table."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    return with_totals(n)


def with_totals(n: DataFrame) -> DataFrame:
    """``ra``, ``rb`` and ``t`` for counts ``a, b, n``."""
    total = n.agg(F.sum("n").alias("t")).first()["t"] or 0
    rows, columns = n.groupBy("a").agg(F.sum("n").alias("ra")), n.groupBy("b").agg(F.sum("n").alias("rb"))
    return n.join(rows, "a").join(columns, "b").withColumn("t", F.lit(total))


def contingency(df: DataFrame, attribute: str, target: str) -> DataFrame:
    """One row: chi-squared, Cramer's V, entropies, gain, gain ratio, symmetrical uncertainty.

    The windows run over the table of counts, whose size is that of the two domains.
    """
    m = _cells(df, attribute, target)
    part = lambda x, y: -F.col(x) / F.col("t") * F.log2(F.col(x) / F.col(y))
    # Cells that are empty add their expectation to chi-squared: the sum below has no need of them.
    sums = m.agg(
        (F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))) - 1).alias("phi2"), F.max("t").alias("t"),
        F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"),
        F.sum(part("n", "t")).alias("hab"),
        F.sum(F.col("n") / F.col("ra") * part("ra", "t")).alias("ha"), F.sum(F.col("n") / F.col("rb") * part("rb", "t")).alias("hb"),
    )
    gain = F.col("ha") + F.col("hb") - F.col("hab")
    small = F.least("ka", "kb") - 1
    return sums.select(
        (F.col("t") * F.col("phi2")).alias("chi2"), F.when(small > 0, F.sqrt(F.col("phi2") / small)).otherwise(F.lit(0.0)).alias("cramers_v"),
        F.col("ha").alias("attribute_entropy"), F.col("hb").alias("class_entropy"), gain.alias("info_gain"),
        F.when(F.col("ha") > 0, gain / F.col("ha")).otherwise(F.lit(0.0)).alias("gain_ratio"),
        F.when(F.col("ha") + F.col("hb") > 0, 2 * gain / (F.col("ha") + F.col("hb"))).otherwise(F.lit(0.0)).alias("symmetrical_uncertainty"),
    )


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def threshold_curve(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row a distinct score with the counts of a rule ``score >= threshold``.

    Scores are first aggregated; prefix sums in two levels then run over the distinct scores alone.
    """
    points = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("q")
    )
    run = running(points, [F.desc("threshold")], {"tp": "p", "fp": "q"}).drop("p", "q")
    ends = points.agg(F.sum("p").alias("pos"), F.sum("q").alias("neg")).first()
    return run.select(
        "threshold", "tp", "fp", (F.lit(ends["pos"]) - F.col("tp")).alias("fn"), (F.lit(ends["neg"]) - F.col("fp")).alias("tn"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("fp") / (F.col("tp") + F.col("fp"))).alias("fallout"),
    )


def paired_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    d = F.col(x) - F.col(y)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd_difference"), F.corr(x, y).alias("correlation")
    )


def attribute_cells(df: DataFrame, attributes: list[str], target: str, weight: str | None = None) -> DataFrame:
    """``name, v, y, n`` with the totals ``rv, ry, t`` of each nominal attribute, from one pass over all of them."""
    cells = df.where(F.col(target).isNotNull()).select(
        F.col(target).cast("string").alias("y"), (F.col(weight) if weight else F.lit(1)).alias("w"), F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.col(a).cast("string").alias("v")) for a in attributes])).alias("x")
    ).where("x.v is not null")
    n = cells.groupBy("x.name", "x.v", "y").agg(F.sum("w").alias("n"))
    total = lambda name, *c: n.groupBy("name", *c).agg(F.sum("n").alias(name_of[name]))
    name_of = {"v": "rv", "y": "ry", "t": "t"}
    return n.join(total("v", "v"), ["name", "v"]).join(total("y", "y"), ["name", "y"]).join(total("t"), "name")


def rank_attributes(df: DataFrame, attributes: list[str], target: str, weight: str | None = None) -> DataFrame:
    """``name, info_gain, gain_ratio, symmetrical_uncertainty, chi2`` of each nominal attribute."""
    n, v, y, t = (F.col(c).cast("double") for c in ("n", "rv", "ry", "t"))
    s = attribute_cells(df, attributes, target, weight).groupBy("name").agg(
        F.sum(n / t * F.log2(n * t / (v * y))).alias("info_gain"), F.sum(-n / t * F.log2(v / t)).alias("hv"), F.sum(-n / t * F.log2(y / t)).alias("hy"),
        (F.max(t) * (F.sum(n * n / (v * y)) - 1)).alias("chi2"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    gain = F.col("info_gain")
    return s.select("name", "info_gain", ratio(gain, F.col("hv")).alias("gain_ratio"), ratio(2 * gain, F.col("hv") + F.col("hy")).alias("symmetrical_uncertainty"), "chi2")


def top_ranked(scores: DataFrame, score: str, n: int | None = None, threshold: float | None = None) -> DataFrame:
    """Attributes by falling score, ties by name: at most ``n``, and those above ``threshold``."""
    kept = scores if threshold is None else scores.where(F.col(score) > threshold)
    return kept.orderBy(F.desc(score), "name").limit(n) if n is not None else kept


def conditional_entropies(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: entropy of the pairs, of the rows and columns of their table, and of each given the other."""
    m = _cells(df, a, b)
    n, t = F.col("n"), F.col("t")
    part = lambda x, y: -n / t * F.log2(F.col(x) / F.col(y))
    return m.agg(
        F.sum(part("n", "t")).alias("joint"), F.sum(part("ra", "t")).alias("over_rows"), F.sum(part("rb", "t")).alias("over_columns"),
        F.sum(part("n", "ra")).alias("given_rows"), F.sum(part("n", "rb")).alias("given_columns"),
    )


def test_entropy_given_rows(train: DataFrame, test: DataFrame, a: str, b: str, classes: int) -> DataFrame:
    """One row: entropy of the columns given the rows of the test table, by the training table with one more in each cell."""
    n = _cells(test, a, b).select("a", "b", "n", "t")
    known = _cells(train, a, b).select("a", "b", F.col("n").alias("m"), "ra")
    rows = known.groupBy("a").agg(F.max("ra").alias("ra"))
    held = n.join(known.select("a", "b", "m"), ["a", "b"], "left").join(rows, "a", "left")
    share = F.log2((F.coalesce("m", F.lit(0)) + 1) / (F.coalesce("ra", F.lit(0)) + classes))
    return held.agg(F.sum(-F.col("n") / F.col("t") * share).alias("entropy"))


def log2_hypergeometric(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: minus the binary logarithm of the chance of the table, given its margins."""
    from millrace.functions.special import column, ln_factorial

    f = column(ln_factorial)
    m = _cells(df, a, b)
    rows, columns = m.groupBy("a").agg(F.max("ra").alias("n")), m.groupBy("b").agg(F.max("rb").alias("n"))
    parts = m.select((-f(F.col("n"))).alias("x")).unionAll(rows.select(f(F.col("n")).alias("x"))).unionAll(columns.select(f(F.col("n")).alias("x")))
    total = m.agg(F.max("t").alias("n")).select((-f(F.col("n"))).alias("x"))
    return parts.unionAll(total).agg((-F.sum("x") / math.log(2)).alias("bits"))


def reduced(counts: DataFrame) -> DataFrame:
    """Counts ``a, b, n`` without the rows and columns that are all zero."""
    rows = counts.groupBy("a").agg(F.sum("n").alias("s")).where("s > 0").select("a")
    columns = counts.groupBy("b").agg(F.sum("n").alias("s")).where("s > 0").select("b")
    return counts.join(rows, "a", "left_semi").join(columns, "b", "left_semi")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``name, count, sum, sum_squared, min, max, mean, deviation``: of one value the deviation is infinite."""
    def of(c: str) -> list:
        x = F.col(c).cast("double")
        sd = F.when(F.count(x) == 1, float("inf")).otherwise(F.stddev_samp(x))
        return [F.struct(F.lit(c).alias("name"), F.count(x).alias("count"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("sum_squared"),
                         F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), sd.alias("deviation"))]

    return df.agg(F.array(*[s for c in columns for s in of(c)]).alias("x")).select(F.inline("x"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column the whole and the fractional cells besides its ``profile`` counts."""
    kinds = [F.struct(F.lit(c).alias("name"), F.count(F.when(F.col(c) == F.floor(c), 1)).alias("whole"), F.count(F.when(F.col(c) != F.floor(c), 1)).alias("fractional")) for c in columns]
    counted = df.agg(F.array(*kinds).alias("x")).select(F.inline("x"))
    return profile(df, columns).join(counted, "name")


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """``bin, n``: rows of each value, or of each of ``bins`` ranges of equal width."""
    from millrace.operators.columns import equal_width_bins

    rows = df.where(F.col(column).isNotNull())
    rows = equal_width_bins(rows, column, bins, "bin") if bins else rows.withColumn("bin", F.col(column))
    return rows.groupBy("bin").agg(F.count("*").alias("n"))


def frequent_pairs(df: DataFrame, basket: str, item: str, least: int) -> DataFrame:
    """Pairs of items in at least ``least`` baskets; only frequent items are paired."""
    rows = df.select(F.col(basket).alias("k"), F.col(item).alias("i")).where("k is not null and i is not null").distinct()
    often = rows.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("i")
    rows = rows.join(often, "i", "left_semi")
    left, right = rows.select("k", F.col("i").alias("a")), rows.select("k", F.col("i").alias("b"))
    return left.join(right, "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def association(df: DataFrame, attribute: str, target: str) -> DataFrame:
    """One row: Goodman and Kruskal's tau of the target given the attribute, and chi-squared, corrected for
    continuity where both have two values."""
    m = _cells(df, attribute, target)
    expected = F.col("ra") * F.col("rb") / F.col("t")
    s = m.agg(
        F.sum(F.col("n") * F.col("n") / F.col("ra")).alias("within"), F.sum(F.col("n") / F.col("rb") * F.col("rb") * F.col("rb")).alias("squares"), F.max("t").alias("t"),
        (F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))) - 1).alias("phi2"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"),
        F.min(F.abs(F.col("n") - expected)).alias("off"), F.max(F.col("ra")).alias("ra"), F.max(F.col("rb")).alias("rb"),
    )
    t, base = F.col("t"), F.col("squares") / F.col("t")
    # In a table of two by two every cell is off its expectation by the same amount.
    corrected = F.pow(F.greatest(F.col("off") - 0.5, F.lit(0.0)), 2) * F.pow(t, 3) / (F.col("ra") * (t - F.col("ra")) * F.col("rb") * (t - F.col("rb")))
    chi = t * F.col("phi2")
    return s.select(F.when(t > base, (F.col("within") - base) / (t - base)).otherwise(F.lit(0.0)).alias("tau"), F.when((F.col("ka") == 2) & (F.col("kb") == 2), corrected).otherwise(chi).alias("chi2"))


def subset_merit(df: DataFrame, attributes: list[str], target: str) -> list[str]:
    """Forward search for the attributes of most merit, ``k r_ac / sqrt(k + k (k - 1) r_aa)`` with mean
    symmetrical uncertainties. Each pair of columns is one aggregation, and only its measure is kept."""
    known: dict[tuple[str, str], float] = {}

    def between(a: str, b: str) -> float:
        pair = (min(a, b), max(a, b))
        if pair not in known:
            known[pair] = contingency(df, *pair).first()["symmetrical_uncertainty"] or 0.0
        return known[pair]

    def merit(chosen: list[str]) -> float:
        outer = sum(between(a, target) for a in chosen)
        inner = sum(between(a, b) for i, a in enumerate(chosen) for b in chosen[:i])
        return outer / (len(chosen) + 2 * inner) ** 0.5

    chosen: list[str] = []
    while len(chosen) < len(attributes):
        best = max((a for a in attributes if a not in chosen), key=lambda a: merit([*chosen, a]))
        if chosen and merit([*chosen, best]) <= merit(chosen):
            break
        chosen.append(best)
    return chosen


def value_shares(df: DataFrame, column: str, by: list[str] = (), weight: str | None = None, laplace: bool = False) -> DataFrame:
    """``share`` of each known value, within groups of ``by``; with ``laplace`` each has one more."""
    w = F.col(weight) if weight else F.lit(1.0)
    n = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg((F.sum(w) + (1.0 if laplace else 0.0)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by))).drop("n")


def subgroup(df: DataFrame, attributes: list[str], target: str, value, least: int, depth: int = 3) -> list[tuple[str, str, int, float]]:
    """Greedily the tests ``attribute = value`` that raise the share of a target value most, with at least
    ``least`` rows each: ``(attribute, value, rows, share)``. One aggregation a level."""
    hit = F.sum(F.when(F.col(target) == value, 1).otherwise(0))
    rows, found, open_ = df.where(F.col(target).isNotNull()), [], [a for a in attributes if a != target]
    share = rows.agg((hit / F.count("*")).alias("s")).first()["s"]
    while open_ and len(found) < depth and share is not None and share < 1:
        cells = rows.select(target, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).cast("string").alias("v")) for a in open_])).alias("x")).where("x.v is not null")
        best = cells.groupBy("x.a", "x.v").agg(F.count("*").alias("n"), (hit / F.count("*")).alias("s")).where(F.col("n") >= least).orderBy(F.desc("s"), F.desc("n"), "a", "v").first()
        if not best or best["s"] <= share:
            break
        share = best["s"]
        found.append((best["a"], best["v"], best["n"], share))
        rows, open_ = rows.where(F.col(best["a"]).cast("string") == best["v"]), [a for a in open_ if a != best["a"]]
    return found
