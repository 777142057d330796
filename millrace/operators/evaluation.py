"""Scores of predictions and clusters, paired tests and result tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.special import student_two_sided
from millrace.operators.stats import with_totals
from millrace.plans.numbering import running


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    known = df.where(F.col(actual).isNotNull())
    right = F.sum(F.when(F.col(actual) == F.col(predicted), 1).otherwise(0))
    return known.agg(F.count("*").alias("n"), right.alias("correct"), (right / F.count("*")).alias("accuracy"))


def class_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``class, tp, fp, fn, precision, recall, f`` from one aggregation of the pairs."""
    n = df.where(F.col(actual).isNotNull()).groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = n.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.lit("a").alias("side")), F.struct(F.col("p").alias("class"), F.lit("p").alias("side")))).alias("x"), "a", "p", "n")
    same = F.col("a").eqNullSafe(F.col("p"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    counts = sides.where("x.class is not null").groupBy("x.class").agg(
        total((F.col("x.side") == "a") & same).alias("tp"), total((F.col("x.side") == "p") & ~same).alias("fp"), total((F.col("x.side") == "a") & ~same).alias("fn")
    )
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("class", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f"))


def regression_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mean_absolute"), F.sqrt(F.avg(e * e)).alias("root_mean_squared"), F.corr(actual, predicted).alias("correlation")
    )


def cluster_agreement(df: DataFrame, cluster: str, label: str, count: str | None = None) -> DataFrame:
    """One row: purity, entropy of labels in clusters, normalised mutual information, pair precision, recall and F, and
    the mean of the best F of each label. With ``count`` the rows are cells of a table of counts."""
    held = F.sum(F.col(count)) if count else F.count("*")
    n = df.where(F.col(cluster).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(cluster).alias("a"), F.col(label).alias("b")).agg(held.cast("double").alias("n"))
    m = with_totals(n).join(n.groupBy("a").agg(F.max("n").alias("top")), "a")
    pairs = lambda x: x * (x - 1) / 2
    share = lambda c: F.col("n") / F.col(c)
    s = m.agg(
        F.sum(share("ra") * F.col("top") / F.col("t")).alias("purity"), F.sum(-F.col("n") / F.col("t") * F.log2(share("ra"))).alias("entropy"),
        F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("ra") * F.col("rb")))).alias("mi"),
        F.sum(-F.col("n") / F.col("t") * F.log2(F.col("ra") / F.col("t"))).alias("ha"), F.sum(-F.col("n") / F.col("t") * F.log2(F.col("rb") / F.col("t"))).alias("hb"),
        F.sum(pairs(F.col("n"))).alias("both"), F.sum(share("ra") * pairs(F.col("ra"))).alias("pa"), F.sum(share("rb") * pairs(F.col("rb"))).alias("pb"),
    )
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    both, pa, pb = F.col("both"), F.col("pa"), F.col("pb")
    best = m.groupBy("b").agg(F.max(2 * F.col("n") / (F.col("ra") + F.col("rb"))).alias("f"), F.max(F.col("rb") / F.col("t")).alias("w")).agg(F.sum(F.col("f") * F.col("w")).alias("f_measure"))
    s = s.join(F.broadcast(best))  # one row
    return s.select("f_measure", "purity", "entropy", ratio(2 * F.col("mi"), F.col("ha") + F.col("hb")).alias("nmi"), ratio(both, pa).alias("pair_precision"), ratio(both, pb).alias("pair_recall"), ratio(2 * both, pa + pb).alias("pair_f"))


def margin_curve(df: DataFrame, margin: str) -> DataFrame:
    """``margin, current, cumulative``: rows of each margin, and of those up to it."""
    counts = df.where(F.col(margin).isNotNull()).groupBy(F.col(margin).alias("margin")).agg(F.count("*").alias("current"))
    return running(counts, ["margin"], {"cumulative": "current"})


def cost_curve(curve: DataFrame) -> DataFrame:
    """The line of each threshold: its cost where no row is positive, and where all are."""
    return curve.select("threshold", (F.col("fp") / (F.col("fp") + F.col("tn"))).alias("cost_at_0"), (F.col("fn") / (F.col("fn") + F.col("tp"))).alias("cost_at_1"))


def paired_test(results: DataFrame, keys: list[str], scheme: str, value: str, base, test_share: float = 0.0) -> DataFrame:
    """Each scheme against ``base`` over shared keys: ``scheme, n, mean_difference, t, p``.

    With ``test_share`` (test rows over training rows) the variance is corrected for resampling.
    One row a scheme comes to the driver for the tail.
    """
    left = results.where(F.col(scheme) == base).select(*keys, F.col(value).alias("_x"))
    d = F.col(value) - F.col("_x")
    found = results.where(F.col(scheme) != base).join(left, keys).groupBy(F.col(scheme).alias("scheme")).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).collect()
    rows = []
    for r in found:
        t = r["m"] / math.sqrt((1 / r["n"] + test_share) * r["s"] ** 2) if r["s"] else None
        rows.append((str(r["scheme"]), r["n"], r["m"], t, student_two_sided(t, r["n"] - 1) if t is not None else None))
    return results.sparkSession.createDataFrame(rows, "scheme string, n long, mean_difference double, t double, p double")


def averaged(results: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    made = [x for v in values for x in (F.avg(v).alias(f"avg_{v}"), F.stddev_samp(v).alias(f"sd_{v}"))]
    return results.groupBy(*keys).agg(F.count("*").alias("n"), *made)


def result_matrix(results: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Means of ``value`` with a column for each of ``columns``."""
    return results.groupBy(row).pivot(column, columns).agg(F.avg(value))


def classes_to_clusters(df: DataFrame, cluster: str, label: str) -> tuple[dict, int]:
    """The classes that clusters stand for, each class at most once, with the fewest wrong rows; and how many are wrong.

    The table of counts comes to the driver, one row a cluster and class; the assignment is searched
    there by paths that gain (the Hungarian method).
    """
    counts = df.where(F.col(cluster).isNotNull() & F.col(label).isNotNull()).groupBy(cluster, label).count().collect()
    clusters, labels = sorted({r[cluster] for r in counts}), sorted({r[label] for r in counts})
    size = max(len(clusters), len(labels))
    cost = [[0] * size for _ in range(size)]
    for r in counts:
        cost[clusters.index(r[cluster])][labels.index(r[label])] = -r["count"]
    match = assignment(cost)
    found = {c: labels[j] for c, j in zip(clusters, match) if j < len(labels) and cost[clusters.index(c)][j] < 0}
    return found, sum(r["count"] for r in counts) - sum(r["count"] for r in counts if found.get(r[cluster]) == r[label])


def assignment(cost: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest assignment of a square table."""
    n = len(cost)
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, used = [math.inf] * (n + 1), [False] * (n + 1)
        while row_of[at]:
            used[at], row, step, then = True, row_of[at], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    gap = cost[row - 1][j - 1] - u[row] - v[j]
                    if gap < least[j]:
                        least[j], way[j] = gap, at
                    if least[j] < step:
                        step, then = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[row_of[j]], v[j] = u[row_of[j]] + step, v[j] - step
                else:
                    least[j] -= step
            at = then
        while at:
            row_of[at], at = row_of[way[at]], way[at]
    found = [0] * n
    for j in range(1, n + 1):
        found[row_of[j] - 1] = j - 1
    return found


def expected_cost(df: DataFrame, actual: str, predicted: str, costs: DataFrame) -> DataFrame:
    """One row: rows, their total and mean cost by ``costs(actual, predicted, cost)``; pairs that are not listed cost
    nothing where right and 1 where wrong."""
    known = df.where(F.col(actual).isNotNull()).select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
    n = known.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    plain = F.when(F.col("actual").eqNullSafe(F.col("predicted")), 0.0).otherwise(1.0)
    cost = F.coalesce(F.col("cost").cast("double"), plain)
    return n.join(costs, ["actual", "predicted"], "left").agg(F.sum("n").alias("n"), F.sum(F.col("n") * cost).alias("total_cost"), (F.sum(F.col("n") * cost) / F.sum("n")).alias("mean_cost"))


def cost_benefit(curve: DataFrame, costs: tuple[float, float, float, float]) -> DataFrame:
    """``threshold, cost`` of a threshold curve, for the costs of its ``tp``, ``fp``, ``fn`` and ``tn``."""
    return curve.select("threshold", sum((F.col(c) * v for c, v in zip(("tp", "fp", "fn", "tn"), costs)), F.lit(0.0)).alias("cost"))


def best_threshold(curve: DataFrame, measure: str = "f") -> float | None:
    """The threshold of the largest ``f``, ``accuracy``, ``precision``, ``recall`` or ``tpr_less_fpr``; the highest of equals."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    value = {"f": over(2 * tp, 2 * tp + fp + fn), "accuracy": over(tp + tn, tp + tn + fp + fn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "tpr_less_fpr": over(tp, tp + fn) - over(fp, fp + tn)}[measure]
    best = curve.agg(F.max(F.struct(value.alias("v"), "threshold")).alias("b")).first()["b"]
    return best["threshold"] if best else None


def area_under(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the area under the curve of true over false positives, equal scores counting half.

    Each score adds its false positives times the true ones up to it, less half of its own.
    """
    points = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("q")
    )
    run = running(points, [F.desc("s")], {"tp": "p"})
    return run.agg((F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("q"))).alias("area"))


def predictions(df: DataFrame, actual: str, predicted: str, distribution: str | None = None, classes: list | None = None) -> DataFrame:
    """Rows ``actual, predicted`` with the ``error`` of numbers, or the ``margin`` of classes: the probability of the
    actual class less the largest of the others."""
    if distribution is None:
        return df.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), (F.col(predicted) - F.col(actual)).alias("error"))
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(actual))
    own = F.get(F.col(distribution), (place - 1).cast("int"))
    others = F.array_max(F.transform(F.col(distribution), lambda p, i: F.when(i + 1 == place, F.lit(0.0)).otherwise(p)))
    return df.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), F.when(place > 0, own - others).alias("margin"))


def wins(results: DataFrame, keys: list[str], scheme: str, value: str) -> DataFrame:
    """``scheme, wins, losses``: over all pairs of schemes and keys, how often one has the larger value."""
    a, b = (results.select(*keys, F.col(scheme).alias(f"s{x}"), F.col(value).alias(f"v{x}")) for x in "ab")
    pairs = a.join(b, keys).where("sa <> sb")
    return pairs.groupBy(F.col("sa").alias("scheme")).agg(F.sum(F.when(F.col("va") > F.col("vb"), 1).otherwise(0)).alias("wins"), F.sum(F.when(F.col("va") < F.col("vb"), 1).otherwise(0)).alias("losses"))


def rendered(matrix: DataFrame, row: str, columns: list[str], form: str = "text", decimals: int = 2, title: str = "") -> DataFrame:
    """``place, line``: a result matrix as lines. ``form``: text, csv, html, latex, gnuplot, or significance, for which
    cells are tests whose sign alone is shown."""
    number = lambda c: F.coalesce(F.format_string(f"%.{decimals}f", F.col(f"`{c}`").cast("double")), F.lit(""))
    name, cells = F.col(row).cast("string"), [number(c) for c in columns]
    sign = lambda c: F.when(F.col(f"`{c}`") > 0, "v").when(F.col(f"`{c}`") < 0, "*").otherwise(F.lit(" "))
    join: dict[str, tuple[str, Column, str]] = {
        "text": (" ".join([title.ljust(20), *[c.rjust(12) for c in columns]]), F.concat_ws(" ", F.rpad(name, 20, " "), *[F.lpad(c, 12, " ") for c in cells]), ""),
        "csv": (",".join([title, *columns]), F.concat_ws(",", name, *cells), ""),
        "html": ("<table><tr>" + "".join(f"<th>{c}</th>" for c in [title, *columns]) + "</tr>", F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in [name, *cells]], F.lit("</tr>")), "</table>"),
        "latex": ("\\begin{tabular}{l" + "r" * len(columns) + "} " + " & ".join([title, *columns]) + " \\\\", F.concat(F.concat_ws(" & ", name, *cells), F.lit(" \\\\")), "\\end{tabular}"),
        "gnuplot": ("# " + " ".join([title, *columns]), F.concat_ws(" ", F.regexp_replace(name, r"\s+", "_"), *cells), ""),
        "significance": (title + ": " + " ".join(columns), F.concat_ws(" ", name, *[sign(c) for c in columns]), ""),
    }
    head, line, foot = join[form]
    ends = [(f"0{head}", head)] + ([(f"2{foot}", foot)] if foot else [])
    rows = matrix.select(F.concat(F.lit("1"), name).alias("place"), line.alias("line"))
    return matrix.sparkSession.createDataFrame(ends, "place string, line string").unionAll(rows)
