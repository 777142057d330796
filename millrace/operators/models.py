"""Models whose fit is an aggregation, applied as column expressions; the rest from ``pyspark.ml``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.naming import Apply, free


def _majority(df: DataFrame, target: str, *by: str) -> DataFrame:
    """The commonest class of each group of values, the first in order among equals, with its rows and all rows."""
    n, best = free(df, "_n", "_best")
    counts = df.where(F.col(target).isNotNull()).groupBy(*by, target).agg(F.count("*").alias(n))
    found = counts.groupBy(*by).agg(F.min(F.struct((-F.col(n)).alias("n"), F.col(target).alias("y"))).alias(best), F.sum(n).alias("all"))
    return found.select(*by, F.col(f"{best}.y").alias("prediction"), (-F.col(f"{best}.n")).alias("right"), "all")


def zero_rule(df: DataFrame, target: str) -> Apply:
    """The mean of numbers, else the commonest class."""
    kind = dict(df.dtypes)[target]
    value = df.agg(F.avg(target)).first()[0] if kind in ("double", "float") else (_majority(df, target).first() or [None])[0]
    return lambda rows: rows.withColumn("prediction", F.lit(value))


def one_rule(df: DataFrame, attributes: list[str], target: str) -> tuple[str, Apply]:
    """The attribute whose values' commonest classes are right most often, the first among equals.

    A missing cell is a value of its own; one that was not seen gets the commonest class of all.
    """
    cells = df.where(F.col(target).isNotNull()).select(target, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(a).cast("string").alias("v")) for i, a in enumerate(attributes)])).alias("x")).select(target, "x.i", "x.v")
    rule = _majority(cells, target, "i", "v")
    best = rule.groupBy("i").agg(F.sum("right").alias("s")).orderBy(F.desc("s"), "i").first()
    chosen, rest = attributes[best["i"]], _majority(df, target).first()["prediction"]
    table = rule.where(F.col("i") == best["i"]).select(F.col("v").alias("_v"), F.col("prediction").alias("_p"))

    def apply(rows: DataFrame) -> DataFrame:
        found = rows.join(table, F.col(chosen).cast("string").eqNullSafe(F.col("_v")), "left")
        return found.select(*rows.columns, F.coalesce("_p", F.lit(rest)).alias("prediction"))

    return chosen, apply


def decision_table(df: DataFrame, attributes: list[str], target: str) -> Apply:
    """The commonest class of the rows that agree in all attributes, else of all rows."""
    rest = _majority(df, target).first()["prediction"]
    table = _majority(df, target, *attributes).select(*[F.col(a).alias(f"_{a}") for a in attributes], F.col("prediction").alias("_p"))

    def apply(rows: DataFrame) -> DataFrame:
        same = [F.col(a).eqNullSafe(F.col(f"_{a}")) for a in attributes]
        found = rows.join(table, same, "left")
        return found.select(*rows.columns, F.coalesce("_p", F.lit(rest)).alias("prediction"))

    return apply


def consistency(df: DataFrame, attributes: list[str], target: str) -> DataFrame:
    """One row: the share of rows that a decision table on the attributes would get right."""
    return _majority(df, target, *attributes).agg((F.sum("right") / F.sum("all")).alias("consistency"))


def naive_bayes(df: DataFrame, numbers: list[str], nominals: list[str], target: str) -> Apply:
    """Normal densities and Laplace-corrected counts by class; missing cells say nothing.

    Moments by class come as literals, one row a class. The counts of a nominal attribute stay a
    table, with one row a value and an array over the classes, which is joined to the rows.
    """
    known = df.where(F.col(target).isNotNull())
    moments = known.groupBy(target).agg(F.count("*").alias("n"), *[x for c in numbers for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).orderBy(target).collect()
    total, k = sum(r["n"] for r in moments), len(moments)
    tables = {}
    for a in nominals:
        n = known.where(F.col(a).isNotNull()).groupBy(a, target).count()
        seen = n.groupBy(target).agg(F.sum("count").alias("s")).collect()
        values = n.select(a).distinct().count()
        sums = {r[target]: r["s"] for r in seen}
        logs = [F.log((F.coalesce(F.max(F.when(F.col(target) == r[target], F.col("count"))), F.lit(0)) + 1) / float(sums.get(r[target], 0) + values)) for r in moments]
        tables[a] = n.groupBy(a).agg(F.array(*logs).alias("logs"))

    def apply(rows: DataFrame) -> DataFrame:
        held, names = rows, free(rows, *[f"_logs_{a}" for a in nominals])
        for a, name in zip(nominals, names):
            value = free(held, "_value")[0]
            held = held.join(tables[a].select(F.col(a).alias(value), F.col("logs").alias(name)), F.col(a) == F.col(value), "left").drop(value)

        def score(i: int, r):
            s = F.lit(math.log((r["n"] + 1) / (total + k)))
            for c in numbers:
                m, d = r[f"m_{c}"], max(r[f"s_{c}"] or 0.0, 1e-6)
                if m is not None:
                    z = (F.col(c) - m) / d
                    s = s + F.coalesce(-z * z / 2 - math.log(d * math.sqrt(2 * math.pi)), F.lit(0.0))
            for name in names:
                s = s + F.coalesce(F.get(F.col(name), F.lit(i)), F.lit(0.0))
            return s

        scored = F.array(*[F.struct(score(i, r).alias("s"), F.lit(-i).alias("i"), F.lit(r[target]).alias("y")) for i, r in enumerate(moments)])
        best = free(held, "_best")[0]
        held = held.withColumn(best, F.array_max(scored))
        return held.select(*rows.columns, F.col(f"{best}.y").alias("prediction"), F.col(f"{best}.s").alias("log_score"))

    return apply


def hyper_pipes(df: DataFrame, numbers: list[str], target: str) -> Apply:
    """The class within whose ranges most of a row's cells lie, the first among equals."""
    ranges = df.where(F.col(target).isNotNull()).groupBy(target).agg(*[x for c in numbers for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))]).orderBy(target).collect()

    def apply(rows: DataFrame) -> DataFrame:
        inside = lambda r: sum((F.when(F.col(c).between(r[f"a_{c}"], r[f"b_{c}"]), 1).otherwise(0) for c in numbers), F.lit(0))
        name = free(rows, "_best")[0]
        best = rows.withColumn(name, F.array_max(F.array(*[F.struct(inside(r).alias("s"), F.lit(-i).alias("i"), F.lit(r[target]).alias("y")) for i, r in enumerate(ranges)])))
        return best.select(*rows.columns, F.col(f"{name}.y").alias("prediction"), (F.col(f"{name}.s") / len(numbers)).alias("share"))

    return apply


def line_fit(df: DataFrame, attributes: list[str], target: str) -> tuple[str, float, float]:
    """The attribute with the least squared error of a straight line: its name, slope and intercept."""
    found = df.agg(*[x for a in attributes for x in (F.regr_slope(target, a).alias(f"k_{a}"), F.regr_intercept(target, a).alias(f"b_{a}"), F.regr_r2(target, a).alias(f"r_{a}"))]).first()
    best = max((a for a in attributes if found[f"k_{a}"] is not None), key=lambda a: found[f"r_{a}"] or 0.0)
    return best, found[f"k_{best}"], found[f"b_{best}"]


def farthest_first(df: DataFrame, key: str, numbers: list[str], k: int) -> list[dict]:
    """``k`` centres: the row with the smallest key, then each time the row farthest from all so far.

    One aggregation a centre; numbers are scaled to their range, ties go to the smallest key.
    """
    ends = df.agg(*[x for c in numbers for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))]).first()
    unit = lambda c: (F.col(c) - F.lit(ends[f"a_{c}"])) / F.lit((ends[f"b_{c}"] - ends[f"a_{c}"]) or 1.0)
    rows = df.select(F.col(key).alias("k"), *[F.coalesce(unit(c).cast("double"), F.lit(0.5)).alias(c) for c in numbers])
    centres = [rows.orderBy("k").first().asDict()]
    while len(centres) < k:
        near = F.array_min(F.array(*[F.sqrt(sum((F.pow(F.col(c) - x[c], 2) for c in numbers), F.lit(0.0))) for x in centres]))
        far = rows.withColumn("d", near).orderBy(F.desc("d"), "k").first()
        if not far or not far["d"]:
            break
        centres.append({c: far[c] for c in ["k", *numbers]})
    return centres


def spark_model(kind: str, df: DataFrame, columns: list[str], target: str | None = None, **options):
    """A fitted ``pyspark.ml`` pipeline by a short name: vector assembly, label index where classes are
    text, then the estimator. Rows with missing numbers are skipped."""
    from pyspark.ml import Pipeline, classification, clustering, regression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    classifiers = {"logistic": classification.LogisticRegression, "tree": classification.DecisionTreeClassifier, "forest": classification.RandomForestClassifier,
                   "boosted": classification.GBTClassifier, "svm": classification.LinearSVC, "bayes": classification.NaiveBayes, "perceptron": classification.MultilayerPerceptronClassifier}
    regressors = {"linear": regression.LinearRegression, "regression_tree": regression.DecisionTreeRegressor, "regression_forest": regression.RandomForestRegressor,
                  "boosted_regression": regression.GBTRegressor, "isotonic": regression.IsotonicRegression}
    clusterers = {"k_means": clustering.KMeans, "gaussian_mixture": clustering.GaussianMixture, "bisecting": clustering.BisectingKMeans}
    stages = [VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip")]
    if kind in clusterers:
        stages.append(clusterers[kind](featuresCol="_features", predictionCol="prediction", **options))
        return Pipeline(stages=stages).fit(df)
    label = target
    if kind in classifiers:
        stages.append(StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip"))
        label = "_label"
    stages.append((classifiers | regressors)[kind](featuresCol="_features", labelCol=label, **options))
    return Pipeline(stages=stages).fit(df)
