"""Frequent itemsets with rule measures, and frequent sequences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import special
from millrace.plans.numbering import stored


def itemsets(df: DataFrame, basket: str, item: str, support: float) -> DataFrame:
    """``items`` (sorted) and ``n`` baskets that hold them all."""
    from pyspark.ml.fpm import FPGrowth

    baskets = df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).groupBy(basket).agg(F.collect_set(F.col(item).cast("string")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(baskets)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))


def rules(df: DataFrame, basket: str, item: str, support: float, confidence: float) -> DataFrame:
    """Rules with one item on the right: confidence, lift, leverage and conviction from the counts alone."""
    sets = itemsets(df, basket, item, support)
    total = float(df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(basket).distinct().count())
    both = sets.where(F.size("items") > 1).select(F.col("n").alias("nxy"), F.explode("items").alias("y"), "items")
    both = both.select("nxy", "y", F.array_except("items", F.array("y")).alias("x"))
    left = sets.select(F.col("items").alias("x"), F.col("n").alias("nx"))
    right = sets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("y"), F.col("n").alias("ny"))
    c = F.col("nxy") / F.col("nx")
    return both.join(left, "x").join(right, "y").where(c >= confidence).select(
        F.array_join("x", ",").alias("premise"), F.col("y").alias("consequence"), F.col("nxy").alias("n"), c.alias("confidence"),
        (c / (F.col("ny") / total)).alias("lift"), (F.col("nxy") / total - F.col("nx") * F.col("ny") / (total * total)).alias("leverage"),
        F.when(F.col("nx") > F.col("nxy"), F.col("nx") * (total - F.col("ny")) / (total * (F.col("nx") - F.col("nxy")))).alias("conviction"),
    )


def sequences(df: DataFrame, key: str, item: str, order: list[str], support: float, longest: int | None = None) -> DataFrame:
    """Frequent sequences of single items within the rows of a key, as text ``a > b``, and their support.

    They are of any length unless ``longest`` is given.
    """
    from pyspark.ml.fpm import PrefixSpan

    held = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item"))))
    rows = df.groupBy(key).agg(F.transform(held, lambda x: F.array(x["_item"])).alias("sequence"))
    found = PrefixSpan(minSupport=support, maxPatternLength=longest or 2**31 - 1).findFrequentSequentialPatterns(rows)
    return found.select(F.array_join(F.transform("sequence", lambda x: F.array_join(x, "+")), " > ").alias("sequence"), F.col("freq").alias("n"))


def best_rules(df: DataFrame, basket: str, item: str, n: int = 10, metric: str = "confidence", least: float = 0.9, upper: float = 1.0, lower: float = 0.1, delta: float = 0.05) -> DataFrame:
    """The ``n`` best rules: the support falls by ``delta`` until there are enough of at least ``least``."""
    support = upper - delta
    while True:
        found = rules(df, basket, item, max(support, lower), least if metric == "confidence" else 0.0)
        found = found if metric == "confidence" else found.where(F.col(metric) >= least)
        if support <= lower + 1e-9 or found.limit(n).count() >= n:
            return found.orderBy(F.desc(metric), F.desc("n"), "premise", "consequence").limit(n)
        support -= delta


def item_rows(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Nominal columns as baskets: an item ``column=value`` for each known cell, and the ``basket``."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    return df.select(F.struct(*key).alias("basket"), F.explode(cells).alias("x")).where("x.v is not null").select("basket", F.concat("x.c", F.lit("="), "x.v").alias("item"))


def class_rules(df: DataFrame, key: list[str], columns: list[str], target: str, support: float, confidence: float) -> DataFrame:
    """``premise, consequence, n, confidence``: itemsets of the columns, counted by class in one table, whose rows are mostly of
    one class."""
    sets = itemsets(item_rows(df, key, [*columns, target]).withColumn("b", F.col("basket").cast("string")), "b", "item", support)
    is_class = lambda x: x.startswith(f"{target}=")
    labelled = sets.where(F.size(F.filter("items", is_class)) == 1).where(F.size("items") > 1)
    both = labelled.select(F.filter("items", lambda x: ~is_class(x)).alias("x"), F.get(F.filter("items", is_class), F.lit(0)).alias("consequence"), F.col("n").alias("nxy"))
    left = sets.select(F.col("items").alias("x"), F.col("n").alias("nx"))
    c = F.col("nxy") / F.col("nx")
    return both.join(left, "x").where(c >= confidence).select(F.array_join("x", ",").alias("premise"), "consequence", F.col("nxy").alias("n"), c.alias("confidence"))


def predictive_accuracy(prior: list[tuple[float, float]], n_premise: float, confidence: float) -> float:
    """What a rule of that premise and confidence is likely to reach, under a prior over true accuracies."""
    hits = confidence * n_premise
    logs = [(math.log(max(w, 1e-300)) + hits * math.log(max(a, 1e-12)) + (n_premise - hits) * math.log(max(1 - a, 1e-12)), a) for a, w in prior]
    top = max(v for v, _ in logs)
    total = sum(math.exp(v - top) for v, _ in logs)
    return sum(math.exp(v - top) * a for v, a in logs) / total


def accuracy_prior(found: DataFrame, bins: int = 100) -> list[tuple[float, float]]:
    """How often rules have each confidence: the prior of predictive mining, one row a bin."""
    n = found.groupBy((F.floor(F.least(F.col("confidence"), F.lit(1 - 1e-9)) * bins)).alias("b")).count().collect()
    total = sum(r["count"] for r in n)
    return [((r["b"] + 0.5) / bins, r["count"] / total) for r in sorted(n, key=lambda r: r["b"])]


def predictive_rules(df: DataFrame, basket: str, item: str, n: int = 10, support: float = 0.01) -> DataFrame:
    """The ``n`` rules that are likely to be right most often: confidences drawn towards those of all rules, the less the
    larger the premise's support."""
    found = rules(df, basket, item, support, 0.0)
    prior = accuracy_prior(found)
    column = special.column(lambda m, c: predictive_accuracy(prior, m, c))
    scored = found.withColumn("predicted", F.round(column(F.col("n") / F.col("confidence"), F.col("confidence")), 9))
    return scored.orderBy(F.desc("predicted"), F.desc("n"), "premise", "consequence").limit(n).select("premise", "consequence", "n", "confidence", "predicted")


def filtered_rules(df: DataFrame, step, mine) -> DataFrame:
    """Rules of filtered rows."""
    return mine(step(df))


def mining_report(found: DataFrame, began: float, ended: float) -> DataFrame:
    """One row: how many rules, their mean confidence and lift, and the seconds they took."""
    return found.agg(F.count("*").alias("rules"), F.avg("confidence").alias("confidence"), F.avg("lift").alias("lift"), F.lit(ended - began).alias("seconds"))


def confirmed_rules(df: DataFrame, key: list[str], columns: list[str], most: int = 2, least: float = 0.1, noise: float = 1.0) -> DataFrame:
    """First-order rules ``body -> head`` over nominal columns by confirmation: how much rarer counter-instances are than if body
    and head were independent. ``body, head, confirmation, counter``; bodies of up to ``most`` literals of different columns."""
    rows = df.select(F.struct(*key).alias("k"), F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns]).alias("items"))
    total = rows.count()
    literals = F.filter("items", lambda x: x.isNotNull())
    sets = rows.select(F.explode(_subsets(literals, most + 1)).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    sets = stored(sets, "literals")
    heads = sets.where(F.size("s") == 1).select(F.get("s", F.lit(0)).alias("head"), F.col("n").alias("nh"))
    bodies = sets.where(F.size("s") <= most).select(F.col("s").alias("body"), F.col("n").alias("nb"))
    whole = sets.where(F.size("s") > 1).select(F.explode("s").alias("head"), F.col("s"), F.col("n").alias("nbh")).select("head", F.array_except("s", F.array("head")).alias("body"), "nbh")
    held = whole.join(bodies, "body").join(heads, "head")
    counter = (F.col("nb") - F.col("nbh")) / total
    expected = F.col("nb") / total * (1 - F.col("nh") / total)
    value = F.when(F.sqrt(expected) > expected, (expected - counter) / (F.sqrt(expected) - expected)).otherwise(F.lit(0.0))
    return held.select(F.array_join("body", ",").alias("body"), "head", value.alias("confirmation"), counter.alias("counter")).where((F.col("confirmation") >= least) & (F.col("counter") <= noise))


def _subsets(items, most: int):
    """All sets of one to ``most`` of an array's items, in its order."""
    empty = F.array().cast("array<array<string>>")

    def grow(sets, x):
        more = F.transform(F.filter(sets, lambda s: F.size(s) < most), lambda s: F.concat(s, F.array(x)))
        return F.concat(sets, more, F.array(F.array(x)))

    return F.aggregate(items, empty, grow)


def subgroup_tree(df: DataFrame, columns: list[str], target: str, value, least: int, branch: int = 2, depth: int = 2, gain: float = 0.01) -> DataFrame:
    """``rule, n, share``: a tree of the ``branch`` best tests ``column = value`` at each node, each of at least ``least`` rows and
    raising the target's share by the part ``gain``. Every level is one aggregation over all of its nodes."""
    hit = F.when(F.col(target) == value, 1).otherwise(0)
    base = df.where(F.col(target).isNotNull())
    share = base.agg(F.avg(hit)).first()[0] or 0.0
    nodes, out = [((), share)], []
    for _ in range(depth):
        tags = F.array(*[F.when(_all(tests), F.lit(i)) for i, (tests, _) in enumerate(nodes)])
        rows = base.select(hit.alias("h"), F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("node"), F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns if c != target]).alias("x"))
        cells = rows.select("node", "h", F.explode("x").alias("x")).where("x.v is not null").groupBy("node", "x.c", "x.v").agg(F.count("*").alias("n"), F.avg("h").alias("s")).where(F.col("n") >= least)
        ranked = cells.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("s"), F.desc("n"), "c", "v"))).where(F.col("r") <= branch + depth * len(columns))
        following = []
        for i, (tests, s) in enumerate(nodes):
            taken = 0
            for r in sorted((r for r in ranked.collect() if r["node"] == i), key=lambda r: r["r"]):
                if taken < branch and r["c"] not in [c for c, _ in tests] and r["s"] > s * (1 + gain):
                    following.append(((*tests, (r["c"], r["v"])), r["s"]))
                    out.append((" and ".join(f"{c} = {v}" for c, v in following[-1][0]), r["n"], r["s"]))
                    taken += 1
        nodes = following
        if not nodes:
            break
    return df.sparkSession.createDataFrame(out, "rule string, n long, share double")


def _all(tests):
    out = F.lit(True)
    for c, v in tests:
        out = out & F.coalesce(F.col(c).cast("string") == v, F.lit(False))
    return out
