"""Synthetic tables from ``spark.range``: each row is drawn from its number and a seed by hash, so that
a task that is run again draws the same."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, salt: int = 0, low: float = 0.0, high: float = 1.0) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53) * (high - low) + low


def normal(seed: int, salt: int = 0) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, 2 * salt))) * F.cos(2 * math.pi * uniform(seed, 2 * salt + 1))


def mexican_hat(spark: SparkSession, n: int, seed: int = 1, low: float = -10.0, high: float = 10.0, noise: float = 0.0) -> DataFrame:
    """``x, y`` with y = sin|x| / |x| and normal noise."""
    rows = spark.range(n).withColumn("x", uniform(seed, 100, low, high))
    y = F.when(F.col("x") == 0, 1.0).otherwise(F.sin(F.abs("x")) / F.abs("x"))
    return rows.select("x", (y + normal(seed, 60) * noise).alias("y"))


def expression(spark: SparkSession, n: int, text: str, seed: int = 1) -> DataFrame:
    """``x`` uniform in 0 to 1 and ``y`` from an SQL expression over it."""
    return spark.range(n).select(uniform(seed).alias("x")).withColumn("y", F.expr(text).cast("double"))


def gaussian_clusters(spark: SparkSession, n: int, k: int, width: int, seed: int = 1, spread: float = 1.0) -> DataFrame:
    """``a0 ..`` around ``k`` random centres, and the number of the ``cluster``."""
    r = random.Random(seed)
    centres = [[r.uniform(0, 10 * k) for _ in range(width)] for _ in range(k)]
    rows = spark.range(n).withColumn("cluster", F.floor(uniform(seed, 1000) * k).cast("int"))
    at = [F.get(F.array(*[F.lit(c[i]) for c in centres]), F.col("cluster")) for i in range(width)]
    return rows.select(*[(at[i] + normal(seed, i) * spread).alias(f"a{i}") for i in range(width)], "cluster")


def grid_clusters(spark: SparkSession, n: int, side: int, seed: int = 1, distance: float = 4.0) -> DataFrame:
    """Clusters on a square grid."""
    rows = spark.range(n).withColumn("cluster", F.floor(uniform(seed, 1000) * side * side).cast("int"))
    x, y = F.col("cluster") % side, F.floor(F.col("cluster") / side)
    return rows.select((x * distance + normal(seed, 0)).alias("a0"), (y * distance + normal(seed, 1)).alias("a1"), "cluster")


def box_clusters(spark: SparkSession, n: int, boxes: list[list[tuple[float, float]]], seed: int = 1) -> DataFrame:
    """Uniform rows within one of the given boxes each."""
    rows = spark.range(n).withColumn("cluster", F.floor(uniform(seed, 1000) * len(boxes)).cast("int"))
    pick = lambda i, j: F.get(F.array(*[F.lit(float(b[i][j])) for b in boxes]), F.col("cluster"))
    return rows.select(*[(pick(i, 0) + uniform(seed, i) * (pick(i, 1) - pick(i, 0))).alias(f"a{i}") for i in range(len(boxes[0]))], "cluster")


def agrawal(spark: SparkSession, n: int, function: int = 1, seed: int = 1, noise: float = 0.0) -> DataFrame:
    """Loan applicants with two groups by one of ten published functions; ``noise`` moves numbers by that share of their range.

    ``salary, commission, age, elevel, car, zipcode, hvalue, hyears, loan, group``.
    """
    u = lambda k: uniform(seed, k)
    rows = spark.range(n).withColumn("salary", 20_000 + 130_000 * u(1))
    rows = rows.withColumn("commission", F.when(F.col("salary") >= 75_000, 0.0).otherwise(10_000 + 65_000 * u(2)))
    whole = lambda k, low, high: F.floor(low + u(k) * (high - low + 1)).cast("int")
    rows = rows.withColumns({"age": whole(3, 20, 80), "elevel": whole(4, 0, 4), "car": whole(5, 1, 20), "zipcode": whole(6, 0, 8)})
    rows = rows.withColumn("hvalue", (9 - F.col("zipcode")) * 100_000 * (0.5 + u(7)))
    rows = rows.withColumns({"hyears": whole(8, 1, 30), "loan": u(9) * 500_000})
    group = agrawal_group(function)
    rows = rows.withColumn("group", F.when(group, "1").otherwise("0"))
    if noise:
        spans = {"salary": (20_000, 150_000), "commission": (0, 75_000), "hvalue": (0, 1_350_000), "loan": (0, 500_000)}
        moved = {c: F.least(F.greatest(F.col(c) + (2 * u(20 + i) - 1) * noise * (b - a), F.lit(float(a))), F.lit(float(b))) for i, (c, (a, b)) in enumerate(spans.items())}
        rows = rows.withColumns(moved)
    return rows.drop("id")


def agrawal_group(function: int) -> Column:
    """Whether an applicant is of the first group."""
    age, salary, elevel, loan = F.col("age"), F.col("salary"), F.col("elevel"), F.col("loan")
    income = salary + F.col("commission")
    by_age = lambda a, b, c: F.when(age < 40, a).when(age < 60, b).otherwise(c)
    within = lambda c, low, high: c.between(low, high)
    low = lambda k: elevel.isin(k)
    equity = F.when(F.col("hyears") >= 20, F.col("hvalue") * (F.col("hyears") - 20) / 10).otherwise(0.0)
    functions = {
        1: (age < 40) | (age >= 60),
        2: by_age(within(salary, 50_000, 100_000), within(salary, 75_000, 125_000), within(salary, 25_000, 75_000)),
        3: by_age(low([0, 1]), low([1, 2, 3]), low([2, 3, 4])),
        4: by_age(F.when(low([0, 1]), within(salary, 25_000, 75_000)).otherwise(within(salary, 50_000, 100_000)), F.when(low([1, 2, 3]), within(salary, 50_000, 100_000)).otherwise(within(salary, 75_000, 125_000)),
                  F.when(low([2, 3, 4]), within(salary, 50_000, 100_000)).otherwise(within(salary, 25_000, 75_000))),
        5: by_age(F.when(within(salary, 50_000, 100_000), within(loan, 100_000, 300_000)).otherwise(within(loan, 200_000, 400_000)), F.when(within(salary, 75_000, 125_000), within(loan, 200_000, 400_000)).otherwise(within(loan, 300_000, 500_000)),
                  F.when(within(salary, 25_000, 75_000), within(loan, 300_000, 500_000)).otherwise(within(loan, 100_000, 300_000))),
        6: by_age(within(income, 50_000, 100_000), within(income, 75_000, 125_000), within(income, 25_000, 75_000)),
        7: 0.67 * income - 0.2 * loan - 20_000 > 0,
        8: 0.67 * income - 5_000 * elevel - 20_000 > 0,
        9: 0.67 * income - 5_000 * elevel - 0.2 * loan - 10_000 > 0,
        10: 0.67 * income - 5_000 * elevel + 0.2 * equity - 10_000 > 0,
    }
    return functions[function]


#: Which of the seven segments of a display are lit for each digit.
LED = ["1110111", "0010010", "1011101", "1011011", "0111010", "1101011", "1101111", "1010010", "1111111", "1111011"]


def led24(spark: SparkSession, n: int, seed: int = 1, noise: float = 0.1) -> DataFrame:
    """``a1 .. a24`` and ``digit``: the lit segments of a digit, each turned over by chance, and seventeen by chance alone."""
    rows = spark.range(n).withColumn("digit", F.floor(uniform(seed, 500) * 10).cast("int"))
    lit = F.get(F.array(*[F.lit(s) for s in LED]), F.col("digit"))
    made = []
    for i in range(7):
        on = F.substring(lit, i + 1, 1).cast("int")
        made.append(F.when(uniform(seed, i) < noise, 1 - on).otherwise(on).alias(f"a{i + 1}"))
    made += [F.when(uniform(seed, i) < 0.5, 1).otherwise(0).alias(f"a{i + 1}") for i in range(7, 24)]
    return rows.select(*made, "digit")


def decision_list(spark: SparkSession, n: int, attributes: int = 10, classes: int = 2, rules: int = 10, least: int = 1, most: int = 10, irrelevant: int = 0, numeric: int = 0, seed: int = 1) -> tuple[DataFrame, list]:
    """Rows of booleans ``a0 ..`` and numbers, and ``class`` by a list of random rules, of which the first that holds decides; the
    rules are given as well. Rows that no rule takes get the last one's class."""
    r = random.Random(seed)
    names, used = [f"a{i}" for i in range(attributes)], list(range(attributes - irrelevant))
    kinds = ["number" if i < numeric else "boolean" for i in range(attributes)]
    rows = spark.range(n).select(*[(uniform(seed, i) if k == "number" else F.when(uniform(seed, i) < 0.5, "true").otherwise("false")).alias(a) for i, (a, k) in enumerate(zip(names, kinds))])
    found = []
    for k in range(rules):
        tests = []
        for i in r.sample(used, min(len(used), r.randint(least, min(most, len(used))))):
            tests.append((names[i], r.choice(["<", ">="]), r.random()) if kinds[i] == "number" else (names[i], "=", r.choice(["true", "false"])))
        found.append((tests, f"c{k % classes}"))
    value = F.lit(found[-1][1])
    for tests, c in found[::-1]:
        holds = F.lit(True)
        for a, sign, v in tests:
            holds = holds & (F.col(a) == v if sign == "=" else F.col(a) < v if sign == "<" else F.col(a) >= v)
        value = F.when(holds, c).otherwise(value)
    return rows.withColumn("class", value), found


def network_rows(spark: SparkSession, n: int, parents: list[list[int]], tables: list[list[list[float]]], seed: int = 1) -> DataFrame:
    """Rows ``x0 ..`` of values ``v0 ..`` drawn from a network: each column by the chances of its parents' values. ``tables[i]`` has a
    line for each combination of them, the last parent's changing fastest; parents come before their children."""
    rows = spark.range(n)
    for i, (given, table) in enumerate(zip(parents, tables)):
        at = F.lit(0)
        for j in given:
            at = at * len(tables[j][0]) + F.col(f"c{j}")
        u, pick = uniform(seed, i), F.lit(len(table[0]) - 1)
        sums = [[sum(line[: k + 1]) for k in range(len(line))] for line in table]
        for k in range(len(table[0]) - 2, -1, -1):
            pick = F.when(u < F.get(F.array(*[F.lit(float(s[k])) for s in sums]), at), k).otherwise(pick)
        rows = rows.withColumn(f"c{i}", pick.cast("int"))
    return rows.select(*[F.concat(F.lit("v"), F.col(f"c{i}")).alias(f"x{i}") for i in range(len(parents))])


def random_network(nodes: int, arcs: int, values: int = 2, seed: int = 1) -> tuple[list[list[int]], list[list[list[float]]]]:
    """Parents and tables of a network by chance, for ``network_rows``."""
    r = random.Random(seed)
    parents: list[list[int]] = [[] for _ in range(nodes)]
    pairs = [(i, j) for i in range(nodes) for j in range(i)]
    for i, j in r.sample(pairs, min(arcs, len(pairs))):
        parents[i].append(j)
    tables = []
    for p in parents:
        lines = []
        for _ in range(values ** len(p)):
            w = [r.random() + 0.05 for _ in range(values)]
            lines.append([x / sum(w) for x in w])
        tables.append(lines)
    return [sorted(p) for p in parents], tables


def sine_clusters(spark: SparkSession, n: int, k: int, seed: int = 1, spread: float = 0.5, distance: float = 4.0) -> DataFrame:
    """Clusters along a sine curve."""
    rows = spark.range(n).withColumn("cluster", F.floor(uniform(seed, 1000) * k).cast("int"))
    x = F.col("cluster") * distance
    y = k / 2 * distance * F.sin(2 * math.pi * F.col("cluster") / k)
    return rows.select((x + normal(seed, 0) * spread).alias("a0"), (y + normal(seed, 1) * spread).alias("a1"), "cluster")


def weighted_clusters(spark: SparkSession, n: int, k: int, width: int, seed: int = 1, classes: int = 2) -> DataFrame:
    """``a0 ..`` and ``class``: random centres with a class, a weight and a spread of their own; rows lie in a random direction
    from theirs, as far as a normal draw says."""
    r = random.Random(seed)
    weights = [r.random() for _ in range(k)]
    total, upto, at = sum(weights), 0.0, F.lit(k - 1)
    edges = []
    for w in weights:
        upto += w / total
        edges.append(upto)
    for i in range(k - 2, -1, -1):
        at = F.when(uniform(seed, 900) < edges[i], i).otherwise(at)
    rows = spark.range(n).withColumn("_c", at.cast("int"))
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_c"))
    directions = [uniform(seed, 100 + i, -1.0, 1.0) for i in range(width)]
    length = F.sqrt(sum((d * d for d in directions), F.lit(0.0)))
    far = F.abs(normal(seed, 400)) * pick([r.random() for _ in range(k)])
    centres = [[r.random() for _ in range(k)] for _ in range(width)]
    return rows.select(*[(pick(centres[i]) + directions[i] / length * far).alias(f"a{i}") for i in range(width)], pick([f"c{r.randrange(classes)}" for _ in range(k)]).alias("class"))
