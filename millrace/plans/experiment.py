"""Cross-validation and splits, with a table of finished results that is not computed again."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.columns import add_noise
from millrace.operators.evaluation import accuracy, expected_cost, regression_scores
from millrace.plans.naming import free
from millrace.plans.numbering import numbered, running, stored

RESULT = "scheme string, run int, fold int, n long, correct long, accuracy double"


def with_folds(df: DataFrame, target: str, key: list[str], folds: int, run: int) -> DataFrame:
    """A column ``_fold`` from 0: rows are shuffled by hash of key and run, then dealt class after class, so that
    folds are even in all and within each class."""
    drawn, place = free(df, "_h", "_i")
    rows = numbered(df.withColumn(drawn, F.xxhash64(F.lit(run), *key)), [target, drawn, *key], place)
    return rows.withColumn("_fold", F.pmod(F.col(place), F.lit(folds)).cast("int")).drop(drawn, place)


def cross_validate(
    df: DataFrame, schemes: dict[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]], target: str, key: list[str],
    folds: int = 10, runs: int = 1, done: DataFrame | None = None,
) -> DataFrame:
    """One row a scheme, run and fold. ``schemes[name](train)`` gives a function that adds ``prediction``.

    Keys that ``done`` has are kept and not computed again.
    """
    have = {(r["scheme"], r["run"], r["fold"]) for r in done.select("scheme", "run", "fold").collect()} if done is not None else set()
    rows = []
    for run in range(1, runs + 1):
        wanted = [(s, f) for f in range(folds) for s in schemes if (s, run, f) not in have]
        if not wanted:
            continue
        dealt = stored(with_folds(df, target, key, folds, run), "folds")

        def one(scheme: str, fold: int, dealt=dealt):
            train, test = (dealt.where(c).drop("_fold") for c in (F.col("_fold") != fold, F.col("_fold") == fold))
            return accuracy(schemes[scheme](train)(test), target, "prediction").first()

        found = together({(s, f): (lambda s=s, f=f, one=one: one(s, f)) for s, f in wanted})
        rows += [(s, run, f, r["n"], r["correct"] or 0, r["accuracy"]) for (s, f), r in found.items()]
    new = df.sparkSession.createDataFrame(rows, RESULT)
    return new if done is None else done.select(new.columns).unionByName(new)


# Runners -------------------------------------------------------------------------------------


def together(tasks: dict, at_once: int = 4) -> dict:
    """Results of independent functions by name, several at the same time on the cluster."""
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(tasks)))) as pool:
        held = {k: pool.submit(inheritable(f)) for k, f in tasks.items()}
        return {k: h.result() for k, h in held.items()}


def inheritable(f: Callable) -> Callable:
    from pyspark import inheritable_thread_target
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    return inheritable_thread_target(session)(f) if session else f


def grid(tables: dict[str, DataFrame], schemes: dict[str, Callable], evaluate: Callable, runs: int = 1, done: DataFrame | None = None, at_once: int = 4) -> list[dict]:
    """``evaluate(table, scheme, run) -> dict`` for every table, scheme and run that ``done`` does not have, in any order."""
    have = {(r["data"], r["scheme"], r["run"]) for r in done.select("data", "scheme", "run").distinct().collect()} if done is not None else set()
    tasks = {}
    for d, t in tables.items():
        for s, f in schemes.items():
            for run in range(1, runs + 1):
                if (d, s, run) not in have:
                    tasks[d, s, run] = lambda t=t, f=f, run=run: evaluate(t, f, run)
    return [{"data": d, "scheme": s, "run": run, **found} for (d, s, run), found in together(tasks, at_once).items()] if tasks else []


def split(df: DataFrame, percent: float, seed: int, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Train and test by hash of ``key``, for runners: no sort, the shares hold on average."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(10_000))
    return df.where(u < percent * 100), df.where(u >= percent * 100)


def split_scores(train: DataFrame, test: DataFrame, target: str, attributes: list[str], scheme, cost: DataFrame | None = None, feature_costs: dict[str, float] | None = None) -> dict:
    """What a scheme reaches: accuracy, likelihood and costs of classes, or errors of numbers; seconds to fit."""
    began = time.time()
    model = scheme(train, target, attributes, None)
    out = {"seconds": time.time() - began, "n": test.count()}
    judged = model.transform(test)
    if model.classes is None:
        r = regression_scores(judged, target, "prediction").first()
        return out | {k: r[k] for k in ("mean_absolute", "root_mean_squared", "correlation")}
    r = accuracy(judged.withColumn(target, F.col(target).cast("string")), target, "prediction").first()
    out |= {"accuracy": r["accuracy"], "correct": r["correct"] or 0}
    if cost is not None:
        out |= {"mean_cost": expected_cost(judged.withColumn(target, F.col(target).cast("string")), target, "prediction", cost).first()["mean_cost"]}
    if feature_costs is not None:
        out |= {"feature_cost": sum(feature_costs.get(a, 0.0) for a in model.attributes)}
    return out


def diversity(committee, test: DataFrame) -> dict:
    """How often two members of a committee answer differently, on average, and how often none of them agrees with the whole."""
    held = committee.transform(test, "_all", None)
    names = []
    for i, m in enumerate(committee.members):
        held = m.transform(held, f"_m{i}", None)
        names.append(f"_m{i}")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    differ = sum((F.when(F.col(a) != F.col(b), 1.0).otherwise(0.0) for a, b in pairs), F.lit(0.0)) / max(len(pairs), 1)
    r = held.agg(F.avg(differ).alias("disagreement")).first()
    return {"members": len(names), "disagreement": r["disagreement"]}


def learning_curve(df: DataFrame, target: str, attributes: list[str], schemes: dict, key: list[str], sizes: list[float], folds: int = 3, run: int = 1, noise: list[float] = (0.0,)) -> DataFrame:
    """``scheme, fold, size, noise, accuracy`` for growing shares of each fold's training rows, of which a part may have
    another class by chance. All points are independent and run at the same time."""
    dealt = stored(with_folds(df.where(F.col(target).isNotNull()), target, key, folds, run), "folds")
    rank = F.pmod(F.xxhash64(*key, F.lit(run), F.lit(77)), F.lit(10_000)) / 100.0
    tasks = {}
    for f in range(folds):
        train, test = dealt.where(F.col("_fold") != f), dealt.where(F.col("_fold") == f)
        for size in sizes:
            for share in noise:
                part = train.where(rank < size)
                part = add_noise(part, target, share, run, key) if share else part
                for name, scheme in schemes.items():
                    tasks[name, f, float(size), float(share)] = lambda p=part, t=test, s=scheme: split_scores(p.drop("_fold"), t.drop("_fold"), target, attributes, s)
    found = together(tasks)
    rows = [(s, f, size, share, r.get("accuracy", r.get("root_mean_squared"))) for (s, f, size, share), r in found.items()]
    return df.sparkSession.createDataFrame(rows, "scheme string, fold int, size double, noise double, accuracy double")


def averaged_curve(curve: DataFrame, by: str = "size") -> DataFrame:
    """``scheme, <by>, mean, deviation``: the points of a plot."""
    return curve.groupBy("scheme", by).agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("deviation"))


def active_curve(df: DataFrame, target: str, attributes: list[str], key: str, choose: Callable, scheme, start: int, step: int, steps: int, test: DataFrame) -> DataFrame:
    """``labelled, accuracy`` while ``choose(labelled, pool, n)`` names the rows whose labels are asked for next."""
    pool = stored(df.where(F.col(target).isNotNull()), "pool")
    names = pool.orderBy(F.xxhash64(key), key).limit(start).select(key)
    labelled = stored(pool.join(names, key, "left_semi"), "labelled")
    out = []
    for _ in range(steps):
        r = split_scores(labelled, test, target, attributes, scheme)
        out.append((labelled.count(), r["accuracy"]))
        rest = pool.join(labelled.select(key), key, "left_anti")
        if not rest.limit(1).count():
            break
        more = choose(labelled, rest, step).select(key)
        labelled = stored(labelled.unionByName(pool.join(more, key, "left_semi")), "labelled")
    return df.sparkSession.createDataFrame(out, "labelled long, accuracy double")


def acquisition_curve(df: DataFrame, target: str, attributes: list[str], bought: list[str], key: str, choose: Callable, scheme, start: int, step: int, steps: int, test: DataFrame) -> DataFrame:
    """``complete, accuracy`` while ``choose(known, pool, n)`` names the rows whose values of ``bought`` are paid for next.

    Every row has its label and its other columns from the beginning; ``known`` is the whole table with nulls where
    nothing was bought, and ``pool`` the rows of it that lack the values. Accuracy is that on ``test``, with all values.
    """
    rows = stored(df.where(F.col(target).isNotNull()), "priced")
    paid = stored(rows.orderBy(F.xxhash64(key), key).limit(start).select(key), "paid")
    out = []
    for _ in range(steps):
        lacking = rows.join(paid, key, "left_anti").withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in bought})
        known = rows.join(paid, key, "left_semi").unionByName(lacking)
        out.append((paid.count(), split_scores(known, test, target, attributes, scheme)["accuracy"]))
        if not lacking.limit(1).count():
            break
        paid = stored(paid.unionAll(choose(known, lacking, step).select(key)), "paid")
    return df.sparkSession.createDataFrame(out, "complete long, accuracy double")


def semi_supervised_curve(df: DataFrame, target: str, attributes: list[str], key: list[str], fit: Callable, shares: list[float], folds: int = 3, run: int = 1, hidden: list[str] = ()) -> DataFrame:
    """``share, fold, accuracy`` of ``fit(rows)`` on training rows of which a share keeps its label; ``hidden`` classes keep none."""
    dealt = stored(with_folds(df.where(F.col(target).isNotNull()), target, key, folds, run), "folds")
    rank = F.pmod(F.xxhash64(*key, F.lit(run), F.lit(78)), F.lit(10_000)) / 100.0
    tasks = {}
    for f in range(folds):
        for share in shares:
            kept = (rank < share) & ~F.col(target).isin(list(hidden)) if hidden else rank < share
            train = dealt.where(F.col("_fold") != f).withColumn(target, F.when(kept, F.col(target)))
            test = dealt.where(F.col("_fold") == f)
            tasks[float(share), f] = lambda tr=train, te=test: accuracy(fit(tr.drop("_fold")).transform(te.drop("_fold")), target, "prediction").first()["accuracy"]
    rows = [(s, f, a) for (s, f), a in together(tasks).items()]
    return df.sparkSession.createDataFrame(rows, "share double, fold int, accuracy double")


def constraint_curve(df: DataFrame, key: str, target: str, cluster: Callable, counts: list[int], seed: int = 1, ask: Callable | None = None) -> DataFrame:
    """``links, pair_f, nmi`` of ``cluster(df, links) -> key, cluster`` for growing numbers of links between rows, drawn by hash or
    named by ``ask(df, n)``; must-links join rows of one class, cannot-links others."""
    from millrace.operators.evaluation import cluster_agreement

    rows = []
    for n in counts:
        links = ask(df, n) if ask else random_links(df, key, target, n, seed)
        found = cluster(df, links)
        r = cluster_agreement(df.select(key, target).join(found, key), "cluster", target).first()
        rows.append((n, r["pair_f"], r["nmi"]))
    return df.sparkSession.createDataFrame(rows, "links long, pair_f double, nmi double")


def random_links(df: DataFrame, key: str, target: str, n: int, seed: int = 1) -> DataFrame:
    """``a, b, link`` of about ``n`` rows and their next ones by hash."""
    some = df.where(F.col(target).isNotNull()).select(F.col(key).alias("k"), F.col(target).alias("y")).orderBy(F.xxhash64(F.lit(seed), key), key).limit(2 * n)
    place = numbered(some, [F.xxhash64(F.lit(seed), "k"), "k"], "i")
    a, b = place.where("i % 2 = 1"), place.where("i % 2 = 0").select(F.col("k").alias("b"), F.col("y").alias("yb"), (F.col("i") - 1).alias("i"))
    return a.join(b, "i").select(F.col("k").alias("a"), "b", F.when(F.col("y") == F.col("yb"), 1).otherwise(-1).alias("link"))


def pair_curve(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """``score, precision, recall, f`` of pairs ``a, b, score`` taken from the highest score on, against true pairs ``a, b``."""
    way = lambda d, *more: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)
    hits = way(scored, "score").join(way(truth).distinct().withColumn("_t", F.lit(1)), ["a", "b"], "left")
    points = hits.groupBy("score").agg(F.count("*").alias("n"), F.count("_t").alias("h"))
    run = running(points, [F.desc("score")], {"taken": "n", "right": "h"})
    total = way(truth).distinct().count()
    p, r = F.col("right") / F.col("taken"), F.col("right") / F.lit(float(max(total, 1)))
    return run.select("score", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f"))


def field_scores(found: DataFrame, truth: DataFrame, fields: list[str], key: str) -> DataFrame:
    """``field, precision, recall, f`` of extracted values against true ones, by row."""
    held = truth.select(key, *[F.col(f).alias(f"_t_{f}") for f in fields]).join(found, key, "full")
    out = None
    for f in fields:
        right = F.count(F.when(F.col(f) == F.col(f"_t_{f}"), 1))
        r = held.agg(right.alias("h"), F.count(f).alias("n"), F.count(f"_t_{f}").alias("t"))
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        row = r.select(F.lit(f).alias("field"), ratio(F.col("h"), F.col("n")).alias("precision"), ratio(F.col("h"), F.col("t")).alias("recall"), ratio(2 * F.col("h"), F.col("n") + F.col("t")).alias("f"))
        out = row if out is None else out.unionAll(row)
    return out
