"""Attribute evaluation and search: scores of attributes or sets from aggregations, searches over them on the driver.

A set's ``merit`` is a function from attributes to a number, remembered so that no set is evaluated twice.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.learn import meta
from millrace.learn.base import Scheme, class_values, frame, gather
from millrace.learn.functions import Design, linear_svm, products
from millrace.operators.similarity import nearest
from millrace.operators.stats import contingency, rank_attributes
from millrace.plans.storage import stored

Merit = Callable[[frozenset], float]


# Scores --------------------------------------------------------------------------------------


def relief(df: DataFrame, target: str, attributes: list[str], key: str, neighbours: int = 10, sample: int = 1000, seed: int = 1) -> dict[str, float]:
    """How much more an attribute differs between a row and its nearest rows of other classes than of its own.

    ``sample`` rows by hash are compared with all rows; numbers differ by range, values by 0 or 1.
    """
    kinds = dict(df.dtypes)
    texts = [a for a in attributes if kinds[a] == "string"]
    rows = stored(df.where(F.col(target).isNotNull()).select(key, F.col(target).cast("string").alias("_y"), *attributes), "relief")
    numbers = [a for a in attributes if a not in texts]
    ends = rows.agg(*[x for a in numbers for x in (F.min(a).cast("double").alias(f"a_{a}"), F.max(a).cast("double").alias(f"b_{a}"))], F.count(F.lit(1)).alias("n")).first()
    domains = {a: [r[0] for r in rows.where(F.col(a).isNotNull()).select(a).distinct().orderBy(a).collect()] for a in texts}
    shown = {f"{a}|{i}": F.when(F.col(a) == v, 2**-0.5).otherwise(0.0) for a in texts for i, v in enumerate(domains[a])}
    flat = stored(rows.select(key, "_y", *attributes, *[F.coalesce(e, F.lit(0.0)).alias(f"_{i}") for i, e in enumerate(shown.values())]), "flat")
    width = {a: (ends[f"b_{a}"] - ends[f"a_{a}"]) or 1.0 for a in numbers} | {f"_{i}": 1.0 for i in range(len(shown))}
    flat = flat.na.fill(0.0, numbers)
    chosen = flat.orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample)
    chosen = stored(chosen, "chosen")
    prior = {r["_y"]: r["count"] / ends["n"] for r in rows.groupBy("_y").count().collect()}
    m, out = chosen.count(), dict.fromkeys(attributes, 0.0)
    for c in sorted(prior):
        found = nearest(chosen, flat.where(F.col("_y") == c), list(width), neighbours, key, key, width)
        a, b = (flat.select(F.col(key).alias(k), *([F.col("_y").alias("_own")] if k == "target" else []), *[F.col(x).alias(f"{k}_{x}") for x in attributes]) for k in ("target", "neighbour"))
        held = found.join(a, "target").join(b, "neighbour")
        per = held.groupBy("target", "_own").agg(*[F.avg(F.when(F.col(f"target_{x}").eqNullSafe(F.col(f"neighbour_{x}")), 0.0).otherwise(1.0) if x in texts else F.abs(F.col(f"target_{x}") - F.col(f"neighbour_{x}")) / width[x]).alias(x) for x in attributes])
        for r in per.groupBy("_own").agg(*[F.sum(x).alias(x) for x in attributes]).collect():  # one row a class
            factor = -1.0 if r["_own"] == c else prior[c] / max(1 - prior[r["_own"]], 1e-12)
            for x in attributes:
                out[x] += factor * r[x] / m
    return out


def svm_ranks(df: DataFrame, target: str, attributes: list[str], drop: int = 1) -> list[str]:
    """Attributes by when a margin learner throws them out, the last first: each time those of the least squared weight."""
    left, gone = list(attributes), []
    while left:
        model = linear_svm(df, target, left)
        names = model.design.names
        size = {a: sum(float((model.weights[1 + i] ** 2).sum()) for i, n in enumerate(names) if n == a or n.startswith(f"{a}=")) for a in left}
        worst = sorted(left, key=lambda a: (size[a], -left.index(a)))[: max(1, min(drop, len(left)))]
        gone += worst
        left = [a for a in left if a not in worst]
    return gone[::-1]


def set_uncertainty(df: DataFrame, a: str, b: str) -> float:
    return contingency(df, a, b).first()["symmetrical_uncertainty"] or 0.0


def cost_scores(df: DataFrame, attributes: list[str], target: str, cost: list[list[float]]) -> DataFrame:
    """``rank_attributes`` on rows weighted by what answering them wrongly costs."""
    held = meta.cost_weights(df, target, class_values(df, target), np.array(cost, float))
    return rank_attributes(held, attributes, target, meta.W)


def filtered_scores(df: DataFrame, attributes: list[str], target: str, step, score=rank_attributes) -> DataFrame:
    """Scores of the attributes that a filter leaves."""
    held = step(df)
    return score(held, [a for a in held.columns if a != target and (a in attributes or a not in df.columns)], target)


# Merits --------------------------------------------------------------------------------------


def remembered(merit: Merit) -> Merit:
    known: dict[frozenset, float] = {}

    def once(s: frozenset) -> float:
        s = frozenset(s)
        if s not in known:
            known[s] = merit(s)
        return known[s]

    once.known = known
    return once


def correlation_merit(df: DataFrame, target: str) -> Merit:
    """Large for sets that tell much of the target and little of one another, by symmetrical uncertainty."""
    pair = {}

    def su(a: str, b: str) -> float:
        k = (min(a, b), max(a, b))
        if k not in pair:
            pair[k] = set_uncertainty(df, *k)
        return pair[k]

    def merit(s: frozenset) -> float:
        if not s:
            return 0.0
        inner = sum(su(a, b) for a, b in itertools.combinations(sorted(s), 2))
        return sum(su(a, target) for a in s) / (len(s) + 2 * inner) ** 0.5

    return remembered(merit)


def consistency_merit(df: DataFrame, target: str) -> Merit:
    from millrace.operators.models import consistency

    return remembered(lambda s: consistency(df, sorted(s), target).first()["consistency"] if s else consistency(df.withColumn("_one", F.lit(1)), ["_one"], target).first()["consistency"])


def wrapper_merit(df: DataFrame, target: str, scheme: Scheme, folds: int = 3, weight: str | None = None, seed: int = 1) -> Merit:
    """What a scheme reaches on left-out folds with the set."""
    return remembered(lambda s: meta.cross_accuracy(df, target, sorted(s), scheme, weight, folds, seed))


def classifier_merit(df: DataFrame, held: DataFrame, target: str, scheme: Scheme) -> Merit:
    """What a scheme reaches on rows held out."""
    return remembered(lambda s: meta.accuracy_of(scheme(df, target, sorted(s), None), held, target))


def cost_merit(df: DataFrame, target: str, cost: list[list[float]], make: Callable[[DataFrame, str], Merit]) -> Merit:
    """A merit of rows drawn with replacement in proportion to their cost, by hash: a row is repeated by the whole part of its
    weight, and once more by chance for the rest."""
    held = meta.cost_weights(df, target, class_values(df, target), np.array(cost, float))
    times = F.floor(F.col(meta.W)) + F.when(meta.uniform(3, *df.columns) < F.col(meta.W) - F.floor(F.col(meta.W)), 1).otherwise(0)
    repeated = held.withColumn("_i", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))))
    return make(stored(repeated.select(df.columns), "costly"), target)


def filtered_merit(df: DataFrame, target: str, step, make: Callable[[DataFrame, str], Merit]) -> Merit:
    return make(stored(step(df), "filtered"), target)


# Searches ------------------------------------------------------------------------------------


def _best(options: list[frozenset], merit: Merit):
    return max(options, key=lambda s: (round(merit(s), 9), -len(s), tuple(-ord(c) for c in "".join(sorted(s))))) if options else None


def greedy(attributes: list[str], merit: Merit, backward: bool = False, n: int | None = None) -> list[str]:
    """Adds (or takes away) the attribute that helps most while something is gained, or until there are ``n``."""
    s = frozenset(attributes) if backward else frozenset()
    while True:
        options = [s - {a} for a in s] if backward else [s | {a} for a in attributes if a not in s]
        best = _best([o for o in options if o or not backward], merit)
        if best is None or (n is None and merit(best) <= merit(s) + 1e-9 and (s or not backward) and (s or merit(best) <= 0)):
            break
        if n is not None and len(s) == n:
            break
        s = best
    return sorted(s, key=attributes.index)


def forward(attributes: list[str], merit: Merit) -> list[str]:
    return greedy(attributes, merit)


def best_first(attributes: list[str], merit: Merit, patience: int = 5, backward: bool = False) -> list[str]:
    """Goes on from the best set seen so far, and ends after ``patience`` of them have brought nothing better."""
    start = frozenset(attributes) if backward else frozenset()
    open_, seen, best, stale = [start], {start}, start, 0
    while open_ and stale < patience:
        s = _best(open_, merit)
        open_.remove(s)
        grown = False
        for a in attributes:
            t = s - {a} if a in s and backward else s | {a} if a not in s and not backward else None
            if t is None or t in seen or not t:
                continue
            seen.add(t)
            open_.append(t)
            if merit(t) > merit(best) + 1e-9:
                best, grown = t, True
        stale = 0 if grown else stale + 1
    return sorted(best, key=attributes.index)


def linear_forward(attributes: list[str], merit: Merit, k: int, fixed: bool = True, floating: bool = False) -> list[str]:
    """Forward search among the ``k`` attributes that are best alone: always the same ones, or the next best in place of one
    taken (``fixed`` False). ``floating`` takes attributes away again where that helps."""
    ranked = sorted(attributes, key=lambda a: (-round(merit(frozenset([a])), 9), attributes.index(a)))
    s = frozenset()
    while True:
        pool = ranked[:k] if fixed else [a for a in ranked if a not in s][:k]
        options = [s | {a} for a in pool if a not in s] + ([s - {a} for a in s] if floating and len(s) > 1 else [])
        best = _best(options, merit)
        if best is None or merit(best) <= merit(s) + 1e-9:
            return sorted(s, key=attributes.index)
        s = best


def subset_size_forward(df: DataFrame, target: str, attributes: list[str], make: Callable[[DataFrame, str], Merit], k: int, folds: int = 3, seed: int = 1) -> list[str]:
    """Forward search up to the size that is best on average over folds."""
    dealt = stored(meta._dealt(df, target, folds, seed), "sizes")
    gains = np.zeros(min(k, len(attributes)) + 1)
    for f in range(folds):
        train, test = make(dealt.where(F.col("_part") != f), target), make(dealt.where(F.col("_part") == f), target)
        s = frozenset()
        for size in range(1, len(gains)):
            s = _best([s | {a} for a in attributes if a not in s], train)
            gains[size] += test(s) / folds
    return greedy(attributes, make(df, target), n=int(np.argmax(np.round(gains, 9))))


def exhaustive(attributes: list[str], merit: Merit, most: int = 15) -> list[str]:
    if len(attributes) > most:
        raise ValueError(f"more than {most} attributes")
    every = [frozenset(c) for n in range(1, len(attributes) + 1) for c in itertools.combinations(attributes, n)]
    return sorted(_best(every, merit), key=attributes.index)


def random_search(attributes: list[str], merit: Merit, share: float = 0.25, seed: int = 1) -> list[str]:
    """The best of as many sets by chance as the share of all of them, and smaller ones among equals."""
    r = random.Random(seed)
    n = max(1, min(int(share * 2 ** min(len(attributes), 20)), 10_000))
    sets = [frozenset(a for a in attributes if r.random() < 0.5) for _ in range(n)]
    return sorted(_best([s for s in sets if s] or [frozenset(attributes)], merit), key=attributes.index)


def rank_search(ranked: list[str], merit: Merit, step: int = 1) -> list[str]:
    """The best of the first attributes of a ranking."""
    return sorted(_best([frozenset(ranked[:n]) for n in range(step, len(ranked) + 1, step)], merit), key=ranked.index)


def evolve(fitness: Callable[[tuple], float], genes: int, population: int = 20, generations: int = 20, cross: float = 0.6, mutate: float = 0.033, seed: int = 1) -> tuple:
    """Bit strings bred by fitness: parents drawn in proportion, crossed at a place, flipped by chance; the best stays."""
    r = random.Random(seed)
    pool = [tuple(r.randint(0, 1) for _ in range(genes)) for _ in range(population)]
    known: dict[tuple, float] = {}
    value = lambda g: known[g] if g in known else known.setdefault(g, fitness(g))
    best = max(pool, key=value)
    for _ in range(generations):
        low = min(map(value, pool))
        weights = [value(g) - low + 1e-9 for g in pool]
        young = [best]
        while len(young) < population:
            a, b = r.choices(pool, weights, k=2)
            if genes > 1 and r.random() < cross:
                at = r.randint(1, genes - 1)
                a, b = a[:at] + b[at:], b[:at] + a[at:]
            young += [tuple(1 - g if r.random() < mutate else g for g in x) for x in (a, b)]
        pool = young[:population]
        best = max([best, *pool], key=value)
    return best


def genetic_search(attributes: list[str], merit: Merit, **options) -> list[str]:
    chosen = evolve(lambda g: round(merit(frozenset(a for a, on in zip(attributes, g) if on)), 9) - 1e-10 * sum(g) if any(g) else -1e9, len(attributes), **options)
    return [a for a, on in zip(attributes, chosen) if on]


def scatter_search(attributes: list[str], merit: Merit, size: int = 6, rounds: int = 5, seed: int = 1) -> list[str]:
    """A few good and a few different sets, joined two by two and improved by single attributes while the best gets better."""
    r = random.Random(seed)

    def better(s: frozenset) -> frozenset:
        while True:
            t = _best([s ^ {a} for a in attributes if s ^ {a}], merit)
            if t is None or merit(t) <= merit(s) + 1e-9:
                return s
            s = t

    pool = list({better(frozenset(a for a in attributes if r.random() < 0.5) or frozenset([attributes[0]])) for _ in range(2 * size)})
    for _ in range(rounds):
        good = sorted(pool, key=lambda s: -merit(s))[: size // 2]
        far = sorted((s for s in pool if s not in good), key=lambda s: -min(len(s ^ g) for g in good))[: size // 2]
        ref = [*good, *far]
        joined = {better(a | b) for a, b in itertools.combinations(ref, 2)} | {better(a & b) for a, b in itertools.combinations(ref, 2) if a & b}
        grown = list(set(pool) | joined)
        if max(map(merit, grown)) <= max(map(merit, pool)) + 1e-9:
            break
        pool = grown
    return sorted(_best(pool, merit), key=attributes.index)


def fcbf(df: DataFrame, target: str, attributes: list[str], threshold: float = 0.0) -> list[str]:
    """Attributes by falling symmetrical uncertainty with the target, without those that a better one tells more of."""
    scores = {a: set_uncertainty(df, a, target) for a in attributes}
    left = [a for a in sorted(attributes, key=lambda a: (-round(scores[a], 9), attributes.index(a))) if scores[a] > threshold]
    kept: list[str] = []
    while left:
        kept.append(left.pop(0))
        left = [b for b in left if set_uncertainty(df, kept[-1], b) < scores[b]]
    return kept


def selected_by_folds(df: DataFrame, target: str, attributes: list[str], search: Callable[[DataFrame], list[str]], folds: int = 10, seed: int = 1) -> dict[str, int]:
    """In how many folds' training rows each attribute is chosen."""
    dealt = stored(meta._dealt(df, target, folds, seed), "selected")
    out = dict.fromkeys(attributes, 0)
    for f in range(folds):
        for a in search(dealt.where(F.col("_part") != f).drop("_part")):
            out[a] += 1
    return out


# Transforms ----------------------------------------------------------------------------------


def latent_semantics(df: DataFrame, columns: list[str], k: int | None = None, share: float = 0.95):
    """``apply`` that replaces columns by ``LSA_1 ..``: rows times the leading right singular vectors, from one pass of products."""
    rows = frame(df, None, columns).na.fill(0.0, columns)
    m = gather(rows, lambda t: [("p", t[columns].to_numpy(float).T @ t[columns].to_numpy(float))])["p"]
    values, vectors = np.linalg.eigh(m)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    n = k or int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12) + 1)
    v = vectors[:, :n] * np.where(vectors[np.abs(vectors).argmax(0), range(len(columns))] < 0, -1, 1)[:n]

    def apply(table: DataFrame) -> DataFrame:
        made = [sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(v[i, j]) for i, c in enumerate(columns)), F.lit(0.0)).alias(f"LSA_{j + 1}") for j in range(n)]
        return table.select(*[c for c in table.columns if c not in columns], *made)

    apply.values = np.sqrt(values[:n])
    return apply


def independent_components(df: DataFrame, columns: list[str], k: int | None = None, rounds: int = 50, seed: int = 1):
    """``apply`` that replaces columns by ``IC_1 ..``: directions of the whitened rows that are least normal, one pass a round."""
    rows = frame(df, None, columns).na.drop()
    design = Design(rows, columns)
    m = products(rows.withColumn("_y", F.lit(0.0)), design)["0"][:-1]
    n, mean = m[0, 0], m[0, 1:-1] / m[0, 0]
    cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[: k or len(columns)]
    white = vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-12))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(order), len(order))))[0]
    for _ in range(rounds):

        def add(t: pd.DataFrame, w=w):
            z = (t[columns].to_numpy(float) - mean) @ white
            g = np.tanh(z @ w.T)
            yield "a", g.T @ z
            yield "b", (1 - g * g).sum(0)

        s = gather(rows, add)
        u, _, vt = np.linalg.svd(s["a"] / n - np.diag(s["b"] / n) @ w)
        after = u @ vt
        moved = np.abs(np.abs((after * w).sum(1)) - 1).max()
        w = after
        if moved < 1e-9:
            break
    turn = white @ w.T

    def apply(table: DataFrame) -> DataFrame:
        made = [sum(((F.col(c).cast("double") - float(mean[i])) * float(turn[i, j]) for i, c in enumerate(columns)), F.lit(0.0)).alias(f"IC_{j + 1}") for j in range(turn.shape[1])]
        return table.select(*[c for c in table.columns if c not in columns], *made)

    return apply


def nonnegative_factors(df: DataFrame, columns: list[str], k: int, rounds: int = 100, inner: int = 30, seed: int = 1) -> tuple[Callable, np.ndarray]:
    """``apply`` that replaces columns by ``NMF_1 ..``, and the factors: rows as non-negative sums of them. A round fits each
    row's shares where it lies, and then the factors from one pass of products."""
    rows = frame(df, None, columns).na.fill(0.0, columns)
    h = np.random.default_rng(seed).random((k, len(columns))) + 0.1

    def shares(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        w, a, b = np.ones((len(x), k)), x @ h.T, h @ h.T
        for _ in range(inner):
            w *= a / np.maximum(w @ b, 1e-12)
        return w

    for _ in range(rounds):

        def add(t: pd.DataFrame, h=h):
            x = t[columns].to_numpy(float)
            w = shares(x, h)
            yield "a", w.T @ x
            yield "b", w.T @ w

        s = gather(rows, add)
        after = h * s["a"] / np.maximum(s["b"] @ h, 1e-12)
        moved = np.abs(after - h).max() / max(np.abs(h).max(), 1e-12)
        h = after
        if moved < 1e-6:
            break

    def apply(table: DataFrame) -> DataFrame:
        @F.pandas_udf("array<double>")
        def parts(x: pd.DataFrame) -> pd.Series:
            return pd.Series([r.tolist() for r in shares(np.nan_to_num(x.to_numpy(float)), h)])

        held = table.withColumn("_nmf", parts(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])))
        return held.select(*[c for c in table.columns if c not in columns], *[F.get("_nmf", F.lit(j)).alias(f"NMF_{j + 1}") for j in range(k)])

    return apply, h
