"""Clusterers. A clusterer gives a model whose classes are the clusters' numbers as texts; each round is one pass.

Constraints are links ``a, b, link`` between keys, 1 for must and -1 for cannot.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.learn.base import Model, Table, frame, gather, one_hot, softmax
from millrace.operators.records import closed_links, components
from millrace.plans.naming import free
from millrace.plans.storage import stored


class Space:
    """Numbers on their range, filled by their means, and a column a value: distances as rows of one array."""

    def __init__(self, df: DataFrame, attributes: list[str], scaled: bool = True):
        self.table, self.attributes = Table.of(df, attributes), attributes
        n = self.table.numbers
        m = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, a in enumerate(n) for x in (F.min(a).cast("double").alias(f"a{i}"), F.max(a).cast("double").alias(f"b{i}"), F.avg(a).alias(f"m{i}"))]).first()
        low = np.array([m[f"a{i}"] if m[f"a{i}"] is not None else 0.0 for i in range(len(n))])
        high = np.array([m[f"b{i}"] if m[f"b{i}"] is not None else 1.0 for i in range(len(n))])
        self.low = low if scaled else np.zeros(len(n))
        self.width = np.where(high > low, high - low, 1.0) if scaled else np.ones(len(n))
        self.fill = np.array([m[f"m{i}"] or 0.0 for i in range(len(n))])
        self.rows = m["n"]

    def __call__(self, x: pd.DataFrame) -> np.ndarray:
        v = self.table.values(x)
        parts = [(np.where(np.isnan(v), self.fill[None], v) - self.low) / self.width]
        c = self.table.codes(x)
        for i, s in enumerate(self.table.sizes):
            h = np.zeros((len(x), s))
            known = c[:, i] >= 0
            h[np.flatnonzero(known), c[known, i]] = math.sqrt(0.5)
            parts.append(h)
        return np.hstack(parts)


def sample_of(df: DataFrame, attributes: list[str], n: int) -> pd.DataFrame:
    """At most ``n`` rows by hash, in the order of the hash: the same on any cluster."""
    rows = frame(df, None, attributes).drop("_w")
    return rows.orderBy(F.xxhash64(*attributes), *attributes).limit(n).toPandas()


class Centres(Model):
    def __init__(self, space: Space, centres: np.ndarray, metric: str = "euclidean", weights: np.ndarray | None = None):
        self.space, self.centres, self.metric, self.attributes = space, centres, metric, space.attributes
        self.weights = np.ones(centres.shape[1]) if weights is None else weights
        self.classes = [str(i) for i in range(len(centres))]

    def distances(self, z: np.ndarray) -> np.ndarray:
        if self.metric == "manhattan":
            return sum((np.abs(z[:, i][:, None] - self.centres[:, i][None]) * self.weights[i] for i in range(z.shape[1])), np.zeros((len(z), len(self.centres))))
        if self.metric == "cosine":
            unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
            return 1 - unit(z * self.weights) @ unit(self.centres).T
        if self.weights.ndim == 2:
            d = z[:, None] - self.centres[None]
            return np.einsum("nki,ij,nkj->nk", d, self.weights, d)
        return ((z[:, None] - self.centres[None]) ** 2 * self.weights).sum(2)

    def scores(self, x):
        return np.eye(len(self.centres))[self.distances(self.space(x)).argmin(1)]


def farthest(z: np.ndarray, k: int, first: int = 0) -> np.ndarray:
    chosen = [first]
    d = ((z - z[first]) ** 2).sum(1)
    while len(chosen) < k and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((z - z[chosen[-1]]) ** 2).sum(1))
    return z[chosen]


def start_centres(df: DataFrame, space: Space, k: int, how: str = "farthest", seed: int = 1, rows: int = 1000) -> np.ndarray:
    """``random`` rows by hash, ``farthest`` ones of a sample, or the mean of all rows moved a little (``perturbed``)."""
    z = space(sample_of(df, space.attributes, rows))
    if how == "random":
        return z[np.random.default_rng(seed).permutation(len(z))[:k]]
    if how == "perturbed":
        mean = gather(frame(df, None, space.attributes), lambda t: [("s", np.concatenate([[len(t)], space(t).sum(0)]))])["s"]
        return mean[1:] / mean[0] + np.random.default_rng(seed).normal(0, 0.1, (k, z.shape[1]))
    return farthest(z, k)


def k_means(df: DataFrame, attributes: list[str], k: int, metric: str = "euclidean", how: str = "farthest", rounds: int = 50, seed: int = 1, centres: np.ndarray | None = None) -> Centres:
    """Means of the nearest rows, again and again until no centre moves; ``manhattan`` takes medians by halving the range of
    each coordinate; a value's share among a cluster's rows stands for its mode."""
    space = Space(df, attributes)
    rows = frame(df, None, attributes)
    model = Centres(space, start_centres(df, space, k, how, seed) if centres is None else centres, metric)
    for _ in range(rounds):

        def add(t: pd.DataFrame, model=model):
            z = space(t)
            out = np.zeros((len(model.centres), z.shape[1] + 1))
            np.add.at(out, model.distances(z).argmin(1), np.column_stack([np.ones(len(z)), z]))
            yield "s", out

        s = gather(rows, add).get("s")
        if s is None:
            break
        after = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), model.centres)
        if metric == "manhattan":
            after = np.where(s[:, :1] > 0, _medians(rows, space, model, s[:, 0]), model.centres)
        moved = np.abs(after - model.centres).max()
        model = Centres(space, after, metric)
        if moved < 1e-9:
            break
    return model


def _medians(rows: DataFrame, space: Space, model: Centres, n: np.ndarray, steps: int = 30) -> np.ndarray:
    low, high = np.zeros_like(model.centres) - 1e-9, np.ones_like(model.centres)
    for _ in range(steps):
        middle = (low + high) / 2

        def add(t: pd.DataFrame, middle=middle):
            z = space(t)
            at = model.distances(z).argmin(1)
            out = np.zeros_like(middle)
            np.add.at(out, at, (z <= middle[at]).astype(float))
            yield "s", out

        below = gather(rows, add)["s"]
        enough = below * 2 >= n[:, None]
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    return high


class Mixture(Model):
    """Independent normals and values by cluster."""

    def __init__(self, table: Table, attributes, weights, means, deviations, values):
        self.table, self.attributes, self.weights, self.means, self.deviations, self.values = table, attributes, weights, means, deviations, values
        self.classes = [str(i) for i in range(len(weights))]

    def logs(self, x: pd.DataFrame) -> np.ndarray:
        v, c = self.table.values(x), self.table.codes(x)
        out = np.log(np.maximum(self.weights, 1e-300))[None] + np.zeros((len(x), len(self.weights)))
        for i in range(v.shape[1]):
            z = (v[:, i][:, None] - self.means[:, i][None]) / self.deviations[:, i][None]
            out += np.where(np.isnan(v[:, i])[:, None], 0, -z * z / 2 - np.log(self.deviations[:, i] * math.sqrt(2 * math.pi))[None])
        for i, p in enumerate(self.values):
            out += np.where((c[:, i] >= 0)[:, None], np.log(p.T[np.maximum(c[:, i], 0)]), 0)
        return out

    def scores(self, x):
        return softmax(self.logs(x))

    def likelihood(self, df: DataFrame) -> float:
        """The mean logarithm of the rows' density."""
        s = gather(frame(df, None, self.attributes), lambda t: [("l", np.array([np.logaddexp.reduce(self.logs(t), 1).sum(), len(t)]))]).get("l", np.array([0.0, 1.0]))
        return float(s[0] / s[1])


def _mixture(rows: DataFrame, table: Table, attributes, shares: Callable[[pd.DataFrame], np.ndarray], k: int, least: float) -> Mixture:
    def add(t: pd.DataFrame):
        q = shares(t)
        v, c = table.values(t), table.codes(t)
        known = ~np.isnan(v)
        filled = np.where(known, v, 0)
        yield "n", q.sum(0)
        yield "m", np.stack([q.T @ known, q.T @ filled, q.T @ filled**2], 2)
        for i, s in enumerate(table.sizes):
            h = np.zeros((s, k))
            np.add.at(h, c[c[:, i] >= 0, i], q[c[:, i] >= 0])
            yield f"c{i}", h.T

    f = gather(rows, add)
    w = np.maximum(f["m"][:, :, 0], 1e-12)
    mean = f["m"][:, :, 1] / w
    deviation = np.maximum(np.sqrt(np.maximum(f["m"][:, :, 2] / w - mean**2, 0)), least)
    values = [(f[f"c{i}"] + 1) / (f[f"c{i}"].sum(1, keepdims=True) + s) for i, s in enumerate(table.sizes)]
    return Mixture(table, attributes, f["n"] / f["n"].sum(), mean, deviation, values)


def em(df: DataFrame, attributes: list[str], k: int, rounds: int = 30, least: float = 1e-6, seed: int = 1) -> Mixture:
    """A mixture by expectation and maximisation, from k-means."""
    rows, table = frame(df, None, attributes), Table.of(df, attributes)
    begun = k_means(df, attributes, k, rounds=5, seed=seed)
    model = _mixture(rows, table, attributes, begun.scores, len(begun.classes), least)
    before = -math.inf
    for _ in range(rounds):
        model = _mixture(rows, table, attributes, model.scores, len(model.classes), least)
        now = model.likelihood(df)
        if now - before < 1e-6:
            break
        before = now
    return model


def em_chosen(df: DataFrame, attributes: list[str], most: int = 5, folds: int = 3, **options) -> Mixture:
    """As many clusters as raise the likelihood of left-out folds."""
    dealt = stored(df.withColumn("_part", F.pmod(F.xxhash64(*attributes, F.lit(5)), F.lit(folds))), "folds")
    best, k = -math.inf, 1
    for n in range(1, most + 1):
        score = np.mean([em(dealt.where(F.col("_part") != f), attributes, n, **options).likelihood(dealt.where(F.col("_part") == f)) for f in range(folds)])
        if score <= best:
            break
        best, k = score, n
    return em(df, attributes, k, **options)


def densities(df: DataFrame, attributes: list[str], inner: Model, least: float = 1e-6) -> Mixture:
    """Densities fitted to the clusters that another clusterer gives."""
    return _mixture(frame(df, None, attributes), Table.of(df, attributes), attributes, inner.scores, len(inner.classes), least)


def memberships(df: DataFrame, model: Mixture, names: str = "pCluster") -> DataFrame:
    """The logarithm of each cluster's density at each row, as columns ``<names>_<i>``."""
    cells = F.struct(*[F.col(a) for a in model.attributes])

    @F.pandas_udf("array<double>")
    def logs(x: pd.DataFrame) -> pd.Series:
        return pd.Series([r.tolist() for r in model.logs(x)])

    held = free(df, "_logs")[0]
    return df.withColumn(held, logs(cells)).withColumns({f"{names}_{i}": F.get(held, F.lit(i)) for i in range(len(model.classes))}).drop(held)


def filtered_clusterer(df: DataFrame, step, cluster: Callable[[DataFrame], Model]):
    """A clusterer on filtered rows: ``(apply, model)``; the filter is fitted on these rows."""
    apply = step.fit(df) if hasattr(step, "fit") else step
    return apply, cluster(apply(df))


def add_cluster(df: DataFrame, model: Model, name: str = "cluster") -> DataFrame:
    return model.transform(df, name, None)


# Density -------------------------------------------------------------------------------------


def near_pairs(df: DataFrame, key: str, columns: list[str], eps: float) -> DataFrame:
    """``a, b, distance`` of all rows closer than ``eps`` by range-scaled numbers, each pair both ways and no row with itself.

    Rows meet in cells as wide as ``eps`` over at most three of the columns: each goes to its own cell and the
    neighbouring ones, so that no row is paired with one that is farther in them.
    """
    m = df.agg(*[x for c in columns for x in (F.min(c).cast("double").alias(f"a_{c}"), F.max(c).cast("double").alias(f"b_{c}"), F.avg(c).alias(f"m_{c}"))]).first()
    unit = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(m[f"m_{c}"])) - m[f"a_{c}"]) / ((m[f"b_{c}"] - m[f"a_{c}"]) or 1.0)
    rows = df.select(F.col(key).alias("k"), F.array(*[unit(c) for c in columns]).alias("x"))
    width = min(3, len(columns))
    cell = [F.floor(F.get("x", F.lit(i)) / eps).cast("int") for i in range(width)]
    own = rows.withColumn("cell", F.array(*cell))
    steps = [[]]
    for _ in range(width):
        steps = [[*s, d] for s in steps for d in (-1, 0, 1)]
    around = F.array(*[F.array(*[F.get("cell", F.lit(i)) + d for i, d in enumerate(s)]) for s in steps])
    left = own.select(F.col("k").alias("a"), F.col("x").alias("u"), "cell")
    right = own.select(F.col("k").alias("b"), F.col("x").alias("v"), F.explode(around).alias("cell"))
    d = F.sqrt(F.aggregate(F.zip_with("u", "v", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))
    return left.join(right, "cell").where("a <> b").select("a", "b", d.alias("distance")).where(F.col("distance") <= eps)


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float = 0.9, least: int = 6) -> DataFrame:
    """``key, cluster``: components of rows with at least ``least`` rows within ``eps``, themselves included, and the rows
    near one, which go to the nearest's; a cluster is named by its smallest core row, and noise has none."""
    pairs = stored(near_pairs(df, key, columns, eps), "near")
    core = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select(F.col("a").alias("k")), "core")
    if least <= 1:
        core = stored(df.select(F.col(key).alias("k")), "core")
    inner = pairs.join(core.withColumnRenamed("k", "a"), "a", "left_semi").join(core.withColumnRenamed("k", "b"), "b", "left_semi")
    found = components(inner.select("a", "b")) if inner.limit(1).count() else df.sparkSession.createDataFrame([], f"node {dict(df.dtypes)[key]}, component {dict(df.dtypes)[key]}")
    cores = core.join(found, core["k"] == found["node"], "left").select("k", F.coalesce("component", "k").alias("c"))
    edge = pairs.join(core.withColumnRenamed("k", "a"), "a", "left_anti").join(cores, pairs["b"] == cores["k"]).groupBy("a").agg(F.min(F.struct("distance", "c")).alias("m")).select(F.col("a").alias("k"), F.col("m.c").alias("c"))
    every = cores.unionAll(edge)
    named = every.toDF("_millrace_k", "_millrace_c")
    return df.select(key).join(named, F.col(key) == F.col("_millrace_k"), "left").select(key, F.col("_millrace_c").alias("cluster"))


def optics(df: DataFrame, key: str, columns: list[str], eps: float = 0.9, least: int = 6, most: int = 20_000) -> DataFrame:
    """``key, place, reachability, core``: rows in the order in which the densest way reaches them.

    The pairs within ``eps`` are found by Spark; the walk over them is one after the other by nature and is
    the driver's, for at most ``most`` rows.
    """
    import heapq

    keys = [r[0] for r in df.select(key).orderBy(key).limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} rows")
    near: dict = {k: [] for k in keys}
    for r in near_pairs(df, key, columns, eps).collect():
        near[r["a"]].append((r["distance"], r["b"]))
    core = {}
    for k in keys:
        near[k].sort()
        core[k] = 0.0 if least <= 1 else near[k][least - 2][0] if len(near[k]) >= least - 1 else None
    done, out = set(), []
    for k in keys:
        if k in done:
            continue
        heap, reach = [(math.inf, k)], {k: math.inf}
        while heap:
            d, x = heapq.heappop(heap)
            if x in done or d > reach[x]:
                continue
            done.add(x)
            out.append((x, len(out), None if math.isinf(d) else d, core[x]))
            if core[x] is not None:
                for e, y in near[x]:
                    r = max(core[x], e)
                    if y not in done and r < reach.get(y, math.inf):
                        reach[y] = r
                        heapq.heappush(heap, (r, y))
    return df.sparkSession.createDataFrame(out, f"{key} {dict(df.dtypes)[key]}, place long, reachability double, core double")


# Hierarchies and baskets ---------------------------------------------------------------------


class Concept:
    """A node of a concept hierarchy: sums of its rows."""

    def __init__(self, width: int, sizes: list[int]):
        self.n, self.sum, self.square = 0.0, np.zeros(width), np.zeros(width)
        self.counts, self.children, self.number = [np.zeros(s) for s in sizes], [], -1

    def add(self, v, c, times: float = 1.0) -> None:
        self.n += times
        self.sum += times * v
        self.square += times * v * v
        for i, k in enumerate(c):
            if k >= 0:
                self.counts[i][k] += times

    def absorb(self, other: Concept) -> None:
        self.n, self.sum, self.square = self.n + other.n, self.sum + other.sum, self.square + other.square
        self.counts = [a + b for a, b in zip(self.counts, other.counts)]

    def copy(self) -> Concept:
        new = Concept(len(self.sum), [len(c) for c in self.counts])
        new.absorb(self)
        new.children = self.children
        return new

    def score(self, acuity: float) -> float:
        if not self.n:
            return 0.0
        deviation = np.sqrt(np.maximum(self.square / self.n - (self.sum / self.n) ** 2, 0))
        return float((1 / (2 * math.sqrt(math.pi) * np.maximum(deviation, acuity))).sum() + sum(((c / self.n) ** 2).sum() for c in self.counts))


def _utility(node: Concept, children: list[Concept], acuity: float) -> float:
    return sum(c.n / node.n * (c.score(acuity) - node.score(acuity)) for c in children) / len(children)


class Concepts(Model):
    def __init__(self, root: Concept, table: Table, attributes, acuity: float):
        self.root, self.table, self.attributes, self.acuity = root, table, attributes, acuity
        leaves, open_ = [], [root]
        while open_:
            x = open_.pop(0)
            x.number = len(leaves)
            leaves.append(x)
            open_ += x.children
        self.classes = [str(i) for i in range(len(leaves))]

    def scores(self, x):
        v, c = np.nan_to_num(self.table.values(x)), self.table.codes(x)
        out = np.zeros((len(x), len(self.classes)))
        for i in range(len(x)):
            node = self.root
            while node.children:
                best = []
                for k, child in enumerate(node.children):
                    grown = child.copy()
                    grown.add(v[i], c[i])
                    best.append((grown.n * grown.score(self.acuity) - child.n * child.score(self.acuity), -k))
                node = node.children[-max(best)[1]]
            out[i, node.number] = 1
        return out


def cobweb(df: DataFrame, attributes: list[str], order: list[str], acuity: float = 1.0, cutoff: float = 0.0028, most: int = 20_000) -> Concepts:
    """A hierarchy that grows row by row: each goes to the child of the largest category utility, to a new one, or after two
    children are merged or one is split. It is sequential by nature; at most ``most`` rows."""
    held = df.orderBy(*order).select(*attributes).limit(most + 1).toPandas()
    if len(held) > most:
        raise ValueError(f"more than {most} rows")
    table = Table.of(df, attributes)
    v, c = np.nan_to_num(table.values(held)), table.codes(held)
    new = lambda: Concept(v.shape[1], table.sizes)

    def leaf(i: int) -> Concept:
        x = new()
        x.add(v[i], c[i])
        return x

    root = new()

    def insert(node: Concept, i: int) -> None:
        if not node.n:
            node.add(v[i], c[i])
            return
        if not node.children:
            old = node.copy()
            node.add(v[i], c[i])
            pair = [old, leaf(i)]
            if _utility(node, pair, acuity) >= cutoff:
                node.children = pair
            return
        node.add(v[i], c[i])
        kids, tried = node.children, []
        for k, child in enumerate(kids):
            grown = child.copy()
            grown.add(v[i], c[i])
            tried.append((_utility(node, [*kids[:k], grown, *kids[k + 1 :]], acuity), -k))
        tried.sort(reverse=True)
        best, at = tried[0][0], -tried[0][1]
        options = [(best, 0, "host"), (_utility(node, [*kids, leaf(i)], acuity), 1, "new")]
        if len(kids) > 2:
            second = -tried[1][1]
            merged = kids[at].copy()
            merged.absorb(kids[second])
            merged.children = [kids[at], kids[second]]
            grown = merged.copy()
            grown.add(v[i], c[i])
            options.append((_utility(node, [x for k, x in enumerate(kids) if k not in (at, second)] + [grown], acuity), -1, "merge"))
        if kids[at].children:
            options.append((_utility(node, [*[x for k, x in enumerate(kids) if k != at], *kids[at].children], acuity), -2, "split"))
        value, _, what = max(options)
        if value < cutoff:
            node.children = []
            return
        if what == "new":
            node.children = [*kids, leaf(i)]
        elif what == "merge":
            node.children = [x for k, x in enumerate(kids) if k not in (at, second)] + [merged]
            insert(merged, i)
        elif what == "split":
            node.children = [*[x for k, x in enumerate(kids) if k != at], *kids[at].children]
            node.n -= 1
            node.sum, node.square = node.sum - v[i], node.square - v[i] ** 2
            for j, k in enumerate(c[i]):
                if k >= 0:
                    node.counts[j][k] -= 1
            insert(node, i)
        else:
            insert(kids[at], i)

    for i in range(len(held)):
        insert(root, i)
    return Concepts(root, table, attributes, acuity)


def clope(df: DataFrame, key: str, items: str, repulsion: float = 2.0, rounds: int = 5, most: int = 100_000) -> DataFrame:
    """``key, cluster``: baskets go to the cluster whose histogram they make higher for its width, again until none moves.
    Sequential by nature; at most ``most`` baskets."""
    held = df.select(key, items).orderBy(key).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} baskets")
    counts: list[dict] = []
    sizes: list[float] = []
    members: list[int] = []

    def gain(k: int, basket, add: bool) -> float:
        n, s, w = members[k], sizes[k], len(counts[k])
        size = s + len(basket)
        width = w + sum(x not in counts[k] for x in basket)
        return size * (n + 1) / width**repulsion - (s * n / w**repulsion if w else 0.0)

    place: dict = {}
    for r in range(rounds):
        moved = False
        for row in held:
            basket = list(dict.fromkeys(row[items] or []))
            old = place.get(row[key])
            if not basket:
                continue
            if old is not None:
                for x in basket:
                    counts[old][x] -= 1
                    if not counts[old][x]:
                        del counts[old][x]
                sizes[old], members[old] = sizes[old] - len(basket), members[old] - 1
            options = [(gain(k, basket, True), -k) for k in range(len(counts)) if members[k]]
            fresh = len(basket) / len(basket) ** repulsion
            best = max(options) if options else (-math.inf, 0)
            k = -best[1] if best[0] >= fresh else next((j for j in range(len(counts)) if not members[j]), len(counts))
            if k == len(counts):
                counts.append({})
                sizes.append(0.0)
                members.append(0)
            for x in basket:
                counts[k][x] = counts[k].get(x, 0) + 1
            sizes[k], members[k] = sizes[k] + len(basket), members[k] + 1
            moved |= k != old
            place[row[key]] = k
        if not moved:
            break
    names = {k: i for i, k in enumerate(dict.fromkeys(place[r[key]] for r in held if r[key] in place))}
    return df.sparkSession.createDataFrame([(k, names[c]) for k, c in place.items()], f"{key} {dict(df.dtypes)[key]}, cluster int")


def information_bottleneck(df: DataFrame, key: str, columns: list[str], k: int, rounds: int = 20, seed: int = 1) -> Model:
    """Rows as distributions over columns, in the cluster that loses least information by taking them. All rows are moved
    at once, one pass a round, instead of one after the other."""
    rows = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    total = gather(rows, lambda t: [("s", t.to_numpy(float).sum(0))])["s"].sum()
    some = rows.where(sum((F.col(c) for c in columns), F.lit(0.0)) > 0).orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(500).toPandas().to_numpy(float)
    p = some / some.sum(1, keepdims=True)
    model = _Bottleneck(farthest(np.sqrt(p), k) ** 2 + 1e-9, np.full(k, 1 / k), columns, total)
    for _ in range(rounds):

        def add(t: pd.DataFrame, model=model):
            x = t.to_numpy(float)
            yield "s", model.scores(t).T @ x

        s = gather(rows, add)["s"]
        after = _Bottleneck((s + 1e-9) / (s + 1e-9).sum(1, keepdims=True), np.maximum(s.sum(1), 1e-9) / total, columns, total)
        if np.abs(after.p - model.p).max() < 1e-9:
            break
        model = after
    return model


class _Bottleneck(Model):
    def __init__(self, p, prior, columns, total):
        self.p, self.prior, self.attributes, self.total = p / p.sum(1, keepdims=True), prior, columns, total
        self.classes = [str(i) for i in range(len(p))]

    def scores(self, x):
        v = np.nan_to_num(x[self.attributes].to_numpy(float))
        n = v.sum(1)
        q = v / np.maximum(n, 1e-12)[:, None]
        w = n / self.total
        cost = np.zeros((len(x), len(self.p)))
        for k, (p, prior) in enumerate(zip(self.p, self.prior)):
            a, b = w / (w + prior), prior / (w + prior)
            m = a[:, None] * q + b[:, None] * p[None]
            kl = lambda u: np.where(u > 0, u * np.log2(np.maximum(u, 1e-300) / np.maximum(m, 1e-300)), 0).sum(1)  # noqa: B023, E731
            cost[:, k] = (w + prior) * (a * kl(q) + b * kl(np.repeat(p[None], len(q), 0)))
        return np.eye(len(self.p))[cost.argmin(1)]


def spectral(df: DataFrame, key: str, columns: list[str], k: int, gamma: float = 10.0, most: int = 2000) -> DataFrame:
    """``key, cluster`` by normalised cuts in two, each time of the part whose cut is cheapest; at most ``most`` rows."""
    held = df.select(key, *columns).orderBy(key).limit(most + 1).toPandas()
    if len(held) > most:
        raise ValueError(f"more than {most} rows")
    x = held[columns].to_numpy(float)
    x = (x - np.nanmin(x, 0)) / np.maximum(np.nanmax(x, 0) - np.nanmin(x, 0), 1e-12)
    x = np.where(np.isnan(x), np.nanmean(x, 0), x)
    s = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    parts = [np.arange(len(x))]

    def cut(rows: np.ndarray):
        if len(rows) < 2:
            return None
        w = s[np.ix_(rows, rows)]
        d = w.sum(1)
        values, vectors = np.linalg.eigh(np.eye(len(rows)) - w / np.sqrt(np.outer(d, d)))
        order = np.argsort(vectors[:, 1] / np.sqrt(d), kind="stable")
        best = None
        for i in range(1, len(rows)):
            a, b = order[:i], order[i:]
            between = w[np.ix_(a, b)].sum()
            value = between / d[a].sum() + between / d[b].sum()
            if best is None or value < best[0] - 1e-12:
                best = (value, rows[a], rows[b])
        return best

    while len(parts) < k:
        cuts = [(c[0], i, c) for i, p in enumerate(parts) if (c := cut(p)) is not None]
        if not cuts:
            break
        _, i, c = min(cuts, key=lambda t: t[:2])
        parts = [*parts[:i], c[1], c[2], *parts[i + 1 :]]
    parts = sorted(parts, key=min)
    return df.sparkSession.createDataFrame([(held[key].iloc[int(r)].item(), i) for i, p in enumerate(parts) for r in p], f"{key} {dict(df.dtypes)[key]}, cluster int")


# Constraints ---------------------------------------------------------------------------------


def seeded_centres(df: DataFrame, space: Space, key: str, labels: DataFrame) -> np.ndarray:
    """The means of the labelled rows ``key, label``, one a label in order."""
    rows = df.join(labels.select(key, F.col("label").cast("string").alias("_y")), key).select(*space.attributes, "_y")
    names = sorted(r[0] for r in labels.select(F.col("label").cast("string")).distinct().collect())
    s = gather(rows, lambda t: [("s", one_hot(t["_y"], names).T @ np.column_stack([np.ones(len(t)), space(t)]))])["s"]
    return s[:, 1:] / np.maximum(s[:, :1], 1)


def neighbourhood_centres(df: DataFrame, space: Space, key: str, links: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The means of must-link components, the farthest from one another by size, and rows of a sample for what is left."""
    closed = closed_links(links).select("component", F.explode("members").alias("_k"))
    rows = df.join(closed, df[key] == closed["_k"]).select(*space.attributes, F.col("component").cast("string").alias("_c"))

    def add(t: pd.DataFrame):
        z = space(t)
        for c in t["_c"].unique():
            here = (t["_c"] == c).to_numpy()
            yield c, np.concatenate([[here.sum()], z[here].sum(0)])

    found = sorted(gather(rows, add).values(), key=lambda a: -a[0])
    centres = [a[1:] / a[0] for a in found if a[0] > 1][: 4 * k]
    weights = [a[0] for a in found if a[0] > 1][: 4 * k]
    chosen = [0] if centres else []
    while chosen and len(chosen) < min(k, len(centres)):
        d = [min(((centres[i] - centres[j]) ** 2).sum() for j in chosen) * weights[i] if i not in chosen else -1 for i in range(len(centres))]
        chosen.append(int(np.argmax(d)))
    got = [centres[i] for i in chosen]
    if len(got) < k:
        z = space(sample_of(df, space.attributes, 500))
        for x in farthest(np.vstack([*got, z]) if got else z, k)[len(got) :]:
            got.append(x)
    return np.array(got[:k])


def _by_messages(d: np.ndarray, links: list[tuple], weight: float, rounds: int = 200, keep: float = 0.5) -> np.ndarray:
    """The cluster of least cost for each row by min-sum messages along the links: exact where links form no ring,
    else what the damped messages settle on within ``rounds``."""
    if not links:
        return d.argmin(1)
    a, b, link = (np.array(c) for c in zip(*links))
    source, to = np.concatenate([a, b]), np.concatenate([b, a])
    back = np.roll(np.arange(len(source)), len(a))
    must = np.concatenate([link, link])[:, None] == 1
    sent = np.zeros((len(source), d.shape[1]))
    for _ in range(rounds):
        total = d.copy()
        np.add.at(total, to, sent)
        own = total[source] - sent[back]
        ranked = np.sort(own, axis=1)
        low = ranked[:, :1]
        other = np.where(own == low, ranked[:, 1:2] if d.shape[1] > 1 else np.inf, low)
        new = np.where(must, np.minimum(own, low + weight), np.minimum(own + weight, other))
        new = keep * sent + (1 - keep) * (new - new.min(1, keepdims=True))
        if np.abs(new - sent).max() < 1e-9:
            break
        sent = new
    total = d.copy()
    np.add.at(total, to, sent)
    return total.argmin(1)


def _by_program(d: np.ndarray, links: list[tuple], weight: float, most: int = 4000) -> np.ndarray:
    """The clusters that rows have whole in the linear program whose whole-numbered solutions are the assignments; rows that it
    divides follow, the least divided first, each to the cluster of the least cost among the rows placed.

    A link costs ``weight`` by the part of the shares that breaks it, at each cluster. Solved by the simplex method from the
    nearest clusters on; a program of more than ``most`` rows, n plus k a link, raises ValueError.
    """
    n, k = d.shape
    if not links:
        return d.argmin(1)
    tied = np.unique([i for a, b, _ in links for i in (a, b)])
    at, row, near = d.argmin(1), {i: r for r, i in enumerate(tied.tolist())}, d[tied].argmin(1)
    size, shares, cells = len(tied), len(tied) * k, len(links) * k
    if size + cells > most:
        raise ValueError(f"{size + cells} rows are more than the {most} that a linear program may have")
    table, right = np.zeros((size + cells, shares + 2 * cells)), np.ones(size + cells)
    cost = np.concatenate([d[tied].ravel(), np.full(cells, weight), np.zeros(cells)])
    for r in range(size):
        table[r, r * k : (r + 1) * k] = 1
    basis = [r * k + int(near[r]) for r in range(size)]
    for e, (a, b, link) in enumerate(links):
        a, b, sign = row[a], row[b], -1 if link == 1 else 1
        for c in range(k):
            at_row, u = size + e * k + c, shares + e * k + c
            table[at_row, a * k + c], table[at_row, b * k + c] = 1, sign
            table[at_row, u], table[at_row, u + cells] = -1, 1
            right[at_row] = 0 if link == 1 else 1
            over = (near[a] == c) + sign * int(near[b] == c) - right[at_row]
            basis.append(u if over > 0 else u + cells)
    inverse = np.linalg.inv(table[:, basis])
    table, right = inverse @ table, inverse @ right
    price = cost - cost[basis] @ table
    for step in range(50 * len(basis)):
        enter = np.flatnonzero(price < -1e-9)
        if not len(enter):
            break
        # The steepest column; later on the first, which cannot run in a ring.
        c = int(enter[price[enter].argmin()] if step < 10 * len(basis) else enter[0])
        up = np.flatnonzero(table[:, c] > 1e-9)
        ratio = right[up] / table[up, c]
        r = int(min(up[ratio <= ratio.min() + 1e-12], key=lambda i: basis[i]))
        right[r], table[r] = right[r] / table[r, c], table[r] / table[r, c]
        part = table[:, c].copy()
        part[r] = 0
        right, table, price = right - part * right[r], table - np.outer(part, table[r]), price - price[c] * table[r]
        basis[r] = c
    share = np.zeros(shares + 2 * cells)
    share[basis] = right
    share = share[:shares].reshape(size, k)
    sure = np.round(share.max(1), 6)
    at[tied] = np.where(sure == 1, share.argmax(1), -1)
    for r in np.argsort(-sure, kind="stable").tolist():
        i = tied[r]
        if at[i] < 0:
            price = d[i].copy()
            for a, b, link in links:
                other = at[b] if a == i else at[a] if b == i else -1
                if other >= 0:
                    price += weight * (np.arange(k) != other if link == 1 else np.arange(k) == other)
            at[i] = price.argmin()
    return at


def _assign(z: np.ndarray, d: np.ndarray, keys: list, links: list[tuple], weight: float, order: str, seed: int) -> np.ndarray:
    """Rows one after the other to the cluster of the least distance and broken links, in order of rows (``simple``), by chance
    (``random``) or by distance (``sorted``); ``global`` sweeps until nothing changes from the nearest clusters on. All at once by
    messages along the links (``belief``) or a linear program (``program``)."""
    n, k = d.shape
    if order in ("belief", "program"):
        place = {x: i for i, x in enumerate(keys)}
        held = [(place[a], place[b], link) for a, b, link in links if a in place and b in place and a != b]
        return (_by_messages if order == "belief" else _by_program)(d, held, weight)
    must: dict = {}
    cannot: dict = {}
    place = {x: i for i, x in enumerate(keys)}
    for a, b, link in links:
        if a in place and b in place:
            held = must if link == 1 else cannot
            held.setdefault(place[a], []).append(place[b])
            held.setdefault(place[b], []).append(place[a])
    turn = np.arange(n)
    if order == "random":
        turn = np.random.default_rng(seed).permutation(n)
    elif order == "sorted":
        turn = np.argsort(d.min(1), kind="stable")
    at = d.argmin(1) if order == "global" else np.full(n, -1)
    for _ in range(20 if order == "global" else 1):
        moved = False
        for i in turn:
            cost = d[i].copy()
            for j in must.get(i, ()):
                if at[j] >= 0:
                    cost += weight
                    cost[at[j]] -= weight
            for j in cannot.get(i, ()):
                if at[j] >= 0:
                    cost[at[j]] += weight
            best = int(cost.argmin())
            moved |= best != at[i]
            at[i] = best
        if not moved:
            break
    return at


def constrained_k_means(df: DataFrame, key: str, attributes: list[str], links: DataFrame, k: int, weight: float = 1.0, order: str = "simple", metric: str = "none", rounds: int = 20, seed: int = 1, regular: str = "none", strength: float = 0.1) -> tuple[DataFrame, Centres]:
    """``key, cluster`` and the model: k-means that pays ``weight`` for each broken link.

    ``order``: see ``_assign``. Rows without links are assigned where they lie. Those with links are assigned together, since each
    depends on the others: they come to the driver, as many as the links name. ``metric``: none; ``euclidean``, a
    weight for each column from the scatter within clusters; ``mahalanobis``, a full matrix; ``gradient``, ``cosine`` or ``kl``, steps of
    descent. ``regular``: ``l1`` or ``rayleigh`` keeps the weights of descent small.
    """
    space = Space(df, attributes)
    rows = stored(df.select(key, *attributes), "constrained")
    named = links.select(F.col("a").alias("_k")).unionAll(links.select("b")).distinct()
    tied, loose = stored(rows.join(named, rows[key] == named["_k"], "left_semi"), "tied"), stored(rows.join(named, rows[key] == named["_k"], "left_anti"), "loose")
    pairs, few = [tuple(r) for r in links.select("a", "b", "link").collect()], tied.orderBy(key).toPandas()
    z, keys = space(few), few[key].tolist()
    model = Centres(space, neighbourhood_centres(df, space, key, links, k, seed), "cosine" if metric == "cosine" else "euclidean")
    before = None
    for _ in range(rounds):
        at = _assign(z, model.distances(z), keys, pairs, weight, order, seed) if len(keys) else np.zeros(0, int)

        def add(t: pd.DataFrame, model=model):
            x = space(t)
            near = model.distances(x).argmin(1)
            out = np.zeros((k, 1 + 2 * x.shape[1]))
            np.add.at(out, near, np.column_stack([np.ones(len(x)), x, x * x]))
            yield "s", out
            if metric == "mahalanobis":
                d = x - model.centres[near]
                yield "m", d.T @ d

        found = gather(loose.select(*attributes), add)
        width = z.shape[1]
        s = found.get("s", np.zeros((k, 1 + 2 * width))).copy()
        if len(keys):
            np.add.at(s, at, np.column_stack([np.ones(len(z)), z, z * z]))
        n = np.maximum(s[:, :1], 1e-12)
        centres = np.where(s[:, :1] > 0, s[:, 1 : 1 + width] / n, model.centres)
        scatter = (s[:, 1 + width :] - 2 * centres * s[:, 1 : 1 + width] + s[:, :1] * centres**2).sum(0)
        total = s[:, 0].sum()
        broken = np.zeros(width)
        place = {x: i for i, x in enumerate(keys)}
        for a, b, link in pairs:
            if a in place and b in place and ((at[place[a]] == at[place[b]]) != (link == 1)):
                gap = (z[place[a]] - z[place[b]]) ** 2
                broken += weight * (gap if link == 1 else np.maximum(1 - gap, 0))
        weights = model.weights
        if metric == "euclidean":
            weights = np.minimum(total / np.maximum(scatter + broken, 1e-6), 1e3)
            weights = weights * width / weights.sum()
        elif metric == "mahalanobis":
            m = found.get("m", np.zeros((width, width))) + (((z - centres[at]).T @ (z - centres[at])) if len(keys) else 0)
            weights = np.linalg.pinv(m / max(total, 1) + 1e-3 * np.eye(width))
            weights = weights * width / np.trace(weights)
        elif metric in ("gradient", "cosine", "kl"):
            slope = (scatter + broken) / max(total, 1)
            slope = slope / max(np.abs(slope).max(), 1e-12) - 1 / np.maximum(weights, 1e-3) / max((1 / np.maximum(weights, 1e-3)).max(), 1e-12)
            if regular == "l1":
                slope = slope + strength
            elif regular == "rayleigh":
                slope = slope - strength * (1 / np.maximum(weights, 1e-3) - weights)
            weights = np.clip(weights - 0.1 * slope, 1e-3, 1e3)
            weights = weights * width / weights.sum()
        model = Centres(space, centres, model.metric, weights)
        state = (at.tolist(), np.round(centres, 9).tolist())
        if state == before:
            break
        before = state
    rest = model.transform(loose, "cluster", None).select(key, F.col("cluster").cast("int").alias("cluster"))
    if not len(keys):
        return rest, model
    known = df.sparkSession.createDataFrame([(x.item() if hasattr(x, "item") else x, int(c)) for x, c in zip(keys, at)], f"{key} {dict(df.dtypes)[key]}, cluster int")
    return rest.unionByName(known), model


def broken_links(clusters: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """One row: how many must- and cannot-links a clustering breaks."""
    a, b = (clusters.select(F.col(key).alias(n), F.col("cluster").alias(f"c{n}")) for n in "ab")
    held = links.join(a, "a").join(b, "b")
    same = F.col("ca") == F.col("cb")
    return held.agg(F.count(F.when((F.col("link") == 1) & ~same, 1)).alias("must"), F.count(F.when((F.col("link") == -1) & same, 1)).alias("cannot"))


def certain(model: Model) -> Model:
    """All share on the likeliest cluster."""
    from millrace.learn.meta import Certain

    return Certain(model)


