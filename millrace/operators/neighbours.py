"""Cells for neighbour search: trees of balls or boxes, built on a bounded sample, that prune what is too far.

A splitter parts a node's points in two; the leaves are cells, and every row descends to one. The bounds
of the cells come from one aggregation over all rows, so that they hold whatever the sample was. A
target first looks at the cell with the least bound; the distance of its k-th neighbour there tells
which other cells it must look at. The result equals that of a search over all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.similarity import _ranges, best_of, coordinates, distances
from millrace.plans.storage import stored

Rule = tuple


def _widest(x: np.ndarray) -> int:
    return int(np.argmax(x.max(0) - x.min(0)))


def median_distance(x, box):
    """By the median distance from an arbitrary point, the first."""
    d = np.linalg.norm(x - x[0], axis=1)
    return ("point", x[0], float(np.median(d)))


def median_widest(x, box):
    """At the median of the widest dimension."""
    d = _widest(x)
    return ("side", d, float(np.median(x[:, d])))


def furthest_children(x, box):
    """To the closer of two points: the one farthest from the centre, and the one farthest from it."""
    a = x[np.argmax(np.linalg.norm(x - x.mean(0), axis=1))]
    return ("pair", a, x[np.argmax(np.linalg.norm(x - a, axis=1))])


def midpoint_widest(x, box):
    """At the middle of the widest dimension."""
    d = _widest(x)
    return ("side", d, float((x[:, d].min() + x[:, d].max()) / 2))


def sliding_midpoint(x, box):
    """At the middle of the box's widest side, slid to the nearest point where one half would be empty."""
    d = int(np.argmax(box[1] - box[0]))
    v, low, high = (box[0][d] + box[1][d]) / 2, x[:, d].min(), x[:, d].max()
    return ("side", d, float(min(max(v, low), np.nextafter(high, -np.inf))))


def least_spread(x, box):
    """Where the squared distances from the two halves' centres add up to least, in any dimension."""
    best = (np.inf, 0, 0.0)
    for d in range(x.shape[1]):
        order = np.argsort(x[:, d], kind="stable")
        y = x[order]
        n = np.arange(1, len(y))[:, None]
        s, q = np.cumsum(y, 0), np.cumsum(y**2, 0)
        cost = (q[:-1] - s[:-1] ** 2 / n).sum(1) + (q[-1] - q[:-1] - (s[-1] - s[:-1]) ** 2 / (len(y) - n)).sum(1)
        cost[y[1:, d] == y[:-1, d]] = np.inf
        if len(cost) and cost.min() < best[0]:
            k = int(cost.argmin())
            best = (cost[k], d, (y[k, d] + y[k + 1, d]) / 2)
    return ("side", best[1], float(best[2]))


SPLITTERS = {f.__name__: f for f in (median_distance, median_widest, furthest_children, midpoint_widest, sliding_midpoint, least_spread)}


def _first(rule: Rule, x: np.ndarray) -> np.ndarray:
    """Which points go to the first half."""
    kind, a, b = rule
    if kind == "side":
        return x[:, a] <= b
    if kind == "point":
        return np.linalg.norm(x - a, axis=1) <= b
    return np.linalg.norm(x - a, axis=1) <= np.linalg.norm(x - b, axis=1)


def top_down(x: np.ndarray, leaf: int, split) -> list:
    """Nodes ``(rule, first, second)``, or None for a leaf, from the root on."""
    nodes: list = []

    def build(x, box):
        at = len(nodes)
        nodes.append(None)
        if len(x) > leaf and (x.max(0) > x.min(0)).any():
            rule = split(x, box)
            first = _first(rule, x)
            if first.any() and not first.all():
                low, high = (box[0].copy(), box[1].copy()), (box[0].copy(), box[1].copy())
                if rule[0] == "side":
                    low[1][rule[1]] = high[0][rule[1]] = rule[2]
                nodes[at] = (rule, build(x[first], low), build(x[~first], high))
        return at

    if len(x):
        build(x, (x.min(0), x.max(0)))
    return nodes


def middle_out(x: np.ndarray, leaf: int) -> np.ndarray:
    """Anchors: each next one is the point farthest from all before; every point belongs to its nearest."""
    chosen, d = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < -(-len(x) // leaf) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def bottom_up(x: np.ndarray, leaf: int, start: int = 256) -> np.ndarray:
    """Centres of balls that are merged two by two, the pair with the smallest joint ball first."""
    centres = [(x[i], 1, 0.0) for i in np.linspace(0, len(x) - 1, min(start, len(x))).astype(int)]
    while len(centres) > max(1, -(-len(x) // leaf)):
        c, r = np.array([b[0] for b in centres]), np.array([b[2] for b in centres])
        joint = np.linalg.norm(c[:, None] - c[None], axis=2) + r[:, None] + r[None]
        np.fill_diagonal(joint, np.inf)
        i, j = np.unravel_index(joint.argmin(), joint.shape)
        (a, n, _), (b, m, _) = centres[i], centres[j]
        merged = ((a * n + b * m) / (n + m), n + m, float(joint[i, j] / 2))
        centres = [v for k, v in enumerate(centres) if k not in (i, j)] + [merged]
    return np.array([b[0] for b in centres])


class Index:
    """``construct``: top_down, middle_out or bottom_up; ``split``, for top_down, one of ``SPLITTERS``; ``shape`` of
    the cells' bounds: ball or box. The sample of ``sample_rows`` shapes the cells alone."""

    def __init__(self, construct: str = "top_down", split: str = "median_widest", shape: str = "ball", leaf: int = 64, sample_rows: int = 4096):
        self.construct, self.split, self.shape, self.leaf, self.sample_rows = construct, SPLITTERS[split], shape, leaf, sample_rows

    def fit(self, rows: DataFrame, width: np.ndarray) -> Cells:
        names = rows.columns[1:]
        sample = coordinates(rows.orderBy(F.xxhash64(*names), *names).limit(self.sample_rows).toArrow()) / width
        nodes, centres = [], np.zeros((0, len(names)))
        if len(sample):
            if self.construct == "top_down":
                nodes = top_down(sample, self.leaf, self.split)
            else:
                centres = (middle_out if self.construct == "middle_out" else bottom_up)(sample, self.leaf)
        return Cells(rows, width, nodes, centres, self.shape)


def _descend(x: np.ndarray, nodes: list, centres: np.ndarray) -> np.ndarray:
    if len(centres):
        return ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    at = np.zeros(len(x), np.int64)
    for k, node in enumerate(nodes):
        if node is not None:
            here = np.flatnonzero(at == k)
            first = _first(node[0], x[here])
            at[here[first]], at[here[~first]] = node[1], node[2]
    return at


class Cells:
    """Rows by cell, and the cells' bounds."""

    def __init__(self, rows: DataFrame, width: np.ndarray, nodes: list, centres: np.ndarray, shape: str):
        names = rows.columns[1:]
        self.width, self.shape = width, shape

        def place(batches):
            for batch in batches:
                at = _descend(coordinates(batch) / width, nodes, centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "cell"])

        kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
        self.rows = stored(rows.mapInArrow(place, f"{kinds}, cell long"), "cells")
        bounds = self.rows.groupBy("cell").agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).orderBy("cell").collect()  # one row a cell
        self.cells = np.array([r["cell"] for r in bounds], np.int64)
        self.low = np.array([[r[f"min_{n}"] for n in names] for r in bounds]).reshape(len(bounds), -1) / width
        self.high = np.array([[r[f"max_{n}"] for n in names] for r in bounds]).reshape(len(bounds), -1) / width
        self.centre = (self.low + self.high) / 2
        far = F.sqrt(sum((F.pow((F.col(n) / float(w)) - F.get(F.array(*[F.lit(float(v)) for v in self.centre[:, i]]), F.col("k")), 2) for i, (n, w) in enumerate(zip(names, width))), F.lit(0.0)))
        radius = {}
        if len(bounds):
            spot = F.array_position(F.array(*[F.lit(int(c)) for c in self.cells]), F.col("cell")) - 1
            radius = {r["cell"]: r["r"] for r in self.rows.withColumn("k", spot.cast("int")).groupBy("cell").agg(F.max(far).alias("r")).collect()}
        self.radius = np.array([radius[c] for c in self.cells.tolist()])

    def bounds(self, t: np.ndarray) -> np.ndarray:
        """The least distance that a row of each cell can have from each target."""
        if self.shape == "ball":
            return np.maximum(np.sqrt(((t[:, None] - self.centre[None]) ** 2).sum(2)) - self.radius[None], 0)
        off = np.maximum(np.maximum(self.low[None] - t[:, None], t[:, None] - self.high[None]), 0)
        return np.sqrt((off**2).sum(2))

    def _visit(self, targets: pa.Table, at: list[np.ndarray], k: int, schema: str) -> DataFrame:
        """The best pairs of each target with the rows of its cells; ``at`` has the targets of each cell."""
        asked = {int(c): i for c, i in zip(self.cells, at) if len(i)}
        width, names = self.width, targets.column_names

        def run(batches):
            for batch in batches:
                cell = np.asarray(batch.column(batch.num_columns - 1))
                for c in np.unique(cell).tolist():
                    if c in asked:
                        some = batch.select([i for i in range(batch.num_columns - 1)]).take(pa.array(np.flatnonzero(cell == c)))
                        mine = targets.take(pa.array(asked[c])).select(names)
                        yield from best_of(mine, width, k)([some])

        return self.rows.where(F.col("cell").isin(list(asked))).mapInArrow(run, schema)

    def search(self, targets: pa.Table, k: int, schema: str) -> DataFrame:
        t = coordinates(targets) / self.width
        if not len(self.cells) or not len(t):
            return self.rows.sparkSession.createDataFrame([], schema)
        bound = self.bounds(t)
        home = bound.argmin(1)
        near = stored(self._visit(targets, [np.flatnonzero(home == c) for c in range(len(self.cells))], k, schema), "near")
        kth = near.groupBy("target").agg(F.sort_array(F.collect_list("distance")).alias("d")).select("target", F.get("d", F.lit(k - 1)).alias("r"))
        reach = {r["target"]: r["r"] for r in kth.collect()}  # at most as many rows as targets
        limit = np.array([reach.get(n) if reach.get(n) is not None else np.inf for n in targets.column("target").to_pylist()])
        more = bound <= limit[:, None] * (1 + 1e-9) + 1e-12
        more[np.arange(len(t)), home] = False
        return near.unionAll(self._visit(targets, [np.flatnonzero(more[:, c]) for c in range(len(self.cells))], k, schema))


def _halves(x, box):
    """At the median of the widest dimension, or below the greatest value where that is the median: both halves have rows."""
    d = _widest(x)
    v = float(np.median(x[:, d]))
    return ("side", d, v if v < x[:, d].max() else float(x[x[:, d] < x[:, d].max(), d].max()))


def _cell_of(x: np.ndarray, nodes: list) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    waiting = [(0, np.arange(len(x)))]
    while waiting:
        k, here = waiting.pop()
        if not len(here) or not nodes or nodes[k] is None:
            out[here] = k
            continue
        rule, a, b = nodes[k]
        first = _first(rule, x[here])
        waiting += [(a, here[first]), (b, here[~first])]
    return out


def _best(t: np.ndarray, x: np.ndarray, ids: list, k: int, own: bool):
    """Of each target the ``k`` first ``(distance, id)`` of points with some ids each, and the distance of the ``k``-th point.
    ``own``: targets are the points, and not their own neighbours."""
    sizes = np.array([len(i) for i in ids], np.int64)
    codes, names = pd.factorize(np.concatenate(ids) if len(ids) else np.zeros(0), sort=True)
    start, near, who, reach = np.cumsum(sizes) - sizes, [], [], np.full(len(t), np.inf)
    for a in range(0, len(t), 256):
        d = distances(t[a : a + 256], x, np.ones(t.shape[1]))
        n = np.arange(len(d))
        if own:
            d[n, a + n] = np.inf
        if k <= d.shape[1]:
            reach[a : a + 256] = np.partition(d, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(np.isfinite(d) & (d <= reach[a : a + 256, None] + 1e-9))
        times = sizes[j]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        code, far, of = codes[np.repeat(start[j], times) + within], np.repeat(d[i, j].round(9), times), np.repeat(i, times)
        order = np.lexsort((code, far, of))
        code, far, of = code[order], far[order], of[order]
        first = np.searchsorted(of, n)
        keep = np.arange(len(of)) - first[of] < k
        code, far, ends = code[keep], far[keep], np.searchsorted(of[keep], np.arange(len(d) + 1))
        near += [far[p:q].tolist() for p, q in zip(ends, ends[1:])]
        who += [names[code[p:q]].tolist() for p, q in zip(ends, ends[1:])]
    return near, who, reach


#: Points that shape the cells of ``all_nearest``.
MOST_SHAPING = 200_000


def all_nearest(rows: DataFrame, columns: list[str], k: int, key: str, leaf: int = 512) -> DataFrame:
    """``target, near``: for every row the keys of its ``k`` nearest other rows, the first by distance to nine places and key.

    Distances are Euclidean over columns divided by their ranges; a row with a missing cell has none and is none's.
    Equal rows are searched for once, with the first ``k + 1`` of their keys. Points lie in boxes of about ``leaf``, shaped
    by a bounded sample; each is compared with its own box and then with those that its ``k``-th distance reaches. No table
    comes to one task, and a box is compared with few others unless the columns are many.
    """
    kind, names = dict(rows.dtypes)[key], [f"x{i}" for i in range(len(columns))]
    ends = _ranges(rows, columns)
    width = np.array([(ends[f"{c}|b"] or 0) - (ends[f"{c}|a"] or 0) or 1.0 for c in columns], float)
    held = rows.select(F.col(key).alias("id"), *[(F.col(c).cast("double") / float(w)).alias(x) for c, w, x in zip(columns, width, names)]).na.drop(subset=names)
    place = F.row_number().over(Window.partitionBy(*names).orderBy("id"))
    firsts = held.withColumn("place", place).where(F.col("place") <= k + 1)
    points = stored(firsts.groupBy(*names).agg(F.array_sort(F.collect_list("id")).alias("ids")), "points")
    n = points.count()
    sample = points.where(F.pmod(F.xxhash64(*names), F.lit(max(n, 1))) < MOST_SHAPING).select("ids", *names)
    x = coordinates(sample.toArrow())
    nodes = top_down(x, max(1, int(leaf * min(1.0, len(x) / max(n, 1)))), _halves)

    def settle(batches):
        for batch in batches:
            at = _cell_of(coordinates(pa.table([batch.column(0), *batch.columns[:-1]], ["", *names])), nodes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "cell"])

    fields = ", ".join(f"{x} double" for x in names)
    homes = stored(points.mapInArrow(settle, f"{fields}, ids array<{kind}>, cell long"), "homes")
    boxes = homes.groupBy("cell").agg(*[f(x) for f in (F.min, F.max) for x in names]).orderBy("cell").toPandas().to_numpy(float)  # one row a cell
    cells, low, high = boxes[:, 0].astype(np.int64), boxes[:, 1 : 1 + len(names)], boxes[:, 1 + len(names) :]

    def at_home(t: pd.DataFrame) -> pd.DataFrame:
        x, me = t[names].to_numpy(float), int(np.searchsorted(cells, t["cell"].iloc[0]))
        near, who, reach = _best(x, x, t["ids"].tolist(), k, True)
        search = np.array([len(i) <= k for i in t["ids"]])  # others are near enough to themselves
        limit = np.where(search, reach * (1 + 1e-9) + 1e-8, -1)
        off = np.maximum(np.maximum(low - high[me], low[me] - high), 0)
        maybe = np.flatnonzero(np.sqrt((off**2).sum(1)) <= limit.max(initial=-1))
        maybe = maybe[maybe != me]
        visit = [[] for _ in range(len(t))]
        for c in maybe:
            off = np.maximum(np.maximum(low[c] - x, x - high[c]), 0)
            for i in np.flatnonzero(np.sqrt((off**2).sum(1)) <= limit):
                visit[i].append(int(cells[c]))
        return t.drop(columns="cell").assign(near=near, who=who, visit=visit, first=[i[0] for i in t["ids"]])

    lists = f"near array<double>, who array<{kind}>"
    home = stored(homes.groupBy("cell").applyInPandas(at_home, f"{fields}, ids array<{kind}>, {lists}, visit array<long>, first {kind}"), "home")

    def on_visit(t: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(there):
            return pd.DataFrame({"first": [], "near": [], "who": []}, dtype=object)
        near, who, _ = _best(t[names].to_numpy(float), there[names].to_numpy(float), there["ids"].tolist(), k, False)
        return pd.DataFrame({"first": t["first"], "near": near, "who": who})

    visits = home.select("first", *names, F.explode("visit").alias("cell"))
    away = visits.groupBy("cell").cogroup(homes.groupBy("cell")).applyInPandas(on_visit, f"first {kind}, {lists}")
    pairs = F.arrays_zip("near", "who")
    found = home.select("first", pairs.alias("p")).unionAll(away.select("first", pairs.alias("p")))
    found = found.groupBy("first").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
    found = found.join(home.select("first", "ids"), "first").select("first", F.concat(F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("near"), i.alias("who"))), "p").alias("p"))
    every = held.join(points.select(*names, F.get("ids", F.lit(0)).alias("first")), names).select(F.col("id").alias("target"), "first")
    ranked = F.array_sort(F.filter("p", lambda p: p["who"] != F.col("target")))
    return every.join(found, "first").select("target", F.transform(F.slice(ranked, 1, k), lambda p: p["who"]).alias("near"))
