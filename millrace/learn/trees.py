"""Trees from histograms, level by level over all rows, and locally where a node has become small.

Attributes become codes: a nominal one the place of its value, a number how many of its cuts lie below it.
Cuts are the middles between distinct values where there are at most ``bins`` of them, else quantiles.
Rows that are equal are kept once, with their number in ``_n``. Each pass adds up, for the open nodes of all trees at once, the classes (or the sums of the target) by
attribute and code; the driver chooses splits from them. A node of at most ``local_rows`` rows is finished
by the task that gets them, from the same histograms by the same rule. A row without a value goes down
the heaviest branch in fitting; a scored one goes down all, by their weights.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.special import normal_inverse
from millrace.learn.base import Model, Table, class_values, frame, gather, normalised, one_hot
from millrace.plans.storage import discard, stored


@dataclass
class Rule:
    """How a tree grows. ``criterion``: gain, ratio, or variance for numbers. ``many``: nominal attributes part into all
    their values, else into one against the rest. ``take``: attributes drawn at each node, 0 for all."""

    criterion: str = "gain"
    many: bool = True
    least: float = 2.0
    depth: int = 30
    take: int = 0
    seed: int = 1
    correct: bool = False  # the gain of a number pays for the choice of its cut
    average: bool = False  # only attributes of at least average gain are compared by ratio


@dataclass
class Node:
    dist: np.ndarray  # class weights, or (weight, sum, sum of squares)
    attribute: int = -1
    kind: str = ""
    value: int = 0
    children: list = field(default_factory=list)
    shares: np.ndarray | None = None
    state: str = "open"  # open, leaf, or local: finished by a task
    model: object = None


def _entropy(n: np.ndarray) -> np.ndarray:
    """Of the last axis, times its sum."""
    total = n.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, total * np.log2(np.where(total > 0, total, 1)), 0) - np.where(n > 0, n * np.log2(np.where(n > 0, n, 1)), 0).sum(-1)


def impurity(n: np.ndarray, criterion: str) -> np.ndarray:
    """Entropy times weight, or the squared deviation."""
    if criterion == "variance":
        w = n[..., 0]
        return n[..., 2] - np.where(w > 0, n[..., 1] ** 2 / np.where(w > 0, w, 1), 0)
    return _entropy(n)


def mass(n: np.ndarray, criterion: str) -> np.ndarray:
    return n[..., 0] if criterion == "variance" else n.sum(-1)


def _splits(hist: np.ndarray, numeric: bool, rule: Rule):
    """``(kind, value, branches)`` of an attribute; branches are sums by code, missing cells left out."""
    if numeric:
        upto = np.cumsum(hist, 0)
        for cut in np.flatnonzero(mass(hist, rule.criterion)[:-1] > 0):
            yield "cut", int(cut), np.stack([upto[cut], upto[-1] - upto[cut]])
    elif rule.many:
        yield "many", 0, hist
    else:
        for v in np.flatnonzero(mass(hist, rule.criterion) > 0):
            yield "is", int(v), np.stack([hist[v], hist.sum(0) - hist[v]])


def best_split(hists: list[np.ndarray], numeric: list[bool], rule: Rule, allowed: list[int]):
    """The best ``(attribute, kind, value, branches)`` or None: ties go to the first."""
    found = []
    for a in allowed:
        hist = hists[a]
        known = mass(hist.sum(0), rule.criterion)
        if known <= 0:
            continue
        best, tried = None, 0
        for kind, value, parts in _splits(hist, numeric[a], rule):
            w = mass(parts, rule.criterion)
            if (w >= rule.least).sum() < 2:
                continue
            tried += 1
            gain = impurity(hist.sum(0), rule.criterion) - impurity(parts, rule.criterion).sum()
            if best is None or gain > best[0] + 1e-9:
                best = (gain, kind, value, parts)
        if best is None:
            continue
        gain, kind, value, parts = best
        gain = gain / known if rule.criterion != "variance" else gain
        if rule.correct and numeric[a]:
            gain -= np.log2(max(tried, 1)) / known
        if gain > 1e-9:
            w = mass(parts, rule.criterion)
            info = _entropy(w) / w.sum()
            found.append((gain, gain / info if info > 1e-9 else 0.0, a, kind, value, parts))
    if not found:
        return None
    if rule.criterion == "ratio":
        mean = np.mean([f[0] for f in found])
        found = [f for f in found if f[0] >= mean - 1e-3] if rule.average else found
        return max(found, key=lambda f: (round(f[1], 9), -f[2]))[2:]
    return max(found, key=lambda f: (round(f[0], 9), -f[2]))[2:]


def _histograms(codes: np.ndarray, value: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Of each attribute the sums of ``value`` rows by code; missing cells, of code -1, are left out."""
    out = []
    for a, size in enumerate(sizes):
        known = codes[:, a] >= 0
        h = np.zeros((size, value.shape[1]))
        np.add.at(h, codes[known, a], value[known])
        out.append(h)
    return out


def branch(codes: np.ndarray, node: Node) -> np.ndarray:
    """Where rows go; -1 for those without a value."""
    c = codes[:, node.attribute]
    if node.kind == "cut":
        to = (c > node.value).astype(int)
    elif node.kind == "is":
        to = (c != node.value).astype(int)
    else:
        to = np.where(c < len(node.children), c, -1)
    return np.where(c < 0, -1, to)


def _split(node: Node, found, rule: Rule) -> None:
    node.attribute, node.kind, node.value, parts = found
    w = mass(parts, rule.criterion)
    node.shares, node.state = w / w.sum(), "split"
    parts = parts.copy()
    parts[int(np.argmax(node.shares))] += node.dist - parts.sum(0)  # the rows without a value
    node.children = [Node(p.copy()) if m > 0 else Node(node.dist * 0 + (node.dist / max(mass(node.dist, rule.criterion), 1e-12)) * 1e-9, state="leaf") for p, m in zip(parts, w)]


def _may_split(node: Node, depth: int, rule: Rule) -> bool:
    return depth < rule.depth and mass(node.dist, rule.criterion) >= 2 * rule.least and impurity(node.dist, rule.criterion) > 1e-9


def _allowed(path: str, seed: int, count: int, rule: Rule) -> list[int]:
    if not rule.take or rule.take >= count:
        return list(range(count))
    rng = np.random.default_rng([rule.seed, seed, *path.encode()])
    return sorted(rng.choice(count, rule.take, replace=False).tolist())


def grow_local(codes: np.ndarray, value: np.ndarray, sizes: list[int], numeric: list[bool], rule: Rule, path: str = "", depth: int = 0, seed: int = 0) -> Node:
    node = Node(value.sum(0))
    found = best_split(_histograms(codes, value, sizes), numeric, rule, _allowed(path, seed, len(sizes), rule)) if _may_split(node, depth, rule) else None
    if found is None:
        node.state = "leaf"
        return node
    _split(node, found, rule)
    to = branch(codes, node)
    to = np.where(to < 0, int(np.argmax(node.shares)), to)
    for i, child in enumerate(node.children):
        if child.state != "leaf":
            here = to == i
            node.children[i] = grow_local(codes[here], value[here], sizes, numeric, rule, f"{path}.{i}", depth + 1, seed)
    return node


def nodes_of(root: Node, path: str = ""):
    yield path, root
    for i, c in enumerate(root.children):
        yield from nodes_of(c, f"{path}.{i}")


def place(root: Node, codes: np.ndarray) -> np.ndarray:
    """The path of the open or last node that each row reaches."""
    out = np.full(len(codes), "", object)

    def walk(node: Node, rows: np.ndarray, path: str) -> None:
        if not node.children:
            out[rows] = path
            return
        to = branch(codes[rows], node)
        to = np.where(to < 0, int(np.argmax(node.shares)), to)
        for i, c in enumerate(node.children):
            walk(c, rows[to == i], f"{path}.{i}")

    walk(root, np.arange(len(codes)), "")
    return out


@dataclass
class Coding:
    """Codes of a table's attributes."""

    table: Table
    cuts: list[np.ndarray]

    def codes(self, x: pd.DataFrame) -> np.ndarray:
        v = self.table.values(x)
        made = [np.where(np.isnan(v[:, i]), -1, np.searchsorted(c, v[:, i], "left")) for i, c in enumerate(self.cuts)]
        return np.column_stack([np.zeros((len(x), 0), np.int64), *made, self.table.codes(x)]).astype(np.int64)

    @property
    def sizes(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts] + [max(s, 1) for s in self.table.sizes]

    @property
    def numeric(self) -> list[bool]:
        return [True] * len(self.cuts) + [False] * len(self.table.domains)


def coding(df: DataFrame, attributes: list[str], bins: int = 256) -> Coding:
    table, cuts = Table.of(df, attributes), []
    for a in table.numbers:
        values = [r[0] for r in df.where(F.col(a).isNotNull()).select(F.col(a).cast("double").alias("v")).distinct().orderBy("v").limit(bins + 1).collect()]
        if len(values) > bins:
            q = df.agg(F.percentile_approx(F.col(a).cast("double"), [i / bins for i in range(1, bins)], 10_000).alias("q")).first()["q"]
            values = sorted(set(q))
            cuts.append(np.array(values))
        else:
            cuts.append((np.array(values[:-1]) + np.array(values[1:])) / 2)
    return Coding(table, cuts)


def grow(rows: DataFrame, c: Coding, value_of, width: int, rule: Rule, trees: int = 1, local_rows: int = 20_000, drawn=None) -> list[Node]:
    """Trees over ``rows``. ``value_of(table)`` gives what a row adds to a histogram (``width`` numbers), ``_n`` times where there is
    that column; ``drawn(table, tree)`` how often each row counts in each tree, ``_n`` times without."""
    sizes, numeric, width_all = c.sizes, c.numeric, sum(c.sizes) * width
    roots: list[Node | None] = [None] * trees

    def load(t: pd.DataFrame, k: int):
        return c.codes(t), value_of(t if drawn is None else t.assign(_n=drawn(t, k)))

    def sums(t: pd.DataFrame):
        for k in range(trees):
            value = load(t, k)[1]
            yield str(k), value.sum(0)
            yield f"n{k}", np.array([float((value != 0).any(1).sum() if drawn is not None else len(t))])

    first = gather(rows, sums)
    sent: dict[tuple[int, str], float] = {}
    for k in range(trees):
        roots[k] = Node(first.get(str(k), np.zeros(width)))
        sent[k, ""] = float(first.get(f"n{k}", np.zeros(1))[0])
    while True:
        open_ = [(k, p, n) for k, r in enumerate(roots) for p, n in nodes_of(r) if n.state == "open"]
        for _, p, n in open_:
            if not _may_split(n, p.count("."), rule):
                n.state = "leaf"
            elif sent.get((_, p), np.inf) <= local_rows:
                n.state = "local"
        wide = [(k, p) for k, p, n in open_ if n.state == "open"][: max(1, 200_000_000 // (8 * max(width_all, 1)))]
        if not wide:
            break
        wanted = set(wide)

        def count(t: pd.DataFrame, wanted=wanted):
            for k in {k for k, _ in wanted}:
                codes, value = load(t, k)
                at = place(roots[k], codes)
                for p in set(at.tolist()):
                    if (k, p) in wanted:
                        here = at == p
                        hists = _histograms(codes[here], value[here], sizes)
                        yield f"{k}|{p}", np.concatenate([*[h.ravel() for h in hists], [float(here.sum())]])

        found = gather(rows, count)
        for k, p in wide:
            node = next(n for q, n in nodes_of(roots[k]) if q == p)
            flat, hists, at = found.get(f"{k}|{p}"), [], 0
            if flat is None:
                node.state = "leaf"
                continue
            for s in sizes:
                hists.append(flat[at : at + s * width].reshape(s, width))
                at += s * width
            best = best_split(hists, numeric, rule, _allowed(p, k, len(sizes), rule))
            if best is None:
                node.state = "leaf"
                continue
            _split(node, best, rule)
            total = max(mass(node.dist, rule.criterion), 1e-12)
            for i, child in enumerate(node.children):
                sent[k, f"{p}.{i}"] = flat[-1] * (mass(child.dist, rule.criterion) / total) * 1.5 + 1
    waiting = {(k, p) for k, r in enumerate(roots) for p, n in nodes_of(r) if n.state == "local"}
    if waiting:

        def deal(tables):
            for t in tables:
                for k in {k for k, _ in waiting}:
                    codes, value = load(t, k)
                    at = place(roots[k], codes)
                    keep = np.array([(k, p) in waiting for p in at]) & ((value != 0).any(1) if drawn is not None else True)
                    if keep.any():
                        yield pd.DataFrame({"k": k, "p": at[keep].astype(str), "codes": [r.tobytes() for r in codes[keep]], "value": [r.tobytes() for r in np.ascontiguousarray(value[keep])]})

        def finish(t: pd.DataFrame) -> pd.DataFrame:
            t = t.sort_values(["codes", "value"])
            codes = np.frombuffer(b"".join(t["codes"]), np.int64).reshape(len(t), -1)
            value = np.frombuffer(b"".join(t["value"])).reshape(len(t), -1)
            k, p = int(t["k"].iloc[0]), t["p"].iloc[0]
            return pd.DataFrame({"k": [k], "p": [p], "tree": [pickle.dumps(grow_local(codes, value, sizes, numeric, rule, p, p.count("."), k))]})

        dealt = rows.mapInPandas(deal, "k int, p string, codes binary, value binary")
        for r in dealt.groupBy("k", "p").applyInPandas(finish, "k int, p string, tree binary").collect():  # one row a small node
            _replace(roots, r["k"], r["p"], pickle.loads(bytes(r["tree"])))
    return roots


def _replace(roots: list, k: int, path: str, node: Node) -> None:
    if not path:
        roots[k] = node
        return
    steps = [int(s) for s in path[1:].split(".")]
    at = roots[k]
    for s in steps[:-1]:
        at = at.children[s]
    at.children[steps[-1]] = node


# Pruning -------------------------------------------------------------------------------------


def _leaf(node: Node) -> None:
    node.children, node.state, node.attribute = [], "leaf", -1


def added_errors(n: float, e: float, confidence: float) -> float:
    """How many errors more than seen are likely at most, by the upper bound of a binomial share."""
    if confidence > 0.5:
        return 0.0
    if e < 1:
        base = n * (1 - confidence ** (1 / n))
        return base if e == 0 else base + e * (added_errors(n, 1.0, confidence) - base)
    if e + 0.5 >= n:
        return max(n - e, 0.0)
    z = normal_inverse(1 - confidence)
    f = (e + 0.5) / n
    r = (f + z * z / (2 * n) + z * (f / n - f * f / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
    return r * n - e


def prune_by_bound(node: Node, confidence: float) -> float:
    """Replaces subtrees that are not likely to err less than a leaf; returns the errors that are likely."""
    n = node.dist.sum()
    e = n - node.dist.max()
    own = e + added_errors(n, e, confidence) if n > 0 else 0.0
    if not node.children:
        return own
    below = sum(prune_by_bound(c, confidence) for c in node.children)
    if own <= below + 0.1:
        _leaf(node)
        return own
    return below


def prune_by_rows(roots: list[Node], rows: DataFrame, c: Coding, value_of, classes: bool) -> None:
    """Reduced-error pruning: a node whose leaf errs no more on the given rows than its subtree becomes one."""

    def count(t: pd.DataFrame):
        codes, value = c.codes(t), value_of(t)
        for k, root in enumerate(roots):
            at = place(root, codes)
            for p in set(at.tolist()):
                yield f"{k}|{p}", value[at == p].sum(0)

    found = gather(rows, count)

    def walk(k: int, node: Node, path: str) -> tuple[np.ndarray, float]:
        zero = np.zeros_like(node.dist)
        if not node.children:
            held = found.get(f"{k}|{path}", zero)
        else:
            below = [walk(k, ch, f"{path}.{i}") for i, ch in enumerate(node.children)]
            held, err = sum((b[0] for b in below), zero), sum(b[1] for b in below)
        if classes:
            own = held.sum() - held[int(node.dist.argmax())]
        else:
            m = node.dist[1] / max(node.dist[0], 1e-12)
            own = held[2] - 2 * m * held[1] + m * m * held[0]
        if not node.children:
            return held, own
        if own <= err + 1e-9:
            _leaf(node)
            return held, own
        return held, err

    for k, root in enumerate(roots):
        walk(k, root, "")


# Models --------------------------------------------------------------------------------------


class TreeModel(Model):
    """One tree, or the mean of several. ``leaf(node, rows of values)`` may give what a leaf says about its rows."""

    def __init__(self, roots: list[Node], c: Coding, attributes: list[str], classes: list[str] | None, laplace: bool = False):
        self.roots, self.coding, self.attributes, self.classes, self.laplace = roots, c, attributes, classes, laplace

    def _say(self, node: Node, x: pd.DataFrame, rows: np.ndarray) -> np.ndarray:
        if node.model is not None:
            s = node.model.scores(x.iloc[rows])
            return s if self.classes is not None else s[:, None]
        if self.classes is None:
            return np.full((len(rows), 1), node.dist[1] / max(node.dist[0], 1e-12))
        return np.repeat(normalised((node.dist + (1 if self.laplace else 0))[None]), len(rows), 0)

    def _walk(self, node: Node, x, codes, rows, weight, out) -> None:
        if not len(rows):
            return
        if not node.children:
            out[rows] += weight[:, None] * self._say(node, x, rows)
            return
        to = branch(codes[rows], node)
        for i, child in enumerate(node.children):
            here, lost = to == i, to < 0
            self._walk(child, x, codes, rows[here], weight[here], out)
            if lost.any() and node.shares[i] > 0:
                self._walk(child, x, codes, rows[lost], weight[lost] * node.shares[i], out)

    def scores(self, x):
        codes, width = self.coding.codes(x), len(self.classes) if self.classes is not None else 1
        out = np.zeros((len(x), width))
        for root in self.roots:
            one = np.zeros((len(x), width))
            self._walk(root, x, codes, np.arange(len(x)), np.ones(len(x)), one)
            out += one / len(self.roots)
        return normalised(out) if self.classes is not None else out[:, 0]


def _values(classes: list[str] | None):
    w = lambda t: t["_w"] * t["_n"] if "_n" in t else t["_w"]
    if classes is None:
        return lambda t: np.column_stack([w(t), w(t) * t["_y"], w(t) * t["_y"] ** 2]), 3
    return lambda t: one_hot(t["_y"], classes) * w(t).to_numpy()[:, None], len(classes)


def _prepared(df: DataFrame, target: str, attributes: list[str], weight: str | None, bins: int, once: bool = True):
    """The training rows, equal ones ``once`` with their number, their coding and classes."""
    rows = frame(df, target, attributes, weight)
    rows = stored(rows.groupBy(*[F.col(f"`{a}`") for a in rows.columns]).agg(F.count("*").cast("double").alias("_n")) if once else rows, "training")
    classes = None if dict(rows.dtypes)["_y"] == "double" else class_values(rows, "_y")
    return rows, coding(df, attributes, bins), classes


def _order(c: Coding) -> list[str]:
    return [*c.table.numbers, *c.table.domains]


def fit_tree(df: DataFrame, target: str, attributes: list[str], weight: str | None, rule: Rule, bins: int = 256, local_rows: int = 20_000, trees: int = 1, drawn=None, laplace: bool = False) -> TreeModel:
    rows, c, classes = _prepared(df, target, attributes, weight, bins)
    if classes is None:
        rule.criterion = "variance"
    value_of, width = _values(classes)
    roots = grow(rows, c, value_of, width, rule, trees, local_rows, drawn)
    discard(rows)
    return TreeModel(roots, c, _order(c), classes, laplace)


def id3(df, target, attributes, weight=None, **options):
    """Information gain on nominal attributes, parted into all their values until nothing is gained."""
    return fit_tree(df, target, attributes, weight, Rule("gain", True, 1e-9), **options)


def j48(df, target, attributes, weight=None, confidence: float = 0.25, least: float = 2.0, **options):
    """Gain ratio among attributes of at least average gain; numbers pay for their cut; pruned by an upper bound of the errors."""
    model = fit_tree(df, target, attributes, weight, Rule("ratio", True, least, correct=True, average=True), **options)
    if confidence:
        for root in model.roots:
            prune_by_bound(root, confidence)
    return model


def decision_stump(df, target, attributes, weight=None, **options):
    """One split in two."""
    return fit_tree(df, target, attributes, weight, Rule("gain", False, 1e-9, depth=1), **options)


def random_tree(df, target, attributes, weight=None, take: int = 0, seed: int = 1, least: float = 1.0, **options):
    """The best of some attributes drawn at each node, unpruned."""
    return fit_tree(df, target, attributes, weight, Rule("gain", True, least, take=take or int(np.log2(len(attributes)) + 1), seed=seed), **options)


#: Of more equal rows than these the draws are one Poisson count.
MOST_RANKS = 64


def draws(seed: int):
    """How often each row is drawn into each tree: Poisson counts by hash of the row and the tree, the same wherever it lies;
    of ``_n`` equal rows their sum."""

    def drawn(t: pd.DataFrame, tree: int) -> np.ndarray:
        h = pd.util.hash_pandas_object(t.drop(columns=["_w", "_n"], errors="ignore"), index=False).to_numpy()
        h = h + (t["_w"].to_numpy(float).view(np.uint64) - np.ones(1).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        n = t["_n"].to_numpy(float) if "_n" in t else np.ones(len(t))
        start = h ^ np.uint64((seed * 1_000_003 + tree * 7919 + 1) * 0x9E3779B97F4A7C15 % 2**64)
        table, out = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)]), np.zeros(len(t))
        here = np.flatnonzero(n <= MOST_RANKS)
        for rank in range(MOST_RANKS):
            here = here[n[here] > rank]
            if not len(here):
                break
            u = start[here] + np.uint64(rank * 0xD6E8FEB86659FD93 % 2**64)
            u = (u ^ (u >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            u = ((u ^ (u >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(11)
            out[here] += np.searchsorted(table, u / 2.0**53)
        for i in np.flatnonzero(n > MOST_RANKS):
            out[i] = np.random.default_rng(int(start[i])).poisson(n[i])
        return out

    return drawn


def random_forest(df, target, attributes, weight=None, trees: int = 10, take: int = 0, seed: int = 1, **options):
    """Random trees on rows drawn with replacement, all grown in the same passes."""
    take = take or int(np.log2(len(attributes)) + 1)
    return fit_tree(df, target, attributes, weight, Rule("gain", True, 1.0, take=take, seed=seed), trees=trees, drawn=draws(seed), **options)


def _parted(rows: DataFrame, folds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    h = F.pmod(F.xxhash64(*[F.col(f"`{a}`") for a in rows.columns if a != "_n"], F.lit(seed)), F.lit(folds))
    return rows.where(h != 0), rows.where(h == 0)


def rep_tree(df, target, attributes, weight=None, folds: int = 3, seed: int = 1, least: float = 2.0, bins: int = 256, local_rows: int = 20_000):
    """Gain or variance; pruned on a fold that is held out, which then counts at the leaves as well."""
    rows, c, classes = _prepared(df, target, attributes, weight, bins)
    value_of, width = _values(classes)
    rule = Rule("gain" if classes is not None else "variance", True, least)
    grown, held = _parted(rows, folds, seed)
    roots = grow(grown, c, value_of, width, rule, 1, local_rows)
    prune_by_rows(roots, held, c, value_of, classes is not None)
    _refill(roots, rows, c, value_of)
    discard(rows)
    return TreeModel(roots, c, _order(c), classes)


def _refill(roots: list[Node], rows: DataFrame, c: Coding, value_of) -> None:
    """Leaves say what all rows say."""

    def count(t: pd.DataFrame):
        codes, value = c.codes(t), value_of(t)
        for k, root in enumerate(roots):
            at = place(root, codes)
            for p in set(at.tolist()):
                yield f"{k}|{p}", value[at == p].sum(0)

    found = gather(rows, count)
    for k, root in enumerate(roots):
        for p, n in nodes_of(root):
            if not n.children and f"{k}|{p}" in found:
                n.dist = found[f"{k}|{p}"]


def with_leaf_models(df, target, attributes, weight, fit_groups, rule: Rule, confidence: float = 0.0, bins: int = 256, local_rows: int = 20_000) -> TreeModel:
    """A tree whose leaves have models: ``fit_groups(rows, group, count)`` fits one for each number that ``group(table)`` gives
    to rows, all of them in the same passes."""
    rows, c, classes = _prepared(df, target, attributes, weight, bins, once=False)
    if classes is None:
        rule.criterion = "variance"
    value_of, width = _values(classes)
    root = grow(rows, c, value_of, width, rule, 1, local_rows)[0]
    if confidence and classes is not None:
        prune_by_bound(root, confidence)
    leaves = [p for p, n in nodes_of(root) if not n.children]
    number = {p: i for i, p in enumerate(leaves)}
    models = fit_groups(rows, lambda t: np.array([number[p] for p in place(root, c.codes(t))]), len(leaves))
    for p, n in nodes_of(root):
        if not n.children:
            n.model = models[number[p]]
    discard(rows)
    return TreeModel([root], c, _order(c), classes)
