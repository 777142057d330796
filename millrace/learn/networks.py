"""Bayes networks over nominal columns: structures searched on the driver, scored from counts by family.

A family is a column and its parents. One pass counts all the families that a step of a search asks for,
and none is counted twice. Columns are numbered, the class first. Local scores add up over families; the
global one is the share of rows that a network answers rightly when their fold is left out.
"""

from __future__ import annotations

import itertools
import math
import random
import xml.etree.ElementTree as ET
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.learn.base import Model, Table, class_values, frame, gather, softmax

Parents = tuple[frozenset, ...]


class Coder:
    """The class, -1 where there is none, and the values; a missing value counts as the first."""

    def __init__(self, table: Table, classes: list[str]):
        self.table, self.place = table, {c: i for i, c in enumerate(classes)}

    def __call__(self, t: pd.DataFrame) -> np.ndarray:
        y = np.array([self.place.get(v, -1) for v in t["_y"]]) if "_y" in t else np.full(len(t), -1)
        return np.column_stack([y, np.maximum(self.table.codes(t), 0)])


class Counts:
    """Counts of families, by fold; ``ask`` counts those that are not known in one pass."""

    def __init__(self, df: DataFrame, target: str, attributes: list[str], weight: str | None = None, folds: int = 1, seed: int = 1):
        rows = frame(df, target, attributes, weight)
        self.table, self.classes, self.attributes, self.folds = Table.of(rows, attributes), class_values(rows, "_y"), attributes, folds
        if self.table.numbers:
            raise ValueError("nominal attributes are needed")
        self.rows = rows.withColumn("_f", F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(folds)).cast("int"))
        self.sizes = [len(self.classes), *[max(s, 1) for s in self.table.sizes]]
        self.known: dict[tuple, np.ndarray] = {}

    @property
    def coder(self) -> Coder:
        return Coder(self.table, self.classes)

    def ask(self, families: list[tuple]) -> None:
        new = [f for f in dict.fromkeys(families) if f not in self.known]
        if not new:
            return
        sizes, folds, codes = self.sizes, self.folds, self.coder

        def add(t: pd.DataFrame):
            c, w, fold = codes(t), t["_w"].to_numpy(), t["_f"].to_numpy()
            for f in new:
                shape = (folds, *[sizes[i] for i in f])
                at = np.ravel_multi_index((fold, *[c[:, i] for i in f]), shape)
                yield str(f), np.bincount(at, w, math.prod(shape)).reshape(shape)

        found = gather(self.rows, add)
        for f in new:
            self.known[f] = found.get(str(f), np.zeros((self.folds, *[sizes[i] for i in f])))

    def of(self, node: int, parents: frozenset) -> np.ndarray:
        """By fold, parents' values in order of their numbers, and value."""
        key = (*sorted(parents), node)
        self.ask([key])
        n = self.known[key]
        return n.reshape(self.folds, -1, self.sizes[node])


def family(node: int, parents: frozenset) -> tuple:
    return (*sorted(parents), node)


def local_score(counts: Counts, kind: str = "bayes", alpha: float = 0.5) -> Callable[[int, frozenset], float]:
    """``bayes``: the likelihood of a family with even priors; ``entropy``; ``aic`` and ``mdl`` take off for what it has to learn."""

    def score(node: int, parents: frozenset) -> float:
        n = counts.of(node, parents).sum(0)
        if kind == "bayes":
            lg = np.vectorize(math.lgamma)
            return float((lg(np.full(len(n), alpha * n.shape[1])) - lg(n.sum(1) + alpha * n.shape[1])).sum() + (lg(n + alpha) - math.lgamma(alpha)).sum())
        total = n.sum(1, keepdims=True)
        log = float(np.where(n > 0, n * np.log(np.where(n > 0, n, 1) / np.maximum(total, 1e-300)), 0).sum())
        free_ = n.shape[0] * (n.shape[1] - 1)
        return log - (free_ if kind == "aic" else 0.5 * free_ * math.log(max(n.sum(), 2)) if kind == "mdl" else 0.0)

    return score


class Network(Model):
    """Tables of chances by family. ``alpha`` is added to each count; ``averaged`` mixes each table with that of no parents, in
    proportion to their likelihoods."""

    def __init__(self, counts: Counts, parents: Parents, alpha: float = 0.5, averaged: str = "none", fold: int | None = None):
        self.table, self.classes, self.attributes, self.parents, self.sizes = counts.table, counts.classes, counts.attributes, parents, counts.sizes
        self.tables = []
        counts.ask([family(i, p) for i, p in enumerate(parents)] + ([family(i, frozenset()) for i in range(len(parents))] if averaged != "none" else []))
        for i, p in enumerate(parents):
            n = counts.of(i, p)
            n = n.sum(0) - (n[fold] if fold is not None else 0)
            t = (n + alpha) / (n + alpha).sum(1, keepdims=True)
            if averaged != "none" and p:
                flat = n.sum(0)
                plain = (flat + alpha) / (flat + alpha).sum()
                own, base = local_score(counts)(i, p), local_score(counts)(i, frozenset())
                share = 1 / (1 + math.exp(min(max(base - own, -500), 500)))
                if averaged == "multinomial":
                    share = n.sum(1, keepdims=True) / (n.sum(1, keepdims=True) + self.sizes[i]) * share
                t = share * t + (1 - share) * plain[None]
            self.tables.append(t)

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), len(self.classes)))
        for i, p in enumerate(self.parents):
            for k in range(len(self.classes)) if i == 0 or 0 in p else (0,):
                c = codes.copy()
                c[:, 0] = k
                given = sorted(p)
                at = np.ravel_multi_index(tuple(c[:, j] for j in given), tuple(self.sizes[j] for j in given)) if given else np.zeros(len(c), int)
                log = np.log(np.maximum(self.tables[i][at, c[:, i]], 1e-300))
                if i == 0 or 0 in p:
                    out[:, k] += log
                else:
                    out += log[:, None]  # the same for all classes
        return out

    def scores(self, x):
        codes = np.column_stack([np.zeros(len(x), int), np.maximum(self.table.codes(x), 0)])
        return softmax(self._logs(codes))

    def arcs(self) -> list[tuple[str, str]]:
        names = ["class", *self.attributes]
        return sorted((names[j], names[i]) for i, p in enumerate(self.parents) for j in p)


def global_score(counts: Counts, alpha: float = 0.5) -> Callable[[Parents], float]:
    """Right answers for rows whose fold is left out."""
    known: dict[Parents, float] = {}

    def score(parents: Parents) -> float:
        if parents not in known:
            nets, codes = [Network(counts, parents, alpha, fold=f) for f in range(counts.folds)], counts.coder

            def add(t: pd.DataFrame):
                c, hit = codes(t), 0.0
                for f, net in enumerate(nets):
                    here = (t["_f"] == f).to_numpy()
                    if here.any():
                        hit += ((net._logs(c[here]).argmax(1) == c[here, 0]) * t["_w"].to_numpy()[here]).sum()
                yield "s", np.array([hit, t["_w"].sum()])

            s = gather(counts.rows, add)["s"]
            known[parents] = float(s[0] / s[1])
        return known[parents]

    return score


def acyclic(parents: Parents) -> bool:
    left, done = set(range(len(parents))), set()
    while left:
        free_ = [i for i in left if parents[i] <= done]
        if not free_:
            return False
        done |= set(free_)
        left -= set(free_)
    return True


def bayes_structure(n: int) -> Parents:
    """The class before every attribute."""
    return (frozenset(), *[frozenset([0])] * (n - 1))


def _steps(parents: Parents, most: int, turn: bool = True):
    """Structures one arc away: added, taken off or turned."""
    n = len(parents)
    for i in range(n):
        for j in range(n):
            if i == j:
                continue
            if j in parents[i]:
                less = parents[:i] + (parents[i] - {j},) + parents[i + 1 :]
                yield less
                if turn and len(parents[j]) < most:
                    t = less[:j] + (less[j] | {i},) + less[j + 1 :]
                    if acyclic(t):
                        yield t
            elif len(parents[i]) < most:
                t = parents[:i] + (parents[i] | {j},) + parents[i + 1 :]
                if acyclic(t):
                    yield t


class Search:
    """Structures by a score: ``local`` sums of families' scores, or a global one."""

    def __init__(self, counts: Counts, kind: str = "bayes", most: int = 2, crossed: bool = False, seed: int = 1):
        self.counts, self.most, self.n, self.r = counts, most, len(counts.sizes), random.Random(seed)
        self.family, self.whole = local_score(counts, kind), global_score(counts) if crossed else None

    def score(self, parents: Parents) -> float:
        return self.whole(parents) if self.whole else sum(self.family(i, p) for i, p in enumerate(parents))

    def prepare(self, options: list[Parents]) -> None:
        self.counts.ask([family(i, p) for s in options for i, p in enumerate(s)])

    def best(self, options: list[Parents]):
        self.prepare(options)
        return max(options, key=lambda s: (round(self.score(s), 9), -sum(map(len, s)), str([sorted(p) for p in s])))

    def fixed(self) -> Parents:
        return bayes_structure(self.n)

    def k2(self, order: list[int] | None = None, start: Parents | None = None) -> Parents:
        """Column after column in order, each takes the earlier ones that help most while they help."""
        order = order or list(range(self.n))
        parents = list(start or bayes_structure(self.n))
        for at, i in enumerate(order):
            if i == 0:
                continue
            while len(parents[i]) < self.most:
                options = [tuple(parents[:i] + [parents[i] | {j}] + parents[i + 1 :]) for j in order[:at] if j not in parents[i]]
                if not options:
                    break
                t = self.best(options)
                if self.score(t) <= self.score(tuple(parents)) + 1e-9:
                    break
                parents = list(t)
        return tuple(parents)

    def hill(self, start: Parents | None = None) -> Parents:
        s = start or bayes_structure(self.n)
        while True:
            t = self.best(list(_steps(s, self.most)) or [s])
            if self.score(t) <= self.score(s) + 1e-9:
                return s
            s = t

    def look_ahead(self, start: Parents | None = None, width: int = 5) -> Parents:
        """Two steps at a time: of the ``width`` best first ones, the pair that ends best."""
        s = start or bayes_structure(self.n)
        while True:
            first = list(_steps(s, self.most))
            self.prepare(first)
            good = sorted(first, key=lambda t: -self.score(t))[:width]
            second = good + [u for t in good for u in _steps(t, self.most)]
            t = self.best(second)
            if self.score(t) <= self.score(s) + 1e-9:
                return s
            s = t

    def random_start(self) -> Parents:
        s = (frozenset(),) * self.n
        for _ in range(self.n):
            options = list(_steps(s, self.most))
            s = self.r.choice(options)
        return s

    def repeated(self, runs: int = 3) -> Parents:
        found = [self.hill()] + [self.hill(self.random_start()) for _ in range(runs)]
        return self.best(found)

    def annealed(self, steps: int = 60, heat: float = 10.0, cool: float = 0.95) -> Parents:
        s = best = bayes_structure(self.n)
        for _ in range(steps):
            t = self.r.choice(list(_steps(s, self.most)))
            gain = self.score(t) - self.score(s)
            if gain > 0 or self.r.random() < math.exp(max(gain / max(heat, 1e-9), -700)):
                s = t
            best = s if self.score(s) > self.score(best) else best
            heat *= cool
        return best

    def tabu(self, steps: int = 15, memory: int = 5) -> Parents:
        s = best = bayes_structure(self.n)
        seen = [s]
        for _ in range(steps):
            options = [t for t in _steps(s, self.most) if t not in seen]
            if not options:
                break
            s = self.best(options)
            seen = [*seen, s][-memory:]
            best = s if self.score(s) > self.score(best) + 1e-9 else best
        return best

    def genetic(self, population: int = 8, rounds: int = 8) -> Parents:
        pool = [bayes_structure(self.n), *[self.random_start() for _ in range(population - 1)]]
        for _ in range(rounds):
            young = []
            for _ in range(population):
                a, b = self.r.sample(pool, 2)
                at = self.r.randint(1, self.n - 1)
                child = a[:at] + b[at:]
                child = child if acyclic(child) else a
                young.append(self.r.choice(list(_steps(child, self.most))))
            self.prepare([*pool, *young])
            pool = sorted(dict.fromkeys([*pool, *young]), key=lambda s: (-self.score(s), str(s)))[:population]
        return pool[0]

    def tan(self) -> Parents:
        """The class before all, and the tree between attributes of the most information given the class."""
        m = self.n - 1
        self.counts.ask([(0, i, j) for i, j in itertools.combinations(range(1, self.n), 2)])
        info = {}
        for i, j in itertools.combinations(range(1, self.n), 2):
            n = self.counts.known[0, i, j].sum(0)
            a, b, c, t = n.sum(2, keepdims=True), n.sum(1, keepdims=True), n.sum((1, 2), keepdims=True), n.sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                info[i, j] = info[j, i] = float(np.nansum(np.where(n > 0, n / t * np.log(n * c / (a * b)), 0)))
        parents = [frozenset(), *[frozenset([0])] * m]
        inside = {1} if m else set()
        while len(inside) < m:
            i, j = max(((i, j) for i in inside for j in range(1, self.n) if j not in inside), key=lambda p: (round(info[p], 12), -p[0], -p[1]))
            parents[j] = parents[j] | {i}
            inside.add(j)
        return tuple(parents)

    def independence(self, limit: float = 0.05) -> Parents:
        """Arcs between columns that stay dependent given any one other, from earlier to later ones; the class leads."""
        from millrace.functions.special import chi_squared_probability

        def dependent(i: int, j: int, given: tuple[int, ...]) -> bool:
            key = (*given, *sorted((i, j)))
            self.counts.ask([key])
            n = self.counts.known[key].sum(0).reshape(-1, self.counts.sizes[min(i, j)], self.counts.sizes[max(i, j)])
            a, b, t = n.sum(2, keepdims=True), n.sum(1, keepdims=True), n.sum((1, 2), keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                g = 2 * float(np.nansum(np.where(n > 0, n * np.log(n * t / (a * b)), 0)))
            return chi_squared_probability(g, max(n.shape[0] * (n.shape[1] - 1) * (n.shape[2] - 1), 1)) < limit

        parents = [frozenset()] * self.n
        for i, j in itertools.combinations(range(self.n), 2):
            others = [k for k in range(self.n) if k not in (i, j)]
            if dependent(i, j, ()) and all(dependent(i, j, (k,)) for k in others) and len(parents[j]) < self.most:
                parents[j] = parents[j] | {i}
        return tuple(parents)


def bayes_net(df, target, attributes, weight=None, search: str = "k2", score: str = "bayes", most: int = 2, crossed: bool = False, folds: int = 3, alpha: float = 0.5, averaged: str = "none", seed: int = 1, **options) -> Network:
    """``search``: fixed, k2, hill, look_ahead, repeated, annealed, tabu, genetic, tan or independence; ``crossed`` scores by folds."""
    counts = Counts(df, target, attributes, weight, folds if crossed else 1, seed)
    s = Search(counts, score, most, crossed, seed)
    return Network(counts, getattr(s, search)(**options), alpha, averaged)


def write_bif(net: Network, name: str = "network") -> str:
    """The network as XML: variables, and a definition with its table for each."""
    root = ET.Element("BIF")
    top = ET.SubElement(root, "NETWORK")
    ET.SubElement(top, "NAME").text = name
    names = ["class", *net.attributes]
    domains = [net.classes, *net.table.domains.values()]
    for n, d in zip(names, domains):
        v = ET.SubElement(top, "VARIABLE", TYPE="nature")
        ET.SubElement(v, "NAME").text = n
        for o in d:
            ET.SubElement(v, "OUTCOME").text = o
    for i, p in enumerate(net.parents):
        d = ET.SubElement(top, "DEFINITION")
        ET.SubElement(d, "FOR").text = names[i]
        for j in sorted(p):
            ET.SubElement(d, "GIVEN").text = names[j]
        ET.SubElement(d, "TABLE").text = " ".join(repr(float(v)) for v in net.tables[i].ravel())
    return ET.tostring(root, "unicode")


def read_bif(text: str, target: str | None = None) -> Network:
    """A network from such XML, with its tables; the first variable is the class unless one is named."""
    top = ET.fromstring(text).find("NETWORK")
    domains = {v.findtext("NAME"): [o.text for o in v.findall("OUTCOME")] for v in top.findall("VARIABLE")}
    names = sorted(domains, key=lambda n: (n != (target or next(iter(domains))), list(domains).index(n)))
    net = Network.__new__(Network)
    net.classes, net.attributes = domains[names[0]], names[1:]
    net.table = Table([], {n: domains[n] for n in names[1:]})
    net.sizes = [len(domains[n]) for n in names]
    parents, tables = [frozenset()] * len(names), [None] * len(names)
    for d in top.findall("DEFINITION"):
        i, given = names.index(d.findtext("FOR")), [names.index(g.text) for g in d.findall("GIVEN")]
        t = np.array([float(v) for v in d.findtext("TABLE").split()]).reshape([net.sizes[g] for g in given] + [net.sizes[i]])
        parents[i] = frozenset(given)
        tables[i] = np.moveaxis(t, range(len(given)), [sorted(given).index(g) for g in given]).reshape(-1, net.sizes[i])
    net.parents, net.tables = tuple(parents), tables
    return net
