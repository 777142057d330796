"""Rule learners: every search step is one aggregation over the rows that are left.

Tests are ``(attribute, sign, value)`` and compile to column expressions, so that the rows a rule covers are
a filter of the plan, and a list of rules is one ``CASE``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.special import log2_binomial
from millrace.learn import bayes, trees
from millrace.learn.base import Constant, Model, Table, class_values, frame, gather, majority, normalised, one_hot
from millrace.learn.functions import Linear, linear_regression
from millrace.plans.storage import stored

Test = tuple[str, str, object]


def holds(test: Test) -> Column:
    """Whether a row passes; a missing cell does not."""
    a, sign, v = test
    c = F.col(f"`{a}`")
    made = {"=": lambda: c == F.lit(v), "<>": lambda: c != F.lit(v), "<=": lambda: c <= F.lit(v), ">": lambda: c > F.lit(v)}[sign]()
    return F.coalesce(made, F.lit(False))


def covered(tests: list[Test]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & holds(t)
    return out


def _passes(x: pd.DataFrame, tests: list[Test]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for a, sign, v in tests:
        c = x[a]
        made = {"=": lambda: c == v, "<>": lambda: (c != v) & c.notna(), "<=": lambda: c <= v, ">": lambda: c > v}[sign]()  # noqa: B023
        out &= made.fillna(False).to_numpy(bool)
    return out


class RuleList(Model):
    """Rules ``(tests, answer)`` in order, and what is said where none holds. An answer is an array or a model."""

    def __init__(self, rules: list, rest, attributes: list[str], classes: list[str] | None):
        self.rules, self.rest, self.attributes, self.classes = rules, rest, attributes, classes

    def _say(self, answer, x: pd.DataFrame) -> np.ndarray:
        if isinstance(answer, Model):
            return answer.scores(x)
        return np.repeat(np.atleast_1d(answer)[None], len(x), 0) if self.classes is not None else np.full(len(x), float(answer))

    def scores(self, x):
        out = np.zeros((len(x), len(self.classes))) if self.classes is not None else np.zeros(len(x))
        open_ = np.ones(len(x), bool)
        for tests, answer in [*self.rules, ([], self.rest)]:
            here = open_ & _passes(x, tests)
            if here.any():
                out[here] = self._say(answer, x[here])
            open_ &= ~here
        return out


def _counts(rows: DataFrame, attributes: list[str]) -> dict[str, pd.DataFrame]:
    """Class weights by value of each nominal attribute, from one pass."""
    cells = rows.select("_y", "_w", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(f"`{a}`").alias("v")) for a in attributes])).alias("x")).where("x.v is not null")
    n = cells.groupBy("x.a", "x.v", "_y").agg(F.sum("_w").alias("n")).toPandas()
    return {a: p for a, p in n.groupby("a")}


def prism(df, target, attributes, weight=None, most: int = 1000) -> RuleList:
    """Rules without errors, class after class: the test with the largest share of the class is added until all rows that
    are covered are of it; then these go. Nominal attributes; missing cells are values of their own."""
    rows = stored(frame(df, target, attributes, weight).na.fill("?", attributes), "prism")
    classes, rules = class_values(rows, "_y"), []
    for k, c in enumerate(classes):
        left = rows
        while len(rules) < most and left.where(F.col("_y") == c).limit(1).count():
            tests, here, used = [], left, []
            while True:
                total, own = here.agg(F.sum("_w"), F.sum(F.when(F.col("_y") == c, F.col("_w")).otherwise(0.0))).first()
                if total - own < 1e-9 or len(used) == len(attributes):
                    break
                best = None
                for a, p in sorted(_counts(here, [a for a in attributes if a not in used]).items(), key=lambda i: attributes.index(i[0])):
                    for v, q in sorted(p.groupby("v"), key=lambda i: i[0]):
                        mine, every = q[q["_y"] == c]["n"].sum(), q["n"].sum()
                        if mine > 0 and (best is None or (mine / every, mine) > best[:2]):
                            best = (mine / every, mine, (a, "=", v))
                if best is None:
                    break
                tests.append(best[2])
                used.append(best[2][0])
                here = here.where(holds(best[2]))
            rules.append((tests, np.eye(len(classes))[k]))
            left = left.where(~covered(tests))
            if not tests:
                break
    model = RuleList(rules, majority(df, target, [], weight), attributes, classes)
    return _Filled(model, attributes)


class _Filled(Model):
    def __init__(self, inner: Model, attributes: list[str]):
        self.inner, self.attributes, self.classes = inner, attributes, inner.classes

    def scores(self, x):
        return self.inner.scores(x.fillna({a: "?" for a in self.attributes}))


def conjunctive_rule(df, target, attributes, weight=None, folds: int = 3, seed: int = 1, least: float = 2.0) -> RuleList:
    """One rule: the test of most information (or least variance) is added while something is gained, then tests are cut
    from its end as long as it does not get worse on a fold that is held out. Rows that it does not cover get their own answer."""
    rows = stored(frame(df, target, attributes, weight), "conjunctive")
    number = dict(rows.dtypes)["_y"] == "double"
    classes = None if number else class_values(rows, "_y")
    value_of, width = trees._values(classes)
    c = trees.coding(rows, attributes)
    order = trees._order(c)
    grown, held = trees._parted(rows, folds, seed)
    rule = trees.Rule("variance" if number else "gain", False, least)
    tests: list[Test] = []
    for _ in range(2 * len(attributes)):
        here = grown.where(covered(tests))

        def add(t: pd.DataFrame):
            yield "s", value_of(t).sum(0)
            for i, h in enumerate(trees._histograms(c.codes(t), value_of(t), c.sizes)):
                yield str(i), h

        found = gather(here, add)
        if "s" not in found:
            break
        best = trees.best_split([found[str(i)] for i in range(len(c.sizes))], c.numeric, rule, list(range(len(c.sizes))))
        if best is None:
            break
        a, kind, value, parts = best
        first = trees.impurity(parts, rule.criterion) / np.maximum(trees.mass(parts, rule.criterion), 1e-12)
        side = int(first.argmin())
        if kind == "cut":
            tests.append((order[a], "<=" if side == 0 else ">", float(c.cuts[a][value])))
        elif side == 0:
            tests.append((order[a], "=", list(c.table.domains.values())[a - len(c.cuts)][value]))
        else:
            break

    def judged(kept: list[Test]) -> float:
        inside, out = held.where(covered(kept)), held.where(~covered(kept))
        worst = 0.0
        for part, whole in ((inside, grown.where(covered(kept))), (out, grown.where(~covered(kept)))):
            base = gather(whole, lambda t: [("s", value_of(t).sum(0))]).get("s")
            if base is None:
                continue
            seen = gather(part, lambda t: [("s", value_of(t).sum(0))]).get("s")
            if seen is None:
                continue
            worst += seen[2] - 2 * (base[1] / base[0]) * seen[1] + (base[1] / base[0]) ** 2 * seen[0] if number else seen.sum() - seen[int(base.argmax())]
        return worst

    errors = [judged(tests[:k]) for k in range(len(tests) + 1)]
    tests = tests[: int(np.argmin(errors))]
    answer = lambda part: (lambda s: (s[1] / s[0] if number else s / s.sum()) if s is not None else (0.0 if number else np.full(width, 1 / width)))(gather(part, lambda t: [("s", value_of(t).sum(0))]).get("s"))
    return RuleList([(tests, answer(rows.where(covered(tests))))] if tests else [], answer(rows.where(~covered(tests))) if tests else answer(rows), attributes, classes)


def _paths(model: trees.TreeModel):
    """``(tests, leaf)`` of the leaves of a single tree."""
    c, order = model.coding, trees._order(model.coding)

    def walk(node, tests):
        if not node.children:
            yield tests, node
            return
        a = order[node.attribute]
        for i, child in enumerate(node.children):
            if node.kind == "cut":
                test = (a, "<=" if i == 0 else ">", float(c.cuts[node.attribute][node.value]))
            else:
                domain = c.table.domains[a]
                v = domain[i] if node.kind == "many" else domain[node.value]
                if node.kind == "is" and i == 1:
                    yield from walk(child, [*tests, (a, "<>", v)])
                    continue
                test = (a, "=", v)
            yield from walk(child, [*tests, test])

    yield from walk(model.roots[0], [])


def part(df, target, attributes, weight=None, confidence: float = 0.25, least: float = 2.0, most: int = 100) -> RuleList:
    """A list of rules, each the leaf that covers most rows of a pruned tree on the rows that are left."""
    rows = stored(frame(df, target, attributes, weight), "part")
    classes, rules, left = class_values(rows, "_y"), [], rows
    for _ in range(most):
        n = left.agg(F.sum("_w")).first()[0]
        if not n:
            break
        model = trees.j48(left, "_y", attributes, "_w", confidence, least)
        tests, leaf = max(_paths(model), key=lambda p: p[1].dist.sum())
        place = [classes.index(c) for c in model.classes]
        answer = np.zeros(len(classes))
        answer[place] = leaf.dist / leaf.dist.sum()
        rules.append((tests, answer))
        if not tests:
            break
        left = left.where(~covered(tests))
    return RuleList(rules, majority(df, target, [], weight), attributes, classes)


def m5_rules(df, target, attributes, weight=None, least: float = 4.0, most: int = 50) -> RuleList:
    """A list of rules for a number: again and again the leaf that covers most rows of a model tree, with its line."""
    rows = stored(frame(df, target, attributes, weight), "m5")
    rules, left = [], rows
    for _ in range(most):
        n = left.agg(F.sum("_w")).first()[0] or 0
        if n < 2 * least:
            break
        model = trees.fit_tree(left, "_y", attributes, "_w", trees.Rule("variance", False, least, depth=6))
        tests, _ = max(_paths(model), key=lambda p: p[1].dist[0])
        rules.append((tests, linear_regression(left.where(covered(tests)), "_y", attributes, "_w")))
        if not tests:
            break
        left = left.where(~covered(tests))
    rest = linear_regression(left, "_y", attributes, "_w") if left.limit(1).count() else float(rows.agg(F.avg("_y")).first()[0] or 0.0)
    return RuleList(rules, rest, attributes, None)


def one_r(df, target, attributes, weight=None, bucket: float = 6.0, bins: int = 1024) -> RuleList:
    """The attribute whose rules err least. A number is cut where the class of the values so far, of which at least
    ``bucket`` are of one class, is no longer that of the next; neighbours of one class are joined."""
    rows = frame(df, target, attributes, weight)
    classes = class_values(rows, "_y")
    c = trees.coding(rows, attributes, bins)
    order = trees._order(c)

    def add(t: pd.DataFrame):
        v = one_hot(t["_y"], classes) * t["_w"].to_numpy()[:, None]
        codes = c.codes(t)
        for i, h in enumerate(trees._histograms(codes, v, c.sizes)):
            yield str(i), np.vstack([h, v[codes[:, i] < 0].sum(0)])

    found, best = gather(rows, add), None
    for i, a in enumerate(order):
        h = found[str(i)]
        body, lost = h[:-1], h[-1]
        rules, hits = [], 0.0
        if c.numeric[i]:
            groups, at = [], np.zeros(len(classes))
            for k in range(len(body)):
                if at.max() >= bucket and body[k].sum() > 0 and int(body[k].argmax()) != int(at.argmax()):
                    groups.append((k - 1, at))
                    at = np.zeros(len(classes))
                at = at + body[k]
            groups.append((len(body) - 1, at))
            joined: list = []
            for end, n in groups:
                if joined and int(joined[-1][1].argmax()) == int(n.argmax()):
                    joined[-1] = (end, joined[-1][1] + n)
                else:
                    joined.append((end, n))
            for k, (end, n) in enumerate(joined):
                tests = [(a, "<=", float(c.cuts[i][end]))] if k < len(joined) - 1 else [(a, ">", -math.inf)]
                rules.append((tests, np.eye(len(classes))[int(n.argmax())]))
                hits += n.max()
        else:
            for k, v in enumerate(c.table.domains[a]):
                rules.append(([(a, "=", v)], np.eye(len(classes))[int(body[k].argmax())]))
                hits += body[k].max()
        hits += lost.max()
        if best is None or hits > best[0] + 1e-9:
            best = (hits, a, rules, np.eye(len(classes))[int(lost.argmax())] if lost.sum() else majority(df, target, [], weight))
    model = RuleList(best[2], best[3], [best[1]], classes)
    model.chosen = best[1]
    return model


class TableModel(Model):
    """The class weights of each combination of codes; a row whose is not there gets those of all, or of the nearest."""

    def __init__(self, c, places, cells: dict, rest: np.ndarray, attributes, classes, nearest: bool = False):
        self.coding, self.places, self.cells, self.rest, self.attributes, self.classes, self.nearest = c, places, cells, rest, attributes, classes, nearest
        self.keys = np.array(list(cells), np.int64).reshape(len(cells), -1)
        self.values = np.array(list(cells.values()))

    def _found(self, x: pd.DataFrame) -> np.ndarray:
        codes = self.coding.codes(x)[:, self.places]
        out = np.zeros((len(x), self.values.shape[1]))
        for i, key in enumerate(map(tuple, codes.tolist())):
            if key in self.cells:
                out[i] = self.cells[key]
            elif self.nearest and len(self.keys):
                d = (self.keys != codes[i]).sum(1)
                out[i] = self.values[d == d.min()].sum(0)
            else:
                out[i] = self.rest
        return out

    def scores(self, x):
        s = self._found(x)
        return normalised(s) if self.classes is not None else s[:, 1] / np.maximum(s[:, 0], 1e-12)


def _subset_counts(rows: DataFrame, c, value_of, places: list[int], folds: int) -> dict:
    """Sums by combination of codes and fold: aggregated by Spark, one row a combination."""

    def part(tables):
        for t in tables:
            codes, v = c.codes(t)[:, places], value_of(t)
            yield pd.DataFrame({"key": [",".join(map(str, k)) for k in codes.tolist()], "fold": t["_fold"], **{f"v{i}": v[:, i] for i in range(v.shape[1])}})

    width = len(value_of(rows.limit(1).toPandas())[0])
    kind = "key string, fold int, " + ", ".join(f"v{i} double" for i in range(width))
    n = rows.mapInPandas(part, kind).groupBy("key", "fold").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)]).toPandas()
    out: dict = {}
    for r in n.itertuples(index=False):
        out.setdefault(tuple(int(k) for k in r.key.split(",") if k), {})[r.fold] = np.array(r[2:])
    return out


def _left_out(counts: dict, classes: bool, folds: int, total: np.ndarray) -> float:
    """Errors when each fold is answered by the others."""
    errors = 0.0
    for by in counts.values():
        whole = sum(by.values())
        for fold, own in by.items():
            rest = whole - own
            rest = rest if (rest.sum() if classes else rest[0]) > 1e-9 else total
            errors += own.sum() - own[int(rest.argmax())] if classes else own[2] - 2 * rest[1] / rest[0] * own[1] + (rest[1] / rest[0]) ** 2 * own[0]
    return errors


def decision_table(df, target, attributes, weight=None, folds: int = 10, nearest: bool = False, bins: int = 10) -> TableModel:
    """The combinations of some attributes: added one by one while the rows of left-out folds are answered better.

    Numbers are cut into at most ``bins`` ranges of like frequency first.
    """
    rows = frame(df, target, attributes, weight)
    rows = stored(rows.withColumn("_fold", F.pmod(F.xxhash64(*rows.columns, F.lit(7)), F.lit(folds)).cast("int")), "table")
    classes = None if dict(rows.dtypes)["_y"] == "double" else class_values(rows, "_y")
    value_of, _ = trees._values(classes)
    c = trees.coding(rows, attributes, bins)
    total = gather(rows, lambda t: [("s", value_of(t).sum(0))])["s"]
    chosen: list[int] = []
    best = _left_out(_subset_counts(rows, c, value_of, [], folds), classes is not None, folds, total)
    while len(chosen) < len(attributes):
        tried = [(_left_out(_subset_counts(rows, c, value_of, [*chosen, k], folds), classes is not None, folds, total), k) for k in range(len(c.sizes)) if k not in chosen]
        error, k = min(tried)
        if error >= best - 1e-9:
            break
        best, chosen = error, [*chosen, k]
    cells = {key: sum(by.values()) for key, by in _subset_counts(rows, c, value_of, chosen, folds).items()}
    order = trees._order(c)
    model = TableModel(c, chosen, cells, total, order, classes, nearest)
    model.chosen = [order[k] for k in chosen]
    return model


class Product(Model):
    """Two models of one prior: shares multiplied, the prior divided out."""

    def __init__(self, a: Model, b: Model, prior: np.ndarray):
        self.a, self.b, self.prior, self.classes = a, b, prior, a.classes
        self.attributes = list(dict.fromkeys([*a.attributes, *b.attributes]))

    def scores(self, x):
        return normalised(np.maximum(self.a.scores(x), 1e-9) * np.maximum(self.b.scores(x), 1e-9) / self.prior[None])


def table_and_bayes(df, target, attributes, weight=None, folds: int = 10) -> Product:
    """A decision table on some attributes, naive Bayes on the others."""
    table = decision_table(df, target, attributes, weight, folds)
    rest = [a for a in attributes if a not in table.chosen]
    prior = table.rest / table.rest.sum()
    other = bayes.naive_bayes(df, target, rest, weight) if rest else Constant(prior, table.classes)
    return Product(table, other, prior)


def rule_bits(n_tests: int, possible: int, covered_: float, wrong: float, uncovered: float, missed: float) -> float:
    """Bits that a rule set costs: its tests among the possible ones, and the errors among the rows it covers and those it does not."""
    k = max(n_tests, 0)
    theory = math.log2(max(k, 1)) + (log2_binomial(possible, k) if 0 <= k <= possible else 0.0)
    subset = lambda n, e: (log2_binomial(n, e) if n >= e >= 0 and n > 0 else 0.0) + math.log2(n + 1)
    return 0.5 * theory + subset(covered_, wrong) + subset(uncovered, missed)


def linear_model_tree(df, target, attributes, weight=None, least: float = 4.0, depth: int = 8, smooth: float = 15.0) -> trees.TreeModel:
    """A tree for a number with a line at each leaf, pulled towards that of all rows by ``smooth`` rows."""
    whole = linear_regression(df, target, attributes, weight)

    def groups(rows, group, count):
        from millrace.learn.functions import Design, products

        design = Design(rows, attributes)
        found, models = products(rows, design, group), []
        for g in range(count):
            m = found.get(str(g))
            if m is None:
                models.append(whole)
                continue
            p = m.shape[1] - 1
            w = np.linalg.lstsq(m[:p, :p] + 1e-6 * np.diag([0.0] + [1.0] * (p - 1)), m[:p, p], rcond=None)[0]
            n = m[-1, 0]
            models.append(Linear(design, (n * w + smooth * whole.weights) / (n + smooth), attributes))
        return models

    return trees.with_leaf_models(df, target, attributes, weight, groups, trees.Rule("variance", False, max(least, 2 * len(attributes)), depth))


def bayes_tree(df, target, attributes, weight=None, least: float = 30.0, depth: int = 6) -> trees.TreeModel:
    """A tree with naive Bayes at its leaves, all fitted in one pass."""

    def groups(rows, group, count):
        classes = class_values(rows, "_y")
        table, models = Table.of(rows, attributes), []
        one = bayes.NaiveBayes(table, classes, attributes)

        def add(t: pd.DataFrame):
            at = group(t)
            for g in np.unique(at).tolist():
                here = t[at == g]
                for k, a in one._add(here, one_hot(here["_y"], classes) * here["_w"].to_numpy()[:, None]):
                    yield f"{g}|{k}", a

        found = gather(rows, add)
        for g in range(count):
            m = bayes.NaiveBayes(table, classes, attributes)
            models.append(m._take({k.split("|")[1]: v for k, v in found.items() if k.split("|")[0] == str(g)}))
        return models

    return trees.with_leaf_models(df, target, attributes, weight, groups, trees.Rule("ratio", True, least, depth, correct=True))


def logistic_tree(df, target, attributes, weight=None, least: float = 15.0, depth: int = 5, confidence: float = 0.25, ridge: float = 0.1) -> trees.TreeModel:
    """A pruned tree with logistic regressions at its leaves, all fitted in the same passes."""

    def groups(rows, group, count):
        from millrace.learn.functions import Design, _newton, _shares

        classes, design = class_values(rows, "_y"), Design(rows, attributes, True)
        w = _newton(rows, design, classes, ridge, 15, group, count)
        return [Linear(design, v, attributes, classes, _shares) for v in w]

    return trees.with_leaf_models(df, target, attributes, weight, groups, trees.Rule("ratio", True, least, depth, correct=True), confidence)


class _Stacked(Model):
    def __init__(self, first: Model, second: Model, names: list[str]):
        self.first, self.second, self.names = first, second, names
        self.attributes, self.classes = list(dict.fromkeys([*first.attributes, *[a for a in second.attributes if a not in names]])), second.classes

    def scores(self, x):
        s = self.first.scores(x)
        return self.second.scores(x.assign(**{n: s[:, i] for i, n in enumerate(self.names)}))


def functional_tree(df, target, attributes, weight=None, **options) -> Model:
    """A tree that may also split on the class shares of a logistic regression over all rows, with such ones at its leaves."""
    from millrace.learn.functions import logistic

    first = logistic(df, target, attributes, weight, 0.1)
    names = [f"_share_{c}" for c in first.classes]
    held = first.transform(df, "_p", "_d").select(*df.columns, *[F.get("_d", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return _Stacked(first, logistic_tree(stored(held, "functional"), target, [*attributes, *names], weight, **options), names)
