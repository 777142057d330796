"""Learners against plain versions in numpy or pure Python, on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.learn import base, bayes, functions, trees


def table(spark, n=120, seed=1, missing=True):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, x, z = r.choice(list("pqr")), r.choice(list("uv")), float(r.integers(0, 30)), float(r.normal())
        y = "yes" if (x > 14) != (a == "p" and b == "u") else "no"
        if r.random() < 0.08:
            y = "no" if y == "yes" else "yes"
        rows.append((i, None if missing and r.random() < 0.04 else a, b, None if missing and r.random() < 0.04 else x, z, y, 2 * x - 3 * z + 5 + r.normal() * 0.1))
    return spark.createDataFrame(rows, "k int, a string, b string, x double, z double, y string, t double").repartition(3)


@pytest.fixture(scope="module")
def df(spark):
    held = table(spark).cache()
    held.count()
    return held


@pytest.fixture(scope="module")
def whole(spark):
    held = table(spark, 90, 2, False).cache()
    held.count()
    return held


def dist(model, rows):
    return {r["k"]: np.array(r["distribution"]) for r in model.transform(rows).collect()}


def numbers(model, rows):
    return {r["k"]: r["prediction"] for r in model.transform(rows).collect()}


def test_gather(df):
    got = base.gather(df.select("a", "z"), lambda t: ((str(k), np.array([[len(p), p["z"].sum()]])) for k, p in t.groupby("a")))
    t = df.toPandas()
    for k, p in t.groupby("a"):
        assert np.allclose(got[str(k)], [[len(p), p["z"].sum()]])
    assert base.gather(df.limit(0).select("a", "z"), lambda t: []) == {}


# Trees ---------------------------------------------------------------------------------------


def plain_tree(rows, names, many, least, depth=99):
    """Information gain by counting, for nominal attributes and cuts; dicts of class counts at the leaves."""
    n = len(rows)
    counts = {c: sum(r["y"] == c for r in rows) for c in ("no", "yes")}
    h = lambda part: -sum(k / len(part) * math.log2(k / len(part)) for k in (sum(r["y"] == c for r in part) for c in ("no", "yes")) if k) if part else 0
    best = None
    if depth and min(counts.values()) and n >= 2 * least:
        for a in names:
            if isinstance(rows[0][a], str):
                values = sorted({r[a] for r in rows})
                options = [{v: [r for r in rows if r[a] == v] for v in values}] if many else [{v: [r for r in rows if r[a] == v], None: [r for r in rows if r[a] != v]} for v in values]
            else:
                values = sorted({r[a] for r in rows})
                options = [{("<", (p + q) / 2): [r for r in rows if r[a] <= p], (">", (p + q) / 2): [r for r in rows if r[a] > p]} for p, q in zip(values, values[1:])]
            for parts in options:
                if sum(len(p) >= least for p in parts.values()) < 2:
                    continue
                gain = h(rows) - sum(len(p) / n * h(p) for p in parts.values())
                if gain > 1e-9 and (best is None or round(gain, 9) > best[0]):
                    best = (round(gain, 9), a, parts)
    if best is None:
        return counts
    return (best[1], {k: plain_tree(p, names, many, least, depth - 1) for k, p in best[2].items() if p}, counts)


def plain_share(tree, row):
    while isinstance(tree, tuple):
        a, parts, counts = tree
        v = row[a]
        key = next((k for k in parts if k == v or isinstance(k, tuple) and (v <= k[1]) == (k[0] == "<")), None if None in parts and v not in parts else "?")
        if key == "?":
            tree = counts
            break
        tree = parts[key]
    return np.array([tree["no"], tree["yes"]]) / sum(tree.values())


@pytest.mark.parametrize("many", [True, False])
def test_trees_by_gain(whole, many):
    rows = [r.asDict() for r in whole.collect()]
    names = ["x", "z", "a", "b"]
    want = plain_tree(rows, names, many, 2)
    model = trees.fit_tree(whole, "y", names, None, trees.Rule("gain", many, 2.0))
    got = dist(model, whole)
    assert all(np.allclose(got[r["k"]], plain_share(want, r)) for r in rows)


def test_trees_do_not_depend_on_where_nodes_are_finished(df):
    for rule in ({"criterion": "ratio", "correct": True, "average": True}, {"criterion": "gain", "take": 2, "seed": 4}):
        a = dist(trees.fit_tree(df, "y", ["a", "b", "x", "z"], None, trees.Rule(**rule), local_rows=10**9), df)
        b = dist(trees.fit_tree(df, "y", ["a", "b", "x", "z"], None, trees.Rule(**rule), local_rows=0), df)
        c = dist(trees.fit_tree(df, "y", ["a", "b", "x", "z"], None, trees.Rule(**rule), local_rows=25), df)
        assert all(np.allclose(a[k], b[k]) and np.allclose(a[k], c[k]) for k in a)


def test_pruning_and_committees(df):
    t = df.toPandas()
    right = lambda m: np.mean(m.transform(df).toPandas().set_index("k")["prediction"].reindex(t["k"]).to_numpy() == t["y"].to_numpy())
    full, small = trees.j48(df, "y", ["a", "b", "x", "z"], confidence=0), trees.j48(df, "y", ["a", "b", "x", "z"])
    size = lambda m: sum(1 for _ in trees.nodes_of(m.roots[0]))
    assert size(small) <= size(full) and right(small) > 0.8
    assert right(trees.rep_tree(df, "y", ["a", "b", "x", "z"])) > 0.7
    forest = trees.random_forest(df, "y", ["a", "b", "x", "z"], trees=7)
    assert len(forest.roots) == 7 and right(forest) > 0.85
    assert right(trees.random_tree(df, "y", ["a", "b", "x", "z"])) > 0.9
    assert trees.added_errors(10, 0, 0.25) == pytest.approx(10 * (1 - 0.25**0.1))
    number = trees.rep_tree(df, "t", ["x", "a"])
    got = numbers(number, df)
    assert np.corrcoef([got[k] for k in t["k"]], t["t"])[0, 1] > 0.9


def test_stump(whole):
    rows = [r.asDict() for r in whole.collect()]
    got = dist(trees.decision_stump(whole, "y", ["x", "z", "a", "b"]), whole)
    want = plain_tree(rows, ["x", "z", "a", "b"], False, 1, 1)
    assert all(np.allclose(got[r["k"]], plain_share(want, r)) for r in rows)


# Functions -----------------------------------------------------------------------------------


def arrays(whole, names=("x", "z")):
    t = whole.toPandas().sort_values("k")
    return t, np.column_stack([np.ones(len(t)), *[t[n] for n in names]])


def test_linear_regressions(whole):
    t, x = arrays(whole)
    w = np.linalg.lstsq(x, t["t"], rcond=None)[0]
    for m in (functions.linear_regression(whole, "t", ["x", "z"], select="none"), functions.pls_regression(whole, "t", ["x", "z"], components=2), functions.pace_regression(whole, "t", ["x", "z"], estimator="ols")):
        got = numbers(m, whole)
        assert np.allclose([got[k] for k in t["k"]], x @ w, atol=1e-4)
    noisy = whole.withColumn("n1", F.rand(3)).withColumn("n2", F.col("k") % 7 * 1.0)
    m = functions.linear_regression(noisy, "t", ["x", "n2", "z"], select="greedy")
    assert abs(m.weights[1] - 2) < 0.05 and abs(m.weights[3] + 3) < 0.1
    one = functions.simple_linear_regression(whole, "t", ["z", "x"])
    assert np.allclose(one.weights[[0, 2]], np.linalg.lstsq(x[:, :2], t["t"], rcond=None)[0]) and one.weights[1] == 0
    shrunk = functions.pace_regression(whole, "t", ["x", "z"], estimator="bic")
    assert np.allclose(shrunk.weights, w, atol=0.2)
    wild = whole.withColumn("t", F.when(F.col("k") % 10 == 0, 1000.0).otherwise(F.col("t")))
    lms = functions.least_median_squares(wild, "t", ["x", "z"])
    assert abs(lms.weights[1] - 2) < 0.2


def test_isotonic(whole):
    t, _ = arrays(whole)
    got = numbers(functions.isotonic_regression(whole, "t", ["x", "z"]), whole)
    g = t.groupby("x")["t"].agg(["sum", "count"])
    fit = dict(zip(g.index, functions.pooled(g["sum"].to_numpy(), g["count"].to_numpy(float))))
    assert all(got[k] == pytest.approx(fit[x]) for k, x in zip(t["k"], t["x"]))
    assert list(functions.pooled(np.array([3.0, 1.0, 4.0, 2.0]), np.ones(4))) == [2, 2, 3, 3]


def test_logistic_is_at_the_best(whole):
    m = functions.logistic(whole, "y", ["x", "z", "b"], ridge=0.5)
    t = whole.toPandas()
    x, y = m.design(t), (t["y"] == "yes").to_numpy(float)
    p = 1 / (1 + np.exp(-(x @ m.weights[:, 0])))
    grad = x.T @ (y - p) - np.append([0.0], np.full(x.shape[1] - 1, 0.5)) * m.weights[:, 0]
    assert np.abs(grad).max() < 1e-5
    laplace = functions.bayesian_logistic(whole, "y", ["x", "z", "b"], prior="laplace", variance=0.1)
    assert np.abs(laplace.weights[1:]).sum() < np.abs(m.weights[1:]).sum() * 1.5
    three = functions.logistic(whole.withColumn("y", F.concat("y", F.when(F.col("a") == "p", "p").otherwise(""))).limit(90), "y", ["x", "a"])
    s = three.scores(t)
    assert s.shape[1] == 4 and np.allclose(s.sum(1), 1)


def test_margins_are_at_the_best(whole):
    m = functions.linear_svm(whole, "y", ["x", "z"])
    t = whole.toPandas()
    x, y = m.design(t), np.where(t["y"] == "yes", 1.0, -1.0)
    w = m.weights[:, 1]
    slack = np.maximum(1 - y * (x @ w), 0)
    free = np.append([1e-6], np.ones(x.shape[1] - 1))
    assert np.abs(free * w - 2 * x.T @ (y * slack)).max() < 1e-6
    r = functions.svm_regression(whole, "t", ["x", "z"], epsilon=0.05)
    x = r.design(t)
    e = t["t"].to_numpy() - x @ r.weights
    assert np.abs(free * r.weights - 2 * x.T @ (np.sign(e) * np.maximum(np.abs(e) - 0.05, 0))).max() < 1e-5


def test_gaussian_process(whole):
    t, _ = arrays(whole)
    m = functions.gaussian_process(whole, "t", ["x", "z"], kernel=functions.rbf_kernel(0.5), noise=0.7)
    z = np.column_stack([(t[c] - t[c].mean()) / t[c].std(ddof=0) for c in ("x", "z")])
    k = functions.rbf_kernel(0.5)(z, z)
    want = t["t"].mean() + k @ np.linalg.solve(k + 0.49 * np.eye(len(t)), t["t"] - t["t"].mean())
    got = numbers(m, whole)
    assert np.allclose([got[i] for i in t["k"]], want, atol=1e-3)
    small = functions.gaussian_process(whole, "t", ["x", "z"], kernel=functions.rbf_kernel(0.5), noise=0.7, landmarks=40)
    got = numbers(small, whole)
    assert np.corrcoef([got[i] for i in t["k"]], want)[0, 1] > 0.99


def test_kernels():
    a, b = np.array([[1.0, 2.0]]), np.array([[3.0, -1.0], [1.0, 2.0]])
    assert np.allclose(functions.poly_kernel(2, True)(a, b), [[4, 36]])
    assert np.allclose(functions.normalised_poly_kernel(2)(a, b), [[1 / 50, 1]])
    assert np.allclose(functions.rbf_kernel(0.1)(a, b), [[math.exp(-1.3), 1]])
    assert np.allclose(functions.puk_kernel(1, 1)(a, b), [[1 / 53, 1]])
    assert functions.precomputed_kernel(np.arange(9.0).reshape(3, 3))(np.array([[2.0]]), np.array([[1.0], [0.0]])).tolist() == [[7, 6]]


def test_kernel_columns(whole):
    train = whole.limit(5)
    got = functions.kernel_columns(whole, train, ["x", "z"], functions.rbf_kernel(0.2)).collect()
    assert all(len(r["kernel"]) == 5 and 0 < min(r["kernel"]) and max(r["kernel"]) <= 1 + 1e-9 for r in got)


def test_online_learners(whole, spark):
    t = whole.toPandas()
    acc = lambda m: np.mean([r["prediction"] == r["y"] for r in m.transform(whole).collect()])
    assert acc(functions.voted_perceptron(whole, "y", ["x", "z"])) > 0.65
    assert acc(functions.simple_logistic(whole, "y", ["x", "z", "a"], rounds=10)) > 0.7
    assert acc(functions.rbf_network(whole, "y", ["x", "z"], clusters=3)) > 0.65
    rows = spark.createDataFrame([(i, str(i & 1), str(i >> 1 & 1), str(i >> 2 & 1), "t" if i & 1 or i >> 2 & 1 else "f") for i in range(8)] * 5, "k int, p string, q string, r string, y string")
    m = functions.winnow(rows, "y", ["p", "q", "r"], epochs=20)
    assert all(r["prediction"] == r["y"] for r in m.transform(rows).collect())
    number = functions.rbf_network(whole, "t", ["x", "z"], clusters=8)
    got = numbers(number, whole)
    assert np.corrcoef([got[k] for k in t["k"]], t["t"])[0, 1] > 0.8


# Bayes ---------------------------------------------------------------------------------------


def test_naive_bayes_and_updates(df):
    names = ["a", "b", "x", "z"]
    m = bayes.naive_bayes(df, "y", names)
    t = df.toPandas()
    row = t.iloc[3]
    logs = []
    for c in ("no", "yes"):
        p = t[t["y"] == c]
        s = math.log((len(p) + 1) / (len(t) + 2))
        for a, d in (("a", 3), ("b", 2)):
            if row[a] is not None:
                s += math.log(((p[a] == row[a]).sum() + 1) / (p[a].notna().sum() + d))
        for a in ("x", "z"):
            if not math.isnan(row[a]):
                mean, sd = p[a].mean(), p[a].std(ddof=0)
                s += -(((row[a] - mean) / sd) ** 2) / 2 - math.log(sd * math.sqrt(2 * math.pi))
        logs.append(s)
    want = np.exp(logs) / np.exp(logs).sum()
    assert np.allclose(dist(m, df)[row["k"]], want)
    part = bayes.naive_bayes(df.where("k % 2 = 0"), "y", names).update(df.where("k % 2 = 1"), "y")
    again, all_ = dist(part, df), dist(m, df)
    assert all(np.allclose(again[k], all_[k]) for k in all_)
    acc = lambda m: np.mean([r["prediction"] == r["y"] for r in m.transform(df).collect()])
    assert acc(bayes.naive_bayes_kernel(df, "y", names, precision=0.5)) > 0.6 and acc(bayes.naive_bayes_discretized(df, "y", names)) > 0.6
    em = bayes.semi_supervised_em(df.withColumn("y", F.when(F.col("k") % 3 > 0, F.col("y"))), "y", names, rounds=3)
    assert acc(em) > 0.55
    soft = df.withColumn("s", F.when(F.col("y") == "no", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    assert all(np.allclose(a, all_[k]) for k, a in dist(bayes.soft_naive_bayes(soft, "s", ["no", "yes"], names), df).items())


def words(spark):
    r = np.random.default_rng(5)
    rows = [(i, *[float(v) for v in r.poisson([3, 1, 1] if i % 3 else [1, 1, 3])], "u" if i % 3 else "v") for i in range(90)]
    return spark.createDataFrame(rows, "k int, w1 double, w2 double, w3 double, y string")


def test_multinomials(spark):
    rows, names = words(spark), ["w1", "w2", "w3"]
    t = rows.toPandas()
    x = t[names].to_numpy()
    s = {c: t[t["y"] == c][names].sum().to_numpy() for c in "uv"}
    logs = np.column_stack([math.log(((t["y"] == c).sum() + 1) / 92) + x @ np.log((s[c] + 1) / (s[c].sum() + 3)) for c in "uv"])
    got = dist(bayes.multinomial_bayes(rows, "y", names), rows)
    assert all(np.allclose(got[k], np.exp(v) / np.exp(v).sum()) for k, v in zip(t["k"], logs))
    half = bayes.multinomial_bayes(rows.where("k < 45"), "y", names).update(rows.where("k >= 45"), "y")
    assert all(np.allclose(v, got[k]) for k, v in dist(half, rows).items())
    c = bayes.complement_bayes(rows, "y", names)
    want = np.column_stack([-x @ np.log((s[o] + 1) / (s[o].sum() + 3)) for o in "vu"])
    assert all(r["prediction"] == "uv"[int(want[i].argmax())] for i, r in enumerate(sorted(c.transform(rows).collect(), key=lambda r: r["k"])))
    d = bayes.discriminative_multinomial(rows.coalesce(1), "y", names, epochs=2)
    assert np.mean([r["prediction"] == r["y"] for r in d.transform(rows).collect()]) > 0.8


def test_one_dependence(whole):
    names = ["a", "b", "c"]
    rows = whole.withColumn("c", F.when(F.col("x") > 20, "h").when(F.col("x") > 10, "m").otherwise("l"))
    t = rows.toPandas()
    size = {"a": 3, "b": 2, "c": 3}
    got = dist(bayes.aode(rows, "y", names), rows)
    for _, row in t.head(10).iterrows():
        total = np.zeros(2)
        for i in names:
            for k, y in enumerate(("no", "yes")):
                held = t[(t["y"] == y) & (t[i] == row[i])]
                p = (len(held) + 1 / (2 * size[i])) / (len(t) + 1)
                for j in names:
                    if j != i:
                        p *= ((held[j] == row[j]).sum() + 1 / size[j]) / (len(held) + 1)
                total[k] += p
        assert np.allclose(got[row["k"]], total / total.sum())
    acc = lambda m: np.mean([r["prediction"] == r["y"] for r in m.transform(rows).collect()])
    assert min(acc(bayes.weighted_aode(rows, "y", names)), acc(bayes.hidden_naive_bayes(rows, "y", names)), acc(bayes.aode_resolved(rows, "y", names, critical=5))) > 0.75
    p = bayes.Pairs(rows, "y", names, None)
    n = pd.crosstab(t["a"], [t["y"], t["c"]])
    info = 0.0
    for y in ("no", "yes"):
        m = n[y].to_numpy()
        for i in range(m.shape[0]):
            for j in range(m.shape[1]):
                if m[i, j]:
                    info += m[i, j] / len(t) * math.log2(m[i, j] * m.sum() / (m[i].sum() * m[:, j].sum()))
    assert p.conditional_information(0, 2) == pytest.approx(info)


def test_saved_models_and_no_rows(df, whole, tmp_path):
    m = bayes.naive_bayes(df, "y", ["a", "x"])
    base.save(m, df, str(tmp_path / "m"))
    again = base.load(df.sparkSession, str(tmp_path / "m"))
    assert all(np.allclose(v, dist(m, df)[k]) for k, v in dist(again, df).items())
    assert m.transform(df.limit(0)).count() == 0
    assert base.majority(df, "t").scores(pd.DataFrame({"x": [1, 2]})).shape == (2,)
    odd = base.Python(lambda x: np.column_stack([x["x"] > 5, x["x"] <= 5]).astype(float), ["x"], ["big", "small"])
    assert all((r["prediction"] == "big") == (r["x"] > 5) for r in odd.transform(whole).collect())
