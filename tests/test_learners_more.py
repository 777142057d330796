"""Rules, lazy learners, committees, clusterers and attribute search, on small tables."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_learners import dist, numbers, table

from millrace.learn import bayes, cluster, functions, lazy, meta, rules, select, trees


@pytest.fixture(scope="module")
def df(spark):
    held = table(spark, 120, 1, False).withColumn("c", F.when(F.col("x") > 20, "h").when(F.col("x") > 10, "m").otherwise("l")).cache()
    held.count()
    return held


@pytest.fixture(scope="module")
def three(spark):
    r = np.random.default_rng(3)
    rows = [(i, float(r.normal(3 * (i % 3), 0.6)), float(r.normal(2 * (i % 3 == 1), 0.6)), "pqr"[i % 3], "pqr"[i % 3] if r.random() < 0.9 else "p") for i in range(90)]
    held = spark.createDataFrame(rows, "k int, x double, z double, y string, a string").repartition(3).cache()
    held.count()
    return held


def acc(model, rows, target="y"):
    return np.mean([r["prediction"] == r[target] for r in model.transform(rows).collect()])


NAMES = ["a", "b", "x", "z"]


# Rules ---------------------------------------------------------------------------------------


def test_rule_learners(df, three):
    t = df.toPandas()
    perfect = rules.prism(df.withColumn("y", F.when((F.col("a") == "p") & (F.col("b") == "u"), "yes").otherwise("no")), "y", ["a", "b", "c"])
    assert all((r["prediction"] == "yes") == (r["a"] == "p" and r["b"] == "u") for r in perfect.transform(df).collect())
    base = max(t["y"].value_counts()) / len(t)
    assert acc(rules.conjunctive_rule(df, "y", NAMES), df) >= base - 1e-9
    assert acc(rules.part(df, "y", NAMES), df) > 0.85
    one = rules.one_r(df, "y", ["a", "b", "c"])
    best = max((sum(max(p["y"].value_counts()) for _, p in t.groupby(a)), -i) for i, a in enumerate(("a", "b", "c")))
    assert one.chosen == ("a", "b", "c")[-best[1]] and acc(one, df) == pytest.approx(best[0] / len(t))
    assert acc(rules.one_r(three, "y", ["x", "z"]), three) > 0.9
    shown = rules.decision_table(df, "y", ["a", "b", "c", "x"])
    assert acc(shown, df) > 0.7 and shown.chosen
    assert acc(rules.table_and_bayes(df, "y", ["a", "b", "c", "x"]), df) > 0.7
    got = numbers(rules.m5_rules(df, "t", ["x", "z"]), df)
    assert np.corrcoef([got[k] for k in t["k"]], t["t"])[0, 1] > 0.99
    assert rules.rule_bits(2, 10, 20, 1, 30, 2) > rules.rule_bits(2, 10, 20, 0, 30, 0)


def test_trees_with_models_at_their_leaves(df):
    t = df.toPandas()
    got = numbers(rules.linear_model_tree(df, "t", ["x", "z"]), df)
    assert np.corrcoef([got[k] for k in t["k"]], t["t"])[0, 1] > 0.99
    m = rules.linear_model_tree(df.withColumn("t", F.when(F.col("x") > 14, 5 * F.col("x")).otherwise(-3 * F.col("x"))), "t", ["x"], smooth=0.0)
    assert all(abs(r["prediction"] - (5 * r["x"] if r["x"] > 14 else -3 * r["x"])) < 6 for r in m.transform(df.drop("t")).collect())
    assert acc(rules.bayes_tree(df, "y", NAMES, least=15), df) > 0.7
    assert acc(rules.logistic_tree(df, "y", NAMES), df) > 0.75
    assert acc(rules.functional_tree(df, "y", NAMES), df) > 0.75


# Lazy ----------------------------------------------------------------------------------------


def test_neighbours(df):
    t = df.toPandas().sort_values("k").reset_index(drop=True)
    width = {c: t[c].max() - t[c].min() for c in ("x", "z")}
    d = sum(((t[c].to_numpy()[:, None] - t[c].to_numpy()[None]) / width[c]) ** 2 for c in ("x", "z")) + (t["a"].to_numpy()[:, None] != t["a"].to_numpy()[None])
    d = np.sqrt(d.astype(float))
    got = dist(lazy.ibk(df, "y", ["x", "z", "a"], k=3), df)
    for i, k in enumerate(t["k"]):
        near = d[i] <= np.sort(d[i])[2] + 1e-12
        assert np.allclose(got[k], [(t["y"][near] == c).mean() for c in ("no", "yes")])
    assert acc(lazy.ib1(df, "y", NAMES), df) == 1.0
    assert lazy.ibk(df, "y", NAMES, k=5, choose=True).k in range(1, 6)
    got = numbers(lazy.ibk(df, "t", ["x", "z"], k=4, weighting="inverse"), df)
    assert np.corrcoef([got[k] for k in t["k"]], t["t"])[0, 1] > 0.95
    assert acc(lazy.k_star(df, "y", NAMES), df) > 0.85 and acc(lazy.locally_weighted(df, "y", NAMES, k=30), df) > 0.75
    assert acc(lazy.lazy_rules(df, "y", ["a", "b", "c"]), df) > 0.75
    line = numbers(lazy.locally_weighted(df, "t", ["x", "z"], k=20), df)
    assert np.allclose([line[k] for k in t["k"]], 2 * t["x"] - 3 * t["z"] + 5, atol=0.6)
    joined = {r["k"]: r["prediction"] for r in lazy.join(df, df, "y", ["x", "z"], 2, "k", "k").collect()}
    flat = np.sqrt(sum(((t[c].to_numpy()[:, None] - t[c].to_numpy()[None]) / width[c]) ** 2 for c in ("x", "z")))
    np.fill_diagonal(flat, np.inf)
    for i, k in enumerate(t["k"]):
        near = flat[i] <= np.sort(flat[i])[1] + 1e-12
        n = t["y"][near].value_counts()
        assert joined[k] == min(n.index, key=lambda c: (-n[c], c))


# Committees ----------------------------------------------------------------------------------


def test_votes_and_draws(df):
    one, two = bayes.naive_bayes(df, "y", NAMES), trees.decision_stump(df, "y", NAMES)
    a, b = dist(one, df), dist(two, df)
    both = dist(meta.vote(df, "y", NAMES, schemes=[bayes.naive_bayes, trees.decision_stump]), df)
    assert all(np.allclose(both[k], (a[k] + b[k]) / 2) for k in a)
    for rule, f in (("max", np.max), ("min", np.min), ("product", np.prod)):
        got = dist(meta.Committee([one, two], ["no", "yes"], rule=rule), df)
        assert all(np.allclose(got[k], f([a[k], b[k]], 0) / f([a[k], b[k]], 0).sum()) for k in a)
    n = [r["w"] for r in meta.drawn(df, 1, 0).groupBy().agg(F.sum(meta.W).alias("w")).collect()][0]
    assert 80 < n < 160
    assert acc(meta.bagging(df, "y", NAMES, base=trees.j48, members=3), df) > 0.8
    assert acc(meta.dagging(df, "y", NAMES, base=trees.decision_stump, members=3), df) > 0.5
    assert acc(meta.random_committee(df, "y", NAMES, members=3), df) > 0.9
    assert acc(meta.random_subspace(df, "y", NAMES, base=trees.j48, members=3), df) > 0.7
    assert acc(meta.rotation_forest(df, "y", ["x", "z"], members=2), df) > 0.65


def test_adaboost_by_hand(df):
    t = df.toPandas().set_index("k")
    model = meta.adaboost_m1(df, "y", ["a", "b"], base=trees.decision_stump, members=3)
    w, votes = pd.Series(1.0, t.index), []
    for m in model.members:
        s = m.scores(t)
        right = np.array(m.classes)[s.argmax(1)] == t["y"]
        e = w[~right].sum() / w.sum()
        votes.append(math.log((1 - e) / e))
        total = w.sum()
        w = w.where(right, w * (1 - e) / e)
        w *= total / w.sum()
    assert np.allclose(model.weights, votes)
    assert acc(meta.multiboost(df, "y", NAMES, members=4), df) > 0.6


def test_additive_models(df):
    t = df.toPandas()
    m = meta.additive_regression(df, "t", ["x", "z"], rounds=4)
    rest = t["t"] - t["t"].mean()
    for s in m.rounds:
        part = s.scores(t)
        assert abs(np.mean(rest[part == part.min()]) - part.min()) < 1e-6
        rest = rest - part
    assert np.allclose(m.scores(t), t["t"] - rest)
    b = meta.logit_boost(df, "y", NAMES, rounds=4)
    q = dist(b, df)
    assert acc(b, df) > 0.75 and all(abs(v.sum() - 1) < 1e-9 for v in q.values())
    assert acc(meta.raced_logit_boost(df, "y", NAMES, chunks=(1, 2)), df) > 0.5


def test_stacks(df, three):
    two = [bayes.naive_bayes, lambda d, t, a, w=None: trees.j48(d, t, a, w)]
    assert acc(meta.stacking(df, "y", NAMES, schemes=two, folds=2), df) > 0.75
    assert acc(meta.stacking_c(three, "y", ["x", "z"], schemes=two, folds=2), three) > 0.85
    assert acc(meta.grading(df, "y", NAMES, schemes=two, folds=2), df) > 0.75
    better = meta.multi_scheme(df, "y", NAMES, schemes=[lambda d, t, a, w=None: __import__("millrace.learn.base", fromlist=["x"]).majority(d, t, a, w), trees.j48], folds=2)
    assert isinstance(better, trees.TreeModel)
    grid = meta.parameter_selection(df, "y", NAMES, scheme=trees.j48, grid={"least": [2.0, 40.0]}, folds=2)
    assert acc(grid, df) > 0.7
    number = meta.stacking(df, "t", ["x", "z"], schemes=[functions.simple_linear_regression, trees.rep_tree], folds=2)
    t = df.toPandas()
    got = numbers(number, df)
    assert np.corrcoef([got[k] for k in t["k"]], t["t"])[0, 1] > 0.95


def test_costs_and_thresholds(df):
    cost = [[0, 1], [9, 0]]  # a missed yes costs nine
    plain, dear = bayes.naive_bayes(df, "y", NAMES), meta.cost_sensitive(df, "y", NAMES, scheme=bayes.naive_bayes, cost=cost)
    yes = lambda m: sum(r["prediction"] == "yes" for r in m.transform(df).collect())
    assert yes(dear) > yes(plain)
    least = meta.cost_sensitive(df, "y", NAMES, scheme=bayes.naive_bayes, cost=cost, expected=True)
    p = dist(plain, df)
    assert all((r["prediction"] == "yes") == (9 * p[r["k"]][1] > p[r["k"]][0]) for r in least.transform(df).collect())
    assert yes(meta.meta_cost(df, "y", NAMES, scheme=bayes.naive_bayes, cost=cost, members=2)) > yes(plain)
    held = meta.cost_weights(df, "y", ["no", "yes"], np.array(cost, float)).groupBy("y").agg(F.sum(meta.W).alias("w")).collect()
    n = dict(df.toPandas()["y"].value_counts())
    w = {r["y"]: r["w"] for r in held}
    assert w["yes"] / w["no"] == pytest.approx(9 * n["yes"] / n["no"]) and sum(w.values()) == pytest.approx(120)
    th = meta.threshold_selector(df, "y", NAMES, scheme=bayes.naive_bayes, positive="yes", folds=2)
    assert all((r["prediction"] == "yes") == (p[r["k"]][1] >= th.at) for r in th.transform(df).collect())
    assert set(np.unique(np.array(list(dist(meta.Certain(plain), df).values())))) == {0.0, 1.0}


def test_many_classes(three):
    x = ["x", "z"]
    for method in ("rest", "pairs", "random", "exhaustive"):
        assert acc(meta.multi_class(three, "y", x, scheme=functions.logistic, method=method), three) > 0.85
    assert acc(meta.ordinal(three, "y", x, scheme=functions.logistic), three) > 0.85
    assert acc(meta.via_regression(three, "y", x, scheme=trees.rep_tree), three) > 0.8
    assert acc(meta.via_clustering(three, "y", x), three) > 0.85
    for balance in ("none", "classes", "rows"):
        assert acc(meta.nested_dichotomy(three, "y", x, scheme=functions.logistic, balance=balance), three) > 0.8
    assert acc(meta.nested_dichotomies(three, "y", x, scheme=functions.logistic, members=2), three) > 0.85


def test_wrappers(df):
    t = df.toPandas()
    got = numbers(meta.by_discretization(df, "t", ["x", "z"], bins=6), df)
    assert np.corrcoef([got[k] for k in t["k"]], t["t"])[0, 1] > 0.85
    from millrace.operators import columns as C
    from millrace.plans import filters as P

    m = meta.filtered(df.where("k % 2 = 0"), "y", NAMES, step=P.step(C.normalize, ["x"]), scheme=trees.decision_stump)
    low, high = (df.where("k % 2 = 0").agg(f("x")).first()[0] for f in (F.min, F.max))
    same = m.model.transform(df.withColumn("x", (F.col("x") - low) / (high - low))).select("k", "prediction").collect()
    assert {r["k"]: r["prediction"] for r in m(df).collect()} == {r["k"]: r["prediction"] for r in same}
    chosen = meta.attribute_selected(df, "y", ["a", "b", "c"], scheme=bayes.naive_bayes, choose=lambda d, y, a: select.fcbf(d, y, a)[:1])
    assert len(chosen.attributes) == 1


def test_diverse_and_active(df):
    m = meta.decorate(df, "y", NAMES, members=2, tries=3)
    assert acc(m, df) > 0.8
    crowd = meta.bagging(df, "y", NAMES, base=trees.decision_stump, members=3)
    p = dist(crowd, df)
    top = meta.most_useful(crowd, df, 5, ["k"]).collect()
    margins = sorted((abs(v[0] - v[1]), k) for k, v in p.items())
    assert [r["k"] for r in top] == [k for _, k in sorted(margins, key=lambda t: (round(t[0], 12), t[1]))[:5]]
    assert meta.query_by_boosting(df, "y", NAMES, df, 3, ["k"], members=2).count() == 3
    assert meta.most_useful(crowd, df, 4, ["k"], "disagreement").count() == 4
    lib = meta.ensemble_selection(df, "y", NAMES, library=[bayes.naive_bayes, trees.decision_stump, trees.j48], rounds=4)
    assert acc(lib, df) > 0.7 and lib.weights.sum() == 4
    number = meta.decorate(df, "t", ["x", "z"], base=trees.rep_tree, members=2, tries=2)
    t = df.toPandas()
    got = numbers(number, df)
    assert np.corrcoef([got[k] for k in t["k"]], t["t"])[0, 1] > 0.8
    r = meta.bias_and_variance(df, "y", NAMES, trees.decision_stump, ["k"], rounds=3).first()
    assert r["error"] == pytest.approx(r["bias"] + r["variance"])


# Clusters ------------------------------------------------------------------------------------


def test_k_means_and_mixtures(three):
    t = three.toPandas().sort_values("k")
    m = cluster.k_means(three, ["x", "z"], 3)
    z = m.space(t)
    at = ((z[:, None] - m.centres[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(m.centres, [z[at == i].mean(0) for i in range(3)])
    med = cluster.k_means(three, ["x", "z"], 3, metric="manhattan")
    at = np.abs(z[:, None] - med.centres[None]).sum(2).argmin(1)
    assert np.allclose(med.centres, [[np.sort(z[at == i][:, j])[(np.sum(at == i) - 1) // 2] for j in range(2)] for i in range(3)], atol=1e-6)
    e = cluster.em(three, ["x", "z", "a"], 3, rounds=10)
    start = cluster._mixture(three.select("x", "z", "a"), e.table, ["x", "z", "a"], cluster.k_means(three, ["x", "z", "a"], 3, rounds=5).scores, 3, 1e-6)
    assert e.likelihood(three) >= start.likelihood(three) - 1e-9
    assert abs(np.exp(e.logs(t)).sum(1) - np.exp(np.logaddexp.reduce(e.logs(t), 1))).max() < 1e-9
    one = cluster.em(three, ["x"], 1)
    want = -((t["x"] - t["x"].mean()) ** 2) / (2 * t["x"].var(ddof=0)) - 0.5 * math.log(2 * math.pi * t["x"].var(ddof=0))
    assert one.likelihood(three) == pytest.approx(want.mean())
    assert len(cluster.em_chosen(three, ["x", "z"], most=3, folds=2, rounds=5).classes) >= 2
    d = cluster.densities(three, ["x", "z"], m)
    assert cluster.memberships(three, d).select("pCluster_2").count() == 90
    assert cluster.add_cluster(three, m).where("cluster is null").count() == 0
    for how in ("random", "perturbed"):
        assert len(cluster.k_means(three, ["x", "z"], 3, how=how, rounds=3).classes) == 3


def plain_near(t, cols, eps):
    x = np.column_stack([(t[c] - t[c].min()) / (t[c].max() - t[c].min()) for c in cols])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return d, (d <= eps) & ~np.eye(len(t), dtype=bool)


def test_dbscan_and_optics(three):
    t = three.toPandas().sort_values("k").reset_index(drop=True)
    d, near = plain_near(t, ["x", "z"], 0.08)
    got = {(r["a"], r["b"]) for r in cluster.near_pairs(three, "k", ["x", "z"], 0.08).collect()}
    assert got == {(int(t["k"][i]), int(t["k"][j])) for i, j in zip(*np.nonzero(near))}
    core = near.sum(1) + 1 >= 4
    label = np.where(core, np.arange(len(t)), -1)
    for _ in range(len(t)):
        for i, j in zip(*np.nonzero(near)):
            if core[i] and core[j]:
                label[i] = label[j] = min(label[i], label[j])
    found = {r["k"]: r["cluster"] for r in cluster.dbscan(three, "k", ["x", "z"], 0.08, 4).collect()}
    for i, k in enumerate(t["k"]):
        if core[i]:
            assert found[k] == t["k"][label[i]]
        elif (near[i] & core).any():
            j = min(np.flatnonzero(near[i] & core), key=lambda j: (d[i, j], label[j]))
            assert found[k] == t["k"][label[j]]
        else:
            assert found[k] is None
    order = cluster.optics(three, "k", ["x", "z"], 0.08, 4).orderBy("place").collect()
    assert sorted(r["k"] for r in order) == sorted(t["k"]) and sum(r["core"] is not None for r in order) == core.sum()
    starts = sum(r["reachability"] is None for r in order)
    assert starts == len({label[i] for i in np.flatnonzero(core)}) + sum(found[k] is None for k in t["k"]) or starts >= 1


def test_other_clusterers(three, spark, df):
    m = cluster.cobweb(three, ["x", "z", "a"], ["k"], acuity=0.3, cutoff=0.01)
    assert m.root.n == 90 and 2 <= len(m.classes) < 180
    assert all(abs(c.n - sum(x.n for x in c.children)) < 1e-9 for c in [m.root] if c.children)
    baskets = spark.createDataFrame([(i, ["a", "b", "c"] if i % 2 else ["x", "y"]) for i in range(20)] + [(99, [])], "k int, items array<string>")
    got = {r["k"]: r["cluster"] for r in cluster.clope(baskets, "k", "items").collect()}
    assert len(set(got.values())) == 2 and all(got[i] == got[i % 2] for i in range(20)) and 99 not in got
    words = spark.createDataFrame([(i, 9.0 if i % 2 else 0.0, 1.0, 0.0 if i % 2 else 7.0) for i in range(30)], "k int, u double, v double, w double")
    b = cluster.information_bottleneck(words, "k", ["u", "v", "w"], 2)
    got = {r["k"]: r["prediction"] for r in b.transform(words).collect()}
    assert all(got[i] == got[i % 2] for i in range(30)) and got[0] != got[1]
    cut = {r["k"]: r["cluster"] for r in cluster.spectral(three, "k", ["x", "z"], 3, gamma=30).collect()}
    y = {r["k"]: r["y"] for r in three.collect()}
    assert sum(max(sum(y[k] == c for k in cut if cut[k] == i) for c in "pqr") for i in range(3)) > 75
    apply, inner = cluster.filtered_clusterer(three, lambda d: d.select("k", "x"), lambda d: cluster.k_means(d, ["x"], 2))
    assert inner.transform(apply(three)).count() == 90


def test_constraints(three):
    links = three.sparkSession.createDataFrame([(0, 3, 1), (3, 6, 1), (1, 4, 1), (0, 1, -1), (2, 5, 1), (1, 2, -1), (0, 89, -1)], "a int, b int, link int")
    for order, metric in (("simple", "none"), ("random", "euclidean"), ("sorted", "mahalanobis"), ("global", "gradient"), ("simple", "cosine"), ("simple", "kl")):
        got, model = cluster.constrained_k_means(three, "k", ["x", "z"], links, 3, weight=5.0, order=order, metric=metric, rounds=8, regular="rayleigh" if metric == "gradient" else "none")
        assert got.count() == 90 and len(model.classes) == 3
        if metric == "none":
            r = cluster.broken_links(got, links, "k").first()
            assert r["must"] + r["cannot"] <= 1
    space = cluster.Space(three, ["x", "z"])
    c = cluster.seeded_centres(three, space, "k", three.where("k < 30").select("k", F.col("y").alias("label")))
    t = three.where("k < 30").toPandas()
    assert np.allclose(c, [space(t[t["y"] == y]).mean(0) for y in "pqr"])


# Selection -----------------------------------------------------------------------------------


def test_relief_by_hand(df):
    t = df.toPandas().sort_values("k").reset_index(drop=True)
    width = {c: t[c].max() - t[c].min() for c in ("x", "z")}
    diff = {c: np.abs(t[c].to_numpy()[:, None] - t[c].to_numpy()[None]) / width[c] for c in ("x", "z")}
    diff["a"] = (t["a"].to_numpy()[:, None] != t["a"].to_numpy()[None]).astype(float)
    d = np.sqrt(sum(v**2 for v in diff.values()))
    np.fill_diagonal(d, np.inf)
    y, want = t["y"].to_numpy(), dict.fromkeys(diff, 0.0)
    for i in range(len(t)):
        for c in ("no", "yes"):
            others = np.flatnonzero((y == c) & (np.arange(len(t)) != i))
            near = others[d[i, others] <= np.sort(d[i, others])[2] + 1e-12]
            for a in diff:
                want[a] += (-1 if c == y[i] else 1) * diff[a][i, near].mean() / len(t)
    got = select.relief(df, "y", ["x", "z", "a"], "k", neighbours=3)
    assert all(got[a] == pytest.approx(want[a], abs=1e-6) for a in diff)


def test_searches():
    names = list("abcdefg")
    worth = {"a": 3, "b": 2, "c": -1, "d": 0.5, "e": -2, "f": 1, "g": -0.5}
    merit = select.remembered(lambda s: sum(worth[a] for a in s) - (4 if {"a", "f"} <= s else 0))
    every = [frozenset(c) for n in range(8) for c in itertools.combinations(names, n)]
    best = sorted(max(every, key=merit))
    assert best == ["a", "b", "d"] == select.exhaustive(names, merit) == select.greedy(names, merit) == select.best_first(names, merit)
    assert select.linear_forward(names, merit, 4) == best and select.linear_forward(names, merit, 2, fixed=False) == best
    assert select.rank_search(["a", "b", "d", "f", "g", "c", "e"], merit) == best
    assert select.scatter_search(names, merit) == best and select.genetic_search(names, merit, generations=30, population=30) == best
    assert merit(frozenset(select.random_search(names, merit, 1.0))) >= 4
    assert select.greedy(names, merit, backward=True) == best and select.best_first(names, merit, backward=True) == best
    assert select.greedy(names, merit, n=2) == ["a", "b"]


def test_merits(df):
    assert select.exhaustive(["a", "b", "c"], select.consistency_merit(df, "y")) == ["a", "b", "c"]
    assert set(select.forward(["a", "b", "c"], select.correlation_merit(df, "y"))) <= {"a", "b", "c"}
    assert "c" in select.greedy(["a", "c"], select.wrapper_merit(df, "y", bayes.naive_bayes, 2))
    assert "c" in select.greedy(["a", "c"], select.classifier_merit(df.where("k % 2 = 0"), df.where("k % 2 = 1"), "y", bayes.naive_bayes))
    m = select.cost_merit(df, "y", [[0, 1], [3, 0]], select.consistency_merit)
    assert 0.5 < m(frozenset(["a"])) <= 1
    assert select.filtered_merit(df, "y", lambda d: d.where("z > -9"), select.consistency_merit)(frozenset(["a", "b"])) <= 1
    assert select.fcbf(df.withColumn("c2", F.col("c")), "y", ["c", "c2", "b"])[0] == "c" and "c2" not in select.fcbf(df.withColumn("c2", F.col("c")), "y", ["c", "c2", "b"])
    assert select.svm_ranks(df, "y", ["z", "x"])[0] == "x"
    assert len(select.subset_size_forward(df, "y", ["a", "b", "c"], select.consistency_merit, 2, folds=2)) <= 2
    n = select.selected_by_folds(df, "y", ["a", "b", "c"], lambda d: select.fcbf(d, "y", ["a", "b", "c"])[:1], folds=2)
    assert sum(n.values()) == 2
    ranked = select.cost_scores(df, ["a", "c"], "y", [[0, 1], [5, 0]]).collect()
    assert {r["name"] for r in ranked} == {"a", "c"}
    assert select.filtered_scores(df, ["a", "b", "c"], "y", lambda d: d.drop("b")).count() == 2


def test_transforms(df):
    t = df.toPandas().sort_values("k")
    x = t[["x", "z"]].to_numpy()
    f = select.latent_semantics(df, ["x", "z"], 2)
    got = f(df.select("k", "x", "z")).toPandas().sort_values("k")[["LSA_1", "LSA_2"]].to_numpy()
    assert np.allclose(f.values, np.linalg.svd(x, compute_uv=False)) and np.allclose((got**2).sum(0), f.values**2)
    r = np.random.default_rng(1)
    s = r.uniform(-1, 1, (400, 2))
    mixed = df.sparkSession.createDataFrame([(i, *map(float, v)) for i, v in enumerate(s @ np.array([[2.0, 1.0], [1.0, -1.0]]))], "k int, p double, q double")
    got = select.independent_components(mixed, ["p", "q"])(mixed).toPandas().sort_values("k")[["IC_1", "IC_2"]].to_numpy()
    c = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert c.max(0).min() > 0.95
    w, h = r.random((60, 2)), r.random((2, 3))
    low = df.sparkSession.createDataFrame([(i, *map(float, v)) for i, v in enumerate(w @ h)], "k int, p double, q double, r double")
    apply, parts = select.nonnegative_factors(low, ["p", "q", "r"], 2, rounds=40)
    got = apply(low).toPandas().sort_values("k")[["NMF_1", "NMF_2"]].to_numpy()
    assert np.abs(got @ parts - w @ h).mean() < 0.03 and (parts >= 0).all()
