"""Assignment all at once against all assignments, and the buying of values."""

import itertools

import numpy as np
import pytest
from millrace.learn import bayes, cluster, meta
from millrace.learn.cluster import _by_messages, _by_program
from millrace.plans import experiment


def cost(d, at, links, weight):
    return sum(d[i, c] for i, c in enumerate(at)) + sum(weight * ((at[a] == at[b]) != (link == 1)) for a, b, link in links)


def cheapest(d, links, weight):
    return min(cost(d, at, links, weight) for at in itertools.product(range(d.shape[1]), repeat=len(d)))


def test_chains_and_trees_are_assigned_at_the_least_cost():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n, k = int(rng.integers(2, 7)), int(rng.integers(1, 4))
        d, weight = rng.random((n, k)), float(rng.random() * 1.5)
        links = [(int(rng.integers(0, i)), i, int(rng.choice([-1, 1]))) for i in range(1, n)]
        best = cheapest(d, links, weight)
        assert cost(d, _by_messages(d, links, weight), links, weight) == pytest.approx(best)
        assert cost(d, _by_program(d, links, weight), links, weight) == pytest.approx(best)


def test_must_links_in_rings_are_assigned_at_the_least_cost_of_two_clusters():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(3, 8))
        d, weight = rng.random((n, 2)), float(rng.random())
        links = [(a, b, 1) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        assert cost(d, _by_program(d, links, weight), links, weight) == pytest.approx(cheapest(d, links, weight))


def test_edges_of_assignment():
    d = np.array([[0.0, 1.0], [0.2, 0.9], [0.4, 0.5]])
    for assign in (_by_messages, _by_program):
        assert assign(d, [], 1.0).tolist() == [0, 0, 0]
        assert assign(d, [(0, 2, -1), (0, 2, -1)], 5.0).tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        _by_program(d, [(0, 1, 1)], 1.0, most=3)


def test_constrained_clusters(spark):
    rows = spark.createDataFrame([(i, [0.0, 4.0, 8.0][i % 3] + (i % 5) / 10) for i in range(30)], "k int, x double")
    links = spark.createDataFrame([(0, 3, 1), (3, 6, 1), (0, 1, -1), (1, 2, -1), (2, 99, 1)], "a int, b int, link int")
    for order in ("belief", "program"):
        got = cluster.constrained_k_means(rows, "k", ["x"], links, 3, order=order, rounds=6)[0]
        at = {r["k"]: r["cluster"] for r in got.collect()}
        assert all(at[i] == at[i % 3] for i in range(30)) and len(set(at.values())) == 3


def test_values_are_bought_where_the_label_leads_least(spark):
    rows = spark.createDataFrame([(i, float(i % 4), float(i % 2), "ab"[i % 2]) for i in range(40)] + [(40, 1.0, 1.0, None)], "k int, cheap double, dear double, y string")
    model = bayes.naive_bayes(rows.where("y is not null"), "y", ["cheap", "dear"])
    odd = spark.createDataFrame([(1, 0.0, 0.0, "b"), (2, 0.0, 0.0, "a"), (3, 1.0, 1.0, None), (4, 0.0, 0.0, "new")], "k int, cheap double, dear double, y string")
    got = meta.features_wanted(model, odd, 9, ["k"], "y").collect()
    assert {r["k"] for r in got[:2]} == {1, 4} and [r["k"] for r in got[2:]] == [2]
    assert meta.features_wanted(model, odd.limit(0), 9, ["k"], "y").count() == 0
    asked = []

    def choose(known, pool, n):
        assert known.count() == 40 and pool.where("dear is not null").count() == 0
        more = meta.features_wanted(bayes.naive_bayes(known, "y", ["cheap", "dear"]), pool, n, ["k"], "y")
        asked.append({r["k"] for r in more.collect()})
        return more

    curve = experiment.acquisition_curve(rows, "y", ["cheap", "dear"], ["dear"], "k", choose, bayes.naive_bayes, 10, 20, 9, rows.where("y is not null")).collect()
    assert [r["complete"] for r in curve] == [10, 30, 40] and not asked[0] & asked[1] and curve[-1]["accuracy"] > 0.9
