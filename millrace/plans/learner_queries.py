"""Queries of learners, clusterers, mining and experiments. Those whose answer SQL can state have it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from millrace.learn import base, bayes, cluster, functions, instances, lazy, meta, networks, rules, select, trees
from millrace.operators import metrics, mining, similarity, text
from millrace.operators import records as K
from millrace.plans import experiment
from millrace.plans.catalog import _register, query, table
from millrace.plans.mining_queries import _rounded
from millrace.sources import generators

_N = ["l_quantity", "l_tax"]


def _lines(t):
    return t.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("l_line"))


def _shares(model, t, *keep):
    """The rows' predictions with each class's share."""
    held = model.transform(t)
    return _rounded(held.select(*keep, "prediction", *[F.get("distribution", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(model.classes)]), *[f"p_{c}" for c in model.classes], places=6)


_LS = (
    "WITH m AS (SELECT avg(l_quantity) AS a, avg(l_tax) AS b, avg(l_extendedprice) AS c, var_pop(l_quantity) AS s11, var_pop(l_tax) AS s22, covar_pop(l_quantity, l_tax) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1, covar_pop(l_tax, l_extendedprice) AS s2 FROM lineitem), "
    "w AS (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS u, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS v FROM m) SELECT l_orderkey, l_linenumber, round(c + u * (l_quantity - a) + v * (l_tax - b), 2) AS prediction FROM lineitem, w"
)
_register("linear_regression", "lineitem", lambda t: _rounded(functions.linear_regression(t, "l_extendedprice", _N, select="none").transform(t).select("l_orderkey", "l_linenumber", "prediction"), "prediction", places=2), _LS)
_register("partial_least_squares", "lineitem", lambda t: _rounded(functions.pls_regression(t, "l_extendedprice", _N, components=2).transform(t).select("l_orderkey", "l_linenumber", "prediction"), "prediction", places=2), _LS)
_register("pace_regression", "lineitem", lambda t: _rounded(functions.pace_regression(t, "l_extendedprice", _N, estimator="ols").transform(t).select("l_orderkey", "l_linenumber", "prediction"), "prediction", places=2), _LS)
_register("simple_line", "lineitem", lambda t: _rounded(functions.simple_linear_regression(t, "l_extendedprice", _N).transform(t).select("l_orderkey", "l_linenumber", "prediction"), "prediction", places=2), "SELECT l_orderkey, l_linenumber, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity, 2) AS prediction FROM lineitem")
_register("mean_rule", "part", lambda t: _rounded(base.majority(t, "p_retailprice").transform(t).select("p_partkey", "prediction"), "prediction"), "SELECT p_partkey, round((SELECT avg(p_retailprice) FROM part), 6) AS prediction FROM part")
_register("majority_shares", "lineitem", lambda t: _shares(base.majority(t, "l_returnflag"), t, "l_orderkey"), "WITH n AS (SELECT count(*) FILTER (l_returnflag = 'A') + 1.0 AS a, count(*) FILTER (l_returnflag = 'N') + 1.0 AS n, count(*) FILTER (l_returnflag = 'R') + 1.0 AS r FROM lineitem) SELECT l_orderkey, CASE greatest(a, n, r) WHEN a THEN 'A' WHEN n THEN 'N' ELSE 'R' END AS prediction, round(a / (a + n + r), 6) AS \"p_A\", round(n / (a + n + r), 6) AS \"p_N\", round(r / (a + n + r), 6) AS \"p_R\" FROM lineitem, n")

_COUNTS = "WITH c AS (SELECT l_returnflag AS y, count(*) AS n, sum(l_quantity) AS q, sum(l_linenumber) AS w FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n, sum(q) AS q, sum(w) AS w FROM c) "
_MN = "s AS (SELECT k, l_orderkey, l_quantity, l_linenumber, y, ({}) AS s FROM (SELECT row_number() OVER () AS k, * FROM lineitem) l, c, t), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY k)) AS e FROM (SELECT DISTINCT l_quantity, l_linenumber, y, s, l_quantity * 10 + l_linenumber AS k FROM s)) "
_register(
    "word_shares", "lineitem", lambda t: _shares(bayes.multinomial_bayes(t, "l_returnflag", ["l_quantity", "l_linenumber"]), t.select("l_quantity", "l_linenumber").distinct(), "l_quantity", "l_linenumber").drop("prediction"),
    _COUNTS + ", x AS (SELECT DISTINCT l_quantity, l_linenumber FROM lineitem), s AS (SELECT l_quantity, l_linenumber, y, ln((c.n + 1) / (t.n + 3)) + l_quantity * ln((c.q + 1) / (c.q + c.w + 2)) + l_linenumber * ln((c.w + 1) / (c.q + c.w + 2)) AS s FROM x, c, t), "
    "e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY l_quantity, l_linenumber)) AS e FROM s) SELECT l_quantity, l_linenumber, " + ", ".join(f"round(sum(e) FILTER (y = '{v}') / sum(e), 6) AS \"p_{v}\"" for v in "ANR") + " FROM e GROUP BY 1, 2",
)
_register(
    "complement_shares", "lineitem", lambda t: _shares(bayes.complement_bayes(t, "l_returnflag", ["l_quantity", "l_linenumber"]), t.select("l_quantity", "l_linenumber").distinct(), "l_quantity", "l_linenumber").drop("prediction"),
    _COUNTS + ", x AS (SELECT DISTINCT l_quantity, l_linenumber FROM lineitem), s AS (SELECT l_quantity, l_linenumber, y, -l_quantity * ln((t.q - c.q + 1) / (t.q - c.q + t.w - c.w + 2)) - l_linenumber * ln((t.w - c.w + 1) / (t.q - c.q + t.w - c.w + 2)) AS s FROM x, c, t), "
    "e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY l_quantity, l_linenumber)) AS e FROM s) SELECT l_quantity, l_linenumber, " + ", ".join(f"round(sum(e) FILTER (y = '{v}') / sum(e), 6) AS \"p_{v}\"" for v in "ANR") + " FROM e GROUP BY 1, 2",
)
_NB = "WITH c AS (SELECT l_returnflag AS y, count(*) AS n, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem{w} GROUP BY 1), v AS (SELECT l_returnflag AS y, l_linestatus AS v, count(*) AS k FROM lineitem{w} GROUP BY 1, 2), x AS (SELECT DISTINCT l_quantity, l_linestatus FROM lineitem), l AS (SELECT x.*, c.y, ln((n + 1) / ((SELECT sum(n) FROM c) + 3)) - ((l_quantity - m) / s) ** 2 / 2 - ln(s) + ln((coalesce(k, 0) + 1) / (n + 2)) AS s FROM x CROSS JOIN c LEFT JOIN v ON v.y = c.y AND v.v = x.l_linestatus), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY l_quantity, l_linestatus)) AS e FROM l) SELECT l_quantity, l_linestatus, " + ", ".join(f"round(sum(e) FILTER (y = '{v}') / sum(e), 6) AS \"p_{v}\"" for v in "ANR") + " FROM e GROUP BY 1, 2"


def _distinct(t):
    return t.select("l_quantity", "l_linestatus").distinct()


_NAMES = ["l_quantity", "l_linestatus"]
_register("class_shares", "lineitem", lambda t: _shares(bayes.naive_bayes(t, "l_returnflag", _NAMES), _distinct(t), *_NAMES).drop("prediction"), _NB.replace("{w}", ""))
_register("updated_shares", "lineitem", lambda t: _shares(bayes.naive_bayes(t.where("l_orderkey % 2 = 0"), "l_returnflag", _NAMES).update(t.where("l_orderkey % 2 = 1"), "l_returnflag"), _distinct(t), *_NAMES).drop("prediction"), _NB.replace("{w}", ""))
_register("soft_shares", "lineitem", lambda t: _shares(bayes.soft_naive_bayes(t.withColumn("s", F.array(*[F.when(F.col("l_returnflag") == v, 1.0).otherwise(0.0) for v in "ANR"])), "s", ["A", "N", "R"], _NAMES), _distinct(t), *_NAMES).drop("prediction"), _NB.replace("{w}", ""))
_ODE = (
    "WITH b AS (SELECT l_returnflag AS y, l_linestatus AS a, CAST(l_linenumber AS VARCHAR) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT sum(n) AS t FROM b), x AS (SELECT DISTINCT a, b FROM b), y AS (SELECT DISTINCT y FROM b), "
    "p AS (SELECT x.a, x.b, y.y, coalesce(sum(n) FILTER (b.a = x.a AND b.b = x.b), 0) AS ab, coalesce(sum(n) FILTER (b.a = x.a), 0) AS na, coalesce(sum(n) FILTER (b.b = x.b), 0) AS nb FROM x CROSS JOIN y LEFT JOIN b ON b.y = y.y GROUP BY 1, 2, 3), "
    "s AS (SELECT a AS l_linestatus, b AS l_line, y, (na + 1 / 6.0) / (t + 1) * (ab + 1 / 7.0) / (na + 1) + (nb + 1 / 21.0) / (t + 1) * (ab + 1 / 2.0) / (nb + 1) AS s FROM p, t) SELECT l_linestatus, l_line, " + ", ".join(f"round(sum(s) FILTER (y = '{v}') / sum(s), 6) AS \"p_{v}\"" for v in "ANR") + " FROM s GROUP BY 1, 2"
)
_register("averaged_one_dependence", "lineitem", lambda t: _shares(bayes.aode(_lines(t), "l_returnflag", ["l_linestatus", "l_line"]), _lines(t).select("l_linestatus", "l_line").distinct(), "l_linestatus", "l_line").drop("prediction"), _ODE)
_register(
    "stump", "lineitem", lambda t: _shares(trees.decision_stump(_lines(t), "l_returnflag", ["l_line", "l_linestatus"]), _lines(t).select("l_line", "l_linestatus").distinct(), "l_line", "l_linestatus").drop("prediction"),
    "WITH c AS (SELECT 'l_line' AS a, CAST(l_linenumber AS VARCHAR) AS v, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 2, 3 UNION ALL SELECT 'l_linestatus', l_linestatus, l_returnflag, count(*) FROM lineitem GROUP BY 2, 3), k AS (SELECT DISTINCT a, v FROM c), "
    "s AS (SELECT k.a, k.v, c.v = k.v AS side, c.y, sum(n) AS n FROM k JOIN c USING (a) GROUP BY 1, 2, 3, 4), h AS (SELECT a, v, sum(-n * log2(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY a, v, side) AS t FROM s) GROUP BY 1, 2), b AS (SELECT a, v FROM h ORDER BY round(h, 6), a, v LIMIT 1), "
    "d AS (SELECT side, " + ", ".join(f"sum(n) FILTER (y = '{v}') AS n_{v}" for v in "ANR") + ", sum(n) AS t FROM s SEMI JOIN b ON s.a = b.a AND s.v = b.v GROUP BY 1), x AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS l_line, l_linestatus FROM lineitem) "
    "SELECT l_line, l_linestatus, " + ", ".join(f"round(coalesce(n_{v}, 0) / t, 6) AS \"p_{v}\"" for v in "ANR") + " FROM x, b, d WHERE side = (CASE WHEN b.a = 'l_line' THEN l_line ELSE l_linestatus END = b.v)",
)
_GROUPED = "SELECT l_linestatus, l_line, " + ", ".join(f"round(count(*) FILTER (y = '{v}') / count(*), 6) AS \"p_{v}\"" for v in "ANR") + " FROM (SELECT l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_line, l_returnflag AS y FROM lineitem) GROUP BY 1, 2"
_register("tree_of_values", "lineitem", lambda t: _shares(trees.fit_tree(_lines(t), "l_returnflag", ["l_line", "l_linestatus"], None, trees.Rule("gain", True, 1e-9), local_rows=100), _lines(t).where("l_linestatus = 'F'").select("l_linestatus", "l_line").distinct(), "l_linestatus", "l_line").drop("prediction"), _GROUPED.replace("FROM lineitem)", "FROM lineitem WHERE l_linestatus = 'F')"))
_register("nearest_vote", "supplier", lambda t: _rounded(lazy.ibk(t, "s_acctbal", ["s_nationkey"], k=1).transform(t).select("s_suppkey", "prediction"), "prediction", places=4), "SELECT s_suppkey, round(avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS prediction FROM supplier")
_register("nearest_class", "part", lambda t: lazy.join(t.where("p_partkey % 10 = 0"), t, "p_brand", ["p_retailprice"], 1, "p_partkey", "p_partkey").select("p_partkey", "prediction"),
    "WITH d AS (SELECT t.p_partkey, r.p_brand, dense_rank() OVER (PARTITION BY t.p_partkey ORDER BY round(abs(t.p_retailprice - r.p_retailprice), 9)) AS k FROM part t, part r WHERE t.p_partkey % 10 = 0 AND r.p_partkey <> t.p_partkey), n AS (SELECT p_partkey, p_brand, count(*) AS n FROM d WHERE k = 1 GROUP BY 1, 2) SELECT p_partkey, arg_min(p_brand, (-n, p_brand)) AS prediction FROM n GROUP BY 1")
_register("averaged_models", "lineitem", lambda t: _shares(meta.vote(t, "l_returnflag", _NAMES, schemes=[bayes.naive_bayes, lambda d, y, a, w=None: base.majority(d, y)]), _distinct(t), *_NAMES).drop("prediction"),
    "WITH q AS (" + _NB.replace("{w}", "").replace("round(sum(e)", "(sum(e)").replace("sum(e), 6)", "sum(e))") + "), m AS (SELECT " + ", ".join(f"(count(*) FILTER (l_returnflag = '{v}') + 1) / (count(*) + 3) AS {v}" for v in "ANR") + " FROM lineitem) SELECT l_quantity, l_linestatus, " + ", ".join(f"round((\"p_{v}\" + m.{v}) / 2, 6) AS \"p_{v}\"" for v in "ANR") + " FROM q, m")
_register("least_cost", "lineitem", lambda t: meta.cost_sensitive(t, "l_returnflag", _NAMES, scheme=lambda d, y, a, w=None: base.majority(d, y), cost=[[0, 1, 1], [5, 0, 1], [9, 9, 0]], expected=True).transform(t, distribution=None).select("l_orderkey", "l_linenumber", "prediction"),
    "WITH n AS (SELECT count(*) FILTER (l_returnflag = 'A') + 1 AS a, count(*) FILTER (l_returnflag = 'N') + 1 AS n, count(*) FILTER (l_returnflag = 'R') + 1 AS r FROM lineitem) SELECT l_orderkey, l_linenumber, CASE least(5 * n + 9 * r, a + 9 * r, a + n) WHEN 5 * n + 9 * r THEN 'A' WHEN a + 9 * r THEN 'N' ELSE 'R' END AS prediction FROM lineitem, n")
_register("cost_weights", "lineitem", lambda t: _rounded(meta.cost_weights(t, "l_linestatus", ["F", "O"], __import__("numpy").array([[0.0, 1.0], [4.0, 0.0]])).groupBy("l_linestatus").agg(F.sum(meta.W).alias("w")), "w", places=3), "WITH n AS (SELECT count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem) SELECT l_linestatus, round(CASE l_linestatus WHEN 'F' THEN f ELSE 4 * o END * (f + o) / (f + 4 * o), 3) AS w FROM (SELECT DISTINCT l_linestatus FROM lineitem), n")
_register("class_means", "lineitem", lambda t: metrics.WeightedNeighbours(t, "l_returnflag", _N, weights=[1.0, 100.0], prototypes=True).transform(t.select(*_N).distinct(), distribution=None).select(*_N, "prediction"),
    "WITH m AS (SELECT l_returnflag AS y, avg(l_quantity) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1) SELECT l_quantity, l_tax, arg_min(y, (l_quantity - a) ** 2 + 100 * (l_tax - b) ** 2) AS prediction FROM (SELECT DISTINCT l_quantity, l_tax FROM lineitem), m GROUP BY 1, 2")
_register("bag_rows", "lineitem", lambda t: _rounded(instances.propositional(t, "l_orderkey", ["l_quantity", "l_returnflag"], "midrange").join(instances.propositional(t, "l_orderkey", ["l_tax"], "ends"), "l_orderkey"), "l_quantity"), "SELECT l_orderkey, round((min(l_quantity) + max(l_quantity)) / 2, 6) AS l_quantity, arg_min(f, (-n, f)) AS l_returnflag, min(a) AS min_l_tax, max(b) AS max_l_tax FROM (SELECT l_orderkey, l_returnflag AS f, count(*) AS n, min(l_tax) AS a, max(l_tax) AS b, min(l_quantity) AS l1, max(l_quantity) AS l2 FROM lineitem GROUP BY 1, 2) JOIN (SELECT l_orderkey, l_quantity FROM lineitem) USING (l_orderkey) GROUP BY 1")


@query("wrapped_bags", "WITH s AS (SELECT l_returnflag, l_linestatus, sum(1.0 / n) AS w FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY 1, 2), p AS (SELECT l_returnflag, coalesce(sum(w) FILTER (l_linestatus = 'F'), 0) / sum(w) AS f FROM s GROUP BY 1) SELECT l_orderkey, CASE WHEN round(avg(f), 9) >= 0.5 THEN 'F' ELSE 'O' END AS prediction FROM lineitem JOIN p USING (l_returnflag) GROUP BY 1")
def wrapped_bags(spark, d):
    t = table(spark, d, "lineitem")
    return instances.mi_wrapper(t, "l_orderkey", "l_linestatus", ["l_returnflag"], lambda *a: trees.fit_tree(*a, trees.Rule("gain", True, 1e-9)))[1](t)


# Learners that SQL cannot state: their accuracies, against brute force in the tests.
def _accuracies(spark, found):
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in found.items()], "name string, accuracy double")


def _report(name, schemes, source="lineitem", target="l_returnflag", attributes=("l_quantity", "l_tax", "l_linestatus")):
    """Registers the accuracy of each scheme on the rows that it did not see: those whose order's hash is in the last fifth."""

    def run(spark, d):
        t = table(spark, d, source)
        t = _lines(t) if source == "lineitem" else t
        u = F.pmod(F.xxhash64(t.columns[0]), F.lit(5))
        train, test = t.where(u > 0), t.where(u == 0)
        return _accuracies(spark, {n: meta.accuracy_of(s(train, target, list(attributes), None), test, target) for n, s in schemes.items()})

    query(name)(run)


_report("tree_learners", {"pruned": trees.j48, "random": trees.random_tree, "reduced": trees.rep_tree, "forest": partial(trees.random_forest, trees=3)})
_report("rule_learners", {"one": rules.one_r, "conjunctive": rules.conjunctive_rule, "table": rules.decision_table})
_report("margin_learners", {"logistic": functions.logistic, "margin": functions.linear_svm, "additive": partial(functions.simple_logistic, rounds=3)}, target="l_linestatus", attributes=("l_quantity", "l_tax", "l_discount"))
_report("committees", {"bagged": partial(meta.bagging, base=trees.decision_stump, members=2), "boosted": partial(meta.adaboost_m1, members=2), "additive": partial(meta.logit_boost, rounds=2)})
_report("networks", {"tree": partial(networks.bayes_net, search="tan"), "hill": partial(networks.bayes_net, search="hill"), "k2": networks.bayes_net}, attributes=("l_linestatus", "l_line"))


@query("clusters", "SELECT 4 AS clusters, true AS whole FROM part LIMIT 1")
def clusters(spark, d):
    t = table(spark, d, "part")
    held = cluster.k_means(t, ["p_size", "p_retailprice"], 4, rounds=10).transform(t, "c", None)
    return held.agg(F.countDistinct("c").cast("int").alias("clusters"), (F.count("c") == F.lit(t.count())).alias("whole"))


@query("dense_groups", "WITH RECURSIVE m AS (SELECT min(s_acctbal) AS a, max(s_acctbal) AS b FROM supplier), x AS (SELECT s_suppkey AS k, (s_acctbal - a) / (b - a) AS v FROM supplier, m), e AS (SELECT p.k AS a, q.k AS b, abs(p.v - q.v) AS d FROM x p JOIN x q ON p.k <> q.k AND abs(p.v - q.v) <= 0.01), c AS (SELECT a AS k FROM e GROUP BY 1 HAVING count(*) + 1 >= 3), g AS (SELECT a, b FROM e WHERE a IN (SELECT k FROM c) AND b IN (SELECT k FROM c)), r AS (SELECT k, k AS l FROM c UNION SELECT g.b, r.l FROM r JOIN g ON g.a = r.k), l AS (SELECT k, min(l) AS c FROM r GROUP BY 1), o AS (SELECT a AS k, arg_min(l.c, (d, l.c)) AS c FROM e JOIN l ON l.k = e.b WHERE a NOT IN (SELECT k FROM c) GROUP BY 1) SELECT s_suppkey, coalesce(l.c, o.c) AS cluster FROM supplier LEFT JOIN l ON l.k = s_suppkey LEFT JOIN o ON o.k = s_suppkey")
def dense_groups(spark, d):
    return cluster.dbscan(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal"], 0.01, 3)


_register("mixture_moments", "part", lambda t: (lambda m: t.sparkSession.createDataFrame([(round(float(m.means[0, 0]), 6), round(float(m.deviations[0, 0]), 6), round(m.likelihood(t), 6))], "mean double, deviation double, likelihood double"))(cluster.em(t, ["p_size"], 1, rounds=2)), "SELECT round(avg(p_size), 6) AS mean, round(stddev_pop(p_size), 6) AS deviation, round(-0.5 - ln(stddev_pop(p_size) * sqrt(2 * pi())), 6) AS likelihood FROM part")
_register("cluster_densities", "part", lambda t: _rounded(cluster.memberships(t, cluster.densities(t, ["p_retailprice"], cluster.k_means(t, ["p_retailprice"], 1))).select("p_partkey", "pCluster_0"), "pCluster_0"), "SELECT p_partkey, round(-((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part)) ** 2 / 2 * -1 * -1 - ln((SELECT stddev_pop(p_retailprice) FROM part) * sqrt(2 * pi())), 6) AS \"pCluster_0\" FROM part".replace("-((", "-1 * (((").replace(") ** 2 / 2 * -1 * -1", ")) ** 2 / 2"))
_register("latent_values", "lineitem", lambda t: t.sparkSession.createDataFrame([(i, round(float(v), 3)) for i, v in enumerate(select.latent_semantics(t, ["l_discount", "l_tax"], 2).values)], "place int, value double"),
    "WITH m AS (SELECT sum(l_discount * l_discount) AS a, sum(l_tax * l_tax) AS b, sum(l_discount * l_tax) AS c FROM lineitem) SELECT 0 AS place, round(sqrt((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c)), 3) AS value FROM m UNION ALL SELECT 1, round(sqrt((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c)), 3) FROM m")
_SU = (
    "WITH c AS (SELECT k, v, y, CAST(count(*) AS DOUBLE) AS n FROM (SELECT 'l' AS k, CAST(l_linenumber AS VARCHAR) AS v, l_returnflag AS y FROM lineitem UNION ALL SELECT 's', l_linestatus, l_returnflag FROM lineitem UNION ALL SELECT 'i', CAST(l_linenumber AS VARCHAR), l_linestatus FROM lineitem) GROUP BY 1, 2, 3), "
    "x AS (SELECT *, sum(n) OVER (PARTITION BY k, v) AS rv, sum(n) OVER (PARTITION BY k, y) AS ry, sum(n) OVER (PARTITION BY k) AS t FROM c), u AS (SELECT k, 2 * sum(n / t * log2(n * t / (rv * ry))) / (-sum(n / t * log2(rv / t)) - sum(n / t * log2(ry / t))) AS u FROM x GROUP BY 1), "
    "w AS (SELECT max(u) FILTER (k = 'l') AS l, max(u) FILTER (k = 's') AS s, max(u) FILTER (k = 'i') AS i FROM u)"
)
_register("chosen_attributes", "lineitem", lambda t: t.sparkSession.createDataFrame([(a,) for a in select.fcbf(_lines(t).withColumn("copy", F.col("l_linestatus")), "l_returnflag", ["l_linestatus", "copy", "l_line"])[:1]], "name string"), _SU + " SELECT CASE WHEN l >= s THEN 'l_line' ELSE 'l_linestatus' END AS name FROM w")
_register("searched_attributes", "lineitem", lambda t: (lambda m: t.sparkSession.createDataFrame([(n, ",".join(f(["l_linestatus", "l_line"], m))) for n, f in (("best", select.best_first), ("all", select.exhaustive), ("forward", select.forward), ("random", partial(select.random_search, share=1.0)), ("genetic", partial(select.genetic_search, generations=20, population=12)), ("scatter", partial(select.scatter_search, size=4)))], "search string, chosen string"))(select.correlation_merit(_lines(t), "l_returnflag")),
    _SU + " SELECT search, CASE WHEN round((l + s) / sqrt(2 + 2 * i), 9) > round(greatest(l, s), 9) THEN 'l_linestatus,l_line' WHEN l > s THEN 'l_line' ELSE 'l_linestatus' END AS chosen FROM w, (VALUES ('best'), ('all'), ('forward'), ('random'), ('genetic'), ('scatter')) v(search)")

# Mining --------------------------------------------------------------------------------------

_ITEMS = "WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CAST(o_custkey % 3 AS VARCHAR) AS g FROM orders), z AS (SELECT count(*) AS z FROM o) "


def _orders(t):
    return t.select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 3).cast("string").alias("g"))


_register("class_rules", "orders", lambda t: _rounded(mining.class_rules(_orders(t), ["o_orderkey"], ["p", "g"], "s", 0.001, 0.3).where("premise not like '%,%'").select("premise", "consequence", "n", "confidence"), "confidence"),
    _ITEMS + ", x AS (SELECT 'p=' || p AS a, 's=' || s AS c, count(*) AS n, max((SELECT count(*) FROM o q WHERE q.p = o.p)) AS t FROM o GROUP BY p, s UNION ALL SELECT 'g=' || g, 's=' || s, count(*), max((SELECT count(*) FROM o q WHERE q.g = o.g)) FROM o GROUP BY g, s) SELECT a AS premise, c AS consequence, n, round(n / t, 6) AS confidence FROM x, z WHERE n >= ceil(0.001 * z) AND n / t >= 0.3")
_register("confirmed_rules", "orders", lambda t: _rounded(mining.confirmed_rules(_orders(t), ["o_orderkey"], ["s", "p"], 1, -10.0), "confirmation", "counter"),
    _ITEMS + ", l AS (SELECT o_orderkey, 's=' || s AS x FROM o UNION ALL SELECT o_orderkey, 'p=' || p FROM o), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1), b AS (SELECT a.x AS body, c.x AS head, count(*) AS k FROM l a JOIN l c ON a.o_orderkey = c.o_orderkey AND a.x <> c.x GROUP BY 1, 2), v AS (SELECT body, head, p.n / z * (1 - q.n / z) AS e, (p.n - k) / z AS c FROM b JOIN n p ON p.x = body JOIN n q ON q.x = head, z) SELECT body, head, round(CASE WHEN sqrt(e) > e THEN (e - c) / (sqrt(e) - e) ELSE 0 END, 6) AS confirmation, round(c, 6) AS counter FROM v")
_register("rule_search", "lineitem", lambda t: _rounded(mining.best_rules(t, "l_orderkey", "l_linenumber", 3, "confidence", 0.0, 0.6, 0.1, 0.2).select("premise", "consequence", "n", "confidence"), "confidence"), None)
_register("predicted_rules", "lineitem", lambda t: mining.predictive_rules(t, "l_orderkey", "l_linenumber", 5, 0.1), None)
_register("subgroup_tree", "orders", lambda t: _rounded(mining.subgroup_tree(_orders(t), ["p", "g"], "s", "F", 5, 1, 1, 0.0), "share"),
    _ITEMS + ", c AS (SELECT 'p = ' || p AS rule, 'p' AS c, p AS v, count(*) AS n, avg(CAST(s = 'F' AS INT)) AS share FROM o GROUP BY p UNION ALL SELECT 'g = ' || g, 'g', g, count(*), avg(CAST(s = 'F' AS INT)) FROM o GROUP BY g) SELECT rule, n, round(share, 6) AS share FROM c WHERE n >= 5 AND share > (SELECT avg(CAST(s = 'F' AS INT)) FROM o) ORDER BY c.share DESC, n DESC, c, v LIMIT 1")
_register("mining_report", "lineitem", lambda t: _rounded(mining.mining_report(mining.rules(t, "l_orderkey", "l_linenumber", 0.3, 0.5), 0.0, 0.0).select("rules", "confidence"), "confidence"), None)

# Records and metrics -------------------------------------------------------------------------


def _pairs(spark, d):
    t = table(spark, d, "part").where("p_partkey <= 60")
    a, b = t.select(F.col("p_partkey").alias("a")), t.select(F.col("p_partkey").alias("b"))
    return t, a.join(b, (F.col("a") < F.col("b")) & (F.col("b") - F.col("a") <= 5))


@query("resolved_records", "WITH RECURSIVE t AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b FROM part WHERE p_partkey <= 60), e AS (SELECT x.k AS a, y.k AS b FROM t x JOIN t y ON x.k < y.k AND y.k - x.k <= 5 WHERE CASE WHEN x.b = y.b THEN 1 ELSE 0 END + 1 - levenshtein(x.n, y.n) / greatest(length(x.n), length(y.n))::DOUBLE >= 1.2), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT k, k AS c FROM t UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.k) SELECT k AS p_partkey, min(c) AS entity FROM r GROUP BY 1")
def resolved_records(spark, d):
    t, pairs = _pairs(spark, d)
    near = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    s = metrics.field_similarities(t, pairs, "p_partkey", {"name": ("p_name", near), "brand": ("p_brand", lambda a, b: F.when(a == b, 1.0).otherwise(0.0))})
    return metrics.resolved(t, "p_partkey", metrics.summed(s, ["name", "brand"]), 1.2)


@query("vector_distances", "SELECT vec_id, round(sqrt(list_sum([(x::DOUBLE - 0.1) ** 2 * (i % 3 + 1) FOR x, i IN embedding])), 5) AS weighted, round(sqrt(list_sum([(x::DOUBLE - 0.1) ** 2 * 2 FOR x IN embedding])), 5) AS matrix FROM embeddings")
def vector_distances(spark, d):
    t = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double"))).where("embedding is not null")
    n = t.select(F.size("x")).first()[0]
    w = [(i + 1) % 3 + 1 for i in range(n)]
    y = F.transform("x", lambda v: F.lit(0.1))
    two = metrics.weighted_euclidean(F.col("x"), y, [2.0] * n)
    return _rounded(t.select("vec_id", metrics.weighted_euclidean(F.col("x"), y, w).alias("weighted"), two.alias("matrix")), "weighted", "matrix", places=5)


@query("pair_curve", "WITH p AS (SELECT p_partkey AS k, p_size AS s, p_brand AS b FROM part WHERE p_partkey <= 60), c AS (SELECT x.b = y.b AS t, -abs(x.s - y.s) AS score FROM p x JOIN p y ON x.k < y.k AND y.k - x.k <= 5), g AS (SELECT score, count(*) AS n, count(*) FILTER (t) AS h FROM c GROUP BY 1), r AS (SELECT score, sum(n) OVER w AS n, sum(h) OVER w AS h, (SELECT count(*) FROM c WHERE t) AS t FROM g WINDOW w AS (ORDER BY score DESC)) SELECT score, round(h / n, 6) AS precision, round(h / t, 6) AS recall, round(2 * h / (n + t), 6) AS f FROM r")
def pair_curve(spark, d):
    t, pairs = _pairs(spark, d)
    side = lambda n: t.select(F.col("p_partkey").alias(n), F.col("p_size").alias(f"s{n}"), F.col("p_brand").alias(f"b{n}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    return _rounded(experiment.pair_curve(held.select("a", "b", (-F.abs(F.col("sa") - F.col("sb"))).alias("score")), held.where("ba = bb").select("a", "b")), "precision", "recall", "f")


@query("field_scores", "SELECT 'p_brand' AS field, round(avg(CAST(p_size > 10 AS INT)), 6) AS precision, round(avg(CAST(p_size > 10 AS INT)), 6) AS recall, round(avg(CAST(p_size > 10 AS INT)), 6) AS f FROM part")
def field_scores(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return _rounded(experiment.field_scores(t.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("none").alias("p_brand")), t.select("p_partkey", "p_brand"), ["p_brand"], "p_partkey"), "precision", "recall", "f")


_register("edit_similarities", "nation", lambda t: t.select("n_nationkey", similarity.edit_distance(F.lower("n_name"), F.lit("nation_12")).alias("d"), F.array_join(text.ngrams(text.delimited(F.col("n_name"), "_"), 1, 2), "|").alias("grams")), "SELECT n_nationkey, CAST(levenshtein(lower(n_name), 'nation_12') AS INT) AS d, CASE WHEN contains(n_name, '_') THEN replace(n_name, '_', ' ') || '|' || replace(n_name, '_', '|') ELSE n_name END AS grams FROM nation")

# Experiments and generated rows --------------------------------------------------------------


@query("learning_curve", "SELECT scheme, fold, size, CAST(0 AS DOUBLE) AS noise, true AS fine FROM (VALUES ('table'), ('zero')) s(scheme), range(2) f(fold), (VALUES (50.0::DOUBLE), (100.0::DOUBLE)) z(size)")
def learning_curve(spark, d):
    schemes = {"zero": lambda t, y, a, w=None: base.majority(t, y), "table": lambda t, y, a, w=None: trees.decision_stump(t, y, a)}
    found = experiment.learning_curve(_lines(table(spark, d, "lineitem")), "l_returnflag", ["l_linestatus"], schemes, ["l_orderkey", "l_linenumber"], [50, 100], 2)
    return found.select("scheme", F.col("fold").cast("long").alias("fold"), "size", "noise", F.col("accuracy").between(0, 1).alias("fine"))


@query("generated_rows", "SELECT name, 0 AS wrong FROM (VALUES ('agrawal'), ('led'), ('list'), ('hat'), ('line')) v(name)")
def generated_rows(spark, d):
    """Rows that contradict the rule that made them: none."""
    a = generators.agrawal(spark, 2000, 5).select(F.lit("agrawal").alias("name"), F.when(generators.agrawal_group(5), "1").otherwise("0").alias("x"), F.col("group").alias("y"))
    lit = F.get(F.array(*[F.lit(s) for s in generators.LED]), F.col("digit"))
    b = generators.led24(spark, 500, noise=0.0).select(F.lit("led").alias("name"), F.concat(*[f"a{i}" for i in range(1, 8)]).alias("x"), lit.alias("y"))
    rows, found = generators.decision_list(spark, 500, rules=3)
    value = F.lit(found[-1][1])
    for tests, c in found[::-1]:
        value = F.when(rules.covered([(n, "=", v) for n, _, v in tests]), c).otherwise(value)
    c = rows.select(F.lit("list").alias("name"), value.alias("x"), F.col("class").alias("y"))
    h = generators.mexican_hat(spark, 300).select(F.lit("hat").alias("name"), F.round(F.sin(F.abs("x")) / F.abs("x"), 9).cast("string").alias("x"), F.round("y", 9).cast("string").alias("y"))
    e = generators.expression(spark, 300, "2 * x + 1").select(F.lit("line").alias("name"), F.round(2 * F.col("x") + 1, 9).cast("string").alias("x"), F.round("y", 9).cast("string").alias("y"))
    every = a.unionAll(b).unionAll(c).unionAll(h).unionAll(e)
    return every.groupBy("name").agg(F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), 0).otherwise(1)).cast("int").alias("wrong"))


@query("clique_votes", "SELECT o_orderkey AS idx, o_orderstatus AS label FROM orders")
def clique_votes(spark, d):
    """Relabelling without cliques changes nothing."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("label"), F.lit(1.0).alias("prob"))
    none = spark.createDataFrame([], "clique long, items array<long>, support double, confidence double")
    return K.relabel(none, t).select("idx", "label")
