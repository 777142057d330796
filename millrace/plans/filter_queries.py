"""Queries of fitted filters, their composition, and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.operators import discretize, reshape, similarity, stats
from millrace.operators import neighbours as N
from millrace.operators import rows as R
from millrace.plans import filters as P
from millrace.plans.catalog import _register, query, table
from millrace.plans.mining_queries import _rounded

_TRAIN, _TEST = "l_orderkey % 2 = 0", "l_orderkey % 2 = 1"


def _halves(t):
    held = t.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    return held.where(_TRAIN), held.where(_TEST)


def _fit_query(name, fit, sql, columns=("l_quantity", "l_extendedprice")):
    """Fitted on the even orders, applied to the odd ones."""

    def run(t):
        train, test = _halves(t)
        return _rounded(fit(train)(test).select("l_orderkey", "l_linenumber", *columns), *columns)

    _register(name, "lineitem", run, sql)


_BOTH = ["l_quantity", "l_extendedprice"]
_fit_query("center_fitted", lambda t: C.center.fit(t, _BOTH), f"WITH m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem WHERE {_TRAIN}) SELECT l_orderkey, l_linenumber, round(l_quantity - a, 6) AS l_quantity, round(l_extendedprice - b, 6) AS l_extendedprice FROM lineitem, m WHERE {_TEST}")
_fit_query("standardize_fitted", lambda t: C.standardize.fit(t, _BOTH), f"WITH m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, stddev_samp(l_quantity) AS c, stddev_samp(l_extendedprice) AS d FROM lineitem WHERE {_TRAIN}) SELECT l_orderkey, l_linenumber, round((l_quantity - a) / c, 6) AS l_quantity, round((l_extendedprice - b) / d, 6) AS l_extendedprice FROM lineitem, m WHERE {_TEST}")
_NORMAL = f"WITH m AS (SELECT min(l_quantity) AS a, min(l_extendedprice) AS b, max(l_quantity) AS c, max(l_extendedprice) AS d FROM lineitem WHERE {_TRAIN}) SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (c - a), 6) AS l_quantity, round((l_extendedprice - b) / (d - b), 6) AS l_extendedprice FROM lineitem, m WHERE {_TEST}"
_fit_query("normalize_fitted", lambda t: C.normalize.fit(t, _BOTH), _NORMAL)
_fit_query("bins_fitted", lambda t: C.equal_width_bins.fit(t, "l_quantity", 4), f"WITH m AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem WHERE {_TRAIN}) SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= a + (b - a) / 4 THEN 0 WHEN l_quantity <= a + (b - a) / 2 THEN 1 WHEN l_quantity <= a + (b - a) / 4 * 3 THEN 2 ELSE 3 END AS l_quantity FROM lineitem, m WHERE {_TEST}", ("l_quantity",))
_fit_query("imputed_fitted", lambda t: (lambda a: lambda rows: a(rows.withColumn("l_quantity", F.when(F.col("l_quantity") > 10, F.col("l_quantity")))))(C.replace_missing.fit(t, ["l_quantity"])), f"SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 10 THEN l_quantity ELSE (SELECT avg(l_quantity) FROM lineitem WHERE {_TRAIN}) END, 6) AS l_quantity FROM lineitem WHERE {_TEST}", ("l_quantity",))
_fit_query("math_fitted", lambda t: C.math_expression.fit(t, "l_quantity", "ifelse(A < MEAN & !(A = MIN), pow(A, 2) - SUMSQUARED / COUNT, A ^ 0.5 * SD)"), f"WITH m AS (SELECT avg(l_quantity) AS a, min(l_quantity) AS b, stddev_samp(l_quantity) AS s, sum(l_quantity * l_quantity) / count(*) AS q FROM lineitem WHERE {_TRAIN}) SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < a AND l_quantity <> b THEN l_quantity ** 2 - q ELSE sqrt(l_quantity) * s END, 6) AS l_quantity FROM lineitem, m WHERE {_TEST}", ("l_quantity",))
_STEPS = [P.step(C.normalize, _BOTH), P.step(C.center, _BOTH), P.step(C.numeric_cleaner, "l_quantity", -0.4, -0.4, 0.4, 0.4, 0.0, 0.0, 0.01, -1)]
_fit_query(
    "filter_chain", lambda t: P.chain.fit(t, _STEPS),
    f"WITH n AS (SELECT min(l_quantity) AS a, min(l_extendedprice) AS b, max(l_quantity) AS c, max(l_extendedprice) AS d, avg(l_quantity) AS e, avg(l_extendedprice) AS f FROM lineitem WHERE {_TRAIN}), "
    f"x AS (SELECT l_orderkey, l_linenumber, (l_quantity - e) / (c - a) AS q, (l_extendedprice - f) / (d - b) AS p FROM lineitem, n WHERE {_TEST}) "
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN q < -0.4 THEN -0.4 WHEN q > 0.4 THEN 0.4 WHEN abs(q) < 0.01 THEN 0 ELSE q END, 6) AS l_quantity, round(p, 6) AS l_extendedprice FROM x",
)
_register(
    "partitioned_filters", "part",
    lambda t: _rounded(P.by_columns.fit(t.where("p_partkey % 2 = 0"), [(["p_size"], P.step(C.normalize, ["p_size"])), (["p_retailprice"], P.step(C.center, ["p_retailprice"]))], ["p_partkey"], True, "p_brand")(t.where("p_partkey % 2 = 1")), "p_size", "p_retailprice"),
    "WITH m AS (SELECT min(p_size) AS a, max(p_size) AS c, avg(p_retailprice) AS b FROM part WHERE p_partkey % 2 = 0) SELECT p_partkey, round((p_size - a) / (c - a), 6) AS p_size, round(p_retailprice - b, 6) AS p_retailprice, p_brand FROM part, m WHERE p_partkey % 2 = 1",
)
_register(
    "row_and_batch_filters", "lineitem",
    lambda t: _rounded(P.batch_filter(lambda d, c: (lambda m: lambda rows: rows.withColumn(c, F.col(c) / m))(d.agg(F.max(c)).first()[0]))(P.row_filter(lambda d: {"l_quantity": F.col("l_quantity") + 1}, lambda d: F.col("l_returnflag") == "R")(t.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")), "l_quantity").drop("l_returnflag"), "l_quantity"),
    "SELECT l_orderkey, l_linenumber, round((l_quantity + 1) / (SELECT max(l_quantity + 1) FROM lineitem WHERE l_returnflag = 'R'), 6) AS l_quantity FROM lineitem WHERE l_returnflag = 'R'",
)
_register("class_marked", "orders", lambda t: (lambda m: m.select("o_orderkey", F.lit(P.class_column(m)).alias("class")))(P.pick_class_value(P.assign_class(t, "o_orderstatus"), "o_orderstatus", "O")), "SELECT o_orderkey, 'o_orderstatus' AS class FROM orders")
_register("identity", "nation", lambda t: R.all_filter(t), "SELECT * FROM nation")
_register("no_rows", "nation", lambda t: R.null_filter(t), "SELECT * FROM nation WHERE false")
_register(
    "iqr_flags", "part", lambda t: C.interquartile_flags(t.select("p_partkey", "p_retailprice"), "p_retailprice", 0.2, 0.4).select("p_partkey", "Outlier", "ExtremeValue"),
    "WITH s AS (SELECT list(p_retailprice ORDER BY p_retailprice) AS v, count(*) AS n FROM part), q AS (SELECT v[n // 2 // 2 + 1] AS a, v[least(n // 2 + n // 2 // 2 + CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END, n - 1) + 1] AS b FROM s), "
    "r AS (SELECT a - 0.2 * (b - a) AS la, a - 0.4 * (b - a) AS lb, b + 0.2 * (b - a) AS ha, b + 0.4 * (b - a) AS hb FROM q) "
    'SELECT p_partkey, (p_retailprice > ha AND p_retailprice <= hb) OR (p_retailprice < la AND p_retailprice >= lb) AS "Outlier", p_retailprice > hb OR p_retailprice < lb AS "ExtremeValue" FROM part, r',
)
_register("nominal_to_string", "orders", lambda t: C.nominal_to_string(C.with_domain(t, "o_orderstatus", ["F", "O", "P"]), "o_orderstatus").select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders")


def _places(df, column):
    domain = C.domain_of(df, column)
    return F.array_position(F.array(*[F.lit(v) for v in domain]), F.col(column)).cast("int").alias("place")


_register("string_to_nominal", "orders", lambda t: (lambda m: m.select("o_orderkey", _places(m, "o_orderpriority")))(C.string_to_nominal(t, "o_orderpriority", ["o_orderkey"])), "WITH f AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) AS p FROM orders GROUP BY 1) SELECT o_orderkey, CAST(p AS INT) AS place FROM orders JOIN f USING (o_orderpriority)")
_register("add_values", "orders", lambda t: (lambda m: m.select("o_orderkey", _places(m, "o_orderstatus")))(C.add_values(C.with_domain(t, "o_orderstatus", ["P", "F"]), "o_orderstatus", ["O", "A"], True)), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 4 END AS place FROM orders")
_register("swap_values", "orders", lambda t: (lambda m: m.select("o_orderkey", "o_orderstatus", _places(m, "o_orderstatus")))(C.swap_values(C.with_domain(t, "o_orderstatus", ["F", "O", "P"]), "o_orderstatus", "F", "P")), "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS place FROM orders")
_register("class_order", "orders", lambda t: (lambda m: m.select("o_orderkey", _places(m, "o_orderstatus")))(C.class_order(t, "o_orderstatus")), "WITH f AS (SELECT o_orderstatus, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS p FROM orders GROUP BY 1) SELECT o_orderkey, CAST(p AS INT) AS place FROM orders JOIN f USING (o_orderstatus)")
_register("random_subset", "part", lambda t: (lambda m: t.sparkSession.createDataFrame([(len(m.columns), m.columns[-1])], "n int, last string"))(C.random_subset(t, 0.5, 3, "p_partkey")), "SELECT 4 AS n, 'p_partkey' AS last")
_register("best_width_bins", "part", lambda t: C.best_width_bins(t.withColumn("x", F.when(F.col("p_size") > 25, F.col("p_size") + 200).otherwise(F.col("p_size")).cast("double")), "x", 3, "bin").select("p_partkey", "bin"), None)
_register("row_norm", "lineitem", lambda t: _rounded(C.unit_rows(t.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], 1.0, 10.0), "l_quantity", "l_tax"), "SELECT l_orderkey, l_linenumber, round(l_quantity / (l_quantity + l_tax) * 10, 6) AS l_quantity, round(l_tax / (l_quantity + l_tax) * 10, 6) AS l_tax FROM lineitem")
_register("sparse_and_back", "lineitem", lambda t: R.to_dense(R.to_sparse(t.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"]), ["l_discount", "l_tax"]), "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem")
_register("sparse_cells", "lineitem", lambda t: R.to_sparse(t.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", F.size("cells").alias("n")), "SELECT l_orderkey, l_linenumber, CAST(l_discount <> 0 AS INT) + CAST(l_tax <> 0 AS INT) AS n FROM lineitem")
_register("resample_rest", "part", lambda t: R.resample(t, 30, 1, ["p_partkey"]).unionAll(R.resample(t, 30, 1, ["p_partkey"], invert=True)).select("p_partkey"), "SELECT p_partkey FROM part")
_register("resample_biased", "orders", lambda t: R.resample_again(t, 50, 1, "o_orderstatus", 1.0).agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("classes")), "SELECT CAST(floor(count(*) * 0.5) AS BIGINT) AS n, count(DISTINCT o_orderstatus) AS classes FROM orders")
_register("randomize", "nation", lambda t: (lambda m: m.select(F.col("n_nationkey").alias("key")).unionAll(m.select(F.col("place").cast("int"))))(R.randomize(t, 5, ["n_nationkey"])), "SELECT n_nationkey AS key FROM nation UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) FROM nation")


@query("labelled_split", "SELECT s_suppkey, CASE WHEN i % 3 = 0 THEN 'x' || i ELSE NULL END AS label FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS i FROM supplier)")
def labelled_split(spark, d):
    t = table(spark, d, "supplier")
    labels = spark.range(1, t.count() + 1).where("id % 3 = 0").select(F.col("id").alias("row"), F.concat(F.lit("x"), "id").alias("label"))
    train, test = R.split_by_labels(t.select("s_suppkey", F.lit(None).cast("string").alias("label")), labels, [F.desc("s_suppkey")], "label")
    return train.unionAll(test)


@query("smote", "WITH m AS (SELECT o_orderstatus AS s FROM orders GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) SELECT o_orderstatus, CAST(count(*) + CASE WHEN o_orderstatus = any_value(s) THEN count(*) + floor(count(*) * 0.5) ELSE 0 END AS BIGINT) AS n, true AS inside FROM orders, m GROUP BY 1")
def smote(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_custkey").cast("double").alias("c"), "o_orderpriority")
    rows = R.smote(t, "o_orderstatus", "o_orderkey", ["o_totalprice", "c"], ["o_orderpriority"], 5, 150)
    ends = t.groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"))
    return rows.join(ends, "o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min(F.col("o_totalprice").between(F.col("a"), F.col("b"))).alias("inside"))


def _entropy(t):
    return _rounded(stats.conditional_entropies(t, "l_returnflag", "l_linestatus"), "joint", "over_rows", "over_columns", "given_rows", "given_columns")


_register(
    "conditional_entropies", "lineitem", _entropy,
    "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM c) "
    "SELECT round(-sum(n / t * log2(n / t)), 6) AS joint, round(-sum(n / t * log2(ra / t)), 6) AS over_rows, round(-sum(n / t * log2(rb / t)), 6) AS over_columns, round(-sum(n / t * log2(n / ra)), 6) AS given_rows, round(-sum(n / t * log2(n / rb)), 6) AS given_columns FROM x",
)
_register(
    "entropy_of_test_rows", "lineitem", lambda t: _rounded(stats.test_entropy_given_rows(t.where(_TRAIN), t.where(_TEST), "l_linenumber", "l_returnflag", 3), "entropy"),
    f"WITH a AS (SELECT l_linenumber AS x, l_returnflag AS y, count(*) AS n FROM lineitem WHERE {_TRAIN} GROUP BY 1, 2), b AS (SELECT l_linenumber AS x, l_returnflag AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE {_TEST} GROUP BY 1, 2), "
    "r AS (SELECT x, sum(n) AS ra FROM a GROUP BY 1) SELECT round(-sum(b.n * log2((coalesce(a.n, 0) + 1) / (coalesce(ra, 0) + 3))) / sum(b.n), 6) AS entropy FROM b LEFT JOIN a USING (x, y) LEFT JOIN r USING (x)",
)
_register(
    "hypergeometric_bits", "lineitem", lambda t: _rounded(stats.log2_hypergeometric(t, "l_returnflag", "l_linestatus"), "bits", places=2),
    "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT round(((SELECT sum(lgamma(s + 1)) FROM (SELECT sum(n) AS s FROM c GROUP BY a)) + (SELECT sum(lgamma(s + 1)) FROM (SELECT sum(n) AS s FROM c GROUP BY b)) - sum(lgamma(n + 1)) - lgamma(sum(n) + 1)) / -ln(2), 2) AS bits FROM c",
)
_register(
    "reduced_table", "lineitem", lambda t: stats.reduced(t.groupBy(F.col("l_linenumber").alias("a"), F.col("l_returnflag").alias("b")).agg(F.sum(F.when((F.col("l_linenumber") < 4) & (F.col("l_returnflag") != "A"), 1).otherwise(0)).alias("n"))),
    "SELECT l_linenumber AS a, l_returnflag AS b, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_linenumber < 4 AND l_returnflag <> 'A' GROUP BY 1, 2",
)
_register(
    "summary", "part", lambda t: _rounded(stats.summary(t, ["p_size", "p_retailprice"]), "sum", "sum_squared", "mean", "deviation", places=4),
    " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS count, round(CAST(sum({c}) AS DOUBLE), 4) AS sum, round(CAST(sum(CAST({c} AS DOUBLE) * {c}) AS DOUBLE), 4) AS sum_squared, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS deviation FROM part" for c in ("p_size", "p_retailprice")),
)
_register("numeric_profile", "part", lambda t: stats.numeric_profile(t, ["p_size", "p_retailprice"]).select("name", "total", "missing", "distinct", "unique", "whole", "fractional"), " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST(sum(n) AS BIGINT) AS total, CAST(0 AS BIGINT) AS missing, count(v) AS \"distinct\", count(*) FILTER (n = 1) AS \"unique\", CAST(coalesce(sum(n) FILTER (v = floor(v)), 0) AS BIGINT) AS whole, CAST(coalesce(sum(n) FILTER (v <> floor(v)), 0) AS BIGINT) AS fractional FROM (SELECT {c} AS v, count(*) AS n FROM part GROUP BY 1)" for c in ("p_size", "p_retailprice")))
_register("histograms", "part", lambda t: stats.histogram(t, "p_brand").select(F.col("bin").cast("string").alias("bin"), "n").unionAll(stats.histogram(t, "p_size", 5).select(F.col("bin").cast("string"), "n")), "SELECT p_brand AS bin, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT CAST(CASE WHEN p_size <= a + (b - a) / 5.0 THEN 0 WHEN p_size <= a + (b - a) / 5.0 * 2 THEN 1 WHEN p_size <= a + (b - a) / 5.0 * 3 THEN 2 WHEN p_size <= a + (b - a) / 5.0 * 4 THEN 3 ELSE 4 END AS VARCHAR) AS bin, count(*) AS n FROM part, (SELECT min(p_size) AS a, max(p_size) AS b FROM part) GROUP BY 1")
_SCORES = "WITH c AS (SELECT name, v, y, CAST(count(*) AS DOUBLE) AS n FROM (SELECT 'l_linenumber' AS name, CAST(l_linenumber AS VARCHAR) AS v, l_returnflag AS y FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, l_returnflag FROM lineitem) GROUP BY 1, 2, 3), x AS (SELECT *, sum(n) OVER (PARTITION BY name, v) AS rv, sum(n) OVER (PARTITION BY name, y) AS ry, sum(n) OVER (PARTITION BY name) AS t FROM c), s AS (SELECT name, sum(n / t * log2(n * t / (rv * ry))) AS g, -sum(n / t * log2(rv / t)) AS hv, -sum(n / t * log2(ry / t)) AS hy, max(t) * (sum(n * n / (rv * ry)) - 1) AS c2 FROM x GROUP BY 1)"
_register("attribute_scores", "lineitem", lambda t: _rounded(stats.rank_attributes(t, ["l_linenumber", "l_linestatus"], "l_returnflag"), "info_gain", "gain_ratio", "symmetrical_uncertainty", "chi2", places=5), f"{_SCORES} SELECT name, round(g, 5) AS info_gain, round(g / hv, 5) AS gain_ratio, round(2 * g / (hv + hy), 5) AS symmetrical_uncertainty, round(c2, 5) AS chi2 FROM s")
_register("best_attribute", "lineitem", lambda t: stats.top_ranked(stats.rank_attributes(t, ["l_linenumber", "l_linestatus"], "l_returnflag"), "info_gain", 1, 0.0).select("name"), f"{_SCORES} SELECT name FROM s WHERE g > 0 ORDER BY g DESC, name LIMIT 1")

_NEAR = "WITH x AS (SELECT t.s_suppkey AS target, r.s_suppkey AS neighbour, sqrt(((r.s_acctbal - t.s_acctbal) / (b - a)) ** 2 + ((r.s_nationkey - t.s_nationkey) / 24.0) ** 2) AS distance FROM supplier t, supplier r, (SELECT min(s_acctbal) AS a, max(s_acctbal) AS b FROM supplier) WHERE r.s_suppkey <> t.s_suppkey), y AS (SELECT target, neighbour, round(distance, 9) AS distance FROM x QUALIFY rank() OVER (PARTITION BY target ORDER BY distance) <= 2) "


@query("nearest_by_cells", _NEAR + "SELECT kind, y.* FROM y, (VALUES " + ", ".join(f"('{k}')" for k in [*N.SPLITTERS, "middle_out", "bottom_up"]) + ") AS k(kind)")
def nearest_by_cells(spark, d):
    """Every construction and splitter of cells, of both shapes: each must find what a search over all rows finds."""
    t = table(spark, d, "supplier")
    kinds = [(n, N.Index("top_down", n, "ball" if i < 3 else "box", 8)) for i, n in enumerate(N.SPLITTERS)] + [(c, N.Index(c, leaf=8)) for c in ("middle_out", "bottom_up")]
    ends = t.agg(F.max("s_acctbal") - F.min("s_acctbal")).first()[0]
    found = [similarity.nearest(t, t, ["s_acctbal", "s_nationkey"], 2, "s_suppkey", "s_suppkey", {"s_acctbal": ends, "s_nationkey": 24.0}, index).select(F.lit(name).alias("kind"), "*") for name, index in kinds]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


_register(
    "pair_measures", "nation",
    lambda t: _rounded(t.select("n_nationkey", similarity.token_jaccard(F.regexp_replace("n_name", "_", " "), F.lit("Nation seven 7")).alias("tokens"), similarity.edit_distance(F.col("n_name"), F.lit("NATION_77")).alias("edits"),
        *[similarity.combined([similarity.difference(F.col("n_nationkey"), F.lit(3), 0, 24), similarity.difference(F.col("n_regionkey"), F.lit(4), 0, 4), similarity.difference(F.col("n_name"), F.lit("NATION_3"))], m).alias(m) for m in ("euclidean", "manhattan", "chebyshev")]), "tokens", "euclidean", "manhattan", "chebyshev"),
    "SELECT n_nationkey, round(len(list_intersect(w, ['nation', 'seven', '7'])) / greatest(len(w), 3), 6) AS tokens, CAST(levenshtein(n_name, 'NATION_77') AS INT) AS edits, round(sqrt(a * a + b * b + c * c), 6) AS euclidean, round(a + b + c, 6) AS manhattan, round(greatest(a, b, c), 6) AS chebyshev "
    "FROM (SELECT n_nationkey, n_name, list_distinct(list_filter(regexp_split_to_array(lower(n_name), '[^a-z0-9]+'), lambda x: x <> '')) AS w, abs(n_nationkey - 3) / 24.0 AS a, abs(n_regionkey - 4) / 4.0 AS b, CASE WHEN n_name = 'NATION_3' THEN 0 ELSE 1 END AS c FROM nation)",
)
_register("kononenko_bins", "lineitem", lambda t: discretize.entropy_bins(t.withColumn("day", F.unix_date(F.to_date("l_shipdate"))), "day", "l_linestatus", "bin", True).groupBy("bin", "l_linestatus").agg(F.count("*").alias("n")), None)
_register("components_fitted", "part", lambda t: _rounded(reshape.principal_components.fit(t.where("p_partkey % 2 = 0").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 1.0)(t.where("p_partkey % 2 = 1").select("p_partkey", "p_size", "p_retailprice")).select("p_partkey", F.abs("PC1").alias("a"), F.abs("PC2").alias("b")), "a", "b", places=5),
    "WITH m AS (SELECT avg(p_size) AS a, stddev_samp(p_size) AS b, avg(p_retailprice) AS c, stddev_samp(p_retailprice) AS d, corr(p_size, p_retailprice) AS r FROM part WHERE p_partkey % 2 = 0), z AS (SELECT p_partkey, (p_size - a) / b AS x, (p_retailprice - c) / d AS y, r FROM part, m WHERE p_partkey % 2 = 1) "
    "SELECT p_partkey, round(abs(CASE WHEN r > 0 THEN x + y ELSE x - y END) / sqrt(2), 5) AS a, round(abs(CASE WHEN r > 0 THEN x - y ELSE x + y END) / sqrt(2), 5) AS b FROM z")
_register(
    "class_hidden", "lineitem", lambda t: P.without_class(P.step(C.remove_type, {"string"}, "_hidden_l_returnflag"), "l_returnflag")(t.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")),
    "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem",
)
