"""Queries of discretisation, reshaping, text, mining, models, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.operators import discretize, evaluation, mining, models, reshape, similarity, stats, text
from millrace.operators import rows as R
from millrace.plans import experiment
from millrace.plans.catalog import _register, query, table
from millrace.sources import generators
from millrace.streaming import flows


def _rounded(df, *names, places=6):
    return df.select([F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


_register(
    "add_expression", "lineitem", lambda t: _rounded(C.add_expression(t.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), "a3^2 + log(a3) * a4", "e").select("l_orderkey", "l_linenumber", "e"), "e"),
    "SELECT l_orderkey, l_linenumber, round(l_quantity ** 2 + ln(l_quantity) * l_tax, 6) AS e FROM lineitem",
)
_register(
    "numeric_transform", "part", lambda t: _rounded(C.numeric_transform(t.select("p_partkey", "p_retailprice"), ["p_retailprice"], "sqrt"), "p_retailprice"),
    "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS p_retailprice FROM part",
)
_register(
    "change_date_format", "events", lambda t: C.change_date_format(t.select("event_id", "ts"), "ts", "yyyy-MM").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("month")),
    "SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month FROM events",
)
_register("numeric_to_nominal", "part", lambda t: C.numeric_to_nominal(t, ["p_size"], 0).select("p_partkey", "p_size"), "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
_register(
    "obfuscate", "orders", lambda t: C.obfuscate(C.with_domain(t.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])),
    "SELECT o_orderkey AS \"A1\", CASE o_orderstatus WHEN 'F' THEN 'V1' WHEN 'O' THEN 'V2' WHEN 'P' THEN 'V3' END AS \"A2\" FROM orders",
)
_register(
    "supervised_to_binary", "orders", lambda t: C.supervised_to_binary(t.select("o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice").toDF("o_totalprice", *[f"k{i}" for i in range(1, 5)]).agg(*[F.sum(f"k{i}").alias(f"k{i}") for i in range(1, 5)]),
    "WITH m AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY avg(o_totalprice), o_orderpriority) AS r FROM orders GROUP BY 1) SELECT "
    + ", ".join(f"CAST(sum(CASE WHEN r > {i} THEN 1 ELSE 0 END) AS DOUBLE) AS k{i}" for i in range(1, 5)) + " FROM orders JOIN m ON o_orderpriority = v",
)
_register(
    "add_noise", "lineitem", lambda t: C.add_noise(t.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_returnflag").alias("before")), "l_returnflag", 10, 1, ["l_orderkey", "l_linenumber"]).where("before <> l_returnflag").groupBy("before").count(),
    "SELECT l_returnflag AS before, CAST(floor(count(*) * 0.1 + 0.5) AS BIGINT) AS count FROM lineitem GROUP BY 1",
)
_register(
    "time_series_whole", "orders", lambda t: _rounded(C.time_series_delta(t.select("o_orderkey", "o_totalprice"), ["o_totalprice"], ["o_orderkey"]).toDF("o_orderkey", "d"), "d"),
    "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderkey), 6) AS d FROM orders",
)
_register("reservoir_sample", "orders", lambda t: R.reservoir_sample(t, 100, 3, ["o_orderkey"]).select("o_orderkey").distinct().join(t, "o_orderkey", "left_semi").agg(F.count("*").alias("n")), "SELECT least(count(*), 100) AS n FROM orders")
_register("train_test_split", "orders", lambda t: R.train_test_split(t, 66, 1, ["o_orderkey"])[0].agg(F.count("*").alias("n")), "SELECT CAST(floor(count(*) * 0.66 + 0.5) AS BIGINT) AS n FROM orders")


@query("zip_rows", "SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS i FROM supplier) b USING (i)")
def zip_rows(spark, d):
    return R.zip_rows(table(spark, d, "customer").select("c_custkey"), table(spark, d, "supplier").select("s_suppkey"), ["c_custkey"], [F.desc("s_suppkey")])


_register("equal_frequency_bins", "lineitem", lambda t: discretize.equal_frequency_bins(t, "l_extendedprice", 5, "bin").groupBy("bin").agg(F.count("*").alias("n")), None)
_register("root_frequency_bins", "part", lambda t: discretize.root_frequency_bins(t, "p_retailprice", "bin").groupBy("bin").agg(F.count("*").alias("n")), None)
_register("entropy_bins", "lineitem", lambda t: discretize.entropy_bins(t.withColumn("day", F.unix_date(F.to_date("l_shipdate"))), "day", "l_linestatus", "bin").groupBy("bin", "l_linestatus").agg(F.count("*").alias("n")), None)

_register(
    "bags", "lineitem", lambda t: reshape.to_bags(t.select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus"), "l_orderkey", "l_linestatus", ["l_linenumber"]).select("l_orderkey", F.size("bag").alias("n"), F.col("bag")[0]["l_quantity"].alias("first"), "l_linestatus"),
    "SELECT l_orderkey, count(*)::INT AS n, arg_min(l_quantity, (l_linenumber, l_quantity, l_linestatus)) AS first, arg_min(l_linestatus, (l_linenumber, l_quantity, l_linestatus)) AS l_linestatus FROM lineitem GROUP BY 1",
)
_register(
    "bags_unrolled", "lineitem",
    lambda t: _rounded(reshape.from_bags(reshape.to_bags(t.select("l_orderkey", "l_linenumber", "l_linestatus"), "l_orderkey", "l_linestatus", ["l_linenumber"]), "l_orderkey", "bag", "l_linestatus", "bag").select("l_orderkey", "l_linenumber", "_weight"), "_weight"),
    "SELECT l_orderkey, l_linenumber, round(1.0 / count(*) OVER (PARTITION BY l_orderkey), 6) AS _weight FROM lineitem",
)
_register(
    "transpose", "part", lambda t: reshape.transpose(t, ["p_partkey"], ["p_size", "p_retailprice"]),
    " UNION ALL ".join(f"SELECT '{c}' AS name, row_number() OVER (ORDER BY p_partkey) AS row, CAST({c} AS DOUBLE) AS value FROM part" for c in ("p_size", "p_retailprice")),
)
_register(
    "wavelet", "lineitem", lambda t: _rounded(reshape.wavelet(t.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"]), *[f"wavelet_{i}" for i in range(4)]),
    "SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 2, 6) AS wavelet_0, round((l_quantity + l_discount - l_tax) / 2, 6) AS wavelet_1, "
    "round((l_quantity - l_discount) / sqrt(2), 6) AS wavelet_2, round(l_tax / sqrt(2), 6) AS wavelet_3 FROM lineitem",
)
_register("random_projection", "lineitem", lambda t: reshape.random_projection(t.select("l_orderkey", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"], 2, 7), None)
_register("principal_components", "part", lambda t: reshape.principal_components(t.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 1.0).agg(*[F.round(F.variance(f"PC{i}"), 5).alias(f"v{i}") for i in (1, 2)]), "SELECT round(1 + abs(corr(p_size, p_retailprice)), 5) AS v1, round(1 - abs(corr(p_size, p_retailprice)), 5) AS v2 FROM part")

_WORDS = "SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\r\\n\\t.,;:''\"()?!]+'), lambda x: x <> '')) AS word FROM documents"
_register("alphabetic_tokens", "documents", lambda t: t.select("doc_id", F.size(text.alphabetic(F.coalesce("text", F.lit("")))).alias("n")), "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))::INT AS n FROM documents")
_register("ngrams", "part", lambda t: t.select("p_partkey", F.array_join(text.ngrams(text.delimited(F.col("p_type")), 1, 2), "|").alias("grams")), "WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(p_type, '[ \\r\\n\\t.,;:''\"()?!]+'), lambda x: x <> '') AS w FROM part) SELECT p_partkey, array_to_string(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), w), '|') AS grams FROM w")
_register("word_vectors", "documents", lambda t: text.word_vectors(t, "doc_id", "text", 50, "lang"), f"WITH w AS ({_WORDS}), c AS (SELECT lang, word, count(*) AS n FROM w JOIN documents USING (doc_id) GROUP BY 1, 2), k AS (SELECT DISTINCT word FROM (SELECT word, rank() OVER (PARTITION BY lang ORDER BY n DESC) AS r FROM c) WHERE r <= 50) SELECT DISTINCT doc_id, word, CAST(1 AS DOUBLE) AS value FROM w SEMI JOIN k USING (word)")
_register("tf_idf", "documents", lambda t: _rounded(text.tf_idf(t, "doc_id", "text"), "weight", places=5), f"WITH w AS ({_WORDS.replace('(text,', '(lower(text),')}), f AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2), i AS (SELECT word, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM f GROUP BY 1) SELECT doc_id, word, round(tf * idf, 5) AS weight FROM f JOIN i USING (word) WHERE idf > 0")

_MASKS = "WITH o AS (SELECT l_orderkey, bit_or(1 << (l_linenumber - 1)) AS m FROM lineitem GROUP BY 1), c AS (SELECT g AS s, count(*) FILTER (m & g = g) AS n FROM o, generate_series(1, 127) t(g) GROUP BY 1), z AS (SELECT count(*) AS z FROM o)"
_NAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {{0}} & {1 << i} > 0 THEN '{i + 1}' END" for i in range(7)) + "], lambda x: x IS NOT NULL), ',')"
_register("itemsets", "lineitem", lambda t: mining.itemsets(t, "l_orderkey", "l_linenumber", 0.01).select(F.array_join("items", ",").alias("items"), "n"), f"{_MASKS} SELECT {_NAMES.format('s')} AS items, n FROM c, z WHERE n >= ceil(0.01 * z)")
_register(
    "rules", "lineitem", lambda t: _rounded(mining.rules(t, "l_orderkey", "l_linenumber", 0.01, 0.1), "confidence", "lift", "leverage", "conviction"),
    f"{_MASKS} SELECT {_NAMES.format('x.s')} AS premise, {_NAMES.format('y.s')} AS consequence, b.n AS n, round(b.n / x.n, 6) AS confidence, round(b.n / x.n / (y.n / z), 6) AS lift, round(b.n / z - x.n / z * (y.n / z), 6) AS leverage, "
    "CASE WHEN x.n > b.n THEN round(x.n * (z - y.n) / (z * (x.n - b.n)), 6) END AS conviction FROM c b, c x, c y, z WHERE y.s IN (1, 2, 4, 8, 16, 32, 64) AND x.s & y.s = 0 AND b.s = x.s | y.s AND b.n >= ceil(0.01 * z) AND b.n / x.n >= 0.1",
)
_register(
    "sequences", "events", lambda t: mining.sequences(t, "user_id", "event_type", ["ts", "event_id"], 0.01, 2),
    "WITH u AS (SELECT count(DISTINCT user_id) AS u FROM events), s AS (SELECT event_type AS sequence, count(DISTINCT user_id) AS n FROM events GROUP BY 1 UNION ALL "
    "SELECT x.event_type || ' > ' || y.event_type, count(DISTINCT x.user_id) FROM events x JOIN events y ON x.user_id = y.user_id AND (x.ts, x.event_id) < (y.ts, y.event_id) GROUP BY 1) SELECT sequence, n FROM s, u WHERE n >= ceil(0.01 * u)",
)
# Of any length, within a user's day: over all of a user's events nearly all sequences are frequent, too many for any result.
_register("sequences_whole", "events", lambda t: mining.sequences(t.withColumn("day", F.struct("user_id", F.to_date("ts"))), "day", "event_type", ["ts", "event_id"], 0.01), None)

_TOP = "SELECT {0}, arg_max({1}, (n, -r)) AS prediction FROM (SELECT {0}, {1}, count(*) AS n, dense_rank() OVER (ORDER BY {1}) AS r FROM {2} GROUP BY {0}, {1}) GROUP BY {0}"
_register("zero_rule", "lineitem", lambda t: models.zero_rule(t, "l_returnflag")(t).select("l_orderkey", "l_linenumber", "prediction"), "SELECT l_orderkey, l_linenumber, (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction FROM lineitem")
_RULE = " UNION ALL ".join(
    f"SELECT {i} AS i, v, arg_max(y, (n, -r)) AS p, max(n) AS hit FROM (SELECT CAST({c} AS VARCHAR) AS v, l_returnflag AS y, count(*) AS n, dense_rank() OVER (ORDER BY l_returnflag) AS r FROM lineitem GROUP BY 1, 2) GROUP BY v"
    for i, c in enumerate(("l_linestatus", "l_linenumber"))
)
_register(
    "one_rule", "lineitem", lambda t: models.one_rule(t, ["l_linestatus", "l_linenumber"], "l_returnflag")[1](t).groupBy("l_returnflag", "prediction").count(),
    f"WITH m AS ({_RULE}), b AS (SELECT i FROM m GROUP BY 1 ORDER BY sum(hit) DESC, i LIMIT 1) SELECT l_returnflag, p AS prediction, count(*) AS count FROM lineitem, b, m "
    "WHERE m.i = b.i AND m.v = CASE WHEN b.i = 0 THEN l_linestatus ELSE CAST(l_linenumber AS VARCHAR) END GROUP BY 1, 2",
)
_register("decision_table", "lineitem", lambda t: models.decision_table(t, ["l_linestatus", "l_linenumber"], "l_returnflag")(t).groupBy("l_returnflag", "prediction").count(), "WITH m AS (" + _TOP.format("l_linestatus, l_linenumber", "l_returnflag", "lineitem") + ") SELECT l_returnflag, prediction, count(*) AS count FROM lineitem JOIN m USING (l_linestatus, l_linenumber) GROUP BY 1, 2")
_register("consistency", "lineitem", lambda t: _rounded(models.consistency(t, ["l_linestatus", "l_linenumber"], "l_returnflag"), "consistency"), "SELECT round(sum(m) / sum(s), 6) AS consistency FROM (SELECT max(n) AS m, sum(n) AS s FROM (SELECT l_linestatus, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY l_linestatus, l_linenumber)")


@query(
    "naive_bayes",
    "WITH m AS (SELECT l_returnflag AS y, count(*) AS n, avg(l_quantity) AS a, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1), "
    "c AS (SELECT l_returnflag AS y, l_linestatus AS v, count(*) AS k FROM lineitem GROUP BY 1, 2), v AS (SELECT DISTINCT l_linestatus AS v FROM lineitem), "
    "p AS (SELECT m.y, v.v, ln((n + 1) / ((SELECT sum(n) + count(*) FROM m))) + ln((coalesce(k, 0) + 1) / (n + (SELECT count(*) FROM v))) - ln(s * sqrt(2 * pi())) AS b, a, s FROM m CROSS JOIN v LEFT JOIN c ON c.y = m.y AND c.v = v.v) "
    "SELECT l_orderkey, l_linenumber, round(max(b - ((l_quantity - a) / s) ** 2 / 2), 6) AS log_score FROM lineitem JOIN p ON p.v = l_linestatus GROUP BY l_orderkey, l_linenumber, l_quantity",
)
def naive_bayes(spark, d):
    t = table(spark, d, "lineitem")
    return _rounded(models.naive_bayes(t, ["l_quantity"], ["l_linestatus"], "l_returnflag")(t).groupBy("l_orderkey", "l_linenumber", "l_quantity").agg(F.max("log_score").alias("log_score")).drop("l_quantity"), "log_score")


_register(
    "hyper_pipes", "lineitem", lambda t: models.hyper_pipes(t, ["l_quantity", "l_tax"], "l_returnflag")(t).select("l_orderkey", "l_linenumber", "prediction"),
    "WITH r AS (SELECT l_returnflag AS y, min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS d, row_number() OVER (ORDER BY l_returnflag) AS i FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey, l_linenumber, prediction FROM lineitem JOIN (SELECT l_quantity, l_tax, arg_max(y, (CAST(l_quantity BETWEEN a AND b AS INT) + CAST(l_tax BETWEEN c AND d AS INT), -i)) AS prediction FROM (SELECT DISTINCT l_quantity, l_tax FROM lineitem), r GROUP BY 1, 2) USING (l_quantity, l_tax)",
)
_register("farthest_first", "part", lambda t: t.sparkSession.createDataFrame([(c["k"],) for c in models.farthest_first(t, "p_partkey", ["p_size", "p_retailprice"], 4)], "centre long"), None)
_register("k_means", "part", lambda t: models.spark_model("k_means", t, ["p_size", "p_retailprice"], k=4, seed=1).transform(t).groupBy("prediction").agg(F.count("*").alias("n")), None)
_register("logistic", "lineitem", lambda t: models.spark_model("logistic", t, ["l_quantity", "l_tax"], "l_linestatus", maxIter=10).transform(t).groupBy("prediction").agg(F.count("*").alias("n")), None)
_register("class_scores", "lineitem", lambda t: _rounded(evaluation.class_scores(t.withColumn("p", F.when(F.col("l_quantity") > 25, "R").otherwise("A")), "l_returnflag", "p").select("class", "tp", "fp", "fn", "f"), "f"),
    "WITH x AS (SELECT l_returnflag AS a, CASE WHEN l_quantity > 25 THEN 'R' ELSE 'A' END AS p FROM lineitem), c AS (SELECT DISTINCT a AS class FROM x), "
    "s AS (SELECT class, count(*) FILTER (a = class AND p = class) AS tp, count(*) FILTER (a <> class AND p = class) AS fp, count(*) FILTER (a = class AND p <> class) AS fn FROM x, c GROUP BY 1) SELECT *, round(2 * tp / (2 * tp + fp + fn), 6) AS f FROM s")  # fmt: skip
_register(
    "cluster_agreement", "lineitem", lambda t: _rounded(evaluation.cluster_agreement(t, "l_linenumber", "l_returnflag"), "purity", "entropy", "nmi", "pair_precision", "pair_recall", "pair_f").select("purity", "entropy", "pair_precision", "pair_recall", "pair_f"),
    "WITH c AS (SELECT l_linenumber AS a, l_returnflag AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT a, sum(n) AS ra, max(n) AS top FROM c GROUP BY 1), b AS (SELECT sum(rb * (rb - 1) / 2) AS pb FROM (SELECT sum(n) AS rb FROM c GROUP BY b)), "
    "t AS (SELECT sum(ra) AS t, sum(top) AS hit, sum(ra * (ra - 1) / 2) AS pa FROM a), s AS (SELECT sum(n * (n - 1) / 2) AS pp, -sum(n * log2(n / ra)) AS h FROM c JOIN a USING (a)) "
    "SELECT round(hit / t, 6) AS purity, round(h / t, 6) AS entropy, round(pp / pa, 6) AS pair_precision, round(pp / pb, 6) AS pair_recall, round(2 * pp / (pa + pb), 6) AS pair_f FROM s, t, b",
)
_register("margin_curve", "lineitem", lambda t: evaluation.margin_curve(t, "l_discount"), "SELECT l_discount AS margin, count(*) AS current, CAST(sum(count(*)) OVER (ORDER BY l_discount) AS BIGINT) AS cumulative FROM lineitem GROUP BY 1")
_register("result_matrix", "lineitem", lambda t: _rounded(evaluation.result_matrix(t, "l_linestatus", "l_returnflag", "l_quantity", ["A", "N", "R"]), "A", "N", "R"), "SELECT l_linestatus, " + ", ".join(f"round(avg(l_quantity) FILTER (l_returnflag = '{v}'), 6) AS \"{v}\"" for v in "ANR") + " FROM lineitem GROUP BY 1")
_register("folds", "lineitem", lambda t: experiment.with_folds(t.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["l_orderkey", "l_linenumber"], 5, 1).groupBy("l_returnflag", "_fold").agg(F.count("*").alias("n")).groupBy("l_returnflag").agg((F.max("n") - F.min("n") <= 1).alias("even"), F.sum("n").alias("n")), "SELECT l_returnflag, true AS even, count(*) AS n FROM lineitem GROUP BY 1")


@query("cross_validation")
def cross_validation(spark, d):
    schemes = {"zero": lambda train: models.zero_rule(train, "l_returnflag"), "table": lambda train: models.decision_table(train, ["l_linestatus"], "l_returnflag")}
    return experiment.cross_validate(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag"), schemes, "l_returnflag", ["l_orderkey", "l_linenumber"], folds=3)


@query("generated_clusters")
def generated_clusters(spark, d):
    return generators.gaussian_clusters(spark, 1000, 3, 2).groupBy("cluster").agg(F.count("*").alias("n"))


def _events(spark, d):
    return flows.files(spark, d, "events.parquet", table(spark, d, "events").schema)


@query("stream_profile", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def stream_profile(spark, d):
    return _rounded(flows.drain(flows.running_profile(_events(spark, d), "event_type", "value"), "complete"), "total", places=4)


@query("stream_filter", "SELECT event_id, value FROM events WHERE value < 10")
def stream_filter(spark, d):
    return flows.drain(R.subset_by_expression(_events(spark, d).select("event_id", "value"), "ATT2 < 10"))


@query("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    rows = flows.drain(flows.windowed(_events(spark, d), "ts", "event_type", "value", "1 day", "1 hour"), "complete")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


_register(
    "association", "lineitem", lambda t: _rounded(stats.association(t, "l_linestatus", "l_returnflag"), "tau", "chi2", places=4),
    "WITH c AS (SELECT l_linestatus AS a, l_returnflag AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM c), "
    "g AS (SELECT sum(n * n) AS q FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((sum(n * n / ra) - any_value(q) / any_value(t)) / (any_value(t) - any_value(q) / any_value(t)), 4) AS tau, round(any_value(t) * (sum(n * n / (ra * rb)) - 1), 4) AS chi2 FROM x, g",
)
_register("value_shares", "lineitem", lambda t: _rounded(stats.value_shares(t, "l_returnflag", ["l_linestatus"], laplace=True), "share"), "SELECT l_linestatus, l_returnflag, round((n + 1) / sum(n + 1) OVER (PARTITION BY l_linestatus), 6) AS share FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)")
_register(
    "subgroup", "lineitem", lambda t: t.sparkSession.createDataFrame([(a, v, n, round(s, 6)) for a, v, n, s in stats.subgroup(t, ["l_linenumber", "l_linestatus"], "l_returnflag", "R", 50, 1)], "name string, value string, n long, share double"),
    "SELECT name, value, n, round(s, 6) AS share FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n, avg(CAST(l_returnflag = 'R' AS INT)) AS s FROM lineitem GROUP BY 2" for c in ("l_linenumber", "l_linestatus"))
    + ") WHERE n >= 50 AND s > (SELECT avg(CAST(l_returnflag = 'R' AS INT)) FROM lineitem) ORDER BY s DESC, n DESC, name, value LIMIT 1",
)
_VECTORS = (
    "WITH w AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name), '[ \\r\\n\\t.,;:''\"()?!]+'), lambda x: x <> '')) AS word FROM part), f AS (SELECT p_partkey AS k, word, count(*) AS tf FROM w GROUP BY 1, 2), "
    "i AS (SELECT word, ln((SELECT count(*) FROM part) / count(*)) AS idf FROM f GROUP BY 1), v AS (SELECT k, word, tf, tf * idf AS x FROM f JOIN i USING (word) WHERE idf > 0), "
    "s AS (SELECT k, string_agg(word || ':' || tf, ',' ORDER BY word) AS s FROM v GROUP BY 1), r AS (SELECT k, min(k) OVER (PARTITION BY s) AS first FROM s), "
    "u AS (SELECT k, word, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS x FROM v SEMI JOIN (SELECT k FROM r WHERE k = first) USING (k)) "
)
_register("same_vectors", "part", lambda t: similarity.same_vectors(t, "p_partkey", "p_name"), _VECTORS + "SELECT k AS p_partkey, first FROM r")
_register(
    "similar_texts", "part", lambda t: _rounded(similarity.similar_texts(t, "p_partkey", "p_name", 0.4), "cosine", places=5),
    _VECTORS + "SELECT p.k AS a, q.k AS b, round(sum(p.x * q.x), 5) AS cosine FROM u p JOIN u q ON p.word = q.word AND p.k < q.k GROUP BY 1, 2 HAVING sum(p.x * q.x) >= 0.4",
)
_register("affine_gap", "nation", lambda t: t.select("n_nationkey", similarity.affine_gap(F.lit("NATION_7 AND MORE"), F.col("n_name"), extended=1.0).alias("cost")), "SELECT n_nationkey, CAST(levenshtein('NATION_7 AND MORE', n_name) AS DOUBLE) AS cost FROM nation")
_register("remove_misclassified", "lineitem", lambda t: R.remove_misclassified(t, lambda rows: models.zero_rule(rows, "l_returnflag"), "l_returnflag").groupBy("l_returnflag").count(), "SELECT l_returnflag, count(*) AS count FROM lineitem WHERE l_returnflag = (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1")
