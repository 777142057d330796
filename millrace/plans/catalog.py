"""The registered queries over the synthetic tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.operators import rows as R
from millrace.operators import similarity, stats

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL of the same rows."""

    def add(f):
        _ALL[name] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "group_stats",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, "
    "round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY 1, 2",
)
def group_stats(spark, d):
    return (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))
    )


_PART = "p_partkey, p_size, p_retailprice"


def _register(name: str, read: str, made, sql: str) -> None:
    query(name, sql)(lambda spark, d: made(table(spark, d, read)))


def _p(df):
    return df.select("p_partkey", "p_size", "p_retailprice")


_register("remove_columns", "part", lambda t: C.remove(t, "1,3-last", invert=True), "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
_register("remove_type", "part", lambda t: C.remove_type(t, {"string"}), f"SELECT {_PART} FROM part")
_register("reorder", "region", lambda t: C.reorder(t, [2, 1]), "SELECT r_name, r_regionkey FROM region")
_register("copy_columns", "region", lambda t: C.copy(t, ["r_name"]), 'SELECT *, r_name AS "Copy of r_name" FROM region')
_register("add_column", "region", lambda t: C.add(t, "note", "string", 1), "SELECT CAST(NULL AS VARCHAR) AS note, * FROM region")
_register("add_id", "supplier", lambda t: C.add_id(t, ["s_suppkey"]).select("ID", "s_suppkey"), 'SELECT row_number() OVER (ORDER BY s_suppkey) AS "ID", s_suppkey FROM supplier')
_register("remove_useless", "nation", lambda t: C.remove_useless(t), "SELECT n_nationkey, n_regionkey FROM nation")
_register("center", "part", lambda t: C.center(_p(t), ["p_size"]).select("p_partkey", F.round("p_size", 6).alias("p_size")), "SELECT p_partkey, round(p_size - (SELECT avg(p_size) FROM part), 6) AS p_size FROM part")
_register(
    "standardize", "part", lambda t: C.standardize(_p(t), ["p_size"]).select("p_partkey", F.round("p_size", 6).alias("p_size")),
    "SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 6) AS p_size FROM part",
)
_register(
    "normalize", "part", lambda t: C.normalize(_p(t), ["p_size"], 2.0, -1.0).select("p_partkey", F.round("p_size", 6).alias("p_size")),
    "SELECT p_partkey, round((p_size - a) / (b - a) * 2.0 - 1.0, 6) AS p_size FROM part, (SELECT min(p_size) AS a, max(p_size) AS b FROM part)",
)
_register(
    "equal_width_bins", "part", lambda t: C.equal_width_bins(t, "p_size", 7, "bin").select("p_partkey", "bin"),
    "SELECT p_partkey, CAST(" + " + ".join(f"(CASE WHEN p_size > a + (b - a) / 7.0 * {i} THEN 1 ELSE 0 END)" for i in range(1, 7)) + " AS INT) AS bin FROM part, (SELECT min(p_size) AS a, max(p_size) AS b FROM part)",
)
_register("first_order", "lineitem", lambda t: C.first_order(t.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", F.round("l_tax FO l_discount", 6).alias("d")), "SELECT l_orderkey, l_linenumber, round(l_tax - l_discount, 6) AS d FROM lineitem")
_register("make_indicator", "lineitem", lambda t: C.make_indicator(t, "l_returnflag", ["R"]).select("l_orderkey", "l_linenumber", "l_returnflag"), "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS l_returnflag FROM lineitem")
_register("merge_values", "lineitem", lambda t: C.merge_values(t, "l_returnflag", "A", "N").select("l_orderkey", "l_linenumber", "l_returnflag"), "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'N') THEN 'A_N' ELSE l_returnflag END AS l_returnflag FROM lineitem")
_register(
    "numeric_cleaner", "part", lambda t: C.numeric_cleaner(t.select("p_partkey", F.col("p_size").cast("double").alias("p_size")), "p_size", 5, 5, 45, 45, 20, 20, 3, 0),
    "SELECT p_partkey, CASE WHEN p_size < 5 THEN 5.0 WHEN p_size > 45 THEN 45.0 WHEN abs(p_size - 20) < 3 AND p_size <> 20 THEN 20.0 ELSE CAST(p_size AS DOUBLE) END AS p_size FROM part",
)
_register("numeric_to_binary", "lineitem", lambda t: C.numeric_to_binary(t, ["l_discount"]).groupBy("l_discount").count(), "SELECT CASE WHEN l_discount = 0 THEN 0 ELSE 1 END AS l_discount, count(*) AS count FROM lineitem GROUP BY 1")
_register(
    "nominal_to_binary", "lineitem", lambda t: C.nominal_to_binary(t, "l_returnflag", ["A", "N", "R"]).agg(*[F.sum(f"l_returnflag={v}").alias(f"n_{v}") for v in "ANR"]),
    "SELECT " + ", ".join(f"CAST(sum(CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END) AS DOUBLE) AS n_{v}" for v in "ANR") + " FROM lineitem",
)


@query(
    "replace_missing",
    "WITH j AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) "
    "SELECT doc_id, round(coalesce(quality, (SELECT avg(quality) FROM j)), 6) AS quality FROM j",
)
def replace_missing(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double")), "doc_id", "left")
    return C.replace_missing(rows, ["quality"]).select("doc_id", F.round("quality", 6).alias("quality"))


_register(
    "math_expression", "part", lambda t: C.math_expression(_p(t), "p_size", "(A - MEAN) / (MAX - MIN) + log(COUNT)").select("p_partkey", F.round("p_size", 6).alias("p_size")),
    "SELECT p_partkey, round((p_size - m) / (b - a) + ln(n), 6) AS p_size FROM part, (SELECT avg(p_size) AS m, min(p_size) AS a, max(p_size) AS b, count(p_size) AS n FROM part)",
)
_register(
    "relaggs", "lineitem", lambda t: C.relaggs(t, "l_orderkey", ["l_quantity"], {"l_returnflag": ["A", "R"]}, "li"),
    "SELECT l_orderkey, min(l_quantity) AS li_l_quantity_MIN, max(l_quantity) AS li_l_quantity_MAX, avg(l_quantity) AS li_l_quantity_AVG, "
    "CASE WHEN count(*) = 1 THEN CAST('Infinity' AS DOUBLE) ELSE stddev_samp(l_quantity) END AS li_l_quantity_STDEV, sum(l_quantity) AS li_l_quantity_SUM, "
    "count(*) FILTER (l_returnflag = 'A') AS li_l_returnflag_A_CNT, count(*) FILTER (l_returnflag = 'R') AS li_l_returnflag_R_CNT FROM lineitem GROUP BY 1",
)
_register(
    "time_series_delta", "events", lambda t: C.time_series_delta(t.select("event_id", "user_id", "ts", "value"), ["value"], ["ts", "event_id"], by=["user_id"]).select("event_id", F.round("value d-1", 6).alias("delta")),
    "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events",
)
_register(
    "time_series_translate", "events", lambda t: C.time_series_delta(t.select("event_id", "user_id", "ts", "value"), ["value"], ["ts", "event_id"], lag=2, by=["user_id"], translate=True, fill=False).select("event_id", "value"),
    "SELECT event_id, v AS value FROM (SELECT event_id, lead(value, 2) OVER w AS v, lead(1, 2) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p = 1",
)
_register(
    "unit_rows", "lineitem", lambda t: C.unit_rows(t.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", F.round("l_tax", 8).alias("l_tax")),
    "SELECT l_orderkey, l_linenumber, round(l_tax / sqrt(l_quantity * l_quantity + l_tax * l_tax), 8) AS l_tax FROM lineitem",
)
_register(
    "subset_by_expression", "lineitem", lambda t: R.subset_by_expression(t.select("l_orderkey", "l_quantity", "l_returnflag"), "not (ATT2 < 10) and ATT3 is 'R' or ATT2 = 1").select("l_orderkey", "l_quantity"),
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE (l_quantity >= 10 AND l_returnflag = 'R') OR l_quantity = 1",
)
_register("remove_with_values", "part", lambda t: R.remove_with_values(t, "p_size", split=10).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size < 10")
_register(
    "keep_frequent_values", "orders", lambda t: R.keep_frequent_values(t, "o_orderpriority", 2).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)",
)
_register("remove_range", "part", lambda t: R.remove_range(t, 3, 40, ["p_partkey"]).select("p_partkey"), "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i FROM part) WHERE i NOT BETWEEN 3 AND 40")
_register("remove_percentage", "part", lambda t: R.remove_percentage(t, 33.3, ["p_partkey"]).select("p_partkey"), "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i FROM part) WHERE i > floor((SELECT count(*) FROM part) * 33.3 / 100 + 0.5)")
_register("fold", "part", lambda t: R.fold(t, 2, 5, ["p_partkey"]).select("p_partkey"), "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i FROM part) WHERE (i - 1) % 5 = 1")
_register("stratified_fold", "part", lambda t: R.fold(t, 1, 4, ["p_partkey"], by="p_brand").select("p_partkey"), "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part) WHERE (i - 1) % 4 = 0")
_register(
    "spread_subsample", "lineitem", lambda t: R.spread_subsample(t, "l_returnflag", 1.0, ["l_orderkey", "l_linenumber"]).groupBy("l_returnflag").count(),
    "SELECT l_returnflag, (SELECT min(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)) AS count FROM lineitem GROUP BY 1",
)
_register("resample_size", "part", lambda t: R.resample(t, 12.5, 1, ["p_partkey"]).agg(F.count("*").alias("n")), "SELECT CAST(floor(count(*) * 12.5 / 100) AS BIGINT) AS n FROM part")
_register(
    "profile", "orders", lambda t: stats.profile(t, ["o_orderstatus", "o_custkey"]),
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS missing, count(v) AS \"distinct\", "
        f"count(*) FILTER (v IS NOT NULL AND n = 1) AS \"unique\" FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1)"
        for c in ("o_orderstatus", "o_custkey")
    ),
)
_CELLS = (
    "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), "
    "x AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM c), "
    "e AS (SELECT (SELECT -sum(p * log2(p)) FROM (SELECT sum(n) / any_value(t) AS p FROM x GROUP BY a)) AS ha, "
    "(SELECT -sum(p * log2(p)) FROM (SELECT sum(n) / any_value(t) AS p FROM x GROUP BY b)) AS hb, (SELECT -sum(n / t * log2(n / t)) FROM x) AS hab) "
)
_register(
    "contingency", "lineitem", lambda t: stats.contingency(t, "l_returnflag", "l_linestatus").select(*[F.round(c, 8).alias(c) for c in ("cramers_v", "class_entropy", "info_gain", "gain_ratio")]),
    _CELLS + "SELECT round(sqrt((SELECT sum(n * n / (ra * rb)) - 1 FROM x)), 8) AS cramers_v, round(hb, 8) AS class_entropy, round(ha + hb - hab, 8) AS info_gain, round((ha + hb - hab) / ha, 8) AS gain_ratio FROM e",
)
_register(
    "threshold_curve", "lineitem", lambda t: stats.threshold_curve(t.withColumn("y", F.col("l_returnflag") == "R"), "l_discount", "y").select("threshold", "tp", "fp", "fn", "tn"),
    "SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER () - sum(p) OVER w AS BIGINT) AS fn, CAST(sum(q) OVER () - sum(q) OVER w AS BIGINT) AS tn "
    "FROM (SELECT l_discount AS threshold, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY threshold DESC)",
)
_register("confusion", "lineitem", lambda t: stats.confusion(t, "l_returnflag", "l_linestatus"), "SELECT l_returnflag AS actual, l_linestatus AS predicted, count(*) AS n FROM lineitem GROUP BY 1, 2")
_register(
    "paired_stats", "lineitem", lambda t: stats.paired_stats(t, "l_discount", "l_tax").select("n", *[F.round(c, 8).alias(c) for c in ("mean_difference", "sd_difference", "correlation")]),
    "SELECT count(*) AS n, round(avg(l_discount - l_tax), 8) AS mean_difference, round(stddev_samp(l_discount - l_tax), 8) AS sd_difference, round(corr(l_discount, l_tax), 8) AS correlation FROM lineitem",
)
_register(
    "frequent_pairs", "lineitem", lambda t: stats.frequent_pairs(t, "l_orderkey", "l_linenumber", 50),
    "SELECT x.l_linenumber AS a, y.l_linenumber AS b, count(DISTINCT x.l_orderkey) AS support FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber GROUP BY 1, 2 HAVING count(DISTINCT x.l_orderkey) >= 50",
)
_register(
    "rank_attributes", "lineitem", lambda t: stats.rank_attributes(t, ["l_returnflag", "l_linenumber"], "l_linestatus").select("name", F.round("info_gain", 8).alias("info_gain")),
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, round(sum(n / t * log2(n * t / (ra * rb))), 8) AS info_gain FROM (SELECT n, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, CAST(sum(n) OVER () AS DOUBLE) AS t FROM "
        f"(SELECT {c} AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2))"
        for c in ("l_returnflag", "l_linenumber")
    ),
)
_register(
    "nearest", "part", lambda t: similarity.nearest(t.where("p_partkey % 20 = 0"), t, ["p_size", "p_retailprice"], 3, "p_partkey", "p_partkey"),
    "WITH m AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part), "
    "x AS (SELECT t.p_partkey AS target, r.p_partkey AS neighbour, sqrt(((r.p_size - t.p_size) / (b - a)) ** 2 + ((r.p_retailprice - t.p_retailprice) / (d - c)) ** 2) AS distance "
    "FROM part t, part r, m WHERE t.p_partkey % 20 = 0 AND r.p_partkey <> t.p_partkey) SELECT target, neighbour, round(distance, 9) AS distance FROM x QUALIFY rank() OVER (PARTITION BY target ORDER BY distance) <= 3",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}


from millrace.plans import filter_queries, function_queries, learner_queries, mining_queries, record_queries, source_queries  # noqa: E402, F401  register their queries
