"""Queries of score, clique, link and matrix tables, and of dataflow operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evaluation, mining
from millrace.operators import records as K
from millrace.operators import rows as R
from millrace.plans import filters as P
from millrace.plans.catalog import _register, query, table
from millrace.plans.mining_queries import _rounded
from millrace.plans.numbering import scratch
from millrace.streaming import flows


def _scores(t):
    """Scores of three raters: a label, a probability and the actual label of each order."""
    rated = t.where("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber")
    held = rated.agg(F.min("l_returnflag").alias("label"), (F.min("l_discount") * 5 + 0.1).alias("prob"), F.min("l_linestatus").alias("actual"))
    return held.select(F.col("l_orderkey").alias("idx"), "label", "prob", "actual", F.col("l_linenumber").alias("rater"))


_S = "WITH s AS (SELECT l_orderkey AS idx, min(l_returnflag) AS label, min(l_discount) * 5 + 0.1 AS prob, min(l_linestatus) AS actual, l_linenumber AS rater FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 5) "
_register("score_table", "lineitem", lambda t: _rounded(K.score_table(_scores(t).withColumn("label", F.when(F.col("label") == "N", "O").otherwise("F")), ["F", "O"]), "recall", "accuracy"), _S + ", x AS (SELECT actual, CASE WHEN label = 'N' THEN 'O' ELSE 'F' END AS label FROM s) SELECT actual, CAST(count(*) FILTER (label = 'F') AS BIGINT) AS \"as_F\", CAST(count(*) FILTER (label = 'O') AS BIGINT) AS \"as_O\", round(avg(CAST(label = actual AS INT)), 6) AS recall, round((SELECT avg(CAST(label = actual AS INT)) FROM x), 6) AS accuracy FROM x GROUP BY 1")


def _pair(t):
    a = t.select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("label"), F.lit(0.3).alias("prob"))
    return a, t.select(F.col("c_custkey").alias("idx"), (F.col("c_nationkey") * F.col("c_custkey") % 25).alias("label"), F.lit(0.5).alias("prob"))


_register("differing_labels", "customer", lambda t: _rounded(K.differing(*_pair(t), ["idx"]).withColumn("weighted", F.lit(K.differing(*_pair(t), ["idx"], True).first()[0])), "differing", "weighted"), "SELECT round(avg(CASE WHEN x <> y THEN 1.0 ELSE 0.0 END), 6) AS differing, round(avg(CASE WHEN abs(x * 0.3 - y * 0.5) > 1 THEN 1.0 ELSE 0.0 END), 6) AS weighted FROM (SELECT c_nationkey AS x, c_nationkey * c_custkey % 25 AS y FROM customer)")


def _tables(t):
    held = t.groupBy(F.col("l_orderkey").alias("idx"), "l_linenumber").agg(F.max("l_quantity").alias("label"), F.max("l_discount").alias("prob"))
    return [held.where(f"l_linenumber = {k}").drop("l_linenumber") for k in (1, 2, 3)]


_register("mean_vote", "lineitem", lambda t: _rounded(K.mean_vote(_tables(t), t.where("l_linenumber = 1 and l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("idx"), F.lit(7).alias("label")).distinct()), "label"), "SELECT l_orderkey AS idx, round(CASE WHEN l_orderkey % 10 = 0 AND bool_or(l_linenumber = 1) THEN 7 ELSE sum(q * p) / 3 END, 6) AS label FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_discount) AS p FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2) GROUP BY 1")
_register("weighted_vote", "lineitem", lambda t: _rounded(K.weighted_vote(_scores(t)), "share"), _S + ", v AS (SELECT idx, label, sum(prob) AS s FROM s GROUP BY 1, 2) SELECT idx, label, round(s / t, 6) AS share FROM (SELECT *, sum(s) OVER (PARTITION BY idx) AS t, row_number() OVER (PARTITION BY idx ORDER BY round(s, 12) DESC, label) AS r FROM v) WHERE r = 1")
_register("most_uncertain", "lineitem", lambda t: K.most_uncertain(_scores(t).where("rater = 1").withColumn("v", F.col("prob") - 0.35), "v", 40).select("idx"), _S + "SELECT idx FROM s WHERE rater = 1 ORDER BY abs(prob - 0.35), idx LIMIT 40")
_register("most_disputed", "lineitem", lambda t: _rounded(K.most_disputed(_scores(t).select("idx", F.col("prob").alias("label")), t.where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("idx"))), "variance"), _S + "SELECT idx, round(CASE WHEN idx % 5 = 0 THEN 0 ELSE var_pop(prob) END, 6) AS variance FROM s GROUP BY 1")


@query("score_indexing", _S + ", a AS (SELECT idx, row_number() OVER (ORDER BY idx) AS i FROM s WHERE rater = 1), b AS (SELECT c_custkey * 7 AS new, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) SELECT new AS idx, label, 'renamed' AS kind FROM a JOIN b USING (i) JOIN s ON s.idx = a.idx AND rater = 1 UNION ALL SELECT idx, arg_max(label, rater), 'merged' FROM s GROUP BY idx UNION ALL SELECT idx, label, 'only' FROM s WHERE rater = 2 AND idx % 3 = 0")
def score_indexing(spark, d):
    t, c = table(spark, d, "lineitem"), table(spark, d, "customer")
    one = _scores(t).where("rater = 1")
    renamed = K.renumbered(one, c.select((F.col("c_custkey") * 7).alias("idx")), ["idx"])
    last = K.merged([_scores(t).where(f"rater = {k}") for k in (1, 2, 3)])
    some = K.only(_scores(t).where("rater = 2"), t.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("idx")))
    return renamed.select("idx", "label", F.lit("renamed").alias("kind")).unionAll(last.select("idx", "label", F.lit("merged"))).unionAll(some.select("idx", "label", F.lit("only")))


_register("tuned_scores", "lineitem", lambda t: _rounded(K.tuned(_scores(t).withColumn("label", F.when(F.col("label") == "N", "O").otherwise("F")), 2).select("idx", "rater", "prob"), "prob"), _S + "SELECT idx, rater, round((prob + CASE WHEN CASE WHEN label = 'N' THEN 'O' ELSE 'F' END = actual THEN 1 ELSE 0.5 END) / 2, 6) AS prob FROM s")
_register("united_rounds", "lineitem", lambda t: K.united([(t.where(f"l_linenumber = {k}").select(F.col("l_orderkey").alias("idx")).distinct(), _scores(t).where(f"rater = {k}").select("idx", "label")) for k in (1, 2, 3)]), _S + "SELECT rater AS round, idx, label FROM s")


@query("score_files", "SELECT l_orderkey AS idx, l_returnflag AS label, l_discount AS prob, l_linestatus AS actual FROM lineitem WHERE l_linenumber = 1")
def score_files(spark, d):
    from millrace.sources import formats

    path = scratch(spark, "scores")
    formats.write_scores(table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("idx"), F.col("l_returnflag").alias("label"), F.col("l_discount").alias("prob"), F.col("l_linestatus").alias("actual")), path)
    return formats.read_scores(spark, path)


def _cliques(t):
    """The parts of each order with at least three lines, as a clique."""
    held = t.groupBy(F.col("l_orderkey").alias("clique")).agg(F.sort_array(F.collect_set(F.col("l_linenumber") + F.col("l_orderkey") % 40)).alias("items"), F.avg("l_discount").alias("support"), F.avg("l_tax").alias("confidence"))
    return held.where(F.size("items") >= 3).select("clique", F.transform("items", lambda x: x.cast("long")).alias("items"), F.round("support", 6).alias("support"), F.round("confidence", 6).alias("confidence"))


_C = "WITH c AS (SELECT l_orderkey AS clique, list_sort(list_distinct(list(CAST(l_linenumber + l_orderkey % 40 AS BIGINT)))) AS items, round(avg(l_discount), 6) AS support, round(avg(l_tax), 6) AS confidence FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 3) "


@query("clique_files", _C + "SELECT array_to_string(items, ' ') AS items, support, confidence FROM c")
def clique_files(spark, d):
    path = scratch(spark, "cliques")
    K.clique_lines(_cliques(table(spark, d, "lineitem"))).write.text(path)
    return K.read_cliques(spark.read.text(path)).select(F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"), "support", "confidence")


_register("strong_cliques", "lineitem", lambda t: K.ordered_cliques(K.strong_cliques(_cliques(t), 4, 0.05, 0.03), "021").select("clique"), _C + "SELECT clique FROM c WHERE len(items) >= 4 AND support >= 0.05 AND confidence >= 0.03")
_register("clique_items", "lineitem", lambda t: K.clique_items(_cliques(t)), _C + "SELECT item, min(clique) AS first FROM (SELECT clique, unnest(items) AS item FROM c) GROUP BY 1")


def _item_scores(t):
    return t.select((F.col("l_linenumber") + F.col("l_orderkey") % 40).cast("long").alias("idx"), "l_returnflag", "l_discount").groupBy("idx").agg(F.min("l_returnflag").alias("label"), F.round(F.avg("l_discount"), 6).alias("prob"))


_I = ", i AS (SELECT CAST(l_linenumber + l_orderkey % 40 AS BIGINT) AS idx, min(l_returnflag) AS label, round(avg(l_discount), 6) AS prob FROM lineitem GROUP BY 1), m AS (SELECT clique, idx, label, prob FROM (SELECT clique, unnest(items) AS idx FROM c) JOIN i USING (idx)), l AS (SELECT idx, max(clique) AS clique FROM m GROUP BY 1) "
_register("relabelled", "lineitem", lambda t: K.relabel(_cliques(t), _item_scores(t), "best").select("idx", "label").withColumn("by", F.lit("best")).unionAll(K.relabel(_cliques(t), _item_scores(t)).select("idx", "label", F.lit("vote"))), _C + _I + ", b AS (SELECT clique, arg_min(label, (-prob, label)) AS label FROM m GROUP BY 1), v AS (SELECT clique, arg_min(label, (round(-s, 9), label)) AS label FROM (SELECT clique, label, sum(prob) AS s FROM m GROUP BY 1, 2) GROUP BY 1) SELECT i.idx, coalesce(b.label, i.label) AS label, 'best' AS by FROM i LEFT JOIN l USING (idx) LEFT JOIN b USING (clique) UNION ALL SELECT i.idx, coalesce(v.label, i.label), 'vote' FROM i LEFT JOIN l USING (idx) LEFT JOIN v USING (clique)")
_register("clique_links", "lineitem", lambda t: K.clique_links(_cliques(t)), _C + ", u AS (SELECT clique, unnest(items) AS x FROM c) SELECT DISTINCT a.x AS a, b.x AS b, 1 AS link FROM u a JOIN u b ON a.clique = b.clique AND a.x < b.x")


def _links(t):
    return t.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") * 7 % 150 + 1).alias("b"), F.when(F.col("c_custkey") % 3 == 1, 1).otherwise(-1).alias("link"))


_L = "WITH RECURSIVE l AS (SELECT c_custkey AS a, c_custkey * 7 % 150 + 1 AS b, CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE -1 END AS link FROM customer WHERE c_custkey % 3 <> 0)"
_register(
    "closed_links", "customer", lambda t: K.closed_links(_links(t)).select("component", F.array_join("members", ",").alias("members"), F.array_join("apart", ",").alias("apart")),
    f"{_L}, n AS (SELECT a AS v FROM l UNION SELECT b FROM l), e AS (SELECT a, b FROM l WHERE link = 1 UNION SELECT b, a FROM l WHERE link = 1), r AS (SELECT v, v AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v), k AS (SELECT v, min(c) AS c FROM r GROUP BY 1), "
    "x AS (SELECT DISTINCT p.c AS c, q.c AS o FROM (SELECT a, b FROM l WHERE link = -1 UNION SELECT b, a FROM l WHERE link = -1) z JOIN k p ON p.v = z.a JOIN k q ON q.v = z.b WHERE p.c <> q.c) "
    "SELECT k.c AS component, string_agg(v, ',' ORDER BY v) AS members, coalesce((SELECT string_agg(o, ',' ORDER BY o) FROM x WHERE x.c = k.c), '') AS apart FROM k GROUP BY k.c",
)
_register(
    "link_checks", "customer",
    lambda t: (lambda labels: K.filter_links(_links(t), labels).withColumn("kind", F.lit("differ")).unionAll(K.filter_links(_links(t), labels, True).withColumn("kind", F.lit("agree"))).unionAll(K.link_errors(_links(t), labels).withColumn("kind", F.lit("error"))))(t.select(F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("label"))),
    _L.replace(" RECURSIVE", "") + ", j AS (SELECT l.*, x.c_mktsegment = y.c_mktsegment AS same FROM l JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b) SELECT a, b, link, CASE WHEN same THEN 'agree' ELSE 'differ' END AS kind FROM j UNION ALL SELECT a, b, link, 'error' FROM j WHERE (link = 1) <> same",
)


@query(
    "linked_rows",
    _L.replace(" RECURSIVE", "") + ", v AS (SELECT c_custkey AS k, c_mktsegment AS s, CAST(c_nationkey AS DOUBLE) AS x, abs(c_acctbal) / 1000 AS y FROM customer), q AS (SELECT k // 10 AS c, k FROM v) "
    "SELECT a, b, link, p.s AS label_a, r.s AS label_b, p.s = r.s AS agree, round(CASE WHEN (p.x * p.x + p.y * p.y) * (r.x * r.x + r.y * r.y) > 0 THEN 1 - (p.x * r.x + p.y * r.y) / sqrt((p.x * p.x + p.y * p.y) * (r.x * r.x + r.y * r.y)) ELSE 1 END, 6) AS distance, CAST(CASE WHEN a // 10 = b // 10 AND a <> b THEN 1 ELSE 0 END AS BIGINT) AS cliques FROM l JOIN v p ON p.k = a JOIN v r ON r.k = b",
)
def linked_rows(spark, d):
    t = table(spark, d, "customer")
    vectors = t.select(F.col("c_custkey").alias("idx"), F.array(F.col("c_nationkey").cast("double"), F.abs("c_acctbal") / 1000).alias("vector"))
    cliques = t.groupBy(F.floor(F.col("c_custkey") / 10).alias("clique")).agg(F.sort_array(F.collect_list("c_custkey")).alias("items"))
    return _rounded(K.linked_rows(_links(t), t.select(F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("label")), vectors, cliques), "distance")


@query("clique_means", "WITH c AS (SELECT l_orderkey AS clique, l_partkey AS p FROM lineitem GROUP BY 1, 2), j AS (SELECT clique, p_size, p_brand FROM c JOIN part ON p = p_partkey) SELECT j.clique, round(avg(p_size), 6) AS p_size, any_value(b) AS p_brand FROM j JOIN (SELECT clique, arg_min(p_brand, (-n, p_brand)) AS b FROM (SELECT clique, p_brand, count(*) AS n FROM j GROUP BY 1, 2) GROUP BY 1) m ON m.clique = j.clique GROUP BY 1")
def clique_means(spark, d):
    cliques = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("clique")).agg(F.collect_set("l_partkey").alias("items"))
    return _rounded(K.mean_or_mode(table(spark, d, "part"), cliques, "p_partkey", ["p_size"], ["p_brand"]), "p_size")


def _matrix(t):
    """Rows: orders' lines by part of the month; values: quantities, with zeros."""
    return t.groupBy((F.col("l_suppkey") + 1).cast("int").alias("row"), F.col("l_linenumber").alias("column")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("value"))


_X = "WITH x AS (SELECT CAST(l_suppkey + 1 AS INT) AS row, l_linenumber AS \"column\", sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS value FROM lineitem GROUP BY 1, 2) "


@query("matrix_files", _X + "SELECT row, \"column\", value FROM x WHERE value <> 0")
def matrix_files(spark, d):
    from millrace.sources import formats

    path, t = scratch(spark, "matrix"), table(spark, d, "lineitem")
    last = t.agg(F.max("l_suppkey")).first()[0] or 0  # keys may have gaps
    formats.write_matrix(_matrix(t), path, max(table(spark, d, "supplier").count(), last) + 1, 7)
    return formats.read_matrix(spark, path)


_register("matrix_weights", "lineitem", lambda t: _rounded(K.inverse_frequency(_matrix(t), 100).join(K.binary(_matrix(t)).select("row", "column", F.col("value").alias("one")), ["row", "column"]), "value"), _X + ", d AS (SELECT \"column\", count(*) AS df FROM x WHERE value <> 0 GROUP BY 1) SELECT row, \"column\", round(value * log2(100.0 / df), 6) AS value, CAST(1 AS DOUBLE) AS one FROM x JOIN d USING (\"column\") WHERE value <> 0")
_register("matrix_turned", "lineitem", lambda t: K.transposed(K.sparse(_matrix(t))), _X + "SELECT \"column\" AS row, row AS \"column\", value FROM x WHERE value <> 0")
_register("matrix_stacked", "lineitem", lambda t: K.picked(K.stacked([K.sparse(_matrix(t)), K.sparse(_matrix(t))], [100_000, 100_000]), _matrix(t).where("row % 2 = 0").select((F.col("row") + 100_000).alias("row"))), _X + ", n AS (SELECT row, row_number() OVER (ORDER BY row) AS new FROM (SELECT DISTINCT row FROM x WHERE row % 2 = 0)) SELECT new AS row, \"column\", value FROM x JOIN n USING (row) WHERE value <> 0")
_register("matrix_parts", "lineitem", lambda t: K.chunked(_matrix(t), _matrix(t).select("row", (F.col("row") % 3).alias("label")).distinct(), 4), _X + ", p AS (SELECT row, (row_number() OVER (PARTITION BY row % 3 ORDER BY row) - 1) % 4 AS part FROM (SELECT DISTINCT row FROM x)) SELECT CAST(part AS INT) AS part, row, \"column\", value FROM x JOIN p USING (row)")
_register("long_lines", "part", lambda t: K.long_lines(t.select("p_partkey", F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 20, F.col("p_type"))).alias("value")), 2).select("p_partkey"), "SELECT p_partkey FROM part WHERE len(list_filter(regexp_split_to_array(trim(p_name || CASE WHEN p_size > 20 THEN ' ' || p_type ELSE '' END), '\\s+'), lambda x: x <> '')) > 2")
_register("loaded_pairs", "part", lambda t: K.load_pairs(t.select("p_partkey", F.concat(F.lit("2 "), F.col("p_size"), F.lit(" 4 1.5")).alias("value")), 4).select("p_partkey", *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(4)]), "SELECT p_partkey, 0.0::DOUBLE AS v0, p_size::DOUBLE AS v1, 0.0::DOUBLE AS v2, 1.5::DOUBLE AS v3 FROM part")
_register("cosine_distances", "embeddings", lambda t: _rounded(t.select("vec_id", K.close_distance(F.transform("embedding", lambda x: x.cast("double")), F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: (i % 3 - 1).cast("double"))).alias("d")), "d", places=5), "SELECT vec_id, round(1 / (1 + list_cosine_similarity([x::DOUBLE FOR x IN embedding], [(i % 3 - 1)::DOUBLE FOR i IN range(1, len(embedding) + 1)])), 5) AS d FROM embeddings")


def _sets(t):
    return mining.itemsets(t, "l_orderkey", "l_linenumber", 0.15)


_register("maximal_sets", "lineitem", lambda t: K.maximal(_sets(t)).select(F.array_join("items", ",").alias("items"), "n"),
    "WITH o AS (SELECT l_orderkey, max(l_linenumber) AS m, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, bit_or(1 << (l_linenumber - 1)) AS m FROM lineitem GROUP BY 1), z AS (SELECT count(*) AS z FROM b), c AS (SELECT g AS s, count(*) FILTER (m & g = g) AS n FROM b, generate_series(1, 127) t(g) GROUP BY 1), f AS (SELECT s, n FROM c, z WHERE n >= ceil(0.15 * z)) "
    "SELECT array_to_string(list_filter([" + ", ".join(f"CASE WHEN s & {1 << i} > 0 THEN '{i + 1}' END" for i in range(7)) + "], lambda x: x IS NOT NULL), ',') AS items, n FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.s <> f.s AND g.s & f.s = f.s)")
_register("superset_confidence", "lineitem", lambda t: _rounded(K.superset_confidence(_sets(t)).select(F.array_join("items", ",").alias("items"), F.array_join("superset", ",").alias("superset"), "confidence"), "confidence"),
    "WITH b AS (SELECT l_orderkey, bit_or(1 << (l_linenumber - 1)) AS m FROM lineitem GROUP BY 1), z AS (SELECT count(*) AS z FROM b), c AS (SELECT g AS s, count(*) FILTER (m & g = g) AS n FROM b, generate_series(1, 127) t(g) GROUP BY 1), f AS (SELECT s, n FROM c, z WHERE n >= ceil(0.15 * z)), t AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.s <> f.s AND g.s & f.s = f.s)) "
    "SELECT array_to_string(list_filter([" + ", ".join(f"CASE WHEN f.s & {1 << i} > 0 THEN '{i + 1}' END" for i in range(7)) + "], lambda x: x IS NOT NULL), ',') AS items, array_to_string(list_filter([" + ", ".join(f"CASE WHEN t.s & {1 << i} > 0 THEN '{i + 1}' END" for i in range(7)) + "], lambda x: x IS NOT NULL), ',') AS superset, round(t.n / f.n, 6) AS confidence FROM f JOIN t ON t.s <> f.s AND t.s & f.s = f.s")
_register("medoids", "embeddings", lambda t: K.medoids(t.withColumn("v", F.transform("embedding", lambda x: x.cast("double"))), "vec_id", "v", 3, 4)[0].groupBy("cluster").agg(F.count("*").alias("n")), None)
_LLOYD = "WITH c0 AS (SELECT * FROM (VALUES (0, 5.0, 950.0), (1, 25.0, 1000.0), (2, 45.0, 1050.0)) v(i, x, y))"
_STEP = ", a{n} AS (SELECT p_partkey, p_size, p_retailprice, arg_min(i, ((p_size - x) ** 2 + (p_retailprice - y) ** 2, i)) AS k FROM part, c{m} GROUP BY 1, 2, 3), c{n} AS (SELECT c.i, coalesce(avg(p_size), any_value(x)) AS x, coalesce(avg(p_retailprice), any_value(y)) AS y FROM c{m} c LEFT JOIN a{n} a ON a.k = c.i GROUP BY 1)"
_register("lloyd", "part", lambda t: K.lloyd(t, "p_partkey", ["p_size", "p_retailprice"], [[5, 950], [25, 1000], [45, 1050]], most=3)[0], _LLOYD + "".join(_STEP.format(n=i, m=i - 1) for i in (1, 2, 3)) + " SELECT p_partkey, k AS cluster FROM a3")
_register("agreement_of_counts", "lineitem", lambda t: _rounded(evaluation.cluster_agreement(t.groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n")), "l_linenumber", "l_returnflag", "n").select("f_measure", "purity", "entropy", "nmi"), "f_measure", "purity", "entropy", "nmi"),
    "WITH c AS (SELECT l_linenumber AS a, l_returnflag AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM c), f AS (SELECT b, max(2 * n / (ra + rb)) AS f, any_value(rb / t) AS w FROM m GROUP BY 1), "
    "e AS (SELECT sum(n / t * log2(n * t / (ra * rb))) AS mi, -sum(n / t * log2(ra / t)) AS ha, -sum(n / t * log2(rb / t)) AS hb, -sum(n / t * log2(n / ra)) AS h FROM m), p AS (SELECT sum(top) / any_value(t) AS p FROM (SELECT max(n) AS top, any_value(t) AS t FROM m GROUP BY a)) SELECT round((SELECT sum(f * w) FROM f), 6) AS f_measure, round(p, 6) AS purity, round(h, 6) AS entropy, round(2 * mi / (ha + hb), 6) AS nmi FROM e, p")
_register("counts_by_class", "lineitem", lambda t: t.groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0), "SELECT l_linenumber, " + ", ".join(f"count(*) FILTER (l_returnflag = '{v}') AS \"{v}\"" for v in "ANR") + " FROM lineitem GROUP BY 1")


@query("classes_to_clusters", "SELECT l_linestatus AS cluster, CASE l_linestatus WHEN 'F' THEN CASE WHEN a >= r THEN 'A' ELSE 'R' END ELSE 'N' END AS label FROM (SELECT DISTINCT l_linestatus FROM lineitem), (SELECT count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS r FROM lineitem)")
def classes_to_clusters(spark, d):
    found, _ = evaluation.classes_to_clusters(table(spark, d, "lineitem").where("(l_linestatus = 'O') = (l_returnflag = 'N')"), "l_linestatus", "l_returnflag")
    return spark.createDataFrame(list(found.items()), "cluster string, label string")


# Flows ---------------------------------------------------------------------------------------


def _stream(spark, d, name="events"):
    return flows.files(spark, d, f"{name}.parquet", table(spark, d, name).schema)


@query("stream_union", "SELECT event_id, value FROM events UNION ALL SELECT event_id + 1000000000, value FROM events WHERE value > 50")
def stream_union(spark, d):
    a = _stream(spark, d).select("event_id", "value")
    b = _stream(spark, d).where("value > 50").select((F.col("event_id") + 1_000_000_000).alias("event_id"), "value")
    return flows.drain(flows.joined(a, b))


@query("stream_accuracy", "SELECT count(*) AS n, round(avg(CASE WHEN (value > 50) = (user_id % 2 = 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(sqrt(avg((value - user_id) ** 2)), 4) AS error FROM events")
def stream_accuracy(spark, d):
    s = _stream(spark, d).select((F.col("value") > 50).alias("a"), (F.col("user_id") % 2 == 0).alias("p"), "value", F.col("user_id").cast("double").alias("u"))
    return _rounded(_rounded(flows.drain(flows.prequential(s, "a", "p", "value", "u"), "complete"), "accuracy"), "error", places=4)


@query("stream_predictions", "SELECT event_id, CASE WHEN value > (SELECT avg(value) FROM events) THEN 'high' ELSE 'low' END AS prediction FROM events")
def stream_predictions(spark, d):
    mean = table(spark, d, "events").agg(F.avg("value")).first()[0]
    return flows.drain(flows.append_predictions(_stream(spark, d).select("event_id", "value"), lambda rows: rows.withColumn("prediction", F.when(F.col("value") > mean, "high").otherwise("low")))).select("event_id", "prediction")


@query("stream_count", "SELECT count(*) AS n FROM events")
def stream_count(spark, d):
    return flows.drain(flows.counted(_stream(spark, d)), "complete")


@query("stream_saved", "SELECT event_id, event_type FROM events")
def stream_saved(spark, d):
    path = scratch(spark, "saved")
    flows.save(_stream(spark, d).select("event_id", "event_type"), path)
    return spark.read.parquet(path)


@query("flow", "SELECT o_orderkey, CASE WHEN set = 'train' THEN NULL ELSE (SELECT o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END AS prediction FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 'train' ELSE 'test' END AS set FROM orders) WHERE set = 'test'")
def flow(spark, d):
    """A graph of nodes: load, split into sets, fit, append predictions."""
    from millrace.operators import models

    nodes = {
        "load": ([], lambda: table(spark, d, "orders").select("o_orderkey", "o_orderstatus")),
        "train": (["load"], lambda t: P.tagged(t.where("o_orderkey % 4 <> 0"), "train")),
        "test": (["load"], lambda t: P.tagged(t.where("o_orderkey % 4 = 0"), "test")),
        "model": (["train"], lambda t: models.zero_rule(t, "o_orderstatus")),
        "predict": (["model", "test"], lambda m, t: flows.append_predictions(t, m)),
    }
    return flows.run(nodes, "predict").select("o_orderkey", "prediction")


@query("first_rows", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def first_rows(spark, d):
    return flows.shown(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], 7)


@query("strip_chart", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def strip_chart(spark, d):
    rows = flows.drain(flows.series(_stream(spark, d), "ts", "value", "1 day", "1 hour"), "complete")
    return _rounded(rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "mean"), "mean")


_register("fold_sets", "nation", lambda t: R.fold(t, 2, 3, ["n_nationkey"]).select("n_nationkey", F.lit("test").alias("set")).unionAll(R.fold(t, 2, 3, ["n_nationkey"], invert=True).select("n_nationkey", F.lit("train"))), "SELECT n_nationkey, CASE WHEN (row_number() OVER (ORDER BY n_nationkey) - 1) % 3 = 1 THEN 'test' ELSE 'train' END AS set FROM nation")
