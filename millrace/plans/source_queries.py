"""Queries that write a table in a format and read it back."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.plans.catalog import query, table
from millrace.plans.numbering import scratch
from millrace.sources import arff, formats, svmlight

_PART = "SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_brand, CASE WHEN p_size > 10 THEN p_size::DOUBLE END AS p_size, p_retailprice FROM part"


def _part(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").cast("double").alias("p_partkey"), "p_name", "p_brand", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("p_size"), "p_retailprice")
    return C.with_domain(t, "p_brand", C.domain_of(t, "p_brand"))


@query("arff_file", _PART)
def arff_file(spark, d):
    path = scratch(spark, "arff")
    arff.write_arff(_part(spark, d), path)
    return arff.read_arff(spark, path)


@query("sparse_arff_file", _PART)
def sparse_arff_file(spark, d):
    path = scratch(spark, "arff")
    arff.write_arff(_part(spark, d), path, sparse=True)
    return arff.read_arff(spark, path)


@query("arff_dates", "SELECT event_id::DOUBLE AS event_id, strftime(ts, '%Y-%m-%d %H') AS ts FROM events")
def arff_dates(spark, d):
    path = scratch(spark, "arff")
    arff.write_arff(table(spark, d, "events").select(F.col("event_id").cast("double").alias("event_id"), F.col("ts").cast("timestamp").alias("ts")), path)
    return arff.read_arff(spark, path).select("event_id", F.date_format("ts", "yyyy-MM-dd HH").alias("ts"))


@query("csv_file", _PART)
def csv_file(spark, d):
    path = scratch(spark, "csv")
    formats.write_csv(_part(spark, d), path)
    found = formats.read_csv(spark, path)
    return found.select(*[F.col(c).cast("double").alias(c) if c in ("p_partkey", "p_size", "p_retailprice") else F.col(c) for c in found.columns])


@query("appended_csv", "SELECT n_nationkey, n_name FROM nation")
def appended_csv(spark, d):
    """Rows that arrive one batch after the other, as results do."""
    path, t = scratch(spark, "csv"), table(spark, d, "nation").select("n_nationkey", "n_name")
    for k in range(3):
        formats.append_csv(t.where(f"n_nationkey % 3 = {k}"), path)
    return formats.read_csv(spark, path)


@query("names_and_data", "SELECT p_size::DOUBLE AS p_size, p_retailprice, p_brand FROM part")
def names_and_data(spark, d):
    path, t = scratch(spark, "names"), table(spark, d, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("p_brand"))
    formats.write_names(t, f"{path}/names", f"{path}/data", "p_brand")
    found = formats.read_names(spark, f"{path}/names", f"{path}/data").withColumnRenamed("class", "p_brand")
    back = {re.sub("[^A-Za-z0-9]", "_", r[0]): r[0] for r in table(spark, d, "part").select("p_brand").distinct().collect()}
    named = F.coalesce(*[F.when(F.col("p_brand") == k, v) for k, v in back.items()])
    return found.withColumn("p_brand", named)


@query("libsvm_file", "SELECT l_returnflag = 'R' AS label, l_discount, l_tax FROM lineitem")
def libsvm_file(spark, d):
    path = scratch(spark, "libsvm")
    t = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_discount", "l_tax")
    formats.write_libsvm(t, path, ["l_discount", "l_tax"], "y")
    found = formats.read_libsvm(spark, path)
    return found.select((F.col("label") == 1).alias("label"), F.get("features", F.lit(0)).alias("l_discount"), F.get("features", F.lit(1)).alias("l_tax"))


@query("svmlight_file", "SELECT l_quantity AS label, l_discount, l_tax FROM lineitem")
def svmlight_file(spark, d):
    path = scratch(spark, "svmlight")
    entries = F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array("l_discount", "l_tax"))
    svmlight.write_svmlight(table(spark, d, "lineitem").select(entries.alias("features"), F.col("l_quantity").alias("label")), path)
    return svmlight.read_svmlight(spark, path).select("label", F.col("features")[1].alias("l_discount"), F.col("features")[2].alias("l_tax"))


@query("xml_file", _PART.replace("p_retailprice FROM", "p_retailprice, p_retailprice / 2 AS w FROM"))
def xml_file(spark, d):
    path = scratch(spark, "xml")
    formats.write_xml(_part(spark, d).withColumn("w", F.col("p_retailprice") / 2), path, weight="w", codec="gzip")
    return formats.read_xml(spark, path, "w")


@query("binary_table", _PART)
def binary_table(spark, d):
    path = scratch(spark, "table")
    formats.write_table(_part(spark, d), path)
    back = formats.read_table(spark, path)
    if C.domain_of(back, "p_brand") != C.domain_of(_part(spark, d), "p_brand"):
        raise ValueError("the domain is lost")
    return back


@query("saved_by_extension", "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey::DOUBLE, n_name FROM nation")
def saved_by_extension(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("n_nationkey"), "n_name")
    found = None
    for kind in ("arff", "orc"):
        path = f"{scratch(spark, 'saved')}.{kind}"
        formats.save(t.limit(3), path)
        formats.save(t, path, "overwrite")
        formats.save(t.limit(3), path, "ignore")
        back = formats.read_any(spark, path)
        found = back if found is None else found.unionByName(back)
    return found


@query("text_folder", "SELECT doc_id::VARCHAR || '.txt' AS filename, lang AS class, length(trim(coalesce(text, ''), chr(10))) > 0 AS known FROM documents WHERE doc_id % 10 = 0")
def text_folder(spark, d):
    """Texts as files of one folder a language, read back with the folder as the class."""
    path = scratch(spark, "texts")
    t = table(spark, d, "documents").where("doc_id % 10 = 0").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    formats.write_directory(t, path, "doc_id", "text", "lang")
    return formats.read_directory(spark, path).select("filename", "class", (F.length(F.trim("text")) > 0).alias("known"))


@query("sql_over_views", "SELECT n_name, count(*)::DOUBLE AS n, CASE WHEN count(*) > 4 THEN 'true' ELSE 'false' END AS many FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def sql_over_views(spark, d):
    return formats.query_views(spark, {"mr_nation": table(spark, d, "nation"), "mr_supplier": table(spark, d, "supplier")}, "SELECT n_name, count(*) AS n, count(*) > 4 AS many FROM mr_nation JOIN mr_supplier ON s_nationkey = n_nationkey GROUP BY 1")


@query("typed_rows", "SELECT event_id::DOUBLE AS event_id, epoch_ms(ts)::DOUBLE AS ts, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS large FROM events")
def typed_rows(spark, d):
    return formats.typed(table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 50).alias("large")))


@query("zipped_lines", "SELECT n_name AS value FROM nation")
def zipped_lines(spark, d):
    path = scratch(spark, "lines")
    formats.write_lines(table(spark, d, "nation").select("n_name"), path)
    return spark.read.text(path)
