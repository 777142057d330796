"""SVMlight rows: a label, then ``index:value`` pairs; ``qid:`` is skipped and ``#`` ends a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """``features map<int,double>, label double``."""
    parts = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    pairs = F.filter(F.slice(parts, 2, 1_000_000_000), lambda x: x.rlike(r"^\d+:"))
    features = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split(x, ":")[0].cast("int"), F.split(x, ":")[1].cast("double"))))
    rows = spark.read.text(path).where("trim(regexp_replace(value, '#.*$', '')) <> ''")
    return rows.select(features.alias("features"), parts[0].cast("double").alias("label"))


def write_svmlight(df: DataFrame, path: str, features: str = "features", label: str = "label") -> None:
    entries = F.array_sort(F.map_entries(features))
    text = F.concat_ws(" ", F.col(label).cast("string"), F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))))
    df.select(text.alias("value")).write.text(path)
