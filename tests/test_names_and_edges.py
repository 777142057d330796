"""Columns of any name, empty columns, awkward rows, and what is fitted on one table and applied to another."""

import glob
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from millrace.functions.predicates import compile_attributes, compile_math
from millrace.operators import columns as C
from millrace.operators import discretize, models, similarity, stats
from millrace.operators import neighbours as N
from millrace.operators import rows as R
from millrace.plans import filters as P
from millrace.plans import numbering, storage
from millrace.sources import arff, formats


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(10.0,), (100.0,), (0.0,), (-0.2,), (2.5,), (None,)], "x double")
    shown = lambda d: [r["x"] for r in C.numeric_to_nominal(df, ["x"], d).collect()]
    assert shown(0) == ["10", "100", "0", "0", "3", None] and shown(1) == ["10", "100", "0", "-0.2", "2.5", None]
    assert C.domain_of(C.numeric_to_nominal(df, ["x"], 1), "x") == ["-0.2", "0", "2.5", "10", "100"]


def test_helper_names_are_free_to_use(spark):
    df = spark.createDataFrame([(1.0, 3.0, 4.0, 9, "p"), (2.0, 6.0, 8.0, 7, "q")], "a double, count double, _n double, _i int, _v string")
    assert [tuple(r) for r in C.math_expression(df, "a", "A / MAX + COUNT").collect()] == [(2.5, 3.0, 4.0, 9, "p"), (3.0, 6.0, 8.0, 7, "q")]
    assert [round(r["count"], 6) for r in C.unit_rows(df, ["count", "_n"]).collect()] == [0.6, 0.6]
    assert C.unit_rows(df, ["a", "count"]).columns == df.columns
    for out in (R.remove_range(df, 1, 1, ["a"]), R.resample(df, 50, 1, ["a"]), R.fold(df, 1, 2, ["a"]), R.train_test_split(df, 50, 1, ["a"])[0], R.spread_subsample(df, "_v", 1.0, ["a"])):
        assert out.columns == df.columns and all(r["_i"] in (7, 9) for r in out.collect())
    assert {r["_i"] for r in C.add_noise(df, "_v", 100, 1, ["a"]).collect()} == {7, 9}
    assert numbering.numbered(df, ["a"], "at").columns == [*df.columns, "at"]
    assert C.time_series_delta(df, ["a"], ["count"]).columns == ["a d-1", "count", "_n", "_i", "_v"]


def test_expressions(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "x double, y double")
    value = lambda t: df.select(compile_attributes(t, df.columns)).first()[0]
    assert value("sqrt(a1^2+a2^2)^2") == 25 and value("((a1+a2)*(a1))^2") == 441 and value("-a1 + 2 * a2 / 8") == -2 and value("2^3^2") == 64
    assert df.select(compile_math("ifelse(X >= 3 & !(Y < 1), X - Y, 0)", {"X": F.col("x"), "Y": F.col("y")})).first()[0] == -1
    for bad in ("a1 +", "a9", "(a1", "a1 a2", "foo(a1)"):
        with pytest.raises(ValueError):
            value(bad)


def test_empty_columns(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert [tuple(r) for r in C.interquartile_flags(df, "x").collect()] == [(None, False, False)] * 2
    assert C.best_width_bins(df, "x", 5).count() == 2 and discretize.frequency_cuts(df, "x", 4) == []
    assert C.remove_useless(df.withColumn("y", F.monotonically_increasing_id())).columns == ["y"]
    assert similarity.nearest(df.withColumn("k", F.lit(1)), df.withColumn("k", F.lit(2)), ["x"], 1, "k", "k").count() == 0


def test_arff_rows_that_look_like_headers(spark, tmp_path):
    p = tmp_path / "a.arff"
    p.write_text("@relation t\n@attribute s string\n@attribute x numeric\n@attribute d date 'yyyy-MM-dd'\n@data\n@home,1,'2020-01-02'\n'@attribute',2,?\n{0 'a, b', 1 5}\n'it\\'s',3,?\n")
    got = [(r["s"], r["x"], str(r["d"])[:10]) for r in arff.read_arff(spark, str(p)).collect()]
    assert got == [("@home", 1.0, "2020-01-02"), ("@attribute", 2.0, "None"), ("a, b", 5.0, "None"), ("it's", 3.0, "None")]
    arff.write_arff(arff.read_arff(spark, str(p)).repartition(3), str(tmp_path / "out"))
    assert len(glob.glob(str(tmp_path / "out" / "part-*"))) > 1
    assert sorted((r["s"], r["x"]) for r in arff.read_arff(spark, str(tmp_path / "out")).collect()) == sorted((s, x) for s, x, _ in got)
    (tmp_path / "b.arff").write_text("@relation t\n")
    with pytest.raises(ValueError, match="@data"):
        arff.read_arff(spark, str(tmp_path / "b.arff"))


def test_samples_stay_spread_and_repeat(spark):
    df = spark.range(1000).repartition(6)
    one, two = R.resample(df, 33.3, 5, ["id"]), R.resample(df.coalesce(1), 33.3, 5, ["id"])
    assert one.count() == 333 and sorted(one.collect()) == sorted(two.collect())
    assert sorted(r["id"] for r in R.reservoir_sample(df, 10, 1, ["id"]).collect()) == sorted(r["id"] for r in R.reservoir_sample(df.coalesce(1), 10, 1, ["id"]).collect())
    again = R.resample_again(df.withColumn("c", F.when(F.col("id") < 100, "a").otherwise("b")), 100, 3, "c", 1.0)
    n = {r["c"]: r["count"] for r in again.groupBy("c").count().collect()}
    assert again.count() == 1000 and 420 < n["a"] < 580


def test_many_cuts_over_many_ranges(spark):
    values = sorted(float((i * 7919) % 5000) for i in range(3000))
    cuts = discretize.frequency_cuts(spark.createDataFrame([(v,) for v in values], "v double").repartition(5), "v", 100)
    state = {"start": 0, "earlier": None, "v": None, "upto": None, "cuts": 0}
    upto = {v: i + 1 for i, v in enumerate(values)}
    assert cuts == discretize._scan(sorted(upto.items()), state, 100, len(values)) and len(cuts) == 99
    bins = spark.createDataFrame([(v,) for v in values[:50]], "v double").select("v", discretize.bin_number(F.col("v"), cuts).alias("b")).collect()
    assert all(r["b"] == sum(r["v"] > c for c in cuts) for r in bins)


def test_neighbours_by_cells_with_ties(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i // 10 % 3)) for i in range(200)], "k int, x double, y double")
    plain = similarity.nearest(rows.where("k < 40"), rows, ["x", "y"], 3, "k", "k").collect()
    for index in (N.Index("top_down", "least_spread", "box", 10, 50), N.Index("bottom_up", leaf=20, sample_rows=30)):
        assert sorted(similarity.nearest(rows.where("k < 40"), rows, ["x", "y"], 3, "k", "k", index=index).collect()) == sorted(plain)


def test_majority_with_columns_named_like_its_own(spark):
    df = spark.createDataFrame([("x", "u", "p"), ("x", "u", "p"), ("y", "u", "q")], "b string, n string, prediction_ string")
    assert models.consistency(df, ["b", "n"], "prediction_").first()["consistency"] == 1.0
    assert stats.reduced(spark.createDataFrame([(1, "a", 0), (1, "b", 2)], "a int, b string, n int")).count() == 1


def test_chains_keep_what_was_fitted(spark):
    train, test = (spark.createDataFrame([(float(v),) for v in vs], "x double") for vs in ((0, 10), (5, 20)))
    apply = P.chain.fit(train, [P.step(C.normalize, ["x"]), P.step(C.center, ["x"]), lambda d: d.withColumn("y", F.col("x") * 2)])
    assert [tuple(r) for r in apply(test).collect()] == [(0.0, 0.0), (1.5, 3.0)]
    assert P.streamable(P.step(C.add, "z", "int")) and not P.streamable(P.step(C.center, ["x"]))


def test_work_folder(spark):
    class Far:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://far:7077"})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Far())
    held = storage.stored(spark.range(5), "t")
    path = held.stored_at
    assert held.count() == 5 and glob.glob(path.removeprefix("file://") + "/*.parquet")
    storage.discard(held)
    assert not glob.glob(path.removeprefix("file://"))


def test_entry_without_a_library_of_the_text_operators():
    code = "import sys; sys.modules['xxhash'] = None; sys.modules['millrace.llm.bpe'] = None; import __spark_entry__ as e; n = e.queries(); assert 'group_stats' in n and 'op2_bpe' not in n and 'pipeline' not in n; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0]).returncode == 0


def test_streams_of_formats():
    assert formats.can_stream("csv") and not formats.can_stream("arff")
