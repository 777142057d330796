"""What only shows on larger tables: several files, many equal rows, more rows than are held."""

import pytest
from pyspark.sql import functions as F


def test_matrix_of_several_files_keeps_its_row_order(spark, tmp_path):
    from millrace.sources import formats

    cells = spark.range(1, 41).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("id") % 13).cast("int")))).alias("column"))
    cells = cells.withColumn("value", (F.col("row") * 100 + F.col("column")).cast("double"))
    path = str(tmp_path / "m")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a file a range
    try:
        formats.write_matrix(cells, path, 42, 13)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "m").glob("part-*"))) > 2
    got = sorted((r["row"], r["column"], r["value"]) for r in formats.read_matrix(spark, path).collect())
    assert got == sorted((r["row"], r["column"], r["value"]) for r in cells.collect())


def test_matrix_cells_beyond_the_size_are_an_error(spark, tmp_path):
    from millrace.sources import formats

    cells = spark.createDataFrame([(1, 1, 2.0), (5, 1, 3.0)], "row int, column int, value double")
    with pytest.raises(ValueError):
        formats.write_matrix(cells, str(tmp_path / "m"), 4, 1)


def test_equal_rows_are_kept_once(spark, monkeypatch):
    from millrace.learn import lazy

    monkeypatch.setattr(lazy, "MOST_KEPT", 10)
    df = spark.range(200).select("id", (F.col("id") % 10).cast("int").alias("g"), (F.col("id") * 7 % 31).cast("double").alias("y"))
    got = {r["id"]: r["prediction"] for r in lazy.ibk(df, "y", ["g"], k=3).transform(df).collect()}
    means = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.avg("y").alias("m")).collect()}
    assert len(got) == 200 and all(abs(v - means[k % 10]) < 1e-9 for k, v in got.items())


@pytest.mark.parametrize("target", ["y", "c"])
def test_neighbours_of_more_rows_than_are_held(spark, monkeypatch, target):
    from millrace.learn import lazy

    rows = [(i, None if i % 17 == 0 else float(i * 13 % 40), None if i % 19 == 0 else "abc"[i % 3], float(i % 11), "pq"[i * i % 7 % 2]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, x double, a string, y double, c string")
    for k, weighting in ((1, "none"), (6, "inverse")):
        show = lambda m: {r["id"]: r["prediction"] if m.classes is None else tuple(r["distribution"]) for r in m.transform(df).collect()}
        want = show(lazy.ibk(df, target, ["x", "a"], k=k, weighting=weighting))
        with monkeypatch.context() as few:
            few.setattr(lazy, "MOST_KEPT", 40)
            model = lazy.ibk(df, target, ["x", "a"], k=k, weighting=weighting)
            assert model.kept.held is not None
            got = show(model)
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    plain = lazy.Kept(df, target, ["x", "a"], None)  # every row by itself
    x = df.select("x", "a").toPandas()
    d = plain.distances(x)
    import numpy as np

    w = (d <= np.sort(d, axis=1)[:, 5][:, None] + 1e-12) / (d + 0.001)
    brute = w @ plain.y / w.sum(1, keepdims=plain.classes is not None)
    assert all(want[i] == pytest.approx(brute[i], abs=1e-9) for i in range(150))


def _leaves(model):
    from millrace.learn.trees import nodes_of

    return [(p, n.attribute, n.kind, n.value, n.dist.tolist()) for p, n in nodes_of(model.roots[0])]


def test_trees_keep_equal_rows_once(spark, monkeypatch):
    from millrace.learn import trees

    seen, grow = [], trees.grow
    monkeypatch.setattr(trees, "grow", lambda rows, *a, **k: seen.append(rows.count()) or grow(rows, *a, **k))
    one = spark.range(60).select((F.col("id") % 5).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, "p").otherwise("q").alias("a"), F.when(F.col("id") * F.col("id") % 7 > 2, "yes").otherwise("no").alias("y"))
    many = one.crossJoin(spark.range(50)).drop("id")
    different = one.distinct().count()
    schemes = [trees.j48, trees.random_tree, trees.rep_tree]
    models = [s(many, "y", ["x", "a"]) for s in schemes]
    assert max(seen) <= different
    prepared = trees._prepared
    monkeypatch.setattr(trees, "_prepared", lambda *a: prepared(*a, once=False))
    assert [_leaves(m) for m in models] == [_leaves(s(many, "y", ["x", "a"])) for s in schemes]


def test_draws_of_equal_rows_are_those_of_each(spark):
    import numpy as np
    import pandas as pd

    from millrace.learn import trees

    drawn = trees.draws(3)
    rows = pd.DataFrame({"x": np.arange(2000.0), "_y": "u", "_w": 1.0, "_n": 40.0})
    some = drawn(rows, 1)
    assert abs(some.mean() - 40) < 1 and abs(some.var() - 40) < 6
    large = drawn(rows.assign(_n=5000.0), 1)
    assert abs(large.mean() - 5000) < 10 and abs(large.var() / 5000 - 1) < 0.2
    assert (drawn(rows.iloc[::-1], 1)[::-1] == some).all()  # wherever they lie


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_all_nearest_is_that_of_all_pairs(spark, kind):
    import numpy as np

    from millrace.operators.neighbours import all_nearest

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 12, 400) / 1.0, rng.normal(size=400).round(1), rng.integers(0, 2, 400) * 0.5])
    x[100:130] = x[100]  # more copies than neighbours
    rows = [(i if kind == "bigint" else f"k{i}", *(None if i % 97 == 0 and c == 1 else float(v) for c, v in enumerate(r))) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, f"id {kind}, a double, b double, c double")
    known = [r for r in rows if None not in r]
    p = np.array([r[1:] for r in known])
    u = p / (p.max(0) - p.min(0))
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(2)).round(9)
    want = {known[i][0]: [q for _, q in sorted((d[i, j], known[j][0]) for j in range(len(known)) if j != i)[:5]] for i in range(len(known))}
    for leaf in (16, 512):
        got = {r["target"]: r["near"] for r in all_nearest(df, ["a", "b", "c"], 5, "id", leaf=leaf).collect()}
        assert got == want


def test_smote_searches_without_all_pairs(spark, monkeypatch):
    from millrace.operators import rows as R
    from millrace.operators import similarity

    def all_pairs(*a, **k):
        raise AssertionError("every row is compared with every row")

    monkeypatch.setattr(similarity, "nearest", all_pairs)
    df = spark.range(90).select("id", F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("y"), (F.col("id") * 7 % 20).cast("double").alias("v"), F.when(F.col("id") % 2 == 0, "m").otherwise("n").alias("a"))
    made = R.smote(df, "y", "id", ["v"], ["a"], 5, 150).where("id is null").collect()
    assert len(made) == 45 and all(r["y"] == "p" and 0 <= r["v"] <= 19 and r["a"] in "mn" for r in made)
