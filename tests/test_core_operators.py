"""Operators without SQL against brute force on small tables, and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import special
from millrace.operators import columns as C
from millrace.operators import discretize, evaluation, models, reshape, rows
from millrace.plans import experiment, numbering
from millrace.sources import formats, generators


def test_numbers_and_running_sums_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(7)
    got = numbering.numbered(df, ["k"]).orderBy("k").collect()
    assert [r["_i"] for r in got] == list(range(1, 1001))
    total, want = 0, []
    for r in got:
        total += r["v"]
        want.append(total)
    assert [r["s"] for r in numbering.running(df, ["k"], {"s": "v"}).orderBy("k").collect()] == want
    assert numbering.numbered(df.limit(0), ["k"]).count() == 0


def test_numbers_within_missing_values_too(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a" if i % 3 == 1 else "b") for i in range(30)], "k int, c string")
    got = numbering.numbered_within(df, "c", ["k"]).collect()
    assert {(r["c"], r["_i"]) for r in got} == {(c, i) for c in (None, "a", "b") for i in range(1, 11)}


def plain_frequency_cuts(values, bins):
    ordered = sorted(values)
    edges = [((a + b) / 2, i + 1) for i, (a, b) in enumerate(zip(ordered, ordered[1:])) if a < b]
    cuts, start, before = [], 0, None
    for cut, upto in edges:
        if len(cuts) == bins - 1:
            break
        goal = start + (len(ordered) - start) / (bins - len(cuts))
        if upto < goal:
            before = (cut, upto)
        elif before and goal - before[1] < upto - goal:
            cuts.append(before[0])
            start, before = before[1], (cut, upto)
        else:
            cuts.append(cut)
            start, before = upto, None
    return cuts


@pytest.mark.parametrize("seed", [1, 2])
def test_frequency_cuts(spark, seed):
    r = random.Random(seed)
    values = [float(r.choice([1, 1, 1, 2, 3, 5, 8, 13, 21, r.randint(0, 40)])) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert discretize.frequency_cuts(df, "v", 6) == plain_frequency_cuts(values, 6)
    even = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert discretize.frequency_cuts(even, "v", 4) == [24.5, 49.5, 74.5]
    assert {r["count"] for r in discretize.root_frequency_bins(even, "v").groupBy("v").count().collect()} == {10}
    assert discretize.frequency_cuts(df.limit(0), "v", 4) == []


def plain_entropy_cuts(pairs):
    def h(ps):
        return -sum(ps.count(c) / len(ps) * math.log2(ps.count(c) / len(ps)) for c in set(ps))

    values = sorted({v for v, _ in pairs})
    best = None
    for a, b in zip(values, values[1:]):
        left, right = [c for v, c in pairs if v <= a], [c for v, c in pairs if v > a]
        e = (len(left) * h(left) + len(right) * h(right)) / len(pairs)
        if best is None or e < best[0] - 1e-12:
            best = (e, (a + b) / 2, left, right)
    if best is None:
        return []
    e, cut, left, right = best
    whole = [c for _, c in pairs]
    k, k1, k2 = len(set(whole)), len(set(left)), len(set(right))
    price = (math.log2(len(values) - 1) + math.log2(3**k - 2) - (k * h(whole) - k1 * h(left) - k2 * h(right))) / len(pairs)
    if h(whole) - e <= price:
        return []
    return sorted([*plain_entropy_cuts([p for p in pairs if p[0] <= cut]), cut, *plain_entropy_cuts([p for p in pairs if p[0] > cut])])


def test_entropy_cuts(spark):
    r = random.Random(5)
    pairs = [(float(v), "a" if v < 20 or 50 <= v < 70 else "b" if v < 90 else "c") for v in (r.randint(0, 120) for _ in range(400))]
    pairs = [(v, r.choice("abc") if r.random() < 0.05 else c) for v, c in pairs]
    df = spark.createDataFrame([*pairs, (None, "a"), (3.0, None)], "v double, c string")
    want = plain_entropy_cuts(pairs)
    assert len(want) >= 3
    assert discretize.entropy_cuts(df, "v", "c") == want
    assert discretize.entropy_cuts(df.withColumn("c", F.lit("a")), "v", "c") == []


def test_one_rule_and_missing_cells(spark):
    df = spark.createDataFrame([("x", "p", "yes"), ("x", "q", "yes"), ("y", "p", "no"), (None, "q", "no"), ("y", "q", "no")], "a string, b string, c string")
    chosen, apply = models.one_rule(df, ["b", "a"], "c")
    assert chosen == "a"
    unseen = spark.createDataFrame([("x", "p"), (None, "p"), ("new", "p")], "a string, b string")
    assert {r["a"]: r["prediction"] for r in apply(unseen).collect()} == {"x": "yes", None: "no", "new": "no"}


def test_hyper_pipes_and_line_fit(spark):
    df = spark.createDataFrame([(1.0, 5.0, "u"), (2.0, 7.0, "u"), (8.0, 19.0, "v"), (9.0, 21.0, "v")], "x double, y double, c string")
    assert [r["prediction"] for r in models.hyper_pipes(df, ["x", "y"], "c")(df).orderBy("x").collect()] == ["u", "u", "v", "v"]
    name, slope, intercept = models.line_fit(df, ["x"], "y")
    assert name == "x" and slope == pytest.approx(2) and intercept == pytest.approx(3)


def test_farthest_first(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 10.0), (3, 5.0), (4, None)], "k int, x double")
    assert [c["k"] for c in models.farthest_first(df, "k", ["x"], 3)] == [0, 2, 3]
    assert len(models.farthest_first(df.limit(1), "k", ["x"], 3)) == 1


def test_paired_test_against_known_tails(spark):
    assert special.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.student_two_sided(0.0, 5) == 1.0
    assert special.student_two_sided(1.0, 1) == pytest.approx(0.5)
    df = spark.createDataFrame([(i, s, v) for i, (a, b) in enumerate([(1, 2), (2, 4), (3, 4)]) for s, v in (("a", float(a)), ("b", float(b)))], "k int, s string, v double")
    r = evaluation.paired_test(df, ["k"], "s", "v", "a").first()
    assert r["n"] == 3 and r["mean_difference"] == pytest.approx(4 / 3) and r["t"] == pytest.approx(4.0)
    assert evaluation.paired_test(df, ["k"], "s", "v", "a", 1 / 3).first()["t"] == pytest.approx(4 / math.sqrt(2))


def test_wavelet_keeps_length_and_pads(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, None)], "a double, b double, c double, d double, e double, f double")
    r = reshape.wavelet(df, df.columns).first()
    assert len(r) == 8 and sum(x * x for x in r) == pytest.approx(55.0)
    assert r["wavelet_0"] == pytest.approx(15 / math.sqrt(8))


def test_domains(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "c string")
    assert C.domain_of(C.class_order(df, "c"), "c") == ["b", "a"]
    assert C.domain_of(C.swap_values(df, "c", "a", "b"), "c") == ["b", "a"]
    assert C.domain_of(C.add_values(df, "c", ["0", "b"], ordered=True), "c") == ["0", "a", "b"]
    assert [r["A1"] for r in C.obfuscate(C.class_order(df, "c")).collect()] == ["V2", "V1", "V1", None]
    nominal = C.numeric_to_nominal(spark.createDataFrame([(1.5,), (10.0,), (2.0,), (None,)], "x double"), ["x"])
    assert C.domain_of(nominal, "x") == ["1.5", "2", "10"]


def test_cross_validation_keeps_finished_results(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)], "k int, c string")
    schemes = {"zero": lambda train: models.zero_rule(train, "c")}
    first = experiment.cross_validate(df, schemes, "c", ["k"], folds=3)
    assert [r["n"] for r in first.collect()] == [10, 10, 10] and sum(r["correct"] for r in first.collect()) == 20
    kept = first.where("fold < 2").withColumn("correct", F.lit(-1).cast("long"))
    again = experiment.cross_validate(df, schemes, "c", ["k"], folds=3, done=kept)
    assert sorted(r["correct"] for r in again.collect())[:2] == [-1, -1] and again.count() == 3


def test_split_has_every_row_once(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    train, test = rows.train_test_split(df, 50, 1, ["k"])
    assert train.count() == 51 and train.intersect(test).count() == 0 and train.union(test).distinct().count() == 101


def test_generators_repeat(spark):
    a, b = (generators.gaussian_clusters(spark, 50, 3, 2, seed=4).collect() for _ in "ab")
    assert a == b and {r["cluster"] for r in a} == {0, 1, 2}
    y = generators.mexican_hat(spark, 20).collect()
    assert all(r["y"] == pytest.approx(math.sin(abs(r["x"])) / abs(r["x"])) for r in y)


def test_formats(spark, tmp_path):
    (tmp_path / "a.names").write_text("yes, no.\n| a comment\nage: continuous.\nid: ignore.\ncolour: red, blue.\n")
    (tmp_path / "a.data").write_text("31, 1, red, yes.\n?, 2, blue, no.\n")
    got = formats.read_names(spark, str(tmp_path / "a.names"), str(tmp_path / "a.data"))
    assert got.columns == ["age", "colour", "class"]
    assert [tuple(r) for r in got.collect()] == [(31.0, "red", "yes"), (None, "blue", "no")]
    (tmp_path / "a.data").write_text("31, 1, green, yes.\n")
    with pytest.raises(Exception, match="undeclared"):
        got.collect()
    (tmp_path / "d.mat").write_text("2 3\n1 2 3\n4 5 6\n")
    (tmp_path / "s.mat").write_text("2 3 2\n1 7 3 9\n2 8\n")
    assert [r["value"] for r in formats.read_any(spark, str(tmp_path / "d.mat")).orderBy("row", "column").collect()] == [1, 2, 3, 4, 5, 6]
    assert [tuple(r) for r in formats.read_any(spark, str(tmp_path / "s.mat")).orderBy("row", "column").collect()] == [(1, 1, 7.0), (1, 3, 9.0), (2, 2, 8.0)]
    for kind in ("pos", "neg"):
        (tmp_path / "texts" / kind).mkdir(parents=True)
        (tmp_path / "texts" / kind / "1.txt").write_text(kind * 2)
    assert {(r["class"], r["text"]) for r in formats.read_directory(spark, str(tmp_path / "texts")).collect()} == {("pos", "pospos"), ("neg", "negneg")}
    df = spark.createDataFrame([(1.5, "a"), (None, "b")], "x double, c string")
    formats.write_csv(df, str(tmp_path / "t.csv"))
    assert sorted(formats.read_any(spark, str(tmp_path / "t.csv")).collect(), key=str) == sorted(df.collect(), key=str)


def plain_affine(x, y):
    """All alignments, by recursion."""
    from functools import cache

    @cache
    def go(i, j, gap):
        if i == len(x) and j == len(y):
            return 0.0
        options = []
        if i < len(x) and j < len(y):
            options.append((x[i] != y[j]) + go(i + 1, j + 1, ""))
        if i < len(x):
            options.append((0.5 if gap == "x" else 1.0) + go(i + 1, j, "x"))
        if j < len(y):
            options.append((0.5 if gap == "y" else 1.0) + go(i, j + 1, "y"))
        return min(options)

    return go(0, 0, "")


def test_affine_gap(spark):
    from millrace.operators import similarity

    pairs = [("", ""), ("abc", ""), ("kitten", "sitting"), ("aaabbb", "ab"), ("abcdef", "abxxxxdef")]
    df = spark.createDataFrame([*pairs, (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(similarity.affine_gap(F.col("a"), F.col("b"))).collect()]
    assert got[:-1] == [plain_affine(*p) for p in pairs] and got[-1] is None


def test_differences_with_missing_cells(spark):
    from millrace.operators import similarity

    df = spark.createDataFrame([(1.0, 4.0), (None, 4.0), (1.0, None), (None, None)], "a double, b double")
    got = [r[0] for r in df.select(similarity.difference(F.col("a"), F.col("b"), 0.0, 5.0)).collect()]
    assert got == pytest.approx([0.6, 0.8, 0.8, 1.0])
    texts = spark.createDataFrame([("x", "x"), ("x", "y"), (None, None)], "a string, b string")
    assert [r[0] for r in texts.select(similarity.difference(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 1.0]
    d = [F.lit(0.3), F.lit(0.4)]
    got = df.limit(1).select(*[similarity.combined(d, m) for m in ("euclidean", "manhattan", "chebyshev")]).first()
    assert list(got) == pytest.approx([0.5, 0.7, 0.4])


def test_pair_scores_and_continuity(spark):
    from millrace.operators import similarity, stats

    found, truth = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int"), spark.createDataFrame([(2, 1), (5, 6), (7, 8)], "a int, b int")
    assert list(similarity.pair_scores(found, truth).first()) == pytest.approx([1 / 2, 1 / 3, 2 / 5])
    rows = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 15
    df = spark.createDataFrame(rows, "a string, b string")
    want = 75 * (abs(10 * 15 - 20 * 30) - 75 / 2) ** 2 / (30 * 45 * 40 * 35)
    assert stats.association(df, "a", "b").first()["chi2"] == pytest.approx(want)


def test_subset_merit_leaves_a_copy_out(spark):
    from millrace.operators import stats

    df = spark.createDataFrame([(str(i % 2), str(i % 2), str(i % 3), str(i % 2)) for i in range(60)], "a string, copy string, other string, c string")
    assert stats.subset_merit(df, ["a", "copy", "other"], "c") == ["a"]


def test_similar_texts_against_all_pairs(spark):
    from millrace.operators import similarity

    r = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(r.choice(words[: r.randint(5, 25)]) for _ in range(r.randint(1, 12))) for _ in range(60)] + ["", None, "w1 w2", "W2  w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    bags = {k: {w: (t or "").lower().split().count(w) for w in set((t or "").lower().split())} for k, t in enumerate(texts)}
    idf = {w: math.log(len(texts) / sum(w in b for b in bags.values())) for w in words if any(w in b for b in bags.values())}
    first = {}
    for k, b in bags.items():
        if b:
            first.setdefault(tuple(sorted(b.items())), k)
    kept = {k: {w: n * idf[w] for w, n in bags[k].items()} for k in first.values()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in kept.items()}
    cosine = {(a, b): sum(x * kept[b].get(w, 0) for w, x in kept[a].items()) / norm[a] / norm[b] for a in kept for b in kept if a < b}
    got = {(r["a"], r["b"]): r["cosine"] for r in similarity.similar_texts(df, "k", "t", 0.5).collect()}
    want = {p: c for p, c in cosine.items() if c >= 0.5}
    assert len(want) > 10 and got == pytest.approx(want)


def test_sequences_of_any_length(spark):
    import itertools

    from millrace.operators import mining

    held = {1: "abcabca", 2: "abcacb", 3: "bacabca", 4: "cabcab", 5: "aabbcca"}
    rows = [(u, i, x) for u, xs in held.items() for i, x in enumerate(xs)]
    got = mining.sequences(spark.createDataFrame(rows, "u int, i int, x string"), "u", "x", ["i"], 0.6).collect()
    inside = lambda p, xs: all(c in it for it in [iter(xs)] for c in p)
    counts = {" > ".join(p): sum(inside(p, xs) for xs in held.values()) for n in range(1, 8) for p in itertools.product("abc", repeat=n)}
    assert {r["sequence"]: r["n"] for r in got} == {p: n for p, n in counts.items() if n >= 3}
    assert max(r["sequence"].count(">") for r in got) >= 4


def test_sequences_whole_is_registered_without_limit(spark):
    from millrace.plans import catalog

    data = "/root/testdata/sf0.001"
    days = {}
    for r in spark.read.parquet(f"{data}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        days.setdefault((r["user_id"], r["ts"].date()), []).append(r["event_type"])
    inside = lambda p, xs: all(c in it for it in [iter(xs)] for c in p)
    types, open_, want = sorted({x for xs in days.values() for x in xs}), [()], {}
    while open_:
        found = {p + (x,): sum(inside(p + (x,), xs) for xs in days.values()) for p in open_ for x in types}
        open_ = [p for p, n in found.items() if 100 * n >= len(days)]
        want |= {" > ".join(p): found[p] for p in open_}
    got = catalog.queries()["sequences_whole"](spark, data).collect()
    assert len(got) == len(want) and {r["sequence"]: r["n"] for r in got} == want and max(p.count(">") for p in want) >= 2


def test_nearest_answers_any_number_of_targets(spark, monkeypatch):
    from millrace.operators import similarity

    rows = spark.createDataFrame([(i, float(i * i % 37), float(i * 7 % 23)) for i in range(60)], "id long, x double, y double")
    targets = rows.where("id % 3 = 0")
    whole = sorted(map(tuple, similarity.nearest(targets, rows, ["x", "y"], 3, "id", "id").collect()))
    monkeypatch.setattr(similarity, "MOST_TARGETS", 7)
    assert sorted(map(tuple, similarity.nearest(targets, rows, ["x", "y"], 3, "id", "id").collect())) == whole
    assert {t for t, *_ in whole} == set(range(0, 60, 3))
