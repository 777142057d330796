"""Record similarity: string and token measures, nearest rows to given targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from millrace.plans.numbering import numbered, scratch, stored


def words(c: Column) -> Column:
    """Distinct runs of letters and digits, of any script, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Common tokens over those of the longer side (not of the union)."""
    x, y = words(a), words(b)
    n = F.greatest(F.size(x), F.size(y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


#: Targets that are compared with the rows at once.
MOST_TARGETS = 10_000


def nearest(targets: DataFrame, rows: DataFrame, columns: list[str], k: int, target_id: str, row_id: str, widths: dict[str, float] | None = None, index=None) -> DataFrame:
    """``target, neighbour, distance``: the ``k`` nearest rows of each target, with all ties at the last.

    Distances are Euclidean over columns divided by ``widths``, or by their ranges without; a row with a
    missing cell has none. Targets go to all tasks in blocks of at most ``MOST_TARGETS``, one block after the
    other, so that any number is answered. A task multiplies blocks and sends on the best of its own
    rows alone. With ``index``, of ``millrace.operators.neighbours``, cells that are too far are not looked at.
    """
    m = None if widths else _ranges(rows, columns)
    width = [(widths[c] if widths else (m[f"{c}|b"] or 0) - (m[f"{c}|a"] or 0)) or 1.0 for c in columns]
    number = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    held = rows.select(F.col(row_id).alias("neighbour"), *number).na.drop(subset=[f"x{i}" for i in range(len(columns))])
    if held.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism:
        held = held.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    cells = index.fit(held, np.array(width)) if index else None
    wanted = targets.select(F.col(target_id).alias("target"), *number).na.drop(subset=[f"x{i}" for i in range(len(columns))])
    schema = f"target {dict(targets.dtypes)[target_id]}, neighbour {dict(rows.dtypes)[row_id]}, distance double"
    found = None
    for block in _target_blocks(wanted):
        part = _ranked(cells.search(block, k, schema) if cells else held.mapInArrow(best_of(block, np.array(width), k), schema), k)
        if found is None and block.num_rows < MOST_TARGETS:
            return part  # the only block
        path = scratch(rows.sparkSession, "nearest") if found is None else path
        part.write.mode("append").parquet(path)
        found = path
    return rows.sparkSession.read.schema(schema).parquet(found) if found else rows.sparkSession.createDataFrame([], schema)


def _target_blocks(wanted: DataFrame):
    """Arrow tables of at most ``MOST_TARGETS`` targets; a single one is not numbered."""
    first = wanted.limit(MOST_TARGETS).toArrow()
    if first.num_rows < MOST_TARGETS:
        yield first
        return
    held = stored(numbered(wanted, ["target"], "_place"), "targets")
    last = held.agg(F.max("_place")).first()[0]
    for at in range(1, last + 1, MOST_TARGETS):
        yield held.where(F.col("_place").between(at, at + MOST_TARGETS - 1)).drop("_place").toArrow()


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    best = pairs.withColumn("r", F.rank().over(Window.partitionBy("target").orderBy("distance"))).where(F.col("r") <= k)
    return best.select("target", "neighbour", F.round("distance", 9).alias("distance"))


def _ranges(rows: DataFrame, columns: list[str]):
    return rows.agg(*[x for c in columns for x in (F.min(c).alias(f"{c}|a"), F.max(c).alias(f"{c}|b"))]).first()


def coordinates(table) -> np.ndarray:
    """The columns behind the first as an array of rows."""
    return np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy(), float) for c in table.columns[1:]])


def distances(t: np.ndarray, x: np.ndarray, width: np.ndarray) -> np.ndarray:
    total = np.zeros((len(t), len(x)))
    for c in range(t.shape[1]):
        total += ((x[None, :, c] - t[:, None, c]) / width[c]) ** 2
    return np.sqrt(total)


def best_of(targets: pa.Table, width: np.ndarray, k: int, block: int = 256):
    """For ``mapInArrow`` over rows of ``neighbour`` and coordinates: the pairs that may be among the ``k`` best."""
    ids, t = targets.column("target").combine_chunks(), coordinates(targets)
    names = ids.to_pylist()

    def run(batches):
        best = np.full((len(t), k), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = coordinates(batch), batch.column(0)
            same = {v: i for i, v in enumerate(own.to_pylist())}
            for a in range(0, len(t), block):
                d = distances(t[a : a + block], x, width)
                for i, name in enumerate(names[a : a + block]):
                    if name in same:
                        d[i, same[name]] = np.inf
                here = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, : min(k, d.shape[1])]
                best[a : a + block] = np.partition(np.hstack([best[a : a + block], here]), k - 1, axis=1)[:, :k]
                i, j = np.nonzero(np.isfinite(d) & (d <= best[a : a + block].max(1)[:, None]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + a)), own.take(pa.array(j)), pa.array(d[i, j])], ["target", "neighbour", "distance"])

    return run


def difference(a: Column, b: Column, low: float | None = None, high: float | None = None) -> Column:
    """0 to 1. Numbers (with a range): missing on both sides is 1, on one side the farther end of the
    other. Texts (without): 1 unless equal and known."""
    if low is None or high is None:
        return F.when(F.coalesce(a == b, F.lit(False)), 0.0).otherwise(F.lit(1.0))
    unit = lambda c: (c - low) / (high - low) if high > low else F.when(c.isNotNull(), 0.0)
    x, y = unit(a), unit(b)
    one = F.coalesce(x, y)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y)).otherwise(F.coalesce(F.greatest(one, 1 - one), F.lit(1.0)))


def combined(differences: list[Column], metric: str = "euclidean") -> Column:
    total = lambda xs: sum(xs, F.lit(0.0))
    if metric == "manhattan":
        return total(differences)
    if metric == "chebyshev":
        return F.greatest(F.lit(0.0), *differences)
    if metric != "euclidean":
        raise ValueError(f"no metric is named {metric}")
    return F.sqrt(total([d * d for d in differences]))


def affine_costs(x: list[str], y: list[str], match: float, change: float, opened: float, extended: float) -> np.ndarray:
    """The costs of many pairs at once: the table of each pair's prefixes, filled for all pairs cell by cell."""
    code = lambda texts: np.array([np.pad(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), (0, longest - len(t)), constant_values=-1) for t in texts])
    lx, ly = np.array([len(t) for t in x]), np.array([len(t) for t in y])
    longest = int(max(lx.max(initial=0), ly.max(initial=0), 1))
    cx, cy = code(x), code(y)
    whole = np.concatenate([[0.0], opened + extended * np.arange(ly.max(initial=0))])[:, None] + np.zeros(len(x))
    down, found, every = np.full_like(whole, np.inf), np.zeros(len(x)), np.arange(len(x))
    found[lx == 0] = whole[ly, every][lx == 0]
    for i in range(1, int(lx.max(initial=0)) + 1):
        corner, across = whole[0].copy(), np.full(len(x), np.inf)
        whole[0] = opened + extended * (i - 1)
        for j in range(1, len(whole)):
            down[j] = np.minimum(down[j] + extended, whole[j] + opened)
            across = np.minimum(across + extended, whole[j - 1] + opened)
            best = np.minimum(np.minimum(corner + np.where(cx[:, i - 1] == cy[:, j - 1], match, change), down[j]), across)
            corner, whole[j] = whole[j].copy(), best
        done = lx == i
        found[done] = whole[ly, every][done]
    return found


def affine_gap(a: Column, b: Column, match: float = 0.0, change: float = 1.0, opened: float = 1.0, extended: float = 0.5) -> Column:
    """The least cost to turn one text into the other, where a gap's first and later characters differ in cost.

    Missing texts give a missing cost. Pairs of like length are worked on together.
    """

    @pandas_udf("double")
    def cost(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        known = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        sizes = np.array([len(x.iloc[i]) * 4096 + len(y.iloc[i]) for i in known])
        order = known[np.argsort(sizes, kind="stable")]
        for at in range(0, len(order), 512):
            some = order[at : at + 512]
            out[some] = affine_costs([x.iloc[i] for i in some], [y.iloc[i] for i in some], match, change, opened, extended)
        return pd.Series(out)

    return cost(a, b)


def similar_texts(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """``a, b, cosine``: pairs of rows whose weighted token vectors have at least that cosine, exactly.

    Rows of equal vectors are compared once, by the smallest key; ``same_vectors`` has who they are.
    Tokens are ordered from rare to frequent. A pair must share a token in the part of both vectors
    before the rest is shorter than ``least``: frequent tokens are so never paired.
    """
    from millrace.operators.text import tf_idf

    weights = tf_idf(df, key, text).withColumnRenamed(key, "k")
    firsts = _equal(weights).where("k = first").select("k")
    weights = weights.join(firsts, "k", "left_semi")
    norms = weights.groupBy("k").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    often = weights.groupBy("word").agg(F.count("*").alias("rows"))  # any one order of the words will do
    unit = weights.join(norms, "k").join(often, "word").select("k", "word", (F.col("weight") / F.col("norm")).alias("w"), "rows")
    unit = stored(unit, "vectors")
    rest = Window.partitionBy("k").orderBy("rows", "word").rowsBetween(0, Window.unboundedFollowing)
    first = unit.withColumn("rest", F.sum(F.col("w") * F.col("w")).over(rest)).where(F.col("rest") >= least * least - 1e-9)
    first = stored(first.select("k", "word"), "rare")
    pairs = first.select(F.col("k").alias("a"), "word").join(first.select(F.col("k").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    left = pairs.join(unit.select(F.col("k").alias("a"), "word", F.col("w").alias("x")), "a")
    both = left.join(unit.select(F.col("k").alias("b"), "word", F.col("w").alias("y")), ["b", "word"])
    return both.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine")).where(F.col("cosine") >= least)


def _equal(weights: DataFrame) -> DataFrame:
    bag = F.array_sort(F.collect_list(F.struct("word", "weight"))).cast("string")
    bags = weights.groupBy("k").agg(F.sha2(bag, 256).alias("bag"))
    return bags.join(bags.groupBy("bag").agg(F.min("k").alias("first")), "bag").select("k", "first")


def same_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, first``: the smallest key of the rows that have the same weighted tokens; rows without any go."""
    from millrace.operators.text import tf_idf

    return _equal(tf_idf(df, key, text).withColumnRenamed(key, "k")).withColumnRenamed("k", key)


def pair_scores(found: DataFrame, truth: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: precision, recall and F of pairs, whichever way round they are given."""
    way = lambda d: d.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    both = way(found).withColumn("f", F.lit(1)).join(way(truth).withColumn("t", F.lit(1)), ["a", "b"], "full")
    counts = both.agg(F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("hit"), F.count("f").alias("nf"), F.count("t").alias("nt"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    hit, nf, nt = F.col("hit"), F.col("nf"), F.col("nt")
    return counts.select(ratio(hit, nf).alias("precision"), ratio(hit, nt).alias("recall"), ratio(2 * hit, nf + nt).alias("f"))
