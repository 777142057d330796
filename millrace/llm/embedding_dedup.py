"""Near-duplicate vectors: spherical k-means cells and blocked cosine products.

Each vector lives in the cell of its nearest centroid and is sent, besides, to every later cell
whose border lies within the angle of the threshold: a linked pair always meets in one cell, so
that the search is exact. Cells that are still large are parted the same way once more. Cells are
cut into blocks; a task multiplies two blocks, adds up links a vector, and keeps only a spanning
forest of the linked pairs. Equal vectors are searched once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, discard, join_heavy, materialize


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell takes the row farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        home = s.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        for j in np.flatnonzero(norm < 1e-12):
            total[j] = x[s.max(1).argmin()]
            norm[j] = 1.0
        c = total / norm[:, None]
    return c


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the smallest node of their component, of a graph on ``0..n-1``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def _links(x: np.ndarray, y: np.ndarray | None, weight_x, weight_y, guest_x, guest_y, threshold: float, rows: int = 512):
    """Weighted links of each row of ``x`` and ``y`` (of ``x`` alone if ``y`` is None), and forest edges on both.
    Two guests meet elsewhere."""
    same = y is None
    y = x if same else y
    shift = 0 if same else len(x)
    links_x, links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    masked = guest_x.any() and guest_y.any()
    ea, eb = [], []
    for i in range(0, len(x), rows):
        hit = x[i : i + rows] @ y.T >= threshold
        if same:
            hit[np.arange(hit.shape[0]), np.arange(i, i + hit.shape[0])] = False
        if masked:
            hit &= ~(guest_x[i : i + rows, None] & guest_y[None])
        a, b = np.nonzero(hit)
        links_x[i : i + rows] += np.bincount(a, weight_y[b], hit.shape[0]).astype(np.int64)
        if not same:
            links_y += np.bincount(b, weight_x[i + a], len(y)).astype(np.int64)
        if len(a):
            nodes, to = forest(a + i, b + shift, shift + len(y))
            ea.append(nodes)
            eb.append(to)
    if ea:
        ea, eb = forest(np.concatenate(ea), np.concatenate(eb), shift + len(y))
    return links_x, links_y, ea, eb


def _homes(x: np.ndarray, centroids: np.ndarray, sine: float) -> tuple[np.ndarray, pa.ListArray]:
    """The cell of each unit row, and the later cells whose border lies within the angle of the threshold."""
    s = x @ centroids.T
    home = s.argmax(1)
    apart = np.linalg.norm(centroids[:, None] - centroids[None], axis=2) if len(centroids) <= 512 else None
    far = apart[home] if apart is not None else np.sqrt(np.maximum(2 - 2 * centroids[home] @ centroids.T, 0))
    near = s[np.arange(len(x)), home][:, None] - s <= sine * far + 1e-7
    near &= np.arange(len(centroids))[None] > home[:, None]
    row, cell = np.nonzero(near)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))])
    return home.astype(np.int32), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(cell.astype(np.int32)))


_PLACED = "dim int, cell int, fine int, visitor boolean, guest boolean, uid long, n long, x binary"


def _rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _first_level(classes: DataFrame, dim: int, centroids: np.ndarray, sine: float) -> DataFrame:
    """``uid, n, dim, home, others, x`` with unit rows; vectors of other lengths have one cell a length."""

    def assign(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes).tolist():
                chosen = np.flatnonzero(sizes == d)
                x = flat[starts[chosen][:, None] + np.arange(d)[None]]
                x = x / np.abs(x).max(1)[:, None]
                x = x / np.linalg.norm(x, axis=1)[:, None]
                home, others = _homes(x, centroids if d == dim else np.ones((1, d)), sine)
                take = pa.array(chosen)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(chosen), d, np.int32)), pa.array(home), others, pa.array([r.tobytes() for r in x], pa.binary())],
                    ["uid", "n", "dim", "home", "others", "x"],
                )

    return classes.select("uid", "n", "v").mapInArrow(assign, "uid long, n long, dim int, home int, others array<int>, x binary")


def _second_level(placed: DataFrame, dim: int, cell_rows: int, most_cells: int, sample_rows: int, sine: float) -> DataFrame:
    """The rows in each cell, guests among them, by finer cells: cells of more than ``cell_rows`` rows get
    centroids of their own, fitted on about ``sample_rows`` of them. Any two rows of a cell meet in a finer one."""
    live = placed.where(F.col("dim") == dim).groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("live"))
    wanted = live.select("cell", "live", F.least(F.ceil(F.col("live") / cell_rows), F.lit(most_cells)).cast("int").alias("k")).where("k > 1")
    present = placed.select("dim", F.col("home").alias("cell"), F.lit(False).alias("guest"), "uid", "n", "x").unionAll(
        placed.select("dim", F.explode("others").alias("cell"), F.lit(True).alias("guest"), "uid", "n", "x")
    )
    def fit(key, t):
        x, k = _rows_of(t.column("x"), dim), t.column("k")[0].as_py()
        order = np.argsort(t.column("uid").to_numpy())
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "c": pa.array([spherical_kmeans(x[order], min(k, len(x))).tobytes()], pa.binary())})

    chosen = placed.where(F.col("dim") == dim).withColumn("cell", F.col("home")).join(wanted, "cell").where(F.pmod(F.xxhash64("uid", F.lit(3)), F.col("live")) < sample_rows)
    centroids = materialize(chosen.select("cell", "uid", "k", "x").groupBy("cell").applyInArrow(fit, "cell int, c binary"), "centroids")
    plain = present.join(centroids.select(F.lit(dim).alias("dim"), "cell"), ["dim", "cell"], "left_anti").select("dim", "cell", F.lit(0).alias("fine"), F.col("guest").alias("visitor"), "guest", "uid", "n", "x")
    # The rows of a cell are dealt to parts of bounded size, and each part gets the cell's centroids.
    part_rows = max(1000, (32 << 20) // (8 * dim))
    size = present.where(F.col("dim") == dim).groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")).join(centroids.select("cell"), "cell")
    dealt = present.where(F.col("dim") == dim).join(size, "cell").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts", "dim")
    spread = centroids.join(size, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "c")

    def assign(key, t, c):
        if not len(t) or not len(c):
            return pa.table({n: pa.array([], k) for n, k in _KINDS})
        x = _rows_of(t.column("x"), dim)
        home, others = _homes(x, np.frombuffer(c.column("c")[0].as_py(), np.float64).reshape(-1, dim), sine)
        at = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), np.diff(others.offsets.to_numpy()))])
        fine = np.concatenate([home, others.flatten().to_numpy()])
        visitor = np.arange(len(at)) >= len(x)
        took = t.take(pa.array(at))
        columns = [pa.array(np.full(len(at), dim, np.int32)), took.column("cell"), pa.array(fine, pa.int32()), pa.array(visitor), *[took.column(n) for n in ("guest", "uid", "n", "x")]]
        return pa.table(columns, names=[n for n, _ in _KINDS])

    fine = dealt.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInArrow(assign, _PLACED)
    return plain.unionByName(fine)


_KINDS = list(zip([f.split(" ")[0] for f in _PLACED.split(", ")], [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]))


def group_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    cell_rows: int = 8192,
    block_rows: int = 8192,
    most_cells: int = 1024,
    sample_rows: int = 20_000,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors that are null, empty or zero, or hold nulls or values that are not finite, link with
    nothing. Vectors of different lengths never link. Rows of equal vectors link with each other,
    whatever their ids. A null id is no candidate for a component's id. Repeated rows are repeated;
    an empty table gives no rows; other columns are not read. Centroids are fitted on at most
    ``sample_rows`` distinct vectors of the commonest length. Where ``most_cells`` of them leave
    cells larger than ``cell_rows``, those are parted again by centroids of their own.
    """
    sine = math.sqrt(max(0.0, 1 - threshold * threshold))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = (
        F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
        & F.exists("v", lambda e: F.coalesce(e != 0, F.lit(False)))
    )
    fine = F.coalesce(fine, F.lit(False))
    rows = rows.select("vec_id", "v", F.when(fine, F.xxhash64("v")).alias("h1"), F.when(fine, F.xxhash64(F.lit(1), "v")).alias("h2"))
    classes = materialize(
        rows.where("h1 is not null").groupBy("h1", "h2", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("uid", F.monotonically_increasing_id()),
        "vectors",
    )
    sizes = classes.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (1, 0)
    k = max(1, min(most_cells, -(-n // cell_rows)))
    centroids = np.ones((1, dim))
    if k > 1:
        sample = classes.where(F.size("v") == dim).orderBy(F.xxhash64("uid"), "uid").select("v").limit(sample_rows).toArrow()
        x = sample.column(0).combine_chunks().flatten().to_numpy().reshape(-1, dim)
        x = x / np.abs(x).max(1)[:, None]
        centroids = spherical_kmeans(x / np.linalg.norm(x, axis=1)[:, None], min(k, len(x)))
    placed = materialize(_first_level(classes, dim, centroids, sine), "cells")
    if n > 2 * k * cell_rows:
        cells = materialize(_second_level(placed, dim, cell_rows, most_cells, sample_rows, sine), "fine")
    else:
        home = placed.select("dim", F.col("home").alias("cell"), F.lit(0).alias("fine"), F.lit(False).alias("visitor"), F.lit(False).alias("guest"), "uid", "n", "x")
        guests = placed.select("dim", F.explode("others").alias("cell"), F.lit(0).alias("fine"), F.lit(True).alias("visitor"), F.lit(True).alias("guest"), "uid", "n", "x")
        cells = home.unionAll(guests)
    # Blocks of the rows that live in each cell, and of those that visit it: numbers only, one row a cell.
    where = ["dim", "cell", "fine"]
    cut = lambda c: F.greatest(F.lit(1), F.ceil(F.count(F.when(c, 1)) / block_rows)).cast("int")
    blocks = cells.groupBy(where).agg(cut(~F.col("visitor")).alias("live"), cut(F.col("visitor")).alias("visit"))
    # Task (i, j) of a cell: its own blocks i <= j, or own block i against visiting block -1 - j.
    held = cells.join(blocks, where)
    every = F.sequence(F.lit(0), F.col("live") - 1)
    tasks_own = F.concat(
        F.transform(every, lambda j: F.struct(F.least("b", j).alias("i"), F.greatest("b", j).alias("j"))),
        F.transform(F.sequence(F.lit(0), F.col("visit") - 1), lambda j: F.struct(F.col("b").alias("i"), (-1 - j).alias("j"))),
    )
    tasks_guest = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("b").alias("j")))
    held = held.withColumn("b", F.when(F.col("visitor"), -1 - F.pmod(F.xxhash64("uid"), F.col("visit"))).otherwise(F.pmod(F.xxhash64("uid"), F.col("live"))).cast("int"))
    dealt = held.withColumn("t", F.explode(F.when(F.col("visitor"), tasks_guest).otherwise(tasks_own))).select(*where, "t.i", "t.j", "b", "guest", "uid", "n", "x")

    def compare(key, t):
        d, i, j = (key[p].as_py() for p in (0, 3, 4))
        side = t.column("b").to_numpy()
        uid, weight, guest = t.column("uid").to_numpy(), t.column("n").to_numpy(), t.column("guest").to_numpy()
        x = _rows_of(t.column("x"), d)
        first = np.flatnonzero(side == i)
        second = None if i == j else np.flatnonzero(side == j)
        other = first if second is None else second
        got_a, got_b, ea, eb = _links(x[first], None if second is None else x[second], weight[first], weight[other], guest[first], guest[other], threshold)
        order = first if second is None else np.concatenate([first, second])
        links = got_a if second is None else np.concatenate([got_a, got_b])
        has = np.flatnonzero(links)
        ids = uid[order]
        ea, eb = np.array(ea, np.int64), np.array(eb, np.int64)
        return pa.table({
            "a": pa.array(np.concatenate([ids[has], ids[ea]]), pa.int64()),
            "b": pa.array([None] * len(has) + ids[eb].tolist(), pa.int64()),
            "links": pa.array(np.concatenate([links[has], np.zeros(len(ea), np.int64)]), pa.int64()),
        })

    found = materialize(dealt.groupBy(*where, "i", "j").applyInArrow(compare, "a long, b long, links long"), "links")
    discard(placed, cells)
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("b is not null").select("a", "b"))
    known = (
        classes.select("uid", "h1", "h2", "low", "n").join(links.withColumnRenamed("a", "uid"), "uid", "left").join(groups.withColumnRenamed("node", "uid"), "uid", "left")
        .withColumn("component", F.coalesce("component", "uid"))
    )
    lows = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(lows, "component").select("h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return (
        join_heavy(rows.drop("v"), known, ["h1", "h2"], "n", rows.count())
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
