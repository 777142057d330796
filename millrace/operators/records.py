"""Small tables of scores, cliques, links and sparse matrices: votes, comparisons, closures and conversions.

Scores are ``idx, label, prob, actual``; cliques ``clique, items, support, confidence``; links ``a, b, link`` with 1 for must
and -1 for cannot; matrices ``row, column, value``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.naming import free
from millrace.plans.numbering import numbered, numbered_within, stored

# Scores --------------------------------------------------------------------------------------


def score_table(scores: DataFrame, labels: list) -> DataFrame:
    """One row an actual label: the counts of each predicted one, its recall, and the accuracy of all."""
    hit = F.sum(F.when(F.col("label").eqNullSafe(F.col("actual")), 1).otherwise(0))
    counts = scores.groupBy("actual").agg(*[F.sum(F.when(F.col("label") == v, 1).otherwise(0)).alias(f"as_{v}") for v in labels], hit.alias("hit"), F.count("*").alias("n"))
    whole = scores.agg((hit / F.count("*")).alias("accuracy"))
    return counts.join(F.broadcast(whole)).select("actual", *[f"as_{v}" for v in labels], (F.col("hit") / F.col("n")).alias("recall"), "accuracy")  # one row


def differing(a: DataFrame, b: DataFrame, order: list[str], weighted: bool = False) -> DataFrame:
    """One row: the share of places at which two tables of scores differ in their labels; weighted, at which the
    numeric labels times their probabilities lie more than 1 apart."""
    left = numbered(a.select(*order, "label", "prob"), order, "_place").select("_place", F.col("label").alias("x"), F.col("prob").alias("p"))
    right = numbered(b.select(*order, "label", "prob"), order, "_place").select("_place", F.col("label").alias("y"), F.col("prob").alias("q"))
    off = F.abs(F.col("x") * F.col("p") - F.col("y") * F.col("q")) > 1 if weighted else ~F.col("x").eqNullSafe(F.col("y"))
    return left.join(right, "_place").agg(F.avg(F.when(off, 1.0).otherwise(0.0)).alias("differing"))


def mean_vote(scores: list[DataFrame], known: DataFrame | None = None) -> DataFrame:
    """``idx, label``: the mean of label times probability over the tables, or the known label."""
    every = reduce(DataFrame.unionByName, [s.select("idx", (F.col("label") * F.col("prob")).alias("v")) for s in scores])
    voted = every.groupBy("idx").agg((F.sum("v") / len(scores)).alias("vote"))
    if known is None:
        return voted.select("idx", F.col("vote").alias("label"))
    return voted.join(known.select("idx", F.col("label").cast("double").alias("known")), "idx", "full").select("idx", F.coalesce("known", "vote").alias("label"))


def weighted_vote(scores: DataFrame) -> DataFrame:
    """``idx, label, share``: the label of the largest sum of probabilities, the first of equals, and its part of all."""
    sums = scores.groupBy("idx", "label").agg(F.sum("prob").alias("s"))
    best = sums.groupBy("idx").agg(F.min(F.struct((-F.round("s", 12)).alias("s"), "label")).alias("b"), F.sum("s").alias("t"))
    return best.select("idx", F.col("b.label").alias("label"), (-F.col("b.s") / F.col("t")).alias("share"))


def most_uncertain(scores: DataFrame, value: str, n: int | None = None) -> DataFrame:
    """Rows by rising distance of ``value`` from 0, ties by ``idx``."""
    ordered = scores.orderBy(F.abs(value), "idx")
    return ordered.limit(n) if n is not None else ordered


def most_disputed(scores: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``idx, variance``: the population variance of a committee's scores ``idx, label``; 0 where the label is known."""
    spread = scores.groupBy("idx").agg(F.var_pop("label").alias("variance"))
    if known is None:
        return spread
    flagged = spread.join(known.select("idx", F.lit(True).alias("_known")).distinct(), "idx", "left")
    return flagged.select("idx", F.when(F.col("_known"), 0.0).otherwise(F.col("variance")).alias("variance"))


def renumbered(scores: DataFrame, index: DataFrame, order: list[str]) -> DataFrame:
    """Scores whose n-th row gets the n-th ``idx`` of ``index``."""
    place = free([*scores.columns, *index.columns], "_place")[0]
    named = numbered(index.select("idx", *[c for c in order if c in index.columns and c != "idx"]), ["idx"], place).select(place, F.col("idx").alias("_idx"))
    rows = numbered(scores, order, place).join(named, place)
    return rows.select(*[F.col("_idx").alias("idx") if c == "idx" else F.col(c) for c in scores.columns])


def merged(tables: list[DataFrame]) -> DataFrame:
    """One row an ``idx``: that of the last table that has it."""
    every = reduce(DataFrame.unionByName, [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)])
    rest = [c for c in tables[0].columns if c != "idx"]
    return every.groupBy("idx").agg(F.max(F.struct("_table", *rest)).alias("b")).select("idx", *[F.col(f"b.{c}").alias(c) for c in rest])


def only(scores: DataFrame, index: DataFrame) -> DataFrame:
    return scores.join(index.select("idx").distinct(), "idx", "left_semi")


def tuned(scores: DataFrame, classes: int) -> DataFrame:
    """Probabilities moved half way to 1 where right, and to an even share where wrong."""
    goal = F.when(F.col("label").eqNullSafe(F.col("actual")), 1.0).otherwise(1.0 / classes)
    return scores.withColumn("prob", (F.col("prob") + goal) / 2)


def united(pairs: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``round, idx, label``: samples joined with their labels, of all rounds."""
    found = [s.join(labels, "idx").select(F.lit(i).alias("round"), "idx", "label") for i, (s, labels) in enumerate(pairs, 1)]
    return reduce(DataFrame.unionByName, found)


# Cliques and links ---------------------------------------------------------------------------


def read_cliques(lines: DataFrame) -> DataFrame:
    """``items, support, confidence`` of lines ``i j k (support confidence)``; percentages are divided by 100."""
    part = lambda k: F.regexp_extract("value", r"\(\s*([\d.eE+-]+%?)[\s,]+([\d.eE+-]+%?)\s*\)", k)
    number = lambda c: F.when(c.endswith("%"), F.regexp_replace(c, "%", "").cast("double") / 100).otherwise(c.cast("double"))
    items = F.filter(F.split(F.trim(F.regexp_replace("value", r"\(.*$", "")), r"\s+"), lambda x: x != "")
    kept = lines.where(F.col("value").rlike(r"\(.*\)"))
    return kept.select(F.transform(items, lambda x: x.cast("long")).alias("items"), number(part(1)).alias("support"), number(part(2)).alias("confidence"))


def clique_lines(cliques: DataFrame) -> DataFrame:
    text = F.concat(F.array_join(F.transform("items", lambda x: x.cast("string")), " "), F.lit(" ("), F.col("support").cast("string"), F.lit(" "), F.col("confidence").cast("string"), F.lit(")"))
    return cliques.select(text.alias("value"))


def strong_cliques(cliques: DataFrame, size: int = 0, support: float = 0.0, confidence: float = 0.0) -> DataFrame:
    return cliques.where((F.size("items") >= size) & (F.col("support") >= support) & (F.col("confidence") >= confidence))


def ordered_cliques(cliques: DataFrame, keys: str = "012") -> DataFrame:
    """By falling size (0), support (1) and confidence (2), in the order of ``keys``."""
    made = [F.size("items"), F.col("support"), F.col("confidence")]
    return cliques.orderBy(*[made[int(k)].desc() for k in keys], F.col("items"))


def clique_items(cliques: DataFrame) -> DataFrame:
    """``item, first``: each item once, with the smallest clique that has it."""
    return cliques.select("clique", F.explode("items").alias("item")).groupBy("item").agg(F.min("clique").alias("first"))


def relabel(cliques: DataFrame, scores: DataFrame, strategy: str = "vote") -> DataFrame:
    """Scores whose items take their last clique's label: the one of the largest probability in it (``best``), or of
    the largest sum (``vote``). Items without a clique stay."""
    members = cliques.select("clique", F.explode("items").alias("idx")).join(scores.select("idx", "label", "prob"), "idx")
    if strategy == "best":
        chosen = members.groupBy("clique").agg(F.min(F.struct((-F.col("prob")).alias("p"), "label")).alias("b"))
    else:
        sums = members.groupBy("clique", "label").agg(F.sum("prob").alias("s"))
        chosen = sums.groupBy("clique").agg(F.min(F.struct((-F.round("s", 9)).alias("s"), "label")).alias("b"))
    last = members.groupBy("idx").agg(F.max("clique").alias("clique"))
    new = last.join(chosen, "clique").select("idx", F.col("b.label").alias("_label"))
    return scores.join(new, "idx", "left").select(*[F.coalesce("_label", "label").alias("label") if c == "label" else F.col(c) for c in scores.columns])


def clique_links(cliques: DataFrame, last_only: bool = False) -> DataFrame:
    """``a, b, link`` for the pairs of each clique in order; ``last_only`` keeps a left item's last partner alone."""
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    found = cliques.select("clique", F.explode(pairs).alias("p")).select("clique", "p.a", "p.b")
    if last_only:
        place = F.expr("clique")
        found = found.groupBy("a").agg(F.max(F.struct(place.alias("c"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).alias("link")).distinct() if not last_only else found.withColumn("link", F.lit(1))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable, by rounds in which every node takes the least label of its
    neighbours and then that of its label; each round is written to the shared folder."""
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionAll(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    label = stored(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("component")), "labels")
    for _ in range(most):
        low = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("component").alias("m"))
        step = label.join(low, label["node"] == low["u"]).select("node", F.least("component", "m").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = stored(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component")), "labels")
        moved = after.join(label.withColumnRenamed("component", "old"), "node").where("component < old").limit(1).count()
        label = after
        if not moved:
            return label
    raise RuntimeError("components did not settle")


def closed_links(links: DataFrame) -> DataFrame:
    """All links that follow: members of a must-link component belong together, and two components with a cannot-link
    between them are apart. A component is one cell, ``near`` and ``far`` lists; pairs are not written out.

    ``component, members, apart``: the sorted members and the sorted components that they must not meet.
    """
    must = links.where("link = 1")
    nodes = links.select(F.col("a").alias("node")).unionAll(links.select("b")).distinct()
    known = nodes.join(components(must), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    cannot = links.where("link = -1")
    sides = cannot.join(known.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(known.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    apart = sides.select("ca", "cb").unionAll(sides.select("cb", "ca")).where("ca <> cb").groupBy(F.col("ca").alias("component")).agg(F.array_sort(F.collect_set("cb")).alias("apart"))
    members = known.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return members.join(apart, "component", "left").select("component", "members", F.coalesce("apart", F.array().cast("array<bigint>")).alias("apart"))


def _labelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    left, right = (labels.select(F.col("idx").alias(n), F.col("label").alias(f"label_{n}")) for n in "ab")
    return links.join(left, "a").join(right, "b")


def filter_links(links: DataFrame, labels: DataFrame, agree: bool = False) -> DataFrame:
    """Links whose two labels differ, or agree."""
    same = F.col("label_a") == F.col("label_b")
    return _labelled(links, labels).where(same if agree else ~same).select(links.columns)


def link_errors(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links that contradict known labels."""
    same = F.col("label_a") == F.col("label_b")
    return _labelled(links, labels).where(((F.col("link") == 1) & ~same) | ((F.col("link") == -1) & same)).select(links.columns)


def mean_or_mode(rows: DataFrame, cliques: DataFrame, key: str, numbers: list[str], nominals: list[str]) -> DataFrame:
    """One row a clique: the means of its members' numbers and the commonest of their values, the first of equals."""
    members = cliques.select("clique", F.explode("items").alias(key)).join(rows, key)
    found = members.groupBy("clique").agg(*[F.avg(c).alias(c) for c in numbers])
    for c in nominals:
        n = members.where(F.col(c).isNotNull()).groupBy("clique", c).count()
        top = n.groupBy("clique").agg(F.min(F.struct((-F.col("count")).alias("n"), c)).alias("b")).select("clique", F.col(f"b.{c}").alias(c))
        found = found.join(top, "clique", "left")
    return found


def item_distance(x: Column, y: Column) -> Column:
    """1 less the cosine of two arrays of numbers; 1 if one has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(length > 0, 1 - dot(x, y) / length).otherwise(F.lit(1.0))


def close_distance(x: Column, y: Column) -> Column:
    """``1 / (1 + cosine)``; 1 if one has no length."""
    return 1 / (2 - item_distance(x, y))


def linked_rows(links: DataFrame, labels: DataFrame, vectors: DataFrame, cliques: DataFrame | None = None) -> DataFrame:
    """Links with both labels, whether they agree, the distance of the two vectors and, given cliques, how many hold both."""
    left, right = (vectors.select(F.col("idx").alias(n), F.col("vector").alias(f"vector_{n}")) for n in "ab")
    found = _labelled(links, labels).join(left, "a").join(right, "b")
    found = found.withColumns({"agree": F.col("label_a") == F.col("label_b"), "distance": item_distance(F.col("vector_a"), F.col("vector_b"))}).drop("vector_a", "vector_b")
    if cliques is None:
        return found
    held = cliques.select("clique", F.explode("items").alias("x"))
    shared = held.withColumnRenamed("x", "a").join(held.withColumnRenamed("x", "b"), "clique").where("a < b").groupBy("a", "b").agg(F.count("*").alias("cliques"))
    ends = found.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(shared.toDF("lo", "hi", "cliques"), ["lo", "hi"], "left")
    return ends.withColumn("cliques", F.coalesce("cliques", F.lit(0))).drop("lo", "hi")


# Matrices ------------------------------------------------------------------------------------


def binary(matrix: DataFrame) -> DataFrame:
    return matrix.where("value <> 0").withColumn("value", F.lit(1.0))


def inverse_frequency(matrix: DataFrame, rows: int) -> DataFrame:
    """Values times ``log2(rows / rows that have the column)``."""
    held = matrix.where("value <> 0").groupBy("column").agg(F.countDistinct("row").alias("df"))
    return matrix.join(held, "column").select("row", "column", (F.col("value") * F.log2(F.lit(float(rows)) / F.col("df"))).alias("value"))


def stacked(matrices: list[DataFrame], sizes: list[int]) -> DataFrame:
    """The rows of all matrices below each other."""
    start, found = 0, []
    for m, n in zip(matrices, sizes):
        found.append(m.select((F.col("row") + start).alias("row"), "column", "value"))
        start += n
    return reduce(DataFrame.unionByName, found)


def picked(matrix: DataFrame, rows: DataFrame) -> DataFrame:
    """The given rows, numbered anew in their order."""
    named = numbered(rows.select("row").distinct(), ["row"], "_new")
    return matrix.join(named, "row").select(F.col("_new").alias("row"), "column", "value")


def chunked(matrix: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """``part, row, column, value``: rows dealt to parts class after class, evenly within each."""
    dealt = numbered_within(labels.select("row", "label"), "label", ["row"], "_place").select("row", F.pmod(F.col("_place") - 1, F.lit(parts)).cast("int").alias("part"))
    return matrix.join(dealt, "row").select("part", "row", "column", "value")


def sparse(matrix: DataFrame) -> DataFrame:
    return matrix.where("value <> 0")


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("column").alias("row"), F.col("row").alias("column"), "value")


def long_lines(lines: DataFrame, n: int) -> DataFrame:
    """Lines of more than ``n`` tokens."""
    return lines.where(F.size(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")) > n)


def load_pairs(lines: DataFrame, length: int) -> DataFrame:
    """Dense arrays of ``length`` from lines of pairs of place, from 1, and value."""
    tokens = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    places = F.when(F.size(tokens) > 1, F.sequence(F.lit(1), F.size(tokens) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    pairs = F.map_from_entries(F.transform(places, lambda k: F.struct(F.element_at(tokens, k).cast("int"), F.element_at(tokens, k + 1).cast("double"))))
    return lines.withColumn("vector", F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.coalesce(F.try_element_at(pairs, i), F.lit(0.0))))


def includes(a: Column, b: Column) -> Column:
    """Whether the first set holds all of the second."""
    return F.size(F.array_except(b, a)) == 0


def maximal(itemsets: DataFrame) -> DataFrame:
    """Itemsets ``items, n`` without a frequent set around them: one larger by one item tells."""
    inner = itemsets.where(F.size("items") > 1).select(F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x)))).alias("items")).distinct()
    return itemsets.join(inner, "items", "left_anti")


def superset_confidence(itemsets: DataFrame) -> DataFrame:
    """``items, superset, confidence``: how often a frequent set is part of each maximal one around it."""
    top = stored(maximal(itemsets).select(F.col("items").alias("superset"), F.col("n").alias("m")), "maximal")
    smaller = itemsets.join(top.select(F.col("superset").alias("items")), "items", "left_anti")
    # Candidates share an item: their rarest is enough to meet.
    first = smaller.withColumn("i", F.get("items", F.lit(0)))
    held = top.withColumn("i", F.explode("superset"))
    return first.join(held, "i").where(includes(F.col("superset"), F.col("items"))).select("items", "superset", (F.col("m") / F.col("n")).alias("confidence"))


# Clusters ------------------------------------------------------------------------------------


def medoids(rows: DataFrame, key: str, vector: str, k: int, most: int = 50) -> tuple[DataFrame, list]:
    """``key, cluster`` and the medoids' keys: rows go to the medoid of the largest cosine, the first of equals, and the
    new medoid of a cluster is the row whose cosines with its members add up to most.

    The first ``k`` keys begin. A row's cosines with all members are its product with the sum of their
    unit vectors, so that no pairs are formed: one pass a round. Ends when no medoid changes.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = stored(rows.select(F.col(key).alias("key"), F.transform(F.col(vector), lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0))).alias("u")), "unit")
    chosen = [(r["key"], r["u"]) for r in unit.orderBy("key").limit(k).collect()]
    for _ in range(most):
        near = F.array(*[F.struct(F.round(dot(F.col("u"), F.array(*[F.lit(float(x)) for x in u])), 12).alias("s"), F.lit(-i).alias("i")) for i, (_, u) in enumerate(chosen)])
        placed = unit.withColumn("cluster", -F.array_max(near)["i"])
        width = len(chosen[0][1]) if chosen else 0
        sums = placed.groupBy("cluster").agg(F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(width)]).alias("total"))
        best = placed.join(F.broadcast(sums), "cluster").groupBy("cluster").agg(F.max(F.struct(F.round(dot(F.col("u"), F.col("total")), 9).alias("s"), (-F.col("key")).alias("k"), "u")).alias("b"))  # k rows
        new = {r["cluster"]: (-r["b"]["k"], r["b"]["u"]) for r in best.collect()}
        after = [new.get(i, c) for i, c in enumerate(chosen)]
        if [a[0] for a in after] == [c[0] for c in chosen]:
            break
        chosen = after
    return placed.select(F.col("key").alias(key), "cluster"), [c[0] for c in chosen]


def lloyd(rows: DataFrame, key: str, columns: list[str], centres: list[list[float]], metric: str = "euclidean", most: int = 50) -> tuple[DataFrame, list[list[float]]]:
    """``key, cluster`` and the centres of the plain two-step loop from given centres; ends when no row moves.

    ``euclidean`` takes means; ``manhattan`` takes medians, exact, one aggregation a round either way.
    """
    held = stored(rows.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in columns]), "points")
    before = None
    for _ in range(most):
        part = (lambda c, v: F.pow(F.col(c) - float(v), 2)) if metric == "euclidean" else (lambda c, v: F.abs(F.col(c) - float(v)))
        near = F.array(*[F.struct(sum((part(c, v) for c, v in zip(columns, centre)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, centre in enumerate(centres)])
        placed = held.withColumn("cluster", F.array_min(near)["i"])
        found = placed.groupBy("cluster").agg(*[(F.avg(c) if metric == "euclidean" else F.median(c)).alias(c) for c in columns], F.count("*").alias("n")).collect()
        centres = [next(([r[c] for c in columns] for r in found if r["cluster"] == i), centre) for i, centre in enumerate(centres)]
        now = sorted((r["cluster"], r["n"], *[r[c] for c in columns]) for r in found)
        if now == before:
            break
        before = now
    return placed.select(F.col("key").alias(key), "cluster"), centres


def ranked_within(df: DataFrame, by: str, order: list) -> DataFrame:
    """``rank`` of each row within its group, ties sharing one."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(*order)))
