"""Shared storage, materialisation and small helpers of the text operators."""

from __future__ import annotations

import ctypes
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.storage import discard, scratch, shared_dir, stored  # noqa: F401  given on

materialize = stored
#: Slots of the filter that ``only_wanted`` broadcasts: 8 MB, whatever the tables' sizes.
_SLOTS = 1 << 26


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows where the session has Spark's own, five times larger, number:
    whole texts are wide, and a batch is held in several forms at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tidy(run):
    """``run`` over batches, after which the worker, which serves later tasks too, gives unused memory back."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def release() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores until no column is called so in any case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def flag_wanted(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, name: str) -> DataFrame:
    """``df`` with a column ``name``: whether ``key``, a 64-bit hash, may be one of ``wanted``. It is true for all
    that are, and for a few others; a null key is not wanted.

    A filter of a fixed number of bits is broadcast, so that a join that follows shuffles little where
    little is wanted, and all where much is; no row is missed at any size.
    """
    slot = F.pmod(wanted_key, F.lit(_SLOTS))
    bits = wanted.select(slot.alias("s")).where("s is not null").select((F.col("s") / 32_768).cast("int").alias("b"), (F.col("s") % 32_768).alias("p"))
    bits = bits.groupBy("b").agg(F.expr("bitmap_construct_agg(p)").alias("bits"))
    block, place, shown = (free_name([*df.columns, name], n) for n in ("_block", "_place", "_bits"))
    held = df.withColumn(place, F.pmod(key, F.lit(_SLOTS)))
    held = held.withColumn(block, (F.col(place) / 32_768).cast("int"))
    held = held.join(F.broadcast(bits.toDF(block, shown)), block, "left")  # at most 2,048 rows of 4 KB
    byte = F.conv(F.hex(F.substring(shown, (F.col(place) % 32_768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.col(place) % 8).cast("int")) != 0
    return held.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(name))


def only_wanted(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows of ``df`` that ``flag_wanted`` flags."""
    name = free_name(df.columns, "_wanted")
    return flag_wanted(df, key, wanted, wanted_key, name).where(F.col(name)).drop(name)


def block_sizes(total: int, least: int = 600_000, entries: int = 256) -> tuple[int, int]:
    """Entries of a chunk, and the number of buckets of which each chunk fills one block.

    A chunk and a bucket hold at least ``least`` entries, and beyond that the root of the total, so
    that a block has some hundred entries at any size: blocks grow in proportion to the input, and
    the memory of a task with its root.
    """
    size = max(least, math.isqrt(entries * max(total, 1)))
    return size, max(8, -(-total // max(least // 3, math.isqrt(entries * max(total, 1)))))


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], held: str, rows: int, least: int = 10_000) -> DataFrame:
    """Left join of ``left``, of so many ``rows``, with ``right``, whose keys are unique and whose column ``held``
    says how many rows of ``left`` have each.

    Keys of more than a thousandth of the rows (and of ``least`` rows), at most a thousand, are broadcast, so that a hot key
    stays spread over the tasks that read it; the others are shuffled.
    """
    limit = max(rows // 1000, least)
    heavy = F.broadcast(right.where(F.col(held) > limit).drop(held))
    light = right.where(F.col(held) <= limit).drop(held)
    rest = left.join(heavy.select(keys), keys, "left_anti").join(light, keys, "left")
    return left.join(heavy, keys).unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of ``edges(a long, b long)``; nodes without edges are not returned.

    Alternating large-star and small-star rounds, each written to the shared folder. Every round is
    grouped aggregation with partial sums and equi-joins, so that no component meets in one task.
    """
    e = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "cc"
    )
    for _ in range(max_rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        )
        low2 = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low2, "hi")
        after = materialize(
            small.select(F.col("m").alias("lo"), "hi")
            .unionAll(small.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
            .distinct(),
            "cc",
        )
        # A star forest: no hub is the leaf of another hub, and each leaf has one hub.
        leaves = after.groupBy("hi").agg(F.count("*").alias("n"))
        settled = (
            after.join(after.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").limit(1).count() == 0
            and leaves.where("n > 1").limit(1).count() == 0
        )
        discard(e)
        e = after
        if settled:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
