"""Flows over streams: narrow operators apply as they are; these add state or a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.numbering import scratch


def files(spark: SparkSession, folder: str, like: str, schema, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", like).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of two streams of equal columns."""
    return a.unionByName(b)


def running_profile(stream: DataFrame, by: str, value: str) -> DataFrame:
    """Counts and moments by a column over all rows so far; state has one row a value of ``by``."""
    return stream.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def windowed(stream: DataFrame, time: str, by: str, value: str, length: str, late: str) -> DataFrame:
    """Counts and sums by window; windows older than the watermark leave the state."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def prequential(stream: DataFrame, actual: str, predicted: str, value: str | None = None, estimate: str | None = None) -> DataFrame:
    """Running accuracy of predictions, and with two numbers the root of their mean squared error."""
    right = F.when(F.col(actual) == F.col(predicted), 1.0).otherwise(0.0)
    off = [F.sqrt(F.avg(F.pow(F.col(value) - F.col(estimate), 2))).alias("error")] if value else []
    return stream.where(F.col(actual).isNotNull()).groupBy().agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), *off)


def append_predictions(rows: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A model applied to a stream or a table: a narrow step for models that are expressions."""
    return model(rows)


def counted(stream: DataFrame) -> DataFrame:
    return stream.groupBy().agg(F.count("*").alias("n"))


def series(stream: DataFrame, time: str, value: str, length: str, late: str) -> DataFrame:
    """``start, mean`` of each window, for a running chart."""
    held = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return held.groupBy(F.window(time, length).alias("w")).agg(F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), "mean")


def save(stream: DataFrame, path: str) -> None:
    """Appends all that is there to Parquet files, each row once even when a batch is run again."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def shown(df: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The first rows, for a viewer."""
    return df.orderBy(*order).limit(n)


def run(nodes: dict[str, tuple[list[str], Callable]], wanted: str):
    """Runs a graph of named nodes ``(inputs, function)`` up to ``wanted``: each once, those that do not wait for one
    another at the same time. A circle is an error."""
    from concurrent.futures import ThreadPoolExecutor

    done: dict[str, object] = {}
    needed, open_ = set(), [wanted]
    while open_:
        name = open_.pop()
        if name not in needed:
            needed.add(name)
            open_ += nodes[name][0]
    while wanted not in done:
        ready = [n for n in needed if n not in done and all(i in done for i in nodes[n][0])]
        if not ready:
            raise ValueError("the nodes wait for one another")
        with ThreadPoolExecutor(max_workers=min(4, len(ready))) as pool:
            found = list(pool.map(lambda n: nodes[n][1](*[done[i] for i in nodes[n][0]]), ready))
        done.update(zip(ready, found))
    return done[wanted]


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs all that is there and gives the written rows; in mode ``complete`` those of the last batch.

    A batch is written to a folder of its number, over an attempt that was lost.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", path).parquet(path)
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def in_batches(stream: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return stream.transform(apply)
