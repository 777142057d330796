"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt by range of their ids, so that files and the stripes within them follow the
order of the ids, then encoded and written. Readers prune stripes and row groups by the minimum,
maximum and Bloom filter of ``doc_id`` and read the stripes left in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import scratch, tidy
from millrace.llm.pieces import piece_encoder, text_slices

SCHEMA = "doc_id long, ids array<int>, n_tokens long, part int, part_start long"


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int | None = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = 8 << 20,
    row_group: int = 1000,
) -> str:
    """Encode every whole text and write ``ids`` in ascending order of ``id_col`` (nulls first).

    A null text counts as empty and still gets the end id; repeated rows are written as often as
    they occur. ``part`` numbers the files in order, ``part_start`` counts the ids of earlier
    documents in the file. Other columns are not read.
    """

    def run(batches):
        encoder, part, start = piece_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in (x for whole in batches for x in text_slices(whole, 1)):
            values, counts = encoder.ids(batch.column(1), end_id)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)),
                    pa.array(counts),
                    pa.array(np.full(len(counts), part, np.int32)),
                    pa.array(start + offsets[:-1]),
                ],
                ["doc_id", "ids", "n_tokens", "part", "part_start"],
            )
            start += int(offsets[-1])

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    )
    (
        ordered.mapInArrow(tidy(run), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_group))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "lz4")
        .orc(path)
    )
    return path


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens, start``; a list of ids is pushed down to the stripes' statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    chosen = rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))
    return chosen.join(_part_bases(rows), "part").select("doc_id", "ids", "n_tokens", (F.col("base") + F.col("part_start")).alias("start"))


def _part_bases(rows: DataFrame) -> DataFrame:
    """Ids before each file: one row a file, from two narrow columns."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""

    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<i4").tobytes()
            ends = np.cumsum(np.diff(ids.offsets.to_numpy())) * 4
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(crc, pa.int64())],
                ["doc_id", "n_tokens", "part", "part_start", "ids_crc32"],
            )

    rows = spark.read.schema(SCHEMA).orc(path)
    crcs = rows.select("doc_id", "ids", "n_tokens", "part", "part_start").mapInArrow(
        run, "doc_id long, n_tokens long, part int, part_start long, ids_crc32 long"
    )
    return crcs.join(_part_bases(rows), "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digests(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` to a new folder of token files in the shared place, and digest what the files hold."""
    return digest_token_files(spark, write_token_files(docs, scratch(spark, "tokens"), vocabulary))
