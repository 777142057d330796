"""Best-fit packing of token sequences with certified bin counts.

Texts become pieces of at most ``capacity`` tokens. Pieces are dealt to partitions of bounded
size and packed there by best-fit decreasing. Lower bounds from dual feasible functions certify a
partition whose bin count they reach. Partitions with a gap, and the emptiest bin of each, give
whole bins to an exchange: their documents meet others' in new partitions and best-fit decreasing
runs again; its packing is taken where it needs fewer bins.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import library_encoder
from millrace.llm.common import materialize, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "uid long, length long, grp long, seq long, offset long, open boolean"


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a piece. A null text counts as empty and gives one piece that holds the end id."""

    def run(batches):
        encoder, tail = library_encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        encoder.cache.bound = 400_000
        for batch in batches:
            rows = []
            for doc, packed in zip(batch.column(0).to_pylist(), encoder.packed(batch.column(1).to_pylist())):
                packed += tail
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )
        encoder.cache.old = {}  # an idle worker keeps the younger chunks alone

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).mapInArrow(tidy(run), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions. ``counts`` says how often
    each length occurs, once without.

    The first counts items above ``capacity - t`` whole and drops those below ``t``; the second
    rounds ``(k + 1) * length / capacity`` down unless it is whole.
    """
    if not len(lengths):
        return 0
    x, at = np.unique(lengths, return_inverse=True)
    n = np.bincount(at, counts).astype(np.int64)
    mass, count = np.concatenate([[0], np.cumsum(x * n)]), np.concatenate([[0], np.cumsum(n)])
    t = np.concatenate([[0], x[x <= capacity // 2]])
    low, high = np.searchsorted(x, t, "left"), np.searchsorted(x, capacity - t, "right")
    best = int((count[-1] - count[high] + -(-(mass[high] - mass[low]) // capacity)).max())
    for k in range(1, 21):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        total = int((np.where(whole, x * k, (scaled // capacity) * capacity) * n).sum())
        best = max(best, -(-total // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the free room of every bin."""
    bins, offsets, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has r tokens free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = at, capacity - room
        free[at] = room - n
        if room > n:
            by_room.setdefault(room - n, []).append(at)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(free, np.int64)


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """Best-fit decreasing in each group of ``uid, length, grp, bin, at``. A bin is named by its smallest ``uid``;
    ``open`` marks bins to exchange: all with room where the bound is not reached, else the emptiest."""

    def run(part):
        part = part.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = part["length"].to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        if part["bin"].notna().all() and len(free) >= part["bin"].nunique():  # nothing gained: the bins stay as they came
            bins, offsets = part["bin"].factorize()[0], part["at"].to_numpy()
            free = capacity - np.bincount(bins, lengths).astype(np.int64)
        opened = np.zeros(len(free), bool)
        if len(free):
            opened[int(free.argmax())] = free.max() > 0
            if len(free) > lower_bound(lengths, capacity):
                opened |= free > 0
        firsts = part.groupby(bins)["uid"].min().to_numpy()
        return part.assign(seq=firsts[bins], offset=offsets, open=opened[bins])[["uid", "length", "grp", "seq", "offset", "open"]]

    return items.groupBy("grp").applyInPandas(run, PLACED)


def pack(pieces: DataFrame, capacity: int = 4096, group_items: int = 20_000) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``.

    Open bins are exchanged until two rounds in a row have gained none, and ``certificate`` says how
    far the result may be from the best. Ties go to the smaller row number of the written pieces,
    so that repeated rows are packed one by one. An empty table gives no rows; columns of ``pieces`` besides its own five are not read.
    """
    pieces = materialize(pieces.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("uid", F.monotonically_increasing_id()), "pieces")
    loose = pieces.where(F.col("length") < capacity).select("uid", "length")
    groups = max(1, -(-loose.count() // group_items))
    start = loose.select(
        "*", F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("grp"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("at")
    )
    placed, done, number, fruitless = materialize(_packed(start, capacity), "packed"), [], 0, 0
    while fruitless < 2:
        waiting = placed.where("open")
        n, before = waiting.agg(F.count("*"), F.countDistinct("seq")).first()
        if not n:
            break
        done.append(placed.where("not open"))
        number += 1
        groups = max(1, -(-n // group_items))
        again = waiting.select(
            "uid", "length", F.pmod(F.xxhash64("seq", F.lit(number)), F.lit(groups)).alias("grp"), F.col("seq").alias("bin"), F.col("offset").alias("at")
        )
        placed = materialize(_packed(again, capacity), "packed")
        after = placed.agg(F.countDistinct("seq")).first()[0]
        fruitless = 0 if after < before else fruitless + 1
        if groups == 1 and number > 1:  # one group has seen all that is open
            break
    done.append(placed)
    places = reduce(DataFrame.unionAll, done).select("uid", "seq", "offset")
    whole = pieces.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("seq"), F.lit(0).cast("long").alias("offset"))
    return (
        pieces.join(places.unionAll(whole), "uid")
        .withColumnRenamed("seq", "sequence_id")
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )


def certificate(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: ``sequences``, the ``bound`` that no packing of the same pieces is below, and the ``gap``.

    The bound is of all pieces together, from one row a length, of which there are at most ``capacity``.
    """
    held = packed.groupBy("length").agg(F.count("*").alias("n")).collect()
    bound = lower_bound(np.array([r["length"] for r in held], np.int64), capacity, np.array([r["n"] for r in held], np.int64))
    used = packed.agg(F.countDistinct("sequence_id").alias("sequences"))
    return used.select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))
