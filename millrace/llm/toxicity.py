"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training reads a bounded, documented number of labelled rows. Workers count in how many toxic and
other rows each hashed n-gram occurs; the driver gets two counts a hash slot, takes the slots that
separate the classes best, and fits a logistic regression on their presence, scaled by the ratio.
Scoring is one narrow pass over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import tidy

ORDERS = (3, 4, 5, 6)


def hashed_ngrams(text: str, bits: int, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hash slots of all n-grams of a lower-cased text between two spaces, with repeats."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, min(max(orders), len(codes)) + 1):
        h = h[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
        if n in orders:
            x = h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found.append(x >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class ToxicityModel:
    """``place`` gives a chosen slot's position in ``weights`` and -1 elsewhere."""

    bits: int
    place: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        at = self.place[hashed_ngrams(text, self.bits)]
        at = np.unique(at[at >= 0])
        s = self.weights[at].sum() / max(len(at), 1) ** 0.5 + self.intercept
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def _fit(features: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of present features, each divided by the root of their number."""
    sizes = np.array([len(f) for f in features])
    columns = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    rows = np.repeat(np.arange(len(y)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    x = np.append(np.zeros(len(ratio)), np.log(rate / (1 - rate)))
    first, second = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, steps + 1):
        s = np.bincount(rows, (x[:-1] * ratio)[columns], len(y)) * scale + x[-1]
        error = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(y)
        slope = np.append(np.bincount(columns, (error * scale)[rows], len(ratio)) * ratio + penalty * x[:-1] / len(y), error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        x = x - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return x[:-1], float(x[-1])


def log_count_ratios(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How much likelier each slot is in a row of class 1 than in one of class 0, as a logarithm, with one row
    with the slot and one without added to each class. ``counts`` has a line a class, ``rows`` its rows."""
    return np.log((counts[1] + 1) / (rows[1] + 2)) - np.log((counts[0] + 1) / (rows[0] + 2))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    features: int = 4096,
    bits: int = 19,
    penalty: float = 0.1,
    steps: int = 150,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows, the first by a hash of their ids.

    Rows with a null id or label are left out, a null text counts as empty. Without rows of both
    classes the model scores every text by the rate of the labels (0 without any).
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select("y", "text")  # at most max_rows pairs of numbers
    slots, slices = 1 << bits, 64
    wide = slots // slices

    def count(batches):
        total, seen = np.zeros((2, slots), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[int(y > 0), np.unique(hashed_ngrams(text, bits))] += 1
                seen[int(y > 0)] += 1
        if seen.any():
            parts = [total[:, k * wide : (k + 1) * wide].tobytes() for k in range(slices)]
            n = [np.where(k == 0, seen, 0) for k in range(slices)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(slices), pa.int32()), pa.array([int(a[0]) for a in n]), pa.array([int(a[1]) for a in n]), pa.array(parts, pa.binary())],
                ["part", "n0", "n1", "counts"],
            )

    def add(key, t):
        total = np.zeros((2, wide), np.int64)
        for b in t.column("counts"):
            total += np.frombuffer(b.as_buffer(), np.int32).reshape(2, wide)
        sums = [sum(t.column(c).to_pylist()) for c in ("n0", "n1")]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n0": [sums[0]], "n1": [sums[1]], "counts": pa.array([total.astype(np.int32).tobytes()], pa.binary())})

    schema = "part int, n0 long, n1 long, counts binary"
    got = rows.mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect()  # 64 rows of fixed size
    n, counts = np.zeros(2), np.zeros((2, slots))
    for r in got:
        n += (r.n0, r.n1)
        counts[:, r.part * wide : (r.part + 1) * wide] = np.frombuffer(r.counts, np.int32).reshape(2, wide)
    if not n.all():
        rate = n[1] / max(n.sum(), 1)
        return ToxicityModel(bits, np.full(slots, -1, np.int32), np.zeros(1), float(np.log((rate + 1e-9) / (1 - rate + 1e-9))))
    ratio = log_count_ratios(counts, n)
    p = counts.sum(0) / n.sum()
    apart = np.abs(counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))
    apart[counts.sum(0) < min(5, n.sum())] = 0
    top = np.sort(np.argsort(-apart, kind="stable")[:features])
    place = np.full(slots, -1, np.int32)
    place[top] = np.arange(len(top))

    def present(batches):
        for batch in batches:
            packed = []
            for text in batch.column(1).to_pylist():
                at = place[hashed_ngrams(text, bits)]
                packed.append(np.unique(at[at >= 0]).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["y", "present"])

    sample = rows.mapInArrow(present, "y int, present binary").collect()  # at most max_rows rows of at most 2 * features bytes
    sample = sorted((r.present, int(r.y > 0)) for r in sample)
    weights, intercept = _fit([np.frombuffer(b, "<u2") for b, _ in sample], np.array([y for _, y in sample], float), ratio[top], penalty, steps)
    return ToxicityModel(bits, place, weights * ratio[top], intercept)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; a null text counts as empty and repeated rows are repeated. Other columns
    of ``docs`` are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes a hash slot: fixed by ``bits``

    def run(batches):
        m = shared.value
        for batch in batches:
            scores = [m.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns, whatever their names.
    A null text counts as empty; repeated rows are each kept or dropped; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            yield batch.filter(pa.array([m.score(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null id is not held out."""
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )
