"""Exact Jaccard self-join on word shingles by universe partitioning.

1. Every text becomes a set of shingle hashes. Shingles are counted globally in compact blocks; a
   text of which less than the threshold's share of shingles occurs elsewhere can have no link.
   Equal sets become one class.
2. Sizes fall into bands, and a band's universe is hashed into segments. Two linked sets differ in
   at most ``d`` shingles, so that by the pigeonhole principle they agree in some segment: with
   more segments than ``d``, in an exact one; with about half as many, in one up to a single
   deletion. Which of the two a band uses is decided by their costs, from the number of classes
   in the band and from how often shingles of its texts without copies occur elsewhere.
3. Sets that share a segment with a smaller class are verified exactly against that class alone.
   Only where different components still meet in a segment are all such pairs verified; there each
   set leaves out as many of its commonest segments, by the measured lengths of their lists, as the
   principle leaves over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import block_sizes, connected_components, discard, flag_wanted, free_name, join_heavy, materialize, only_wanted, release, tidy
from millrace.llm.shingles import mix, set_hash, shingle_sets

#: Groups up to this size are paired by a join, larger ones block by block; both find the same pairs.
GROUP_PAIRS = 24
_NOBODY = 65_535
_FP_BITS = 28


# Shingle counts ------------------------------------------------------------------------------


def _pack(fps: np.ndarray, owners: np.ndarray) -> bytes:
    """Sorted fingerprints as differences of 2 bytes where they fit, else as 4, with their owners."""
    steps = np.diff(fps, prepend=np.uint32(0))
    kind = b"\x02" if len(steps) and steps.max() < 65_536 else b"\x04"
    return kind + (steps.astype("<u2") if kind == b"\x02" else fps.astype("<u4")).tobytes() + owners.astype("<u2").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = blob[0]
    n = (len(blob) - 1) // (wide + 2)
    if wide == 2:
        fps = np.cumsum(np.frombuffer(blob, "<u2", n, 1), dtype=np.uint32)
    else:
        fps = np.frombuffer(blob, "<u4", n, 1)
    return fps, np.frombuffer(blob, "<u2", n, 1 + wide * n)


_DOC = np.dtype([("id", "<i8"), ("null", "?"), ("t", "<i8"), ("n", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("known", "<i8")])


def _chunk_rows(chunk: int, ids: list, texts: list, sets: list[np.ndarray], buckets: int):
    """Rows ``(bucket, chunk, payload)``: fingerprints by range of the hash, and one row of documents.

    A shingle of several documents of the chunk is counted for them here and sent without owner,
    once, so that a frequent shingle costs its bucket one entry a chunk.
    """
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = flat[1:] == flat[:-1]
    first, shared = np.concatenate([[True], ~same])[: len(flat)], np.zeros(len(flat), bool)
    shared[1:] |= same
    shared[:-1] |= same
    known = np.bincount(owner[shared], minlength=len(sets))
    flat, owner = flat[first], np.where(shared, np.uint16(_NOBODY), owner)[first]
    bucket = (flat >> np.uint64(32)) // np.uint64(-(-(1 << 32) // buckets))
    fps = (mix(flat) >> np.uint64(64 - _FP_BITS)).astype(np.uint32)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist() if len(flat) else []
    for a, b in zip(edges[:-1], edges[1:]):
        o = np.argsort(fps[a:b], kind="stable")
        yield int(bucket[a]), chunk, _pack(fps[a:b][o], owner[a:b][o])
    hashes = [set_hash(s) for s in sets]
    docs = np.zeros(len(sets), _DOC)
    docs["id"], docs["null"], docs["t"] = [i or 0 for i in ids], [i is None for i in ids], texts
    docs["n"], docs["known"] = [len(s) for s in sets], known
    docs["h1"], docs["h2"] = [h[0] for h in hashes], [h[1] for h in hashes]
    yield -1 - chunk, chunk, docs.tobytes()


_ROWS = "bucket long, chunk long, docs binary, seen binary"


def _count_bucket(key, t):
    """Of each chunk, the documents that own shingles which other chunks have too, and how many."""
    if key[0].as_py() < 0:
        return pa.table({"bucket": t.column("bucket"), "chunk": t.column("chunk"), "docs": t.column("payload"), "seen": pa.nulls(len(t), pa.binary())})
    chunks, blobs = t.column("chunk").to_pylist(), [_unpack(b) for b in t.column("payload").to_pylist()]
    place = np.repeat(np.arange(len(blobs), dtype=np.uint32), [len(f) for f, _ in blobs])
    fps, owners = np.concatenate([f for f, _ in blobs]), np.concatenate([o for _, o in blobs])
    order = np.argsort(fps, kind="stable")
    same = fps[order[1:]] == fps[order[:-1]]
    seen = np.zeros(len(fps), bool)
    seen[order[1:][same]] = True
    seen[order[:-1][same]] = True
    seen &= owners != _NOBODY
    found, counts = np.unique(place[seen].astype(np.uint64) << np.uint64(16) | owners[seen], return_counts=True)
    where = (found >> np.uint64(16)).astype(np.int64)
    cuts = np.searchsorted(where, np.arange(len(blobs) + 1))
    out = []
    for k, chunk in enumerate(chunks):
        a, b = cuts[k], cuts[k + 1]
        if b > a:
            out.append((0, chunk, None, np.concatenate([(found[a:b] & np.uint64(65_535)).astype("<u4"), counts[a:b].astype("<u4")]).tobytes()))
    columns = list(zip(*out)) if out else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "chunk", "docs", "seen"])


def _count_chunk(key, t):
    docs = np.concatenate([np.frombuffer(b, _DOC) for b in t.column("docs").to_pylist() if b is not None])
    total = docs["known"].copy()
    for b in t.column("seen").to_pylist():
        if b is not None:
            pair = np.frombuffer(b, "<u4").reshape(2, -1)
            np.add.at(total, pair[0], pair[1])
    return pa.table({
        "doc_id": pa.array(docs["id"], mask=docs["null"]), "t": pa.array(docs["t"]), "n": pa.array(docs["n"]), "h1": pa.array(docs["h1"]),
        "h2": pa.array(docs["h2"]), "shared": pa.array(total),
    })


def shingle_counts(docs: DataFrame, words: int = 5, block_shingles: int = 750_000) -> DataFrame:
    """``doc_id, t, n, h1, h2, shared`` of ``docs(doc_id, t, text)``: set size and hash, and an upper bound of
    the shingles that another row has as well. Blocks grow in proportion to the input, see ``block_sizes``."""
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    size, buckets = block_sizes(chars // 6, block_shingles)

    def run(batches):
        part, k, ids, hashes, sets, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            columns = list(zip(*_chunk_rows(part * 65_536 + k, ids, hashes, sets, buckets)))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["bucket", "chunk", "payload"]
            )

        for batch in batches:
            names, marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
            for i in range(0, len(texts), 500):
                some = shingle_sets(texts[i : i + 500], words)
                ids += names[i : i + 500]
                hashes += marks[i : i + 500]
                sets += some
                held += sum(map(len, some))
                if held > size or len(sets) > 60_000:
                    yield flush()
                    k, ids, hashes, sets, held = k + 1, [], [], [], 0
        if sets:
            yield flush()

    blocks = docs.mapInArrow(tidy(run), "bucket long, chunk long, payload binary").groupBy("bucket").applyInArrow(_count_bucket, _ROWS)
    return blocks.groupBy("chunk").applyInArrow(_count_chunk, "doc_id long, t long, n long, h1 long, h2 long, shared long")


# Segments ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` shingles, the larger of a pair, with their partners from ``least`` on."""

    low: int
    high: int
    segments: int
    deletion: bool


def _differ(n: int, high: int, num: int, den: int) -> int:
    """Most shingles in which a set of ``n`` differs from a linked one of at most ``high``.

    With similarity at least num/den, |A ^ B| * (den + num) <= (den - num) * (|A| + |B|), and the
    other has at most n * den / num shingles.
    """
    return min((den - num) * (n + min(high, n * den // num)) // (den + num), (den - num) * 2 * high // (den + num))


#: Cost of comparing two bitmaps, against that of one signature.
COMPARE = 1 / 16


def band_edges(largest: int, num: int, den: int) -> list[tuple[int, int]]:
    """Bands of ratio den/num up to the largest size."""
    edges, low = [], 1
    while low <= largest:
        edges.append((low, max(low, (low * den - 1) // num)))
        low = edges[-1][1] + 1
    return edges


def measure_bands(rows: DataFrame, edges: list[tuple[int, int]], num: int, den: int) -> list[tuple[int, float]]:
    """Of each band the number of texts that may have a link, and the share of shingles that occur elsewhere in
    the texts that cannot have one: how common a shingle is that no copy brought. One row a band."""
    if not edges:
        return []
    band = F.size(F.filter(F.array(*[F.lit(low) for low, _ in edges]), lambda low: F.col("n") >= low)) - 1
    linked = F.col("shared") * den >= F.col("n") * num
    found = rows.where("n > 0").groupBy(band.alias("band")).agg(
        F.count(F.when(linked, 1)).alias("sets"), F.sum(F.when(~linked, F.col("shared"))).alias("shared"), F.sum(F.when(~linked, F.col("n"))).alias("n")
    )
    known = {r["band"]: (r["sets"], (r["shared"] + 1) / (r["n"] + 1) if r["n"] else 1.0) for r in found.collect()}
    return [known.get(i, (0, 1.0)) for i in range(len(edges))]


def plan_bands(edges: list[tuple[int, int]], measured: list[tuple[int, float]], num: int, den: int) -> list[Band]:
    """Each band with the cheaper kind of segments.

    Exact segments number a third more than the sets' difference asks for, so that common ones can
    be left out. A set costs its signatures, and the sets that agree with one of them by chance:
    those of the band and of the one below, as far as all shingles of both segments are common.
    """
    bands = []
    for i, (low, high) in enumerate(edges):
        sets, share = measured[i][0] + (measured[i - 1][0] if i else 0), measured[i][1]
        d = _differ(high, high, num, den)
        exact, halves = d + 1 + -(-d // 3), d // 2 + 1
        met = lambda keys, shingles: keys * (1 + COMPARE * sets * share ** (2 * shingles))  # noqa: B023, E731
        near = met(halves + high, max(high / halves - 1, 0)) < met(exact, high / exact)
        bands.append(Band(low, high, halves, True) if near else Band(low, high, exact, False))
    return bands


def _segment_keys(s: np.ndarray, band: int, b: Band, num: int, den: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in a band, and how many of the commonest it may leave out."""
    where = ((s >> np.uint64(32)) * np.uint64(b.segments)) >> np.uint64(32)
    order = np.argsort(where, kind="stable")
    where, values = where[order].astype(np.int64), mix(s[order])
    total = np.zeros(b.segments, np.uint64)
    np.add.at(total, where, values)
    salt = mix(np.arange(b.segments, dtype=np.uint64) + np.uint64((band + 1) << 32))
    if b.deletion:
        return np.concatenate([mix(total ^ salt), mix((total[where] - values) ^ salt[where])]), 0
    spare = b.segments - _differ(len(s), b.high, num, den) - 1
    empty = np.ones(b.segments, bool)
    empty[where] = False
    # Empty segments count as the commonest: they go first, in order of their number.
    gone = np.flatnonzero(empty)[:spare]
    kept = np.ones(b.segments, bool)
    kept[gone] = False
    return mix(total ^ salt)[kept], spare - len(gone)


def signatures(sets: DataFrame, bands: list[Band], num: int, den: int, words: int) -> DataFrame:
    """``key, cid, band, spare`` of every class of ``sets(cid, text)``."""

    def run(batches):
        lows = np.array([b.low for b in bands])
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i in range(0, len(texts), 500):
                keys, cids, numbers, spares = [], [], [], []
                for cid, s in zip(batch.column(0)[i : i + 500].to_pylist(), shingle_sets(texts[i : i + 500], words)):
                    own = int(np.searchsorted(lows, len(s), "right")) - 1
                    for k in (own, own + 1):
                        if 0 <= k < len(bands) and len(s) * den >= bands[k].low * num:
                            got, spare = _segment_keys(s, k, bands[k], num, den)
                            keys.append(got)
                            cids.append(np.full(len(got), cid))
                            numbers.append(np.full(len(got), k, np.int32))
                            spares.append(np.full(len(got), spare, np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in keys], cids, numbers, spares)], ["key", "cid", "band", "spare"]
                    )

    return sets.select("cid", "text").mapInArrow(tidy(run), "key long, cid long, band int, spare int")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """The pairs of ``pairs(a, b, salt)`` whose sets are similar enough.

    The pairs of ``a`` are dealt by ``salt``. Each deal is a stretch of a sorted partition: the text
    of ``a`` once, and behind it those of its partners, which pass one batch at a time.
    """
    texts = sets.select("cid", "text")
    lead = pairs.select("a", "salt").distinct().join(texts.toDF("a", "text"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    other = pairs.join(texts.toDF("b", "text"), "b").select("a", "salt", "b", "text")
    dealt = lead.unionAll(other).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        lead, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data = batch.column(3).cast(pa.binary())
            found_a, found_b = [], []
            for at in range(0, len(a), 500):
                some = shingle_sets(data[at : at + 500].to_pylist(), words)
                for x, y, s in zip(a[at : at + 500], b[at : at + 500], some):
                    if y is None:
                        lead, held = x, s
                        continue
                    n = x == lead and min(len(s), len(held)) * den >= max(len(s), len(held)) * num
                    same = len(np.intersect1d(s, held, assume_unique=True)) if n else 0
                    if n and den * same >= num * (len(s) + len(held) - same):
                        found_a.append(x)
                        found_b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long")


def _class_rows(docs: DataFrame, num: int, den: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, t, n, component_id`` of every row: ``t`` is a hash of its text, and texts without a link have no component."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    rows = materialize(shingle_counts(narrow, words), "shingles")
    classes = materialize(
        rows.where(f"n > 0 and shared * {den} >= n * {num}").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("low"), F.min("t").alias("t"), F.count("*").alias("held"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )

    def once(batches):
        """A text that many rows have leaves a task once."""
        seen: set = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            fresh = []
            for k in keys:
                fresh.append(k not in seen)
                seen.add(k)
            yield batch.filter(pa.array(fresh, pa.bool_())).select(["t", "text"])

    def check(batches):
        """Texts whose hash is that of a class's text by chance are left out."""
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            got = [set_hash(s) for i in range(0, len(texts), 500) for s in shingle_sets(texts[i : i + 500].to_pylist(), words)]
            same = [h == (a, b) for h, a, b in zip(got, batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["cid", "text", "n"]).filter(pa.array(same, pa.bool_()))

    wanted = only_wanted(narrow.select("t", "text"), F.col("t"), classes, F.col("t")).withColumn("size", F.length("text"))
    fetched = wanted.mapInArrow(once, "t long, text string").join(classes.select("t", "cid", "h1", "h2", "n"), "t").dropDuplicates(["t"])
    sets = materialize(fetched.select("cid", "text", "h1", "h2", "n").mapInArrow(check, "cid long, text string, n long"), "sets")

    edges = band_edges(classes.agg(F.max("n").alias("n")).first()["n"] or 0, num, den)
    bands = plan_bands(edges, measure_bands(rows, edges, num, den), num, den)
    keys = signatures(sets, bands, num, den, words)
    leads = keys.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last"), F.count("*").alias("held")).where("last > lead").drop("last")
    shared = materialize(keys.join(leads, "key"), "segments")
    near = shared.where("cid > lead").groupBy(F.col("lead").alias("a"), F.col("cid").alias("b")).agg(F.max("held").alias("held"))
    near = near.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("held") / 256)).cast("int").alias("salt"))
    first = links = materialize(verified(near, sets, num, den, words), "edges")
    found, more = connected_components(links), None
    if shared.limit(1).count():
        more = _remaining(shared, found, sets, num, den, words)
        links = links.unionAll(more)
        found = connected_components(links)
    discard(shared, sets, first, *([more] if more is not None else []))
    known = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lows = known.groupBy("component").agg(F.min("low").alias("component_id"))
    named = known.join(lows, "component").select("h1", "h2", "n", "held", "component_id")
    return join_heavy(rows, named, ["h1", "h2", "n"], "held", rows.count()).select("doc_id", "t", "n", "component_id")


def group_documents(
    docs: DataFrame, num: int = 3, den: int = 4, words: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; two rows link from similarity num/den on.

    A null or empty text has no shingles and no links. Rows of equal sets link, whatever their ids.
    A row without an id links as any other, but gives no component its name; a component of such
    rows alone has none. Repeated rows are repeated; an empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    found = _class_rows(docs, num, den, words, id_col, text_col)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_firsts(docs: DataFrame, num: int = 3, den: int = 4, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, without those linked to a row of a smaller id.

    A row goes by its id and its text: another text under the same id stays, and so do all rows of
    the same id and text, and rows without an id. Nulls, empty texts and empty tables as in
    ``group_documents``.
    """
    found = _class_rows(docs, num, den, words, id_col, text_col)
    gone = materialize(found.where("component_id < doc_id").select(F.col("doc_id").alias("d"), "t").distinct(), "gone")
    d, t, flag = (free_name(docs.columns, n) for n in ("_d", "_t", "_flag"))
    held = docs.withColumns({d: F.col(id_col).cast("long"), t: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    held = flag_wanted(held, F.xxhash64(d, t), gone, F.xxhash64("d", "t"), flag)
    rest = held.where(F.col(flag)).join(gone.toDF(d, t), [d, t], "left_anti")
    return held.where(~F.col(flag)).select(docs.columns).unionAll(rest.select(docs.columns))


def _remaining(shared: DataFrame, found: DataFrame, sets: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """Links among all pairs of different components that still share a segment, stored."""
    labels = found.withColumnRenamed("node", "cid")
    rows = shared.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("hi > lo").select("key")
    rows = materialize(rows.join(mixed, "key", "left_semi"), "mixed")
    # Of a set's segments, as many of the commonest go as the band leaves over for it.
    listed = rows.groupBy("cid", "band", "spare", "component").agg(F.array_sort(F.collect_set(F.struct((-F.col("held")).alias("held"), "key"))).alias("keys"))
    kept = listed.select("cid", "component", F.explode(F.slice("keys", F.col("spare") + 1, F.greatest(F.size("keys") - F.col("spare"), F.lit(0)))).alias("k"))
    kept = materialize(kept.select("cid", "component", F.col("k.key").alias("key")), "kept")
    held = kept.groupBy("key").agg(F.count("*").alias("held"))
    sized = kept.join(held, "key")
    few = sized.where(F.col("held") <= GROUP_PAIRS)
    a, b = (few.select("key", F.col("cid").alias(n), F.col("component").alias(f"c{n}")) for n in "ab")
    pairs = a.join(b, "key").where("a < b and ca <> cb").select("a", "b")
    pairs = pairs.unionAll(_block_pairs(sized.where(F.col("held") > GROUP_PAIRS), sets, num, den, words)).distinct()
    pairs = materialize(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(8)).cast("int")), "pairs")  # read twice
    links = materialize(verified(pairs, sets, num, den, words), "edges")
    discard(rows, kept, pairs)
    return links


def _block_pairs(rows: DataFrame, sets: DataFrame, num: int, den: int, words: int, bits: int = 4096, block: int = 2048) -> DataFrame:
    """Pairs ``(a, b)`` of large groups that may be similar enough.

    Each set is a bitmap of its hashed shingles. Two bitmaps differ in no more bits than the sets
    do in shingles, so that no linked pair is lost; groups are compared block by block. A pair is
    given in the smallest of the groups it shares alone.
    """

    def draw(batches):
        for batch in batches:
            found = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), words)
            maps = np.zeros((len(found), bits), bool)
            for row, s in zip(maps, found):
                row[(mix(s) >> np.uint64(40)) % np.uint64(bits)] = True
            packed = [m.tobytes() for m in np.packbits(maps, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(packed, pa.binary())], ["cid", "n", "bits"])

    wanted = sets.join(rows.select("cid").distinct(), "cid", "left_semi").select("cid", "text")
    drawn = wanted.mapInArrow(tidy(draw), "cid long, n long, bits binary")
    blocks = F.ceil(F.col("held") / block).cast("int")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("cid"), blocks).cast("int")).join(drawn, "cid")
    rows = rows.join(rows.groupBy("cid").agg(F.collect_set("key").alias("mine")), "cid")
    tasks = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    dealt = rows.withColumn("t", F.explode(tasks)).select("key", "t.lo", "t.hi", "i", "cid", "component", "n", "bits", "mine")

    def compare(key, t):
        cid, component, n, side = (t.column(c).to_numpy() for c in ("cid", "component", "n", "i"))
        maps = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(cid), -1)
        mine = [frozenset(m) for m in t.column("mine").to_pylist()]
        name, lo, hi = (k.as_py() for k in key)
        first, second = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        a, b = [], []
        for at in range(0, len(first), 64):
            x = first[at : at + 64]
            differ = np.zeros((len(x), len(second)), np.int64)
            for w in range(maps.shape[1]):
                differ += np.bitwise_count(maps[x, w][:, None] ^ maps[second, w][None])
            small, large = np.minimum(n[x][:, None], n[second][None]), np.maximum(n[x][:, None], n[second][None])
            near = ((den + num) * differ <= (den - num) * (small + large)) & (small * den >= large * num)
            near &= component[x][:, None] != component[second][None]
            near &= (cid[x][:, None] < cid[second][None]) if lo == hi else True
            i, j = np.nonzero(near)
            i, j = x[i], second[j]
            here = np.array([min(mine[p] & mine[q]) == name for p, q in zip(i.tolist(), j.tolist())], bool)
            a.append(np.minimum(cid[i], cid[j])[here])
            b.append(np.maximum(cid[i], cid[j])[here])
        release()
        return pa.table({"a": pa.array(np.concatenate([*a, np.zeros(0, np.int64)])), "b": pa.array(np.concatenate([*b, np.zeros(0, np.int64)]))})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")
