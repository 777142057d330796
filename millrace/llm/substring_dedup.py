"""Substring dedup over sliding spans of sentences, and over passages of words at any place.

From each sentence of a text the shortest run of several sentences with enough words is hashed. All
runs are joined globally by their hashes, and the sentences that a non-first run covers go. First is
the smallest document id, and within a document the earliest place.

Passages of many words are found wherever they begin. Of each stretch of words the least of the
windows' hashes is a mark (winnowing), so that equal passages have a mark in common at any offset;
marks only choose where to look. The passages around marks that two texts share are joined by their
own hashes, and every word of a non-first one goes.

Both joins run on blocks: a chunk of documents sorts its hashes and sends each bucket of the hash
range one block, with every hash once; the bucket answers each chunk which of them others have too.
So a passage that a third of all documents share costs its bucket one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import block_sizes, discard, flag_wanted, free_name, materialize, only_wanted, release, tidy
from millrace.llm.shingles import Words, bounded

ADDED = ("n_removed", "first_doc_ids")
_STOP, _CLOSER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSER[list(b"\"')]")] = True
#: Keeps the hashes of runs and of windows apart.
_RUN = np.uint64(0xA0761D6478BD642F)
_NEW, _IS_RUN = np.uint32(1 << 31), np.uint32(1 << 30)


# Spans of a text -----------------------------------------------------------------------------


def sentence_starts(w: Words) -> np.ndarray:
    """Words that begin a sentence: the first of a text, and those behind a stop or a line feed."""
    if not len(w.first):
        return np.zeros(0, np.int64)
    tail, before = w.data[w.last - 1], w.data[np.maximum(w.last - 2, w.first)]
    ends = _STOP[tail] | (_CLOSER[tail] & _STOP[before])
    lines = np.concatenate([[0], np.cumsum(w.data == 10)])
    begins = np.ones(len(w.first), bool)
    begins[1:] = ends[:-1] | (lines[w.first[1:]] > lines[w.last[:-1]])
    begins[w.at[:-1][w.at[:-1] < len(begins)]] = True
    return np.flatnonzero(begins)


def _owners(w: Words) -> np.ndarray:
    return np.repeat(np.arange(len(w.at) - 1), np.diff(w.at))


def runs(w: Words, least_units: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the shortest long enough run from each sentence that has one in its text."""
    starts = sentence_starts(w)
    ends = np.append(starts[1:], len(w.first))
    last = np.maximum(np.searchsorted(ends, starts + least_words), np.arange(len(starts)) + least_units - 1)
    inside = np.flatnonzero(last < len(starts))
    stops = ends[last[inside]]
    own = w.at[np.searchsorted(w.at, starts[inside], "right")] if len(inside) else stops
    fine = stops <= own
    return starts[inside][fine], stops[fine]


def _over(x: np.ndarray, width: int, both) -> np.ndarray:
    """``both`` over each ``width`` neighbours, for the least or the greatest of them."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = both(x[:-step], x[step:])
        have += step
    return x


def marks(w: Words, least_passage: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of windows such that every passage of ``least_passage`` words within a text holds one,
    the same in every text. A window is a mark if its hash is the least of all in such a passage."""
    n, reach = len(w.first), least_passage - window + 1
    if n < least_passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - window + 1)
    found = w.ranges(at, at + window)
    least = _over(found, reach, np.minimum)
    ends = np.repeat(w.at[1:], np.diff(w.at))[: len(least)]
    least[np.arange(len(least)) + least_passage > ends] = 0
    edge = np.zeros(reach - 1, np.uint64)
    places = np.flatnonzero(found == _over(np.concatenate([edge, least, edge]), reach, np.maximum))
    return places, found[places]


def _candidates(texts: list[bytes], rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners and places (with a bit for runs) of all runs and marks of some texts."""
    w = Words(texts)
    owner = _owners(w)
    a, b = runs(w, rule.least_units, rule.least_words)
    at, found = marks(w, rule.least_passage, rule.window)
    first = np.concatenate([a, at])
    own = owner[first] if len(first) else first
    place = (first - w.at[own]).astype(np.uint32)
    place[: len(a)] |= _IS_RUN
    return np.concatenate([w.ranges(a, b) ^ _RUN, found]), own.astype(np.uint32), place


class Rule:
    """What counts as a repeated span."""

    def __init__(self, least_units: int, least_words: int, least_passage: int):
        self.least_units, self.least_words, self.least_passage = least_units, least_words, least_passage
        self.window = max(1, least_passage // 4)

    def spans(self, texts: list[bytes], run_lists: list[list[int]], mark_lists: list[list[int]]):
        """Keys, owners, first words and lengths of the chosen runs, and of all passages that hold a chosen mark."""
        w = Words(texts)
        a, b = runs(w, self.least_units, self.least_words)
        wanted = np.concatenate([np.array(x, np.int64) + w.at[i] for i, x in enumerate(run_lists)])
        chosen = np.isin(a, wanted)
        a, b = a[chosen], b[chosen]
        near = np.zeros(len(w.first) + 2, np.int64)
        for i, x in enumerate(mark_lists):
            if len(x) and w.at[i + 1] - w.at[i] >= self.least_passage:
                p = np.array(x, np.int64) + w.at[i]
                np.add.at(near, np.maximum(p + self.window - self.least_passage, w.at[i]), 1)
                np.add.at(near, np.minimum(p, w.at[i + 1] - self.least_passage) + 1, -1)
        at = np.flatnonzero(np.cumsum(near) > 0)
        first, end = np.concatenate([a, at]), np.concatenate([b, at + self.least_passage])
        keys = w.ranges(first, end)
        keys[: len(a)] ^= _RUN
        own = _owners(w)[first] if len(first) else first
        return keys, own.astype(np.uint32), (first - w.at[own]).astype(np.uint32), (end - first).astype(np.uint32)


# Blocks --------------------------------------------------------------------------------------

_BLOCKS = "bucket long, chunk long, payload binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["bucket", "chunk", "payload"])


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], "<i8")
    return sizes.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, "<i8", len(kinds))
    at = 8 * len(kinds) + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(blob[a:b], k) for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), kinds)]


def _blocks(chunk: int, ids: np.ndarray, keys, owner, columns: list[np.ndarray], buckets: int, with_first: bool) -> list[tuple[int, int, bytes]]:
    """The blocks of a chunk, one a bucket that occurs, and its own row of documents and entries in key order."""
    order = np.argsort(keys, kind="stable")  # equal keys stay in order of the documents
    keys, owner, columns = keys[order], owner[order], [c[order] for c in columns]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    unique = keys[new]
    bucket = (unique >> np.uint64(32)) // np.uint64(-(-(1 << 32) // buckets))
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(unique) else np.zeros(1, np.int64)
    sent = (unique, _least_by_key(ids[0][owner], new)) if with_first else ((unique & np.uint64(0xFFFFFFFF)).astype("<u4"),)
    rows = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        rows.append((int(bucket[a]), chunk, _pack(np.array([a], "<i8"), *[s[a:b] for s in sent])))
    columns[0] = columns[0] | np.where(new, _NEW, np.uint32(0))
    narrow = owner.astype("<u2") if len(ids[0]) <= 65_536 else owner.astype("<u4")
    rows.append((-1 - chunk, chunk, _pack(*ids, narrow, *columns)))
    return rows


def _least_by_key(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, np.flatnonzero(new)) if len(values) else values


def _answer(t: pa.Table, answers: list[tuple[int, bytes]] | None) -> pa.Table:
    """Rows ``chunk, own, seen``: a chunk's own row passes through, else what a bucket answers."""
    if answers is None:
        return pa.table({"chunk": t.column("chunk"), "own": t.column("payload"), "seen": pa.nulls(len(t), pa.binary())})
    columns = list(zip(*answers)) if answers else [[], []]
    return pa.table({"chunk": pa.array(columns[0], pa.int64()), "own": pa.nulls(len(columns[0]), pa.binary()), "seen": pa.array(columns[1], pa.binary())})


_ANSWERS = "chunk long, own binary, seen binary"


def _seen(key, t):
    """Of each block the places of the hashes that another block of the bucket has too."""
    if key[0].as_py() < 0:
        return _answer(t, None)
    blocks = [_unpack(b, "<i8", "<u4") for b in t.column("payload").to_pylist()]
    found = np.concatenate([b[1] for b in blocks])
    order = np.argsort(found, kind="stable")
    same = found[order[1:]] == found[order[:-1]]
    seen = np.zeros(len(found), bool)
    seen[order[1:][same]] = True
    seen[order[:-1][same]] = True
    answers, at = [], 0
    for chunk, (start, part) in zip(t.column("chunk").to_pylist(), blocks):
        hit = np.flatnonzero(seen[at : at + len(part)])
        at += len(part)
        if len(hit):
            answers.append((chunk, (hit + start[0]).astype("<u4").tobytes()))
    return _answer(t, answers)


def _firsts(key, t):
    """Of each block the places of the hashes that a smaller document of another block has, and that document."""
    if key[0].as_py() < 0:
        return _answer(t, None)
    blocks = [_unpack(b, "<i8", "<u8", "<i8") for b in t.column("payload").to_pylist()]
    found, docs = np.concatenate([b[1] for b in blocks]), np.concatenate([b[2] for b in blocks])
    order = np.lexsort((docs, found))
    new = np.concatenate([[True], found[order[1:]] != found[order[:-1]]])[: len(found)]
    first = np.empty(len(found), np.int64)
    first[order] = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(found) else docs
    answers, at = [], 0
    for chunk, (start, part, own) in zip(t.column("chunk").to_pylist(), blocks):
        lead = first[at : at + len(part)]
        at += len(part)
        hit = np.flatnonzero(lead < own)
        if len(hit):
            answers.append((chunk, _pack((hit + start[0]).astype("<u4"), lead[hit])))
    return _answer(t, answers)


def _chunked(rows, take: Callable, buckets: int, size: int, with_first: bool):
    """Batches of blocks. ``take(batch)`` yields ids, hashes of texts, keys, owners and further columns of some
    documents; a chunk is full at ``size`` entries or 65,000 documents."""
    part, number, held, docs, entries = TaskContext.get().partitionId(), 0, [], 0, 0

    def flush():
        ids = [np.concatenate([h[0][i] for h in held]) for i in range(2)]
        base = np.concatenate([[0], np.cumsum([len(h[0][0]) for h in held])])
        owner = np.concatenate([h[2] + np.uint32(k) for h, k in zip(held, base)])
        columns = [np.concatenate([h[3][i] for h in held]) for i in range(len(held[0][3]))]
        return _rows(_blocks(part * 65_536 + number, ids, np.concatenate([h[1] for h in held]), owner, columns, buckets, with_first))

    for batch in rows:
        for ids, keys, owner, columns in take(batch):
            held.append((ids, keys, owner, columns))
            docs, entries = docs + len(ids[0]), entries + len(keys)
            if entries >= size or docs >= 65_000:
                yield flush()
                number, held, docs, entries = number + 1, [], 0, 0
    if held:
        yield flush()


def _own_row(t: pa.Table) -> bytes:
    return next(b for b in t.column("own").to_pylist() if b is not None)


def _by_owner(ids, owner: np.ndarray, hit: np.ndarray):
    """Documents with hits, and where the hits of each, ordered by document, begin and end."""
    order = hit[np.argsort(owner[hit], kind="stable")]
    own = owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
    docs = own[cuts[:-1]]
    return order, cuts, ids[0][docs], ids[1][docs]


def _lists(values: np.ndarray, cuts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(kind)))


def _own(blob: bytes, columns: int) -> list[np.ndarray]:
    """Documents, hashes of texts, owners and columns of a chunk's own row; owners take two bytes where they fit."""
    docs = int(np.frombuffer(blob, "<i8", 1)[0]) // 8
    return _unpack(blob, "<i8", "<i8", "<u2" if docs <= 65_536 else "<u4", *["<u4"] * columns)


def _hits(key, t):
    """``doc, hash, places`` of a chunk: its runs and marks that another text, or the same at another place, has."""
    doc, text, owner, place = _own(_own_row(t), 1)
    new = (place & _NEW) != 0
    which = np.cumsum(new) - 1
    known = np.bincount(which, minlength=1) > 1
    for b in t.column("seen").to_pylist():
        if b is not None:
            known[np.frombuffer(b, "<u4")] = True
    order, cuts, docs, texts = _by_owner((doc, text), owner, np.flatnonzero(known[which]) if len(which) else which)
    return pa.table({"doc": pa.array(docs), "hash": pa.array(texts), "places": _lists((place & ~_NEW)[order], cuts, np.int32)})


def _removed(key, t):
    """``doc, hash, starts, lengths, firsts`` of a chunk: the spans that a smaller document has, or the same text
    at an earlier place that does not overlap."""
    doc, text, owner, place, length = _own(_own_row(t), 2)
    new = (place & _NEW) != 0
    place = (place & ~_NEW).astype(np.int64)
    which = np.cumsum(new) - 1
    first = _least_by_key(doc[owner], new).copy()
    for b in t.column("seen").to_pylist():
        if b is not None:
            at, lead = _unpack(b, "<u4", "<i8")
            first[at] = lead
    if not len(which):
        gone, lead = np.zeros(0, bool), doc[owner]
    else:
        lead = first[which]
        own = np.concatenate([[True], new[1:] | (owner[1:] != owner[:-1])])  # entries of a key are in order of owner and place
        earliest = place[np.flatnonzero(own)][np.cumsum(own) - 1]
        gone = (doc[owner] > lead) | (place >= earliest + length)
    order, cuts, docs, texts = _by_owner((doc, text), owner, np.flatnonzero(gone))
    release()
    firsts = [np.unique(lead[order[a:b]][lead[order[a:b]] < d]) for a, b, d in zip(cuts[:-1], cuts[1:], docs)]
    return pa.table({
        "doc": pa.array(docs), "hash": pa.array(texts), "starts": _lists(place[order], cuts, np.int32), "lengths": _lists(length[order], cuts, np.int32),
        "firsts": pa.array([f.tolist() for f in firsts], pa.list_(pa.int64())),
    })


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def repeated_spans(texts: DataFrame, rule: Rule) -> DataFrame:
    """``doc, hash, starts, lengths, firsts`` of each text of ``texts(doc, hash, text)`` that loses words."""
    chars = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    size, buckets = block_sizes(chars // 30)

    def candidates(batches):
        def take(batch):
            data = _bytes(batch.column(2))
            doc, text = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in bounded(data):
                keys, owner, place = _candidates(data[a:b], rule)
                yield (doc[a:b], text[a:b]), keys, owner, [place]

        yield from _chunked(batches, take, buckets, size, False)

    blocks = texts.mapInArrow(tidy(candidates), _BLOCKS).groupBy("bucket").applyInArrow(_seen, _ANSWERS)
    hits = blocks.groupBy("chunk").applyInArrow(_hits, "doc long, hash long, places array<int>")
    hits = materialize(hits.dropDuplicates(["doc", "hash"]), "hits")

    more = hits.agg(F.sum(F.size("places")).alias("n")).first()["n"] or 0
    size2, buckets2 = block_sizes(more * (rule.least_passage - rule.window))

    def spans(batches):
        def take(batch):
            data = _bytes(batch.column(2))
            doc, text = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places = [np.array(p, np.int64) for p in batch.column(3).to_pylist()]
            chosen = [p[p >= int(_IS_RUN)] - int(_IS_RUN) for p in places]
            marked = [p[p < int(_IS_RUN)] for p in places]
            for a, b in bounded(data):
                keys, owner, place, length = rule.spans(data[a:b], chosen[a:b], marked[a:b])
                yield (doc[a:b], text[a:b]), keys, owner, [place, length]

        yield from _chunked(batches, take, buckets2, size2, True)

    key = F.xxhash64("doc", "hash")
    chosen = only_wanted(texts, key, hits, key).join(hits, ["doc", "hash"]).select("doc", "hash", "text", "places")
    blocks = chosen.mapInArrow(tidy(spans), _BLOCKS).groupBy("bucket").applyInArrow(_firsts, _ANSWERS)
    found = blocks.groupBy("chunk").applyInArrow(_removed, "doc long, hash long, starts array<int>, lengths array<int>, firsts array<long>")
    removed = materialize(found.dropDuplicates(["doc", "hash"]), "removed")
    discard(hits)
    return removed


def _cut(texts: list[bytes], starts: list[list[int]], lengths: list[list[int]]) -> tuple[list[bytes], list[int]]:
    """The texts without the words of their spans, and how many sentences of each lose a word."""
    w = Words(texts)
    lost = np.zeros(len(w.first) + 1, np.int64)
    for i, (x, n) in enumerate(zip(starts, lengths)):
        at = np.array(x, np.int64) + w.at[i]
        np.add.at(lost, at, 1)
        np.add.at(lost, at + np.array(n, np.int64), -1)
    lost = np.cumsum(lost)[:-1] > 0
    heads = sentence_starts(w)
    hurt = np.unique(np.searchsorted(heads, np.flatnonzero(lost), "right") - 1)
    units = np.bincount(np.searchsorted(w.at, heads[hurt], "right") - 1, minlength=len(texts))
    kept = []
    for i, text in enumerate(texts):
        a, b = int(w.at[i]), int(w.at[i + 1])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], lost[a:b], [False]]).astype(np.int8))).reshape(-1, 2) + a
        parts, at = [], 0
        for first, end in edges.tolist():
            parts.append(text[at : int(w.first[first] - w.offsets[i])])
            at = int(w.first[end] - w.offsets[i]) if end < b else len(text)
        kept.append(b"".join(parts) + text[at:])
    return kept, units[: len(texts)].tolist()


def remove_repeats(
    docs: DataFrame, least_units: int = 3, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", least_passage: int = 51
) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, and ``n_removed``, ``first_doc_ids``.

    Removed are the runs of at least ``least_units`` sentences and ``least_words`` words, and the
    passages of ``least_passage`` words at any place, that a smaller document has, or the same
    text earlier without overlap. Words end at ASCII space, and A-Z count as a-z. ``n_removed``
    counts the sentences that lose a word; ``first_doc_ids`` lists the documents that keep what is
    removed here. Spans are compared by 64-bit hashes.

    Every row is kept, with all its columns; a null text stays null, and a text of which all is
    removed becomes empty. Rows without an id stay as they are and are never first. Rows of equal
    ids do not repeat each other. An empty table gives no rows. Columns of ``docs`` named like the
    two added ones, in any case, are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    names, rule = docs.columns, Rule(least_units, least_words, least_passage)
    text = F.col(text_col).cast("string")
    keyed = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))
    removed = repeated_spans(keyed, rule)

    doc, hash_, flag, starts, lengths = (free_name([*names, *ADDED], n) for n in ("_doc", "_hash", "_flag", "_starts", "_lengths"))
    known = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    held = docs.withColumns({doc: F.when(known, F.col(id_col).cast("long")), hash_: F.when(known, F.xxhash64(text))})
    held = flag_wanted(held, F.when(known, F.xxhash64(doc, hash_)), removed, F.xxhash64("doc", "hash"), flag)
    none = [F.lit(0).alias(ADDED[0]), F.array().cast("array<bigint>").alias(ADDED[1])]
    whole = held.where(~F.col(flag)).select(*names, *none)
    joined = held.where(F.col(flag)).join(removed.toDF(doc, hash_, starts, lengths, ADDED[1]), [doc, hash_], "left").select(*names, ADDED[1], starts, lengths)
    at = names.index(text_col)

    def clean(batches):
        for batch in batches:
            chosen = np.flatnonzero(batch.column(len(names) + 1).is_valid().to_numpy(zero_copy_only=False))
            texts, units = _bytes(batch.column(at)), np.zeros(batch.num_rows, np.int32)
            some = [texts[i] for i in chosen.tolist()]
            first, count = (batch.column(len(names) + k).take(pa.array(chosen)).to_pylist() for k in (1, 2))
            for a, b in bounded(some):
                kept, n = _cut(some[a:b], first[a:b], count[a:b])
                for i, x, k in zip(chosen[a:b].tolist(), kept, n):
                    texts[i], units[i] = x, k
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            empty = pa.array([[]], pa.list_(pa.int64()))[0]
            columns += [pa.array(units), batch.column(len(names)).fill_null(empty)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *ADDED])

    fields = [f if f.name != text_col else T.StructField(text_col, T.StringType()) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(ADDED[0], T.IntegerType()), T.StructField(ADDED[1], T.ArrayType(T.LongType()))])
    return whole.withColumn(text_col, text).select(*names, *ADDED).unionByName(joined.mapInArrow(tidy(clean), schema))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_removed, first_doc_ids, text`` of every document."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_removed", "first_doc_ids", "text")
