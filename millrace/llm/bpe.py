"""Byte-pair encoding and decoding over segment trees of adjacent pair ranks.

Every piece of text is an array of symbols. The leaves of its tree hold ``rank * width + place``
of each adjacent pair, or a bound where the pair cannot merge, and inner nodes the minimum of
their children: the root is the leftmost pair of lowest rank. A merge changes three leaves, each
put right up to the root in logarithmic time, and it goes on until no root holds a mergeable
pair. Many pieces are worked on together, one merge of each in a step.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import ChunkCache

_NONE = np.int64(1) << 60
#: Fixed value: the split pattern of this family of byte-level vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs that make one piece of their own behind a word, since none of them begins a contraction.
_SIGNS = ".,!?;:%*&$#|"


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class SegmentTreeBPE:
    """A byte-level BPE vocabulary from a tokenizers JSON file; no code of that library runs."""

    def __init__(self, path: str, bound: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        self.split = regex.compile(SPLIT_PATTERN)
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.bytes_of: dict[int, bytes] = {
            i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()
        }
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of.update((i, t.encode()) for t, i in self.special.items())
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = np.int64(max(self.bytes_of) + 1)
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cache = ChunkCache(self._encode_chunks, bound)
        self.pieces: dict[str, tuple[str, bytes]] = {}
        self.names = {i: str(i) for i in self.bytes_of}
        self.bound = bound

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of symbol pairs; -1 where they do not merge."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((b >= 0) & (self.keys[at] == key), self.ranks[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of byte strings, each merged on its own; memory follows the bytes given, within a factor."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        for width in np.unique(widths[sizes > 0]).tolist():
            chosen = np.flatnonzero((widths == width) & (sizes > 0))
            step = max(1, 400_000 // width)
            for i in range(0, len(chosen), step):
                self._merge_width([pieces[k] for k in chosen[i : i + step]], width, chosen[i : i + step], out)
        return out

    def _merge_width(self, pieces: list[bytes], width: int, places: np.ndarray, out: list) -> None:
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        column = np.arange(width)
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[:, :width][column < sizes[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.minimum(column + 1, width), (n, 1))
        before = np.tile(column - 1, (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rank = self._rank(symbols[:, :width], symbols[:, 1:])
        tree[:, width:] = np.where(rank >= 0, rank * width + column, _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = value
            while node[0] > 1 if len(node) else False:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            r = self._rank(symbols[rows, at], symbols[rows, after[rows, at]])
            return np.where(r >= 0, r * width + at, _NONE)

        live = np.flatnonzero(tree[:, 1] < _NONE) if width > 1 else np.empty(0, np.int64)
        while len(live):
            root = tree[live, 1]
            at = root % width
            gone = after[live, at]
            symbols[live, at] = self.merged[root // width]
            symbols[live, gone] = -1
            behind = after[live, gone]
            after[live, at] = behind
            inner = behind < width
            before[live[inner], behind[inner]] = at[inner]
            put(live, gone, np.full(len(live), _NONE))
            put(live, at, leaf(live, at))
            prior = before[live, at]
            has = prior >= 0
            put(live[has], prior[has], leaf(live[has], prior[has]))
            live = live[tree[live, 1] < _NONE]
        symbols = symbols[:, :width]
        kept = symbols >= 0
        flat, ends = symbols[kept], np.cumsum(kept.sum(1)).tolist()
        for place, at, end in zip(places.tolist(), [0, *ends], ends):
            out[place] = flat[at:end]

    def encode_pieces(self, pieces: Iterable[str]) -> None:
        """Puts all pieces into the table of known ones: their ids joined by commas, and the bytes that these decode to."""
        new = list(set(pieces).difference(self.pieces))
        spelt, known, names = self.bytes_of, self.pieces, self.names
        for piece, ids in zip(new, self.merge_all([p.encode("utf-8", "surrogatepass") for p in new])):
            ids = ids.tolist()
            known[piece] = (names[ids[0]], spelt[ids[0]]) if len(ids) == 1 else (",".join([names[i] for i in ids]), b"".join([spelt[i] for i in ids]))

    def _pieces_of(self, chunk: str) -> list[str]:
        """The pieces of a chunk behind its space: a word of Latin letters and the signs behind it need no pattern."""
        base = chunk.rstrip(_SIGNS)
        if base.isalpha() and (base.isascii() or max(base) <= "\u00ff"):
            return [" " + base, chunk[len(base) :]] if len(base) < len(chunk) else [" " + base]
        return self.split.findall(" " + chunk)

    def _encode_chunks(self, chunks: list[str], heads: list[str]) -> tuple[list, list]:
        """Per chunk its ids joined by commas and the bytes they decode to."""
        if len(self.pieces) > self.bound:
            self.pieces = {}
        found = [*map(self._pieces_of, chunks), *map(self.split.findall, heads)]
        self.encode_pieces(chain.from_iterable(found))
        known, values = self.pieces, []
        for ps in found:
            if len(ps) == 1:
                values.append(known[ps[0]])
            else:
                got = [known[p] for p in ps]
                values.append((",".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        return values[: len(chunks)], values[len(chunks) :]

    def encode_decode(self, texts: list[str], at_once: int = 400) -> Iterator[tuple[str, str]]:
        """Yields the decimal ids joined by commas, and the text decoded from the ids, of each text."""
        for i in range(0, len(texts), at_once):
            some = texts[i : i + at_once]
            parts = [self.special_split.split(t) if self.special and any(s in t for s in self.special) else [t] for t in some]
            got = iter(self.cache.values([p for ps in parts for p in ps if p not in self.special]))
            for ps in parts:
                values: list[tuple[str, bytes]] = []
                for p in ps:
                    if p in self.special:
                        i_ = self.special[p]
                        values.append((str(i_), self.bytes_of[i_]))
                    else:
                        values += next(got)
                yield (
                    ",".join([v[0] for v in values if v[0]]),
                    b"".join([v[1] for v in values]).decode("utf-8", "replace"),
                )

    def encode(self, text: str) -> list[int]:
        joined, _ = next(self.encode_decode([text]))
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids; ids outside the vocabulary are left out, and broken UTF-8 is replaced."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


_LOADED: dict[str, SegmentTreeBPE] = {}


def coder(path: str) -> SegmentTreeBPE:
    if path not in _LOADED:
        _LOADED[path] = SegmentTreeBPE(path)
    return _LOADED[path]


def encode_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids array<int>`` and ``decoded`` of every row; a null text counts as empty, a null id stays null."""

    def run(batches):
        c = coder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, decoded = [], []
            for joined, text in c.encode_decode(texts):
                ids.append([int(x) for x in joined.split(",")] if joined else [])
                decoded.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["id", "ids", "decoded"]
            )

    return _narrow(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>, decoded string")


def decode_tokens(tokens: DataFrame, vocabulary: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id`` and the ``text`` of an id array; null arrays give null."""

    def run(batches):
        c = coder(vocabulary)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")


def digest_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, without ids or texts leaving the workers.

    One row for each input row: null texts count as empty, repeated rows are repeated, columns
    beyond the two named are not read, and an empty table gives no rows.
    """

    def run(batches):
        c = coder(vocabulary)
        for batch in batches:
            n, a, b = [], [], []
            for joined, text in c.encode_decode(batch.column(1).to_pylist()):
                n.append(joined.count(",") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _narrow(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
