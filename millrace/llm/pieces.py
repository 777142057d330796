"""Encoding of whole texts as arrays: pieces are cut, looked up and put together without an object for each.

A text is cut before every space that a non-space follows, as in ``chunks``. For a byte-level vocabulary
it is also cut between an ASCII letter and a sign, and after a single line break between a visible ASCII
character and an ASCII letter. No token crosses such a cut, so the ids of a text are the ids of its
pieces in order. Pieces of at most 15 bytes are compared as two whole numbers and their ids kept in
tables of a bounded size, those of up to 64 bytes in a bounded dictionary; longer ones are encoded once
a block. What is kept changes the speed and never a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millrace.llm.chunks import library_encoder

_U = np.uint64
_FULL = (1 << 64) - 1
#: By a piece's length: the bytes of its first and second number that belong to it.
_FIRST = np.array([_FULL >> (64 - 8 * min(n, 8)) if n else 0 for n in range(16)], _U)
_SECOND = np.array([_FULL >> (64 - 8 * (n - 8)) if n > 8 else 0 for n in range(16)], _U)
#: Kinds of bytes. Whitespace beyond ASCII begins with one of four bytes, after which it is looked for.
_SPACE, _SOLID, _LETTER, _SIGN, _LEAD, _VISIBLE = (1 << k for k in range(6))
_KINDS = bytearray(256)
for _b in range(256):
    _solid = 0 if _b in (*range(9, 14), *range(28, 33)) else _SOLID
    _letter = _LETTER if chr(_b).isascii() and chr(_b).isalpha() else 0
    _sign = _SIGN if _b in b".,!?;:%*&$#" else 0  # none of an added token
    _KINDS[_b] = _solid | _letter | _sign | (_b == 32) * _SPACE | (_b in (0xC2, 0xE1, 0xE2, 0xE3)) * _LEAD | (32 < _b < 127) * _VISIBLE
_WIDE = [int.from_bytes(chr(c).encode(), "big") for c in range(128, 0x3001) if chr(c).isspace()]


class PieceTable:
    """Keys of two numbers, the second never 0, with the place of their ids in ``pool``; open addressing, at most half full."""

    def __init__(self, bound: int):
        bits = (2 * bound - 1).bit_length()
        self.bound, self.shift, self.mask = bound, _U(64 - bits), (1 << bits) - 1
        self.first, self.second, self.value = (np.zeros(1 << bits, t) for t in (_U, _U, np.int64))
        self.pool, self.used, self.n = np.empty(1 << 16, np.int32), 1, 0

    def _slots(self, first, second):
        h = (first ^ (second * _U(0x9E3779B97F4A7C15))) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        return (h * _U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, first, second):
        """Per key its place in the pool times 256, plus the number of its ids; 0 where it is not in the table."""
        slots = self._slots(first, second)
        there = self.second[slots]
        hit = (there == second) & (self.first[slots] == first)
        out = np.where(hit, self.value[slots], 0)
        left = np.flatnonzero(~hit & (there != 0))
        slots = slots[left]
        while len(left):
            slots = (slots + 1) & self.mask
            there = self.second[slots]
            hit = (there == second[left]) & (self.first[slots] == first[left])
            out[left[hit]] = self.value[slots[hit]]
            more = ~hit & (there != 0)
            left, slots = left[more], slots[more]
        return out

    def add(self, first, second, value) -> None:
        """Different keys, none of them in the table, as many as there is room for."""
        left, slots = np.arange(len(first)), self._slots(first, second)
        self.n += len(first)
        while len(left):
            free = np.flatnonzero(self.second[slots] == 0)
            self.value[slots[free]] = left[free]  # of several for one slot, the last
            won = free[self.value[slots[free]] == left[free]]
            at, key = slots[won], left[won]
            self.first[at], self.second[at], self.value[at] = first[key], second[key], value[key]
            more = np.ones(len(left), bool)
            more[won] = False
            left, slots = left[more], (slots[more] + 1) & self.mask

    def put(self, ids: np.ndarray) -> None:
        """Writes ``ids`` behind the used part of the pool, which they join when ``used`` is moved on."""
        if self.used + len(ids) > len(self.pool):
            grown = np.empty(max(2 * len(self.pool), self.used + len(ids)), np.int32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids

    def trim(self) -> None:
        if len(self.pool) > 2 * self.used + (1 << 20):
            self.pool = self.pool[: self.used].copy()


def gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices of ``pool`` one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - ends + count, count) + np.arange(total)]


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) if len(column) else np.zeros(1, np.int64)


def text_slices(batch: pa.RecordBatch, at: int, size: int = 4 << 20):
    """``batch`` in slices of whole rows, of at most ``size`` bytes of text in column ``at`` where a slice has several rows."""
    offsets, i = _offsets(batch.column(at)), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class PieceEncoder:
    """Ids of whole texts from the tokenizers library; what the tables do not know goes to its model or to the whole tokenizer."""

    def __init__(self, path: str, bound: int = 1 << 20, block: int = 1 << 16):
        self.library, self.bound, self.block = library_encoder(path), bound, block
        self.inner = not self.library.by_word
        self.young, self.old, self.longer = PieceTable(bound), None, {}

    def ids(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of ``column``, which has no nulls, each followed by ``end_id``, and how many each has."""
        offsets = _offsets(column)
        ends = offsets - offsets[0]
        size = int(ends[-1])
        blob = (column.buffers()[2].slice(int(offsets[0]), size).to_pybytes() if size else b"") + bytes(32 - size % 8)
        starts = np.append(self.cuts(blob, ends), size)
        parts = [self._block(blob, starts[i : i + self.block + 1]) for i in range(0, len(starts) - 1, self.block)]
        flat = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int32)
        before = np.concatenate([[0], *(p[1] for p in parts)]).cumsum()
        places = before[np.searchsorted(starts, ends)]  # an empty text begins where the next does
        counts = np.diff(places)
        if end_id is not None:
            flat, counts = np.insert(flat, places[1:], end_id), counts + 1
        return flat, counts

    def cuts(self, blob: bytes, ends: np.ndarray) -> np.ndarray:
        """Where the pieces begin, in order; ``blob`` has bytes to spare behind the texts, ``ends`` begins with 0."""
        size = int(ends[-1])
        data, kind = np.frombuffer(blob, np.uint8), np.frombuffer(blob.translate(_KINDS), np.uint8)
        pair = kind[:size] & kind[1 : size + 1] >> 1  # a space and what is solid, a letter and a sign
        cut = (pair & _SPACE).astype(bool)
        again = np.flatnonzero(cut & (kind[1 : size + 1] & _LEAD != 0))
        if len(again):
            a, b, c = (data[again + k].astype(np.int64) for k in (1, 2, 3))
            cut[again[np.isin(np.where(a == 0xC2, a << 8 | b, a << 16 | b << 8 | c), _WIDE)]] = False
        cut[ends[1:][np.diff(ends) > 0] - 1] = False  # the byte behind is another text's
        if self.inner:
            cut[1:] |= (pair[:-1] & _LETTER).astype(bool)
            line = np.flatnonzero(data[1 : max(size - 1, 1)] == 10) + 1
            cut[line[(kind[line - 1] & _VISIBLE != 0) & (kind[line + 1] & _LETTER != 0)] + 1] = True
        cut[ends[:-1][np.diff(ends) > 0]] = True
        return np.flatnonzero(cut)

    def _block(self, blob: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces between ``starts``, and how many each piece has."""
        if self.young.n > self.bound * 7 // 8 or self.young.used > 8 * self.bound:
            self.young, self.old = PieceTable(self.bound), self.young
        young, at, sizes = self.young, starts[:-1], np.diff(starts)
        short = np.minimum(sizes, 15)
        words, place, turn = np.frombuffer(blob, "<u8"), at >> 3, (at.astype(_U) & _U(7)) << _U(3)
        low, middle, high = words[place], words[place + 1], words[place + 2]
        back = _U(63) - turn  # and one more
        first = (low >> turn | middle << back << _U(1)) & _FIRST[short]
        second = (middle >> turn | high << back << _U(1)) & _SECOND[short] | (short.astype(_U) << _U(56))
        second[sizes > 15] = _FULL  # never in a table
        value = young.find(first, second)
        start, count = value >> 8, value & 255
        missing = np.flatnonzero(value == 0)
        if len(missing):
            place = {}
            index = np.array([place.setdefault(blob[a:b], len(place)) for a, b in zip(at[missing].tolist(), starts[missing + 1].tolist())])
            of = missing[np.flatnonzero(np.diff(np.maximum.accumulate(index), prepend=-1))]  # where each is first
            new_start, new_count = self._learn(list(place), first[of], second[of], sizes[of] <= 15)
            start[missing], count[missing] = new_start[index], new_count[index]
        out = gather(young.pool, start, count)
        young.trim()
        return out, count

    def _learn(self, pieces: list[bytes], first, second, keep) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ids of new pieces; those to keep, while there is room, are in the table afterwards, the others' ids are overwritten later."""
        young, found = self.young, [None] * len(pieces)
        if self.old is not None:
            value = self.old.find(first, second)
            for i in np.flatnonzero(value).tolist():
                a, n = int(value[i]) >> 8, int(value[i]) & 255
                found[i] = self.old.pool[a : a + n].tobytes()
        for i in np.flatnonzero(~keep).tolist():
            found[i] = self.longer.get(pieces[i])
        todo = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(todo, self._encode([pieces[i] for i in todo])):
            found[i] = x
        if len(self.longer) > self.bound // 8:
            self.longer = {}
        self.longer.update((pieces[i], found[i]) for i in todo if 15 < len(pieces[i]) <= 64)
        count = np.array([len(x) for x in found], np.int64) >> 2
        keep = np.flatnonzero(keep & (count < 256))[: max(0, young.bound - young.n)]
        order = np.concatenate([keep, np.setdiff1d(np.arange(len(pieces)), keep)])
        young.put(np.frombuffer(b"".join([found[i] for i in order.tolist()]), "<i4"))
        start = np.empty(len(pieces), np.int64)
        start[order] = young.used + np.cumsum(count[order]) - count[order]
        young.add(first[keep], second[keep], start[keep] << 8 | count[keep])
        young.used += int(count[keep].sum())
        return start, count

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        library = self.library
        texts = [p.decode() for p in pieces]
        if not self.inner:
            led = [x[:1] == " " and not x[1:2].isspace() and len(x) > 1 for x in texts]
            chunks, heads = library._encode([x[1:] for x, k in zip(texts, led) if k], [x for x, k in zip(texts, led) if not k])
            chunks, heads = iter(chunks), iter(heads)
            return [next(chunks) if k else next(heads) for k in led]
        out, rest, tokenize, four, shown = [None] * len(texts), [], library.model.tokenize, library.four, library.shown
        for i, text in enumerate(texts):
            bare = text[1:] if text[0] == " " else text
            if bare.isalpha() and (bare.isascii() or max(bare) <= "ÿ"):
                ids = tokenize(pieces[i].decode("latin-1").translate(shown))
                out[i] = four[ids[0].id] if len(ids) == 1 else b"".join([four[t.id] for t in ids])
            else:
                rest.append(i)
        for i, e in zip(rest, library.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


_LOADED: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder a process and path; Python workers are reused between tasks."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]
