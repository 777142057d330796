"""Chunk-wise encoding of whole texts with a bounded cache.

A text is cut before every space that a non-space follows. No token of the two supported
vocabularies crosses such a cut, so the ids of a text are the ids of its chunks in order. Equal
chunks are encoded once while they stay in the cache. The cache keeps two generations and drops
the older one when the younger passes a bound; that changes the speed and never a result.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

_CUT = re.compile(r" (?=\S)")
_LOOSE = re.compile(r" (?!\S)")


def cut(text: str) -> list[str]:
    """Chunks without the space that leads each but the first."""
    return _CUT.split(text) if _LOOSE.search(text) else text.split(" ")


class ChunkCache:
    """Maps chunks to encoded values. ``encode(chunks, heads)`` gives the values of both lists; only
    the chunks, which follow a space in their texts, are cached."""

    def __init__(self, encode: Callable[[list[str], list[str]], tuple[list, list]], bound: int = 400_000):
        self.encode, self.bound, self.young, self.old = encode, bound, {}, {}

    def values(self, texts: list[str]) -> list[list]:
        """Per text the list of its chunks' values."""
        if len(self.young) > self.bound:
            self.young, self.old = {}, self.young
        young, old, rows, heads, holes, missing = self.young, self.old, [], [], [], {}
        look = young.get
        for text in texts:
            chunks = cut(text)
            heads.append(chunks[0])
            row = list(map(look, chunks))
            row[0] = b""
            if None in row:
                at = [i for i, v in enumerate(row) if v is None]
                names = [chunks[i] for i in at]
                missing.update(dict.fromkeys(names))
                holes.append((row, at, names))
            rows.append(row)
        kept = {x: old[x] for x in old.keys() & missing.keys()} if old else {}
        new = [x for x in missing if x not in kept] if kept else list(missing)
        got, first = self.encode(new, heads)
        kept.update(zip(new, got))
        young.update(kept)
        for row, at, names in holes:
            for i, x in zip(at, names):
                row[i] = kept[x]
        for row, head in zip(rows, first):
            row[0] = head
        return rows


class LibraryEncoder:
    """Ids of whole texts from the tokenizers library, packed as little-endian unsigned 32-bit integers.

    Chunks of Latin letters, with signs behind them, are one or two words of the library's model,
    which is asked directly; all others go through the whole tokenizer.
    """

    _TAIL = ".,!?;:%*&$#|"

    def __init__(self, path: str, bound: int = 650_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.by_word = any(t.endswith("</w>") for t in self.tokenizer.get_vocab())
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.shown = "".join([chr(b) if b in shown else chr(next(hidden)) for b in range(256)])
        self.four = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.tails = {"": b""}
        self.cache = ChunkCache(self._encode, bound)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _encode(self, chunks: list[str], heads: list[str]) -> tuple[list[bytes], list[bytes]]:
        out: list = [None] * len(chunks)
        rest, tails, by_word, tokenize, four, shown = [], self.tails, self.by_word, self.model.tokenize, self.four, self.shown
        for i, chunk in enumerate(chunks):
            base = chunk.rstrip(self._TAIL)
            ascii_only = base.isascii()
            if base.isalpha() and (ascii_only or max(base) <= "ÿ"):
                tail = chunk[len(base) :]
                if tail not in tails:
                    tails[tail] = self._word(tail)
                if by_word:
                    base = base.lower()
                if not ascii_only:
                    base = base.encode().decode("latin-1").translate(shown)
                ids = tokenize(base if by_word else "Ġ" + base)
                out[i] = (four[ids[0].id] if len(ids) == 1 else b"".join([four[t.id] for t in ids])) + tails[tail]
            else:
                rest.append(i)
        if len(tails) > 10_000:
            self.tails = {"": b""}
        singly = self.tokenizer.encode_batch_fast([" " + chunks[i] for i in rest] + heads, add_special_tokens=False)
        packed = [array("I", e.ids).tobytes() for e in singly]
        for i, ids in zip(rest, packed):
            out[i] = ids
        return out, packed[len(rest) :]

    def packed(self, texts: list[str], at_once: int = 400):
        """Yields the packed ids of each text."""
        for i in range(0, len(texts), at_once):
            for values in self.cache.values(texts[i : i + at_once]):
                yield b"".join(values)


_LOADED: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder a process and path; Python workers are reused between tasks."""
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]
