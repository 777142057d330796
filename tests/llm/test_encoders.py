"""Short ways of the two encoders against their whole ways."""

import pytest


def test_words_with_signs_need_no_pattern(monkeypatch):
    from millrace.llm import bpe, queries

    coder = bpe.SegmentTreeBPE(queries.vocabulary("byte_bpe_50k.json"))
    chunks = ["word", "Word,", "größe...", "ª", "été!?", "a", "the###", "x;:", "µ.,", "Ÿes", "don't", "it's.", "1st", "a\nb", "", "...", "a1.", "日本", "ça%*&$#|"]
    assert [coder._pieces_of(c) for c in chunks] == [coder.split.findall(" " + c) for c in chunks]

    class Asked(Exception):
        pass

    def findall(text):
        raise Asked(text)

    monkeypatch.setattr(coder, "split", type("Split", (), {"findall": staticmethod(findall)}))
    assert coder._pieces_of("größe...") == [" größe", "..."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_library_encoder_on_odd_words(name):
    import numpy as np
    from tokenizers import Tokenizer

    from millrace.llm import chunks, queries

    path = queries.vocabulary(name)
    encoder, library = chunks.LibraryEncoder(path, bound=5), Tokenizer.from_file(path)
    assert encoder.four[258] == (258).to_bytes(4, "little")
    texts = ["größe Größe... ÉTÉ!? the the### ", "  two  spaces \n here.\nThere", "ª µ ÿ Ÿ ß", "", " ", "don't it's 日本 語", "Ça ça%*&$#| ñandú", "the größe here.\nThere"]
    for _ in range(3):  # old and young chunks
        for got, text in zip(encoder.packed(texts, at_once=2), texts):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_odd_texts(name):
    """Small tables and blocks, so that tables are full, given up and asked again, against the library."""
    import random

    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from millrace.llm import pieces, queries

    path, rng = queries.vocabulary(name), random.Random(5)
    library, small, large = Tokenizer.from_file(path), pieces.PieceEncoder(path, bound=64, block=7), pieces.PieceEncoder(path)
    signs = [" ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", ".", ",", "!", "|", "$", "-", "'", "'s", "\0", "1", "23", "½", "ª", "×", "“", "\u0301", "<|endoftext|>", "<|endof", "text|>"]
    words = ["a", "the", "Word", "É", "ß", "Ÿ", "中", "日本", "ǅ", "😀", "abcdefghijklmn", "abcdefghijklmno", "longwordthatgoeson" * 2]
    for _ in range(100):
        texts = ["".join(rng.choice(signs + 2 * words) for _ in range(rng.choice([0, 0, 1, 2, 3, 10, 60]))) for _ in range(rng.randint(1, 8))]
        want = [library.encode(x, add_special_tokens=False).ids + [0] for x in texts]
        for encoder in (small, large):
            ids, counts = encoder.ids(pa.array(["x y.", *texts]).slice(1), 0)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert small.old is not None and small.young.n <= 64 and large.old is None
    ids, counts = large.ids(pa.array([], pa.string()), 0)
    assert len(ids) == len(counts) == 0


def test_a_word_is_asked_for_once_whatever_sign_follows(monkeypatch):
    """The library is asked for a word once, not once for each sign or line break beside it, and never for a known one."""
    import pyarrow as pa

    from millrace.llm import pieces, queries

    encoder, asked = pieces.PieceEncoder(queries.vocabulary("byte_bpe_50k.json")), []
    real = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda x: asked.extend(x) or real(x))
    texts = pa.array([f" word{a} other{b} word" for a in ("", ".", ",", "!?", "...", ";", ".\nAnd") for b in ("", ",", ".", ":", ".\nAnd")])
    first = encoder.ids(texts)
    assert len(asked) == len(set(asked)) and {b" word", b" other", b"And"} <= set(asked)
    assert not [x for x in asked if x not in (b" word", b" other", b"And") and x.strip(b".,!?;:\n")]
    asked.clear()
    again = encoder.ids(texts)
    assert not asked and all((x == y).all() for x, y in zip(first, again))


def test_longer_words_are_kept_too(monkeypatch):
    """Words of 16 to 64 bytes are asked for once while there is room, and again after; the ids are the same."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from millrace.llm import pieces, queries

    path = queries.vocabulary("byte_bpe_50k.json")
    encoder, asked = pieces.PieceEncoder(path, bound=64), []
    real = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda x: asked.extend(x) or real(x))
    words = ["достопримечательность", "internationalisation", "x" * 63, "y" * 64]
    column = pa.array([" " + w for w in words])
    want = [i for w in words for i in Tokenizer.from_file(path).encode(" " + w).ids]
    assert encoder.ids(column)[0].tolist() == want and len(asked) == 4
    asked.clear()
    assert encoder.ids(column)[0].tolist() == want and [len(x) for x in asked] == [65]
    encoder.ids(pa.array([f" {k:020d}" for k in range(200)]))  # more than there is room for
    for asks in (1, 4, 1):
        asked.clear()
        assert encoder.ids(column)[0].tolist() == want and len(asked) == asks


def test_text_slices_hold_whole_rows():
    import pyarrow as pa

    from millrace.llm import pieces

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * n for n in (0, 3, 4, 20, 1, 0, 9)])], ["id", "text"])
    for whole in (batch, batch.slice(2), batch.slice(0, 0)):
        parts = list(pieces.text_slices(whole, 1, 10))
        assert pa.Table.from_batches(parts, batch.schema).equals(pa.Table.from_batches([whole]))
        assert all(p.num_rows == 1 or sum(len(x.as_py()) for x in p.column(1)) <= 10 for p in parts)
