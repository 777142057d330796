"""The text operators against brute force, on hard rows: nulls, empty and long texts, ties, repeats, no rows."""

import collections
import glob
import gzip
import hashlib
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, embedding_dedup, jaccard_join, packing, pii, quality, substring_dedup, token_files, toxicity, warc
from millrace.llm.common import block_sizes, connected_components, flag_wanted, join_heavy
from millrace.llm.queries import vocabulary

SAID = "The quick brown fox jumps over the lazy dog while seven wizards mix potions. Nobody saw it coming that day! Yet the crowd stayed calm and waited for the last bell of the evening to ring again."
TEXTS = [
    (1, SAID), (2, "Before all that, a preface was written here. " + SAID), (3, SAID), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE two"),
    (9, "a" * 3000 + " end"), (10, "x<|endoftext|> y  double  spaces\n\nlines é ñ 中文 ½ ª's don't\x1cfoo  bar"), (11, "Mail a@b.co.d or +1 (017) 555-7713; 4111 1111 1111 1111 at 10.0.0.255 and 300.1.1.1"),
    (12, "IBAN account GB82 WEST 1234 5698 7654 32 or phone 555 123 4567. https x@y"), (13, "w " * 6000), (None, "no id here at all"), (7, "one two"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_padding(), t.no_truncation()
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_bpe(docs, none):
    t, path = tokenizer("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.json")
    got = collections.Counter(tuple(r) for r in bpe.digest_tokens(docs, path).collect())
    want = collections.Counter()
    for i, x in TEXTS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digest_tokens(none, path).count() == 0
    back = bpe.decode_tokens(bpe.encode_tokens(docs, path), path).collect()
    assert sorted(r["text"] for r in back) == sorted(x or "" for _, x in TEXTS)


def test_token_files(spark, docs, none, tmp_path):
    t, path = tokenizer("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.json")
    got = sorted((r["start"], r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in token_files.token_file_digests(spark, docs, path).collect())
    start = 0
    for (at, i, n, c), (j, x) in zip(got, sorted(TEXTS, key=lambda r: r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        assert (at, i, n, c) == (start, j or 0, len(ids), crc(ids))
        start += len(ids)
    assert token_files.token_file_digests(spark, none, path).count() == 0
    token_files.write_token_files(docs, str(tmp_path / "t"), path)
    assert [r["n_tokens"] for r in token_files.read_token_files(spark, str(tmp_path / "t"), [5]).collect()] == [1]


def scanned(df):
    """Rows that the scan of a plan without shuffles gave out."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_token_files_are_pruned(spark, tmp_path):
    """Files follow the ids; a look-up reads few row groups, and none for an id that the Bloom filter does not know."""
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.format_string("word%d and %d", "id", F.col("id") % 7).alias("text"))
    path = token_files.write_token_files(docs, str(tmp_path / "t"), vocabulary("byte_bpe_50k.json"), row_group=1000)
    rows = spark.read.schema(token_files.SCHEMA).orc(path)
    ends = sorted((r["a"], r["b"]) for r in rows.groupBy(F.input_file_name()).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect())
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
    assert 0 < scanned(rows.where("doc_id = 20000")) <= 1000
    assert sum(scanned(rows.where(f"doc_id = {k}")) > 0 for k in range(10_001, 10_061, 2)) <= 4
    assert "EqualTo(doc_id,20000)" in rows.where("doc_id = 20000")._jdf.queryExecution().toString()


def test_packing(docs, none):
    t = tokenizer("word_bpe_49k.json")
    rows = packing.pack(packing.token_pieces(docs, vocabulary("word_bpe_49k.json"), 512), 512, group_items=4).collect()
    want = collections.Counter()
    for i, x in TEXTS:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[i, k, at, len(part), crc(part)] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(packing.token_pieces(none, vocabulary("word_bpe_49k.json"))).count() == 0


def fewest_bins(items, capacity):
    """By trying all ways, for a few items."""
    best = [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[k] and rooms[j] not in rooms[:j]:
                place(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


def test_packing_against_the_fewest_sequences(spark):
    rng = np.random.default_rng(2)
    for _ in range(40):
        x = rng.integers(5, 70, rng.integers(1, 11))
        least = fewest_bins(sorted(x.tolist(), reverse=True), 100)
        assert packing.lower_bound(x, 100) <= least <= len(packing.best_fit_decreasing(x, 100)[2])
        u, n = np.unique(x, return_counts=True)
        assert packing.lower_bound(u, 100, n) == packing.lower_bound(x, 100)
    rows = [(i, 0, 0, int(n), 1) for i, n in enumerate(rng.integers(1, 101, 600))]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES), 100, group_items=150)
    got = packing.certificate(packed, 100).collect()[0]
    assert got["sequences"] == got["bound"] + got["gap"] and 0 <= got["gap"] <= 0.02 * got["bound"]
    assert packing.certificate(packed.limit(0), 100).collect()[0]["gap"] == 0


def test_packing_bounds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, free = packing.best_fit_decreasing(x, 100)
        assert packing.lower_bound(x, 100) <= len(free) and all(x[bins == b].sum() == 100 - f for b, f in enumerate(free))


sets_of = brute.shingles


def components(rows):
    label = {k: i for k, (i, _) in enumerate(rows)}
    linked = [(p, q) for p in range(len(rows)) for q in range(p) if (a := rows[p][1]) and (b := rows[q][1]) and 100 * len(a & b) >= 75 * len(a | b)]
    for _ in rows:
        for p, q in linked:
            label[p] = label[q] = min(x for x in (label[p], label[q]) if x is not None)
    return sorted((i, len(s), label[k]) for k, (i, s) in enumerate(rows) if i is not None)


def test_jaccard(spark, docs, none):
    rng = np.random.default_rng(3)
    rows = list(TEXTS)
    for g in range(40):  # families of near copies about the threshold
        base = [f"w{g}x{rng.integers(30)}" for _ in range(rng.integers(4, 90))]
        for k in range(rng.integers(1, 9)):
            w = list(base)
            for _ in range(rng.integers(0, 1 + len(w) // 12)):
                w[rng.integers(len(w))] = f"z{rng.integers(10**6)}"
            rows.append((100 + 10 * g + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.group_documents(df).where("doc_id is not null").collect())
    assert got == components([(i, sets_of(x)) for i, x in rows])
    assert jaccard_join.group_documents(none).count() == 0


def test_jaccard_large_group(spark, monkeypatch):
    """Many texts of which half is shared: the blocks of bitmaps must find the same links as the join."""
    rng = np.random.default_rng(5)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for i in range(60):
        own = [f"o{i // 4}x{k}" for k in range(26)]
        own[rng.integers(26)] = f"e{i}"
        rows.append((i, " ".join(common + own)))
    monkeypatch.setattr(jaccard_join, "GROUP_PAIRS", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.group_documents(df).collect()) == components([(i, sets_of(x)) for i, x in rows])


def test_keep_firsts_goes_by_id_and_text(spark):
    rows = [(1, SAID, 7), (2, SAID, 8), (2, "another text under the same id stays as it is", 9), (None, SAID, 1), (3, None, 2), (3, "", 3), (1, SAID, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _t long")
    assert sorted(map(str, jaccard_join.keep_firsts(df).collect())) == sorted(map(str, df.where("_t <> 8").collect()))
    assert jaccard_join.keep_firsts(df.limit(0)).count() == 0


def test_null_ids_link_and_bridge(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [(5, " ".join(base)), (None, " ".join(base[:36])), (3, " ".join(base[:32])), (None, "x y z"), (None, "x y z")]
    got = jaccard_join.group_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(3, 3), (5, 3)]
    assert sorted(str(r["component_id"]) for r in got if not r["doc_id"]) == ["3", "None", "None"]


def test_bands_follow_what_is_measured():
    edges = jaccard_join.band_edges(500, 3, 4)
    assert [e[0] for e in edges[1:]] == [e[1] + 1 for e in edges[:-1]] and edges[-1][1] >= 500
    rare = jaccard_join.plan_bands(edges, [(1000, 0.01)] * len(edges), 3, 4)
    common = jaccard_join.plan_bands(edges, [(10**9, 0.5)] * len(edges), 3, 4)
    assert not rare[-1].deletion and common[-1].deletion


@pytest.mark.parametrize("share", [0.0, 0.9])
def test_jaccard_with_either_kind_of_segments(spark, monkeypatch, share):
    """The links do not depend on the plan: all bands exact, or all with one-deletion neighbourhoods."""
    monkeypatch.setattr(jaccard_join, "measure_bands", lambda rows, edges, num, den: [(10**12 if share else 0, share)] * len(edges))
    rng, rows = np.random.default_rng(8), []
    for g in range(30):
        base = [f"w{g}x{rng.integers(50)}" for _ in range(rng.integers(5, 60))]
        for k in range(4):
            w = list(base)
            for _ in range(rng.integers(0, 1 + len(w) // 14)):
                w[rng.integers(len(w))] = f"z{rng.integers(10**6)}"
            rows.append((10 * g + k, " ".join(w)))
    got = sorted(tuple(r) for r in jaccard_join.group_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == components([(i, sets_of(x)) for i, x in rows])


def test_block_sizes_keep_blocks_filled():
    for total in (0, 10**6, 10**9, 15 * 10**12):
        size, buckets = block_sizes(total)
        assert total / max(1, -(-total // size)) / buckets >= min(256, total / buckets) * 0.9
        assert size <= max(1_500_000, 62_000_000)


def removed_as_brute(got, rows):
    want = collections.Counter((i, text, n, tuple(sorted(firsts))) for (i, _), (text, n, firsts) in zip(rows, brute.without_repeats(rows)))
    have = collections.Counter((r["doc_id"], r["text"], r["n_removed"], None) for r in got)
    assert have == collections.Counter((i, t, n, None) for i, t, n, _ in want.elements())
    seen = {(r["doc_id"], r["text"]): set(r["first_doc_ids"]) for r in got}
    assert all(set(f) == seen[i, t] for i, t, _, f in want)


def test_substring(docs, none):
    got = {(r["doc_id"], r["n_removed"] > 0): r for r in substring_dedup.remove_repeats(docs).collect()}
    assert (1, False) in got and (2, True) in got and (3, True) in got
    assert got[1, False]["text"] == SAID and got[3, True]["text"] == "" and got[2, True]["first_doc_ids"] == [1]
    assert got[2, True]["text"].startswith("Before all that, a preface was written here.") and "wizards" not in got[2, True]["text"]
    assert got[4, False]["text"] is None and got[5, False]["text"] == ""
    assert substring_dedup.remove_repeats(none).count() == 0
    removed_as_brute(substring_dedup.remove_repeats(docs).collect(), TEXTS)


def test_substring_against_all_spans(spark):
    """Passages planted inside sentences, and sentences from a small stock, against a search for every span."""
    rng = np.random.default_rng(5)
    write = lambda n: " ".join(f"w{x}" + ("." if d < 0.02 else "") for x, d in zip(rng.integers(0, 10**6, n), rng.random(n)))
    shared = [write(n) for n in (51, 52, 60, 75, 120, 50, 300)]
    rows = [(i, " ".join([write(int(rng.integers(1, 40))), shared[i % 7].upper() if i % 2 else shared[i % 7], write(int(rng.integers(0, 40))), *([shared[(i + 2) % 7]] if i % 3 else [])])) for i in range(40)]
    rows += [(90, write(30) + " " + rows[3][1][20:900]), (91, rows[0][1] + "\n" + rows[0][1]), (92, write(200)), (93, "é w. " * 300), (93, "another text of this id. " + shared[4])]
    stock = [" ".join(f"s{x}" for x in rng.integers(0, 90, rng.integers(2, 14))).capitalize() + rng.choice([".", "!", "?\"", ".\n", "\n"]) for _ in range(40)]
    rows += [(100 + i, rng.choice([" ", "  ", "\t"]).join(stock[x] for x in (int(rng.integers(0, 34)) + np.arange(rng.integers(1, 7))))) for i in range(60)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (200, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    removed_as_brute(got, rows)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[92] == dict(rows)[92] and texts[0] == rows[0][1]


def test_substring_over_many_chunks(spark, monkeypatch):
    """The same result where every document is a chunk of its own."""
    monkeypatch.setattr(substring_dedup, "block_sizes", lambda n: (1, 16))
    rows = [(i, SAID + f" number {i} " + SAID.replace("fox", f"fox{i % 3}")) for i in range(12)]
    removed_as_brute(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_filter_misses_nothing_and_heavy_keys_join(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"))
    wanted = spark.range(0, 700, 3).select(F.col("id").alias("w"))
    got = flag_wanted(rows, F.xxhash64("k"), wanted, F.xxhash64("w"), "hit").collect()
    assert len(got) == 5000 and all(r["hit"] for r in got if r["k"] % 3 == 0) and sum(r["hit"] for r in got) < 1800
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 1).when(F.col("id") < 2990, F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.where("k is not null and k <> 2500").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    plain = left.join(right.drop("n"), ["k"], "left").collect()
    assert sorted(map(str, join_heavy(left, right, ["k"], "n", 3000, 5).collect())) == sorted(map(str, plain))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: label[n] for a, b in edges if a != b for n in (a, b)}


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, d[::-1]))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii(spark, docs, none):
    hard = ["a@b.c+d@e.f", "1.2.3.4.5.6.7.8 001.2.3.0255", "4111-1111-1111-1111 5", "+1 ()-. 2 +12345678901234567", "é 10.0.0.1 中 a@b.co", "a.b@c.d.e@f.g"]
    rows = [*TEXTS, *[(50 + k, x) for k, x in enumerate(hard)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r, (_, x) in zip(pii.digest(df).collect(), rows):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE for m in re.finditer(p, x or "") if holds(k, m[0])]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and r["spans"].startswith(",".join(spans))
    found = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert found[12].startswith("IBAN account <IBAN> or phone <LOCAL_PHONE>.") and found[4] is None and "<CARD>" in found[11]
    assert pii.digest(none).count() == 0


def test_pii_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "call 555 123 4567 or a@b.co", "mine", [1], 2, "x")], "doc_id long, text string, pii string, pii_base array<int>, pii_more int, _spans string")
    got = pii.mask(rows).collect()[0]
    assert tuple(got) == (1, "call <LOCAL_PHONE> or <EMAIL>", "mine", [1], 2, "x")
    assert [s["kind"] for s in pii.find(rows).collect()[0]["pii"]] == ["email", "local_phone"]


def test_pii_context_on_either_side(spark):
    texts = ["555 123 4567 is my phone", "phone 555 123 4567", "555 123 4567 is a number", "phone " + "x " * 40 + "555 123 4567"]
    got = [r["spans"] for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [bool(x) for x in got] == [True, True, False, False]


def test_host_verdicts(spark):
    """Hosts' shrunk rates and verdicts by hand; a host most of whose documents are junk loses all of them."""
    good = " ".join(f"word{k}" for k in range(60))
    odd = " ".join(f"word{k} #*" for k in range(60))  # fails a rule that is not of the base
    rows = [(h * 100 + k, odd if (k < 30 if h == 3 else k < h) else good, f"h{h}" if h else None) for h in range(4) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, body string, site string")
    got = quality.judge(df, host_col="site", text_col="body").collect()
    n, failed = [40] * 4, [0, 1, 2, 30]
    mean, r = sum(failed) / 160, [f / 40 for f in failed]
    v = sum((x - sum(r) / 4) ** 2 for x in r) / 3
    strength = min(max(mean * (1 - mean) / (v - mean * (1 - mean) / 40) - 1, 1), 1000)
    rate = [(f + mean * strength) / (m + strength) for f, m in zip(failed, n)]
    assert rate[3] > 0.5 > max(rate[:3])
    for x in got:
        h = int(x["host"][1:] or 0) if x["host"] else 0
        assert abs(x["host_rate"] - rate[h]) < 1e-12 and x["kept"] == (h != 3) and not x["base_failed"]
    names = spark.createDataFrame([(1, good, "a", 5, True)], "doc_id long, text string, source string, n_words int, kept boolean")
    assert quality.judge(names).collect()[0]["n_words"] == 60


def test_quality(docs, none):
    for r in quality.judge(docs).collect():
        x = next(t for i, t in TEXTS if i == r["doc_id"]) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k for j in range(len(w) - 2) if c[w[j], w[j + 1], w[j + 2]] > 1 for k in (j, j + 1, j + 2)}
        lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])
    assert quality.judge(none).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(size=8) * 0.25).tolist()) for i in range(240)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, rows[0][1]), (904, [1.0, None] * 4), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [])]
    got = {r["vec_id"]: r for r in embedding_dedup.group_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=40, block_rows=16).collect()}
    fine = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i < 900 or i in (903, 905, 906)]
    link = {i: {j for j, w in fine if j != i and len(w) == len(v) and v @ w >= 0.95} for i, v in fine}
    label = {i: i for i, _ in rows}
    for _ in rows:
        for i in link:
            label[i] = min([label[i], *(label[j] for j in link[i])])
    for i, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(link.get(i, ())), label[i], label[i] == i)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    two = embedding_dedup.group_vectors(df, cell_rows=12, block_rows=8, most_cells=3).collect()  # cells that are parted again
    assert sorted(map(str, two)) == sorted(map(str, got.values()))
    same = spark.createDataFrame([(1, [3.0, 4.0], "x"), (1, [3.0, 4.0], "y"), (None, [6.0, 8.0], None), (7, [0.3, 0.4], "z"), (None, None, "q")], "vec_id long, embedding array<double>, kept string")
    assert sorted(map(str, (tuple(r) for r in embedding_dedup.group_vectors(same).collect()))) == sorted(map(str, [(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (7, 3, 1, False), (None, 0, None, True)]))
    assert embedding_dedup.group_vectors(df.limit(0)).count() == 0


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), 5))
    rows = [(i, " ".join([word() for _ in range(40)] + ["grubworm"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(400)]
    texts, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    held = [r for r in toxicity.classify(texts, labels).collect() if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.9 * len(held)
    plain = toxicity.classify(docs, labels.limit(0)).collect()
    assert len(plain) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in plain)
    assert toxicity.classify(none, labels.limit(0)).count() == 0
    one = toxicity.classify(texts, labels.where("toxic = 1")).collect()
    assert len(one) == 400 and all(r["predicted"] == 1 for r in one)
    clash = texts.select("doc_id", "text", F.lit(0.5).alias("score"), F.lit("k").alias("id"), F.lit(1).alias("y"))
    model = toxicity.train(texts, labels)
    assert toxicity.keep_clean(clash, model).columns == clash.columns and {r["id"] for r in toxicity.keep_clean(clash, model).collect()} == {"k"}


def plain_slots(text, bits):
    out = collections.Counter()
    s = [ord(c) for c in f" {text.lower()} "]
    for n in (3, 4, 5, 6):
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * 0x9E3779B1 + c) % 2**32
            h ^= n * 0x85EBCA6B % 2**32
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
            out[h >> (32 - bits)] += 1
    return out


def test_toxicity_ratios_and_scores_by_hand(spark):
    """N-grams, log-count ratios, the fitted weights' loss and the scores, each against a plain version."""
    rng, bits = np.random.default_rng(9), 12
    rows = [(i, "".join(rng.choice(list("abcde "), 30)) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0 or i % 17 == 0)) for i in range(120)]
    texts, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(texts, labels, features=64, bits=bits, penalty=1.0, steps=3000)
    slots = [set(plain_slots(t, bits)) for _, t, _ in rows]
    for (_, t, _), s in zip(rows, slots):
        assert collections.Counter(toxicity.hashed_ngrams(t, bits).tolist()) == plain_slots(t, bits)
    y = np.array([r[2] for r in rows], float)
    counts = np.array([[sum(s in x and k == c for x, k in zip(slots, y)) for s in range(1 << bits)] for c in (0, 1)])
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    ratio = toxicity.log_count_ratios(counts, n)
    k = int(np.argmax(counts[1]))
    assert abs(ratio[k] - np.log((counts[1][k] + 1) / (n[1] + 2) * (n[0] + 2) / (counts[0][k] + 1))) < 1e-12
    chosen = np.flatnonzero(model.place >= 0)
    spread = np.sqrt(np.maximum(counts.sum(0) / 120 * (1 - counts.sum(0) / 120), 1e-9))
    apart = np.abs(counts[1] / n[1] - counts[0] / n[0]) / spread * (counts.sum(0) >= 5)
    assert len(chosen) == 64 and apart[chosen].min() >= np.sort(apart)[-64] - 1e-9
    present = np.array([[s in x for s in chosen] for x in slots], float)
    x = present * ratio[chosen] / np.sqrt(np.maximum(present.sum(1), 1))[:, None]
    loss = lambda w: np.mean(np.logaddexp(0, x @ w[:-1] + w[-1]) - y * (x @ w[:-1] + w[-1])) + 0.5 * (w[:-1] ** 2).sum() / 120
    w = np.zeros(65)
    for _ in range(60):  # Newton steps
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        z = np.hstack([x, np.ones((120, 1))])
        keep = np.diag([1.0] * 64 + [0.0]) / 120
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / 120 + keep + 1e-12 * np.eye(65), z.T @ (p - y) / 120 + keep @ w)
    fitted = np.append(model.weights / ratio[chosen], model.intercept)
    assert loss(fitted) <= loss(w) + 1e-3
    for (_, t, _), row in zip(rows, present):
        s = (row @ model.weights) / max(row.sum(), 1) ** 0.5 + model.intercept
        assert abs(model.score(t) - 1 / (1 + np.exp(-s))) < 1e-9


def test_warc(spark):
    long = "<p>" + "é中x" * 40_000 + "</p>"
    rows = [(1, "http://a", long), (5, "http://b", long), (3, None, "same" * 400), (9, "http://c", "same" * 400), (9, "http://c", "same" * 400), (2, "u", None), (4, "u", "WARC/1.0\r\n\r\n"), (6, "u", "x"), (7, "u", "x"), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, pages).collect())
    want = collections.Counter()
    for i, _, x in rows:
        b = (x or "").encode()
        best = max(j or 0 for j, _, y in rows if y == x) if len(b) >= 1000 else i
        want[i, len(b), hashlib.sha1(b).hexdigest(), "response" if best == i else "revisit", None if best == i else best] += 1
    assert got == want
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    clash = pages.select("*", F.lit("x").alias("digest"), F.lit(b"y").alias("body"), F.lit(3).alias("best"), F.lit(1).alias("n"))
    assert sorted(map(str, warc.round_trip(spark, clash).drop("payload").collect())) == sorted(map(str, warc.round_trip(spark, pages).drop("payload").collect()))


def test_archives_are_gzip_of_whole_records(spark, tmp_path):
    """Any reader of gzip sees the records one after the other; each record is a member of its own."""
    rows = [(k, f"http://a/{k}", "text é " * (k * 40)) for k in range(200)]
    path = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), file_bytes=64 * 32_768)
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) > 2
    found = collections.Counter()
    for name in files:
        data = open(name, "rb").read()
        assert gzip.decompress(data) == b"".join(warc.members(data))
        kinds = [f["warc-type"] for m in warc.members(data) for f, _ in warc.parse(m)]
        assert len(kinds) == len(list(warc.members(data))) <= 64
        found.update(kinds)
    assert found["response"] == 200
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(data[:-5]))
    with pytest.raises(ValueError):
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "x"), segment_bytes=1 << 24)


def test_broken_segments_are_errors(spark):
    rows = [("a", "response", None, "u", 1, None, "a", 1, None, b"x"), ("b", "continuation", None, "u", None, None, "a", 3, 2, b"y")]
    with pytest.raises(Exception, match="missing or doubled"):
        warc.reassemble(spark.createDataFrame(rows, warc.RECORDS)).collect()
