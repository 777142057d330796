"""The pipeline's stages, each against a plain statement of what it decides."""

import brute
import corpus_pipeline as P
from millrace.llm import pii, toxicity
from millrace.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, at = table(spark, DATA, "documents"), {}
    columns = docs.columns
    at["in"] = docs
    for name, stage in P.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = at[name] = spark.read.parquet(str(tmp_path / name))
    for name, _ in P.STAGES[:-1]:
        assert at[name].columns == columns
    text = {k: {r["doc_id"]: r["text"] for r in v.collect()} for k, v in at.items() if k != "packing"}

    model = toxicity.train(at["in"], table(spark, DATA, "labels").where(~toxicity.held_out()))
    assert text["toxicity"] == {i: x for i, x in text["in"].items() if model.score(x) < 0.3}

    sets = {i: brute.shingles(x) for i, x in text["toxicity"].items()}
    label = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    assert text["jaccard_join"] == {i: text["toxicity"][i] for i in sets if label[i] == i}

    assert text["substring_dedup"].keys() == text["jaccard_join"].keys()
    rows = list(text["jaccard_join"].items())
    assert text["substring_dedup"] == {i: x for (i, _), (x, _, _) in zip(rows, brute.without_repeats(rows))}
    assert any(len(x) < len(text["jaccard_join"][i]) for i, x in text["substring_dedup"].items())

    assert text["pii"].keys() == text["substring_dedup"].keys()
    assert pii.digest(at["pii"]).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    clean = {r["doc_id"] for r in pii.digest(at["substring_dedup"]).where("spans = ''").collect()}
    assert all(text["pii"][i] == text["substring_dedup"][i] for i in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in at["pii"].collect())

    rows = at["packing"].collect()
    assert {r["doc_id"] for r in rows} == set(text["pii"])
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096
