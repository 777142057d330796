from millrace.functions.predicates import compile_predicate
from millrace.sources.arff import read_arff, write_arff
from millrace.sources.svmlight import read_svmlight, write_svmlight


def test_arff(spark, tmp_path):
    p = tmp_path / "a.arff"
    p.write_text("% note\n@relation t\n@attribute s string\n@attribute n {r,g}\n@attribute x numeric\n@data\n'a, b',g,1.5\n?,?,?\n{0 wall, 2 4.3}\n")
    rows = [tuple(r) for r in read_arff(spark, str(p)).collect()]
    assert rows == [("a, b", "g", 1.5), (None, None, None), ("wall", "r", 4.3)]
    write_arff(read_arff(spark, str(p)), str(tmp_path / "out"))
    assert [tuple(r) for r in read_arff(spark, str(tmp_path / "out")).collect()] == rows


def test_svmlight(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("1 qid:3 1:0.5 7:2 # note\n\n-1 2:1\n")
    df = read_svmlight(spark, str(p))
    assert {(r["label"], tuple(sorted(r["features"].items()))) for r in df.collect()} == {(1.0, ((1, 0.5), (7, 2.0))), (-1.0, ((2, 1.0),))}
    write_svmlight(df, str(tmp_path / "out"))
    assert read_svmlight(spark, str(tmp_path / "out")).count() == 2


def test_predicate_precedence_and_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (5.0, "b"), (None, "c")], "x double, y string")
    keep = lambda t: [r["y"] for r in df.where(compile_predicate(t, df.columns)).collect()]
    assert keep("not (ATT1 < 3)") == ["b", "c"]
    assert keep("ATT2 is 'a' or ATT1 > 3 and ATT2 is 'b'") == ["b"]
    assert keep("ismissing(ATT1)") == ["c"]
    assert keep("(ATT1 + 1) * 2 >= 12") == ["b"]
