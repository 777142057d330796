"""Tokens, word vectors and n-grams, all as built-in expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = " \r\n\t.,;:'\"()?!"


def delimited(c: Column, delimiters: str = DELIMITERS) -> Column:
    return F.filter(F.split(c, "[" + re.escape(delimiters) + "]+"), lambda w: w != "")


def alphabetic(c: Column) -> Column:
    """Runs of A-Z and a-z."""
    return F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))


def ngrams(tokens: Column, least: int = 1, most: int = 3) -> Column:
    """Runs of ``most`` down to ``least`` tokens, joined by spaces."""

    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.concat(*[of(n) for n in range(most, least - 1, -1)])


def without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda w: ~F.lower(w).isin(stop))


def of_length(tokens: Column, least: int, most: int) -> Column:
    return F.filter(tokens, lambda w: F.length(w).between(least, most))


def dictionary(df: DataFrame, text: str, k: int, target: str | None = None) -> DataFrame:
    """``word``: of each class, those at least as frequent as its k-th most frequent one, ties included."""
    words = df.select(F.explode(delimited(F.col(text))).alias("word"), (F.col(target) if target else F.lit(0)).alias("y"))
    counts = words.groupBy("y", "word").agg(F.count("*").alias("n"))
    # Few counts are distinct: the k-th largest is found from the number of words that have each.
    sizes = counts.groupBy("y", "n").agg(F.count("*").alias("m"))
    from pyspark.sql import Window

    above = Window.partitionBy("y").orderBy(F.desc("n"))
    cut = sizes.withColumn("upto", F.sum("m").over(above)).groupBy("y").agg(
        F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("n"))), F.min("n")).alias("cut")
    )
    return counts.join(cut, counts["y"].eqNullSafe(cut["y"])).where("n >= cut").select("word").distinct()


def word_vectors(df: DataFrame, key: str, text: str, k: int = 1000, target: str | None = None, counts: bool = False) -> DataFrame:
    """Sparse form ``key, word, value`` of the dictionary's words; value 1 unless ``counts``."""
    words = df.select(F.col(key), F.explode(delimited(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").cast("double").alias("value"))
    found = words.join(dictionary(df, text, k, target), "word", "left_semi").select(key, "word", "value")
    return found if counts else found.withColumn("value", F.lit(1.0))


def tf_idf(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, word, weight``: the count times ``ln(rows / rows with the word)``; words of all rows go."""
    words = df.select(F.col(key), F.explode(delimited(F.lower(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))
    rows = df.count()
    idf = words.groupBy("word").agg(F.log(F.lit(float(rows)) / F.count("*")).alias("idf")).where("idf > 0")
    return words.join(idf, "word").select(key, "word", (F.col("tf") * F.col("idf")).alias("weight"))


def lower_case(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def with_prefix(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose text begins with one of the prefixes, with the longest such ``prefix``: one look-up a length."""
    by_length: dict[int, list[str]] = {}
    for p in dict.fromkeys(prefixes):
        by_length.setdefault(len(p), []).append(p)
    found = F.lit(None).cast("string")
    for n in sorted(by_length):
        start = F.substring(column, 1, n)
        found = F.when(start.isin(by_length[n]), start).otherwise(found)
    return df.withColumn("prefix", found).where(F.col("prefix").isNotNull())


def term_vectors(df: DataFrame, key: str, text: str, stop: list[str] = (), least: int = 1, most: int = 1000, stem: Column | None = None, counts: bool = True) -> DataFrame:
    """``key, word, value``: tokens of letters in lower case, without stop words and those of other lengths, stemmed
    with ``stem`` (a function of a column of tokens), and how often each occurs."""
    tokens = of_length(without(lower_case(alphabetic(F.coalesce(F.col(text), F.lit("")))), list(stop) or [""]), least, most)
    words = df.select(F.col(key), F.explode(stem(tokens) if stem else tokens).alias("word"))
    n = words.groupBy(key, "word").agg(F.count("*").cast("double").alias("value"))
    return n if counts else n.withColumn("value", F.lit(1.0))


def weighted_words(df: DataFrame, key: str, text: str, stop: list[str] = (), stem=None) -> DataFrame:
    """``key, word, value``: counts of word tokens without stop words, stemmed."""
    tokens = without(lower_case(delimited(F.coalesce(F.col(text), F.lit("")))), list(stop) or [""])
    words = df.select(F.col(key), F.explode(stem(tokens) if stem else tokens).alias("word"))
    return words.groupBy(key, "word").agg(F.count("*").cast("double").alias("value"))


def character_ngrams(c: Column, n: int) -> Column:
    """Runs of ``n`` characters; a shorter text is one run."""
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.sequence(F.lit(1), F.lit(1)))
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))))


# Stemmers ------------------------------------------------------------------------------------


def _measure(w: str) -> int:
    """How often a run of vowels is followed by consonants."""
    return len(re.findall("v+c+", "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))))


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and not (w[i] == "y" and i and _consonant(w, i - 1))


def _closed(w: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    n = len(w)
    return n >= 3 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


#: Fixed values of the published algorithm: endings of its second, third and fourth step, each with what replaces it.
_SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
           "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(word: str) -> str:
    """The stem of an English word by Porter's rules of 1980."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    vowel = lambda x: any(not _consonant(x, i) for i in range(len(x)))
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (cut := next((e for e in ("ed", "ing") if w.endswith(e) and vowel(w[: -len(e)])), None)) is not None:
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _closed(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_SECOND, _THIRD):
        end = next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)
        if end is not None and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = next((e for e in sorted(_FOURTH, key=len, reverse=True) if w.endswith(e)), None)
    if end is not None and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _closed(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: Fixed values of Lovins' paper of 1968: the conditions on what is left of a word, by letter.
def _lovins_allows(code: str, stem: str) -> bool:
    ends, n = stem.endswith, len(stem)
    rules = {
        "A": True, "B": n > 2, "C": n > 3, "D": n > 4, "E": not ends("e"), "F": n > 2 and not ends("e"), "G": n > 2 and ends("f"), "H": ends(("t", "ll")),
        "I": not ends(("o", "e")), "J": not ends(("a", "e")), "K": n > 2 and (ends(("l", "i")) or n > 2 and stem[-1] == "e" and stem[-3] == "u"),
        "L": not ends(("u", "x")) and (not ends("s") or ends("os")), "M": not ends(("a", "c", "e", "m")), "N": n > 3 if n > 2 and stem[-3] == "s" else n > 2,
        "O": ends(("l", "i")), "P": not ends("c"), "Q": n > 2 and not ends(("l", "n")), "R": ends(("n", "r")), "S": ends("dr") or ends("t") and not ends("tt"),
        "T": ends("s") or ends("t") and not ends("ot"), "U": ends(("l", "m", "n", "r")), "V": ends("c"), "W": not ends(("s", "u")),
        "X": ends(("l", "i")) or n > 2 and stem[-1] == "e" and stem[-3] == "u", "Y": ends("in"), "Z": not ends("f"), "AA": ends(("d", "f", "ph", "th", "l", "er", "or", "es", "t")),
        "BB": n > 2 and not ends("met") and not ends("ryst"), "CC": ends("l"),
    }
    return bool(rules[code])


#: Fixed values of the same paper: how the ends of stems are respelt, in order; the first that holds is used.
_RESPELT = [("iev", "ief", ""), ("uct", "uc", ""), ("umpt", "um", ""), ("rpt", "rb", ""), ("urs", "ur", ""), ("istr", "ister", ""), ("metr", "meter", ""), ("olv", "olut", ""),
            ("ul", "l", "aoi"), ("bex", "bic", ""), ("dex", "dic", ""), ("pex", "pic", ""), ("tex", "tic", ""), ("ax", "ac", ""), ("ex", "ec", ""), ("ix", "ic", ""), ("lux", "luc", ""),
            ("uad", "uas", ""), ("vad", "vas", ""), ("cid", "cis", ""), ("lid", "lis", ""), ("erid", "eris", ""), ("pand", "pans", ""), ("end", "ens", "s"), ("ond", "ons", ""),
            ("lud", "lus", ""), ("rud", "rus", ""), ("her", "hes", "pt"), ("mit", "mis", ""), ("ent", "ens", "m"), ("ert", "ers", ""), ("et", "es", "n"), ("yt", "ys", ""), ("yz", "ys", "")]


def lovins(word: str, endings: dict[str, str], repeat: bool = False) -> str:
    """The stem of an English word by Lovins' rules. ``endings`` is the published table from ending to the letter of
    its condition, which is long and so a parameter. With ``repeat`` the stem is stemmed until it stays."""
    w = word.lower()
    for n in range(min(11, len(w) - 2), 0, -1):
        code = endings.get(w[-n:])
        if code is not None and _lovins_allows(code, w[:-n]):
            w = w[:-n]
            break
    if len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdglmnprst":
        w = w[:-1]
    for end, new, unless in _RESPELT:
        if w.endswith(end) and not (unless and len(w) > len(end) and w[-len(end) - 1] in unless):
            w = w[: -len(end)] + new
            break
    return lovins(w, endings, True) if repeat and w != word.lower() else w


def same(word: str) -> str:
    return word


def stemmed(stem) -> Column:
    """A function of a column of tokens that stems each. A batch stems every distinct token once."""
    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in known:
                known[w] = stem(w)
            return known[w]

        return lists.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return run


def stop_words(language: str = "english") -> list[str]:
    """A public stop list, that of Spark's own remover."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)
