"""Quality rules by host: failures of document rules are aggregated by domain, rates are shrunk with
an empirical beta prior, and the hosts' verdicts are joined back to their documents.

Only built-in column functions run. Word windows are counted within each row, so that no text is
shuffled; hosts are aggregated with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import join_heavy, materialize

_SPACE = r"[\x20\x09-\x0D]+"


def _repeated_window_words(words: Column) -> Column:
    """Words in three-word windows found twice or more. Windows are told apart by 64-bit hashes."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            same = F.filter(p, lambda x, j: F.coalesce(x["h"] == F.get(p, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, j + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        places = F.get(F.transform(F.array(pairs), positions), F.lit(0))
        total = F.aggregate(
            places,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total)

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(F.get(F.transform(F.array(hashes), covered), F.lit(0)))


def measure(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, host`` and the counts of every row. A null text has no words; a null host counts as the empty one.
    Other columns of ``docs`` are not read, whatever their names."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by_words = F.transform(
        F.array(F.filter(F.split(text, _SPACE), lambda w: w != "")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_window_words(w).alias("n_repeat_words")),
    )
    lines = F.transform(
        F.array(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")
    )
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.get(by_words, F.lit(0)).alias("w"),
        F.length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.get(lines, F.lit(0)).alias("n_dup_lines"),
    ).select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def rules(counts: DataFrame) -> DataFrame:
    """Adds ``base_failed``, and ``failed``: any rule, the base among them."""
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    odd = (10 * F.col("n_symbols") > 5 * n) | (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n) | (5 * F.col("n_dup_lines") > n)
    return counts.withColumn("base_failed", base).withColumn("failed", base | odd)


def host_verdicts(rated: DataFrame, most: float = 0.5) -> DataFrame:
    """``host, n, n_failed, rate, host_ok``: rates pulled towards the mean of all hosts.

    The prior's strength is fitted to the hosts' own rates by moments and kept within 1 and 1000
    documents. A host is rejected when its shrunk rate is above ``most``: half of what it gives, as
    far as the prior lets its own documents say so, is bad.
    """
    hosts = rated.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    r = F.col("n_failed") / F.col("n")
    m = hosts.agg(F.sum("n_failed").alias("k"), F.sum("n").alias("n"), F.var_samp(r).alias("v"), F.avg(1 / F.col("n")).alias("i")).first()
    mean = m["k"] / m["n"] if m["n"] else 0.0
    spread = mean * (1 - mean)
    between = max((m["v"] or 0.0) - spread * (m["i"] or 0.0), 0.0)
    strength = min(max(spread / between - 1, 1.0), 1000.0) if between > 0 else 1000.0
    rate = (F.col("n_failed") + mean * strength) / (F.col("n") + strength)
    return hosts.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= most)


def judge(docs: DataFrame, most: float = 0.5, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs`` with its counts, ``base_failed``, the host's ``rate`` and ``kept``.

    The counts are written once to the shared folder, since hosts and documents both read them.
    Repeated rows count as often as they occur, and an empty table gives no rows. A host of many
    documents meets them where they are read. Other columns of ``docs`` are not read.
    """
    rated = materialize(rules(measure(docs, text_col, host_col, id_col)), "quality")
    hosts = host_verdicts(rated, most).select("host", "rate", "host_ok", "n")
    return join_heavy(rated, hosts, ["host"], "n", rated.count()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host", F.col("rate").alias("host_rate"),
    )
