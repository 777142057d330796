"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only built-in column functions run. A pattern's matches and the gaps between them come from
``regexp_extract_all`` and ``split`` of the same text; their lengths, added up in order, are the
positions in code points. All patterns are possessive or without nested repeats, so that matching
is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name

SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: kind, pattern, a test all texts with a match pass, score of a confirmed match.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.7),
    ("card", r"[0-9](?:[ -]?+[0-9])++", r"[0-9][ -]?[0-9]", 0.8),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7),
)
#: What the method adds to the base: account numbers confirmed by mod-97, and numbers that only
#: words such as those below, in the characters before or behind them, make telephone numbers.
ADDED = (
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?+[A-Z0-9]{4}){2,7}+(?:[ -]?+[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8),
    ("local_phone", r"(?<![A-Za-z0-9+.-])\(?+[0-9]{2,4}\)?+[ -][0-9]{3,4}[ -][0-9]{3,4}(?![A-Za-z0-9-]|\.[0-9])", r"[0-9][ -][0-9]", 0.3),
)
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|téléfono|teléfono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "local_phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|téléphone|teléfono)\b",
}


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(value: Column) -> Column:
    plain = F.regexp_replace(value, "[ -]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(acc, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1)


def _confirmed(kind: str, value: Column) -> Column:
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return _mod97(value)
    if kind == "local_phone":
        return n.between(9, 12)
    return F.lit(True)


def _found(text: Column, kind: str, pattern: str, hint: str, base: float, context_chars: int, least: float) -> Column:
    """The confirmed spans of one kind whose score is at least ``least``, in order."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(SPAN)

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        from_ = F.greatest(start - context_chars, F.lit(0))
        near = F.concat(F.substring(text, from_ + 1, start - from_), F.lit(" "), F.substring(text, end + 1, F.lit(context_chars // 2)))
        score = F.lit(base) + F.when(near.rlike(CONTEXT[kind]), F.lit(0.3)).otherwise(F.lit(0.0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))
        kept = F.concat(acc["out"], F.filter(F.array(span), lambda s: s["score"] >= least).cast(SPAN))
        return F.when(x["hit"].isNull(), acc).otherwise(
            F.struct(end.alias("at"), F.when(_confirmed(kind, x["hit"]), kept).otherwise(acc["out"]).alias("out"))
        )

    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.contains(hint) if kind == "email" else text.rlike(hint), spans).otherwise(empty)


def _spans(text_col: str, least_score: float, context_chars: int) -> tuple[Column, Column]:
    """The base spans, and what the method adds."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = [_found(text, *k, context_chars, 0.0) for k in BASE]
    more = [_found(text, *k, context_chars, least_score) for k in ADDED]
    return F.concat(*base), F.concat(*more)


def find(docs: DataFrame, text_col: str = "text", least_score: float = 0.5, context_chars: int = 40) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii``: the base spans, and these with what the method adds.

    A null or empty text has no spans; every row is kept, with all its columns; repeated rows get
    equal spans; an empty table gives no rows. Base spans stay whatever their score; added ones need
    ``least_score``. Context words are looked for in ``context_chars`` characters before a span and
    half as many behind it. Columns of ``docs`` named like the two added ones, in any case, are replaced.
    """
    if text_col.lower() in ("pii", "pii_base"):
        raise ValueError("the text column must not be named like an added one")
    names = [c for c in docs.columns if c.lower() not in ("pii", "pii_base")]
    base, more = _spans(text_col, least_score, context_chars)
    return docs.select(*names, base.alias("pii_base"), more.alias("pii")).withColumn("pii", F.concat("pii_base", "pii"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans by kind, the digest of the base spans, and all spans as text."""
    found = find(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k[0]) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", least_score: float = 0.5, context_chars: int = 40) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans count as one,
    named by the first. Texts without spans, nulls among them, stay as they are, and so do all other
    columns, whatever their names."""
    columns, spans = docs.columns, free_name(docs.columns, "_spans")
    found = docs.withColumn(spans, F.concat(*_spans(text_col, least_score, context_chars)))
    text = F.col(text_col)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out")
        )

    masked = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )
    return found.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).select(*columns)
