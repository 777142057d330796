"""ARFF text: a header of typed columns and a body of comma-separated rows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATTRIBUTE = re.compile(r"""@attribute\s+('[^']*'|"[^"]*"|\S+)\s+(.+)""", re.I)
_CELL = r"""'(?:[^'\\]|\\.)*'|[^,]*"""


def _field(name: str, kind: str) -> T.StructField:
    name, kind = name.strip("'\""), kind.strip()
    if kind.startswith("{"):
        domain = [v.strip().strip("'\"") for v in kind.strip("{}").split(",")]
        return T.StructField(name, T.StringType(), metadata={"domain": domain})
    if kind.lower().split()[0] in ("numeric", "real", "integer"):
        return T.StructField(name, T.DoubleType())
    if kind.lower().startswith("date"):
        pattern = kind[4:].strip().strip("'\"") or "yyyy-MM-dd'T'HH:mm:ss"
        return T.StructField(name, T.TimestampType(), metadata={"format": pattern})
    return T.StructField(name, T.StringType())


def _header(lines: DataFrame) -> list[str]:
    """The lines up to ``@data``, from the start of the first file; more are taken until it is found."""
    n = 256
    while True:
        held = [r["value"] for r in lines.limit(n).collect()]
        for i, x in enumerate(held):
            if x.strip().lower() == "@data":
                return held[: i + 1]
        if len(held) < n:
            raise ValueError("there is no @data line")
        n *= 8


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Dense and sparse rows; ``?`` is missing, cells that a sparse row leaves out are 0, the first
    value of a domain, or for other kinds missing.

    The header ends at ``@data``; every file of a folder may repeat it. A row that begins with ``@`` is a row.
    """
    raw = spark.read.text(path)
    head = _header(raw)
    fields = [_field(m[1], m[2]) for m in map(_ATTRIBUTE.match, [x.strip() for x in head]) if m]
    lines = raw.where(~F.col("value").isin(head)).select(F.trim("value").alias("line"))
    body = lines.where("line <> '' and line not like '\\%%'")
    sparse = F.col("line").startswith("{")
    cells = F.transform(F.regexp_extract_all("line", F.lit(f"(?:^|,)\\s*({_CELL})"), F.lit(1)), lambda x: _unquoted(F.trim(x)))
    inner = F.regexp_replace("line", r"^\{\s*|\s*\}$", "")
    listed = F.transform(F.regexp_extract_all(inner, F.lit(r"(?:^|,)\s*(\d+\s+(?:'(?:[^'\\]|\\.)*'|[^,]*))"), F.lit(1)), lambda x: F.split(x, r"\s+", 2))
    entries = F.map_from_arrays(F.transform(listed, lambda x: x[0]), F.transform(listed, lambda x: _unquoted(F.trim(F.coalesce(F.get(x, F.lit(1)), F.lit("?"))))))
    rows = body.select(sparse.alias("s"), cells.alias("c"), F.when(sparse, entries).alias("m"))
    made = []
    for i, f in enumerate(fields):
        zero = f.metadata["domain"][0] if "domain" in (f.metadata or {}) else "0" if isinstance(f.dataType, T.DoubleType) else None
        raw = F.when(F.col("s"), F.coalesce(F.try_element_at(F.col("m"), F.lit(str(i))), F.lit(zero))).otherwise(F.get("c", F.lit(i)))
        cell = F.when(raw != "?", raw)
        if "format" in (f.metadata or {}):
            cell = F.to_timestamp(cell, f.metadata["format"])
        made.append(cell.cast(f.dataType).alias(f.name, metadata=f.metadata or {}))
    return rows.select(made)


def _unquoted(x):
    """A quoted cell without its quotes, and with what stands behind a backslash."""
    inner = F.regexp_replace(F.regexp_replace(x, "^'|'$", ""), r"\\(.)", "$1")
    return F.when(x.startswith("'"), inner).otherwise(x)


def header_lines(df: DataFrame, relation: str) -> list[str]:
    head = [f"@relation {relation}"]
    for f in df.schema.fields:
        domain, kind = (f.metadata or {}).get("domain"), "string"
        if domain:
            kind = "{" + ",".join(domain) + "}"
        elif isinstance(f.dataType, T.NumericType):
            kind = "numeric"
        elif isinstance(f.dataType, (T.TimestampType, T.DateType)):
            kind = f'date "{(f.metadata or {}).get("format", _DATE)}"'
        head.append(f"@attribute '{f.name}' {kind}")
    return [*head, "@data"]


_DATE = "yyyy-MM-dd'T'HH:mm:ss"


def write_arff(df: DataFrame, path: str, relation: str = "data", sparse: bool = False) -> None:
    """Files with a header each, one a task; domains and date formats come from the columns' metadata. ``sparse`` leaves
    out zeros and first values of domains."""
    quote = lambda c: F.concat(F.lit("'"), F.regexp_replace(c.cast("string"), r"(['\\])", r"\\$1"), F.lit("'"))

    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            c = F.when(~F.isnan(c.cast("double")), c.cast("string"))
        elif isinstance(f.dataType, (T.TimestampType, T.DateType)):
            c = quote(F.date_format(c, (f.metadata or {}).get("format", _DATE)))
        else:
            c = quote(c)
        return F.coalesce(c, F.lit("?"))

    if sparse:
        kept = []
        for i, f in enumerate(df.schema.fields):
            domain = (f.metadata or {}).get("domain")
            zero = F.lit(domain[0]) if domain else F.lit(0.0) if isinstance(f.dataType, T.NumericType) else F.lit(None)
            same = F.coalesce(F.col(f"`{f.name}`") == zero, F.lit(False))
            kept.append(F.when(~same, F.concat(F.lit(f"{i} "), cell(f))))
        value = F.concat(F.lit("{"), F.concat_ws(",", *kept), F.lit("}"))
    else:
        value = F.concat_ws(",", *[cell(f) for f in df.schema.fields])
    _with_head(df.select(value.alias("value")), header_lines(df, relation)).write.text(path)


def _with_head(lines: DataFrame, head: list[str]) -> DataFrame:
    """Each partition's lines behind the head."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    return lines.mapInArrow(run, "value string")
