"""Other file formats: CSV with ``?``, name and data pairs, dense and sparse matrices, directories of
texts, libsvm, JDBC; and a reader by file extension."""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.numbering import numbered
from millrace.plans.storage import _at, discard, stored
from millrace.sources.arff import read_arff, write_arff
from millrace.sources.svmlight import read_svmlight


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A header line; ``?`` and empty cells are missing; a column is text where a cell is no number."""
    return spark.read.csv(path, header=True, sep=sep, nullValue="?", emptyValue=None, inferSchema=True, quote="'", escape="\\")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, nullValue="?", quote="'", escape="\\")


def read_names(spark: SparkSession, names: str, data: str) -> DataFrame:
    """A file of column declarations (``continuous``, ``ignore``, ``label`` or a list of values; ``|``
    starts a comment) and one of rows, whose last cell is the class. Undeclared values are an error."""
    text = "\n".join(r["value"].split("|")[0] for r in spark.read.text(names).coalesce(1).collect())  # a header, one line a column
    parts = [p.strip().rstrip(".") for p in re.split(r"\.\s*\n|\n", text + "\n") if p.strip()]
    classes = [v.strip() for v in parts[0].split(",")]
    fields, dropped = [], []
    for p in parts[1:]:
        name, kind = (x.strip() for x in p.split(":", 1))
        if kind == "continuous":
            fields.append(T.StructField(name, T.DoubleType()))
        elif kind in ("ignore", "label"):
            fields.append(T.StructField(name, T.StringType()))
            dropped.append(name)
        else:
            fields.append(T.StructField(name, T.StringType(), metadata={"domain": [v.strip() for v in kind.split(",")]}))
    if not (len(classes) == 1 and classes[0] in [f.name for f in fields]):
        fields.append(T.StructField("class", T.StringType(), metadata={"domain": classes}))
    rows = spark.read.csv(data, schema=T.StructType(fields), nullValue="?", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    made = []
    for f in fields:
        c, domain = F.regexp_replace(f"`{f.name}`", r"\.$", "") if f.name == "class" else F.col(f"`{f.name}`"), f.metadata.get("domain")
        if domain:
            c = F.when(c.isNull() | c.isin(domain), c).otherwise(F.raise_error(F.concat(F.lit(f"{f.name} has an undeclared value: "), c)))
        if f.name not in dropped:
            made.append(c.alias(f.name, metadata=f.metadata))
    return rows.select(made)


def write_names(df: DataFrame, names: str, data: str, target: str) -> None:
    """A file of column declarations and one of rows, whose last cell is the class; domains come from the metadata."""
    from millrace.operators.columns import domain_of

    columns = [f for f in df.schema.fields if f.name != target]
    kinds = [f"{f.name}: continuous." if isinstance(f.dataType, T.NumericType) else f"{f.name}: {', '.join(domain_of(df, f.name))}." for f in columns]
    lines = [", ".join(domain_of(df, target)) + ".", *kinds]
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(names)
    df.select(*[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("?")).alias(f.name) for f in columns], target).write.csv(data)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``row, column, value`` from 1. The first line has rows and columns, and for the sparse form, which
    has pairs of column and value, the number of cells. Lines are numbered by their place in the file, so that
    a file is read in many parts; the files of a folder follow each other by part and name, however tasks take them."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("within"))
    part = F.lpad(F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1), 12, "0")
    lines = numbered(lines.where(F.trim("value") != ""), [part, "file", "block", "within"], "line").select("line", F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("c"))
    first = lines.where("line = 1").first()
    if first is None:
        raise ValueError("the file is empty")
    rows = lines.where("line > 1").select((F.col("line") - 1).cast("int").alias("row"), "c")
    if len(first["c"]) < 3:
        return rows.select("row", F.posexplode("c").alias("p", "v")).select("row", (F.col("p") + 1).alias("column"), F.col("v").cast("double").alias("value"))
    at = F.when(F.size("c") > 1, F.sequence(F.lit(1), F.size("c") - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(at, lambda k: F.struct(F.element_at("c", k).cast("int").alias("column"), F.element_at("c", k + 1).cast("double").alias("value")))
    return rows.select("row", F.inline(pairs))


def write_matrix(matrix: DataFrame, path: str, rows: int, columns: int) -> None:
    """The sparse form of ``row, column, value``: a line a row in order, written by as many tasks as there are ranges
    of rows; the first line in a file of its own, which sorts first. A cell beyond ``rows`` or ``columns`` is an error."""
    cells = stored(matrix.where("value <> 0"), "cells")
    n, *ends = cells.agg(F.count("*"), F.min("row"), F.min("column"), F.max("row"), F.max("column")).first()
    if n and (min(ends[:2]) < 1 or ends[2] > rows or ends[3] > columns):
        raise ValueError(f"a cell lies outside {rows} rows and {columns} columns")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "value"))), lambda x: F.concat_ws(" ", x["column"].cast("string"), x["value"].cast("string"))), " ")
    every = matrix.sparkSession.range(1, rows + 1).select(F.col("id").alias("row"))
    lines = every.join(cells.groupBy("row").agg(text.alias("line")), "row", "left").select("row", F.coalesce("line", F.lit(" ")).alias("value"))
    head = matrix.sparkSession.createDataFrame([(0, f"{rows} {columns} {n}")], "row long, value string")
    head.unionByName(lines.select(F.col("row").cast("long"), "value")).orderBy("row").select("value").write.text(path)
    discard(cells)


def write_libsvm(df: DataFrame, path: str, columns: list[str], label: str) -> None:
    """The class first, then ``place:value`` from 1, without zeros; numbers count as classes as they are."""
    pairs = [F.when(F.col(c) != 0, F.concat(F.lit(f"{i}:"), F.col(c).cast("double").cast("string"))) for i, c in enumerate(columns, 1)]
    df.select(F.concat_ws(" ", F.col(label).cast("string"), *pairs).alias("value")).write.text(path)


def write_table(df: DataFrame, path: str) -> None:
    """A table with its columns' metadata in a binary form that is read back whole."""
    df.write.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_xml(df: DataFrame, path: str, relation: str = "data", weight: str | None = None, codec: str = "none") -> None:
    """One ``instance`` a row with its cells as ``value`` elements in order, ``missing="yes"`` for a missing one, and the
    header beside them: names, kinds and labels. A row is a line, so that files are read in parts."""
    fields = [f for f in df.schema.fields if f.name != weight]

    def escape(c):
        c = c.cast("string")
        for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;")):
            c = F.replace(c, F.lit(raw), F.lit(shown))
        return c

    cells = [F.coalesce(F.concat(F.lit("<value>"), escape(F.col(f"`{f.name}`")), F.lit("</value>")), F.lit('<value missing="yes"/>')) for f in fields]
    start = F.coalesce(F.concat(F.lit('<instance weight="'), F.col(weight).cast("string"), F.lit('">')), F.lit("<instance>")) if weight else F.lit("<instance>")
    df.select(F.concat(start, *cells, F.lit("</instance>")).alias("value")).write.option("compression", codec).text(f"{path}/body")
    head = ET.Element("dataset", name=relation)
    for f in fields:
        domain = (f.metadata or {}).get("domain")
        kind = "nominal" if domain else "numeric" if isinstance(f.dataType, T.NumericType) else "string"
        a = ET.SubElement(head, "attribute", name=f.name, type=kind)
        for v in domain or []:
            ET.SubElement(a, "label").text = v
    df.sparkSession.createDataFrame([(ET.tostring(head, "unicode"),)], "value string").coalesce(1).write.text(f"{path}/header")


def read_xml(spark: SparkSession, path: str, weight: str | None = None) -> DataFrame:
    """Rows of ``write_xml``, compressed or not; with ``weight`` a column of the rows' weights, 1 without."""
    head = ET.fromstring("".join(r["value"] for r in spark.read.text(f"{path}/header").collect()))  # one line a file
    cells = "struct<_missing:string,_VALUE:string>"
    rows = spark.read.format("xml").option("rowTag", "instance").option("multiLine", False).schema(f"_weight double, value array<{cells}>").load(f"{path}/body")
    made = []
    for i, a in enumerate(head.findall("attribute")):
        c, domain = F.get("value", F.lit(i)), [x.text for x in a.findall("label")]
        raw = F.when(F.coalesce(c["_missing"], F.lit("no")) != "yes", F.coalesce(c["_VALUE"], F.lit("")))
        made.append((raw.try_cast("double") if a.get("type") == "numeric" else raw).alias(a.get("name"), metadata={"domain": domain} if domain else {}))
    return rows.select(*made, *([F.coalesce("_weight", F.lit(1.0)).alias(weight)] if weight else []))


def save(df: DataFrame, path: str, mode: str = "error", kind: str | None = None, **options) -> None:
    """By extension or ``kind``; ``mode`` as Spark's writers have it: error, overwrite, append or ignore."""
    kind = kind or re.sub(r"\.gz$", "", path).rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc", "json"):
        getattr(df.write.mode(mode).options(**options), kind)(path)
        return
    writers = {"arff": write_arff, "csv": write_csv, "xrff": write_xml}
    if kind not in writers:
        raise ValueError(f"no writer for .{kind}")
    found = _exists(df.sparkSession, path)
    if found and mode == "ignore":
        return
    if found and mode == "error":
        raise ValueError(f"{path} is there")
    if found and mode == "overwrite":
        files, where = _at(df.sparkSession, path)
        files.delete(where, True)
    writers[kind](df, path if mode != "append" or not found else f"{path}/more-{uuid.uuid4().hex}", **options)


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def write_lines(df: DataFrame, path: str, codec: str = "gzip") -> None:
    """Text lines in compressed files."""
    df.write.option("compression", codec).text(path)


def can_stream(kind: str) -> bool:
    """Whether a format can be read row by row as files arrive, besides as a whole."""
    return kind in ("csv", "parquet", "orc", "json", "text", "libsvm", "dat")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """``text, filename, class``: one row a file, its folder is the class."""
    rows = spark.read.text(f"{path}/*", wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    return rows.select(F.col("value").alias("text"), F.regexp_extract("p", "([^/]+)$", 1).alias("filename"), F.regexp_extract("p", "([^/]+)/[^/]+$", 1).alias("class"))


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """Dense ``features``, then ``label``."""
    from pyspark.ml.functions import vector_to_array

    return spark.read.format("libsvm").load(path).select(vector_to_array("features").alias("features"), "label")


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """A query that the database runs; give ``partitionColumn``, bounds and ``numPartitions`` for many tasks."""
    given = {"dbtable": f"({query}) q"} if "partitionColumn" in options else {"query": query}
    return typed(spark.read.format("jdbc").options(url=url, **given, **options).load())


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", key: str | None = None, order: list[str] = (), **options) -> None:
    """Appends rows, with a running number as ``key`` where one is named."""
    rows = numbered(df, list(order) or df.columns, key) if key else df
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def query_views(spark: SparkSession, views: dict[str, DataFrame], query: str) -> DataFrame:
    """An SQL query over named tables, typed as one that a database answers."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return typed(spark.sql(query))


def typed(df: DataFrame) -> DataFrame:
    """Numbers as doubles, booleans as the texts false and true, times as milliseconds."""
    made = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("string").alias(f.name, metadata={"domain": ["false", "true"]})
        elif isinstance(f.dataType, T.NumericType):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.unix_millis(c.cast("timestamp")).cast("double").alias(f.name)
        made.append(c)
    return df.select(made)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    kind = re.sub(r"\.gz$", "", path).rsplit(".", 1)[-1].lower()
    readers = {"arff": read_arff, "csv": read_csv, "tsv": lambda s, p: read_csv(s, p, "\t"), "libsvm": read_libsvm, "dat": read_svmlight, "mat": read_matrix, "xrff": read_xml, "parquet": lambda s, p: s.read.parquet(p), "orc": lambda s, p: s.read.orc(p)}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind](spark, path)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows as further files with a header each; all have the same columns."""
    df.write.csv(path, header=True, nullValue="?", quote="'", escape="\\", mode="append")


def write_directory(df: DataFrame, path: str, name: str, text: str, target: str) -> None:
    """One file a row, in a folder of its class, named by ``name``. The names must be distinct.

    Rows are written by the task that holds them, through the file system of ``path``: a file of text
    each, as small files are what the format is.
    """
    n = df.select(name).distinct().count()
    if n != df.count():
        raise ValueError("names are not distinct")
    root = path.rstrip("/")
    rows = df.select(F.concat(F.lit(f"{root}/"), F.col(target), F.lit("/"), F.col(name).cast("string"), F.lit(".txt")).alias("path"), F.col(text).alias("text"))

    def run(tables):
        import pandas as pd
        from pyarrow import fs

        for t in tables:
            for where, content in zip(t["path"], t["text"]):
                files, inner = fs.FileSystem.from_uri(where)
                files.create_dir(inner.rsplit("/", 1)[0])
                with files.open_output_stream(inner) as f:
                    f.write(content.encode())
            yield pd.DataFrame({"n": [len(t)]})

    rows.mapInPandas(run, "n long").agg(F.sum("n")).collect()


def write_scores(scores: DataFrame, path: str) -> None:
    """Lines of ``idx label prob actual``."""
    scores.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("idx", "label", "prob", "actual")]).alias("value")).write.text(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(parts[0].cast("long").alias("idx"), parts[1].alias("label"), parts[2].cast("double").alias("prob"), F.get(parts, F.lit(3)).alias("actual"))
