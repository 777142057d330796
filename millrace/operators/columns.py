"""Column filters: each takes a DataFrame and gives one with other columns. Missing cells are nulls.

Statistics are fitted in one aggregation and applied as literals, so that the pass over the rows
stays narrow. Filters that fit have a ``fit``: it returns what applies to later tables with the
statistics of the first, so that test rows are treated as the training rows were.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.predicates import compile_attributes, compile_math
from millrace.plans.naming import Apply, fitted, free
from millrace.plans.numbering import numbered, numbered_within

#: A column of more distinct values than this is no nominal one: its domain is not collected.
MOST_VALUES = 100_000


def _finite(c: Column) -> Column:
    """NaN and infinity become missing."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def column_range(df: DataFrame, spec: str) -> list[str]:
    """Columns of a 1-based range such as ``1-3,last``; ``first`` and ``last`` are allowed."""
    place = lambda s: {"first": 1, "last": len(df.columns)}.get(s.strip()) or int(s)
    chosen: list[str] = []
    for part in spec.split(","):
        lo, _, hi = part.partition("-")
        chosen += df.columns[place(lo) - 1 : place(hi or lo)]
    return chosen


def column_index(df: DataFrame, spec: str) -> str:
    """One column by its place from 1, or by ``first`` or ``last``."""
    found = column_range(df, spec)
    if len(found) != 1:
        raise ValueError(f"{spec!r} is not one column")
    return found[0]


def located(df: DataFrame, kind: str) -> list[str]:
    """Paths of all columns of a kind (numeric, string, date or relational), also within bags."""
    kinds = {"numeric": T.NumericType, "string": T.StringType, "date": (T.TimestampType, T.TimestampNTZType, T.DateType)}

    def walk(schema: T.StructType, before: str) -> list[str]:
        found = []
        for f in schema.fields:
            path, inner = f"{before}{f.name}", f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(inner, T.StructType):
                found += ([path] if kind == "relational" else []) + walk(inner, f"{path}.")
            elif kind in kinds and isinstance(f.dataType, kinds[kind]):
                found.append(path)
        return found

    return walk(df.schema, "")


def remove(df: DataFrame, spec: str, invert: bool = False) -> DataFrame:
    gone = column_range(df, spec)
    return df.select([c for c in df.columns if (c in gone) == invert])


def remove_type(df: DataFrame, kinds: set[str], protect: str | None = None) -> DataFrame:
    return df.select([c for c, t in df.dtypes if t not in kinds or c == protect])


@fitted
def remove_useless(df: DataFrame, max_distinct_percent: float = 99.0) -> Apply:
    """Drops columns with fewer than two values, and text columns that are almost keys.

    One aggregation of extremes for all columns; distinct values are counted for texts that vary alone.
    """
    ends = df.agg(*[x for i, c in enumerate(df.columns) for x in (F.min(F.col(f"`{c}`").cast("string")).alias(f"a{i}"), F.max(F.col(f"`{c}`").cast("string")).alias(f"b{i}"))]).first()
    varied = [c for i, c in enumerate(df.columns) if ends[f"a{i}"] != ends[f"b{i}"]]
    texts = [c for c, t in df.dtypes if t == "string" and c in varied]
    keys: set[str] = set()
    for c in texts:
        n = df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.col(f"`{c}`")).alias("n")).agg(F.count("v").alias("d"), F.sum("n").alias("n")).first()
        if n["d"] * 100.0 > max_distinct_percent * n["n"]:
            keys.add(c)
    keep = [c for c in varied if c not in keys]
    return lambda rows: rows.select([F.col(f"`{c}`") for c in keep])


def reorder(df: DataFrame, order: list[int]) -> DataFrame:
    return df.select([df.columns[i - 1] for i in order])


def copy(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.col(c).alias(f"Copy of {c}") for c in columns])


def add(df: DataFrame, name: str, kind: str, at: int | None = None) -> DataFrame:
    """A column of missing cells at a 1-based place, last without one."""
    names = list(df.columns)
    names.insert(len(names) if at is None else at - 1, name)
    return df.withColumn(name, F.lit(None).cast(kind)).select(names)


def add_id(df: DataFrame, order: list[str], name: str = "ID") -> DataFrame:
    return numbered(df, order, "__id").select(F.col("__id").alias(name), *df.columns)


@fitted
def center(df: DataFrame, columns: list[str]) -> Apply:
    m = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return lambda rows: rows.withColumns({c: F.col(c) - F.lit(m[c]) for c in columns})


@fitted
def standardize(df: DataFrame, columns: list[str]) -> Apply:
    """Centred and divided by the sample deviation; a constant column is only centred."""
    m = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}|m"), F.stddev_samp(c).alias(f"{c}|s"))]).first()
    return lambda rows: rows.withColumns({c: (F.col(c) - F.lit(m[f"{c}|m"])) / F.lit(m[f"{c}|s"] or 1.0) for c in columns})


@fitted
def normalize(df: DataFrame, columns: list[str], scale: float = 1.0, translation: float = 0.0) -> Apply:
    """Onto ``translation .. translation + scale``; a constant column becomes 0. Values of later tables may lie outside."""
    m = df.agg(*[x for c in columns for x in (F.min(c).alias(f"{c}|a"), F.max(c).alias(f"{c}|b"))]).first()

    def one(c: str) -> Column:
        a, b = m[f"{c}|a"], m[f"{c}|b"]
        if a is None or a == b:
            return F.when(F.col(c).isNotNull(), 0.0)
        return (F.col(c) - a) / (b - a) * scale + translation

    return lambda rows: rows.withColumns({c: one(c) for c in columns})


@fitted
def equal_width_bins(df: DataFrame, column: str, bins: int = 10, name: str | None = None) -> Apply:
    """Bin numbers from 0; a value at a cut belongs to the lower bin, a constant column to bin 0."""
    a, b = df.agg(F.min(column), F.max(column)).first()
    if a is None or a == b:
        return lambda rows: rows.withColumn(name or column, F.when(F.col(column).isNotNull(), 0))
    cuts = [a + (b - a) / bins * i for i in range(1, bins)]
    number = sum((F.when(F.col(column) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return lambda rows: rows.withColumn(name or column, F.when(F.col(column).isNotNull(), number))


@fitted
def best_width_bins(df: DataFrame, column: str, most: int = 10, name: str | None = None) -> Apply:
    """Bins of equal width, of the number up to ``most`` whose leave-one-out likelihood is best."""
    a, b = df.agg(F.min(column), F.max(column)).first()
    if a is None or a == b:
        return equal_width_bins.fit(df, column, 1, name)
    c = F.col(column)
    at = [F.least(F.floor((c - a) / ((b - a) / n)), F.lit(n - 1)).cast("int") for n in range(1, most + 1)]
    held = df.where(c.isNotNull()).select(F.explode(F.array(*[F.struct(F.lit(n + 1).alias("n"), x.alias("k")) for n, x in enumerate(at)])).alias("x")).groupBy("x.n", "x.k").count()
    scores: dict[int, float] = {}
    total = 0
    for r in held.collect():  # at most ``most`` times ``most`` rows
        total += r["count"] if r["n"] == 1 else 0
        if r["count"] > 1:
            scores[r["n"]] = scores.get(r["n"], 0.0) + r["count"] * math.log((r["count"] - 1) / ((b - a) / r["n"]))
        else:
            scores[r["n"]] = float("-inf")
    best = min(n for n in scores if scores[n] == max(scores.values()))
    return equal_width_bins.fit(df, column, best, name)


def first_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """Differences of adjacent columns in place of the columns."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, *[(F.col(b) - F.col(a)).alias(f"{b} FO {a}") for a, b in zip(columns, columns[1:])])


def make_indicator(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.withColumn(column, F.col(column).isin(values).cast("double"))


def merge_values(df: DataFrame, column: str, a: str, b: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(a, b), f"{a}_{b}").otherwise(F.col(column)))


def numeric_cleaner(
    df: DataFrame, column: str, low: float, low_to: float, high: float, high_to: float, close_to: float, close_default: float, tolerance: float, decimals: int
) -> DataFrame:
    """Below ``low``, above ``high`` and near ``close_to`` are replaced, in that order, then all is rounded."""
    c = F.col(column)
    v = F.when(c < low, low_to).when(c > high, high_to).when((F.abs(c - close_to) < tolerance) & (c != close_default), close_default).otherwise(c)
    return df.withColumn(column, F.floor(v * 10**decimals + 0.5) / 10**decimals if decimals >= 0 else v)


def numeric_to_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.when(F.col(c) == 0, 0).otherwise(1)) for c in columns})


def nominal_to_binary(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One column a value; two values make one column; a missing cell is missing in all."""
    shown = values[1:] if len(values) == 2 else values
    made = [(F.col(column) == v).cast("double").alias(column if len(values) == 2 else f"{column}={v}") for v in shown]
    return df.select(*[c for c in df.columns if c != column], *made)


@fitted
def replace_missing(df: DataFrame, columns: list[str], weight: str | None = None) -> Apply:
    """Means of numbers and modes of texts, weighted; equal modes go to the first value in order."""
    kinds, w = dict(df.dtypes), F.col(weight) if weight else F.lit(1.0)
    numbers = [c for c in columns if kinds[c] != "string"]
    fill: dict = {}
    if numbers:
        sums = df.agg(*[(F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in numbers]).first()
        fill |= {c: sums[c] for c in numbers}
    for c in set(columns) - set(numbers):
        top = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum(w).alias("w")).orderBy(F.desc("w"), c).first()
        fill[c] = top[c] if top else None
    return lambda rows: rows.withColumns({c: F.coalesce(F.col(c), F.lit(fill[c])) for c in columns})


@fitted
def math_expression(df: DataFrame, column: str, expression: str) -> Apply:
    """Arithmetic and ``ifelse`` over ``A`` (the cell) and ``MIN MAX MEAN SD COUNT SUM SUMSQUARED`` of its column;
    other columns may be called so too. NaN and infinity become missing."""
    c = F.col(f"`{column}`").cast("double")
    names = ("MIN", "MAX", "MEAN", "SD", "COUNT", "SUM", "SUMSQUARED")
    found = df.agg(F.min(c), F.max(c), F.avg(c), F.stddev_samp(c), F.count(c).cast("double"), F.sum(c), F.sum(c * c)).first()
    value = _finite(compile_math(expression, {"A": c} | {n: F.lit(v).cast("double") for n, v in zip(names, found)}).cast("double"))
    return lambda rows: rows.withColumn(column, value)


@fitted
def interquartile_flags(df: DataFrame, column: str, outlier: float = 3.0, extreme: float = 6.0) -> Apply:
    """Adds ``Outlier`` and ``ExtremeValue``. The quartiles are picked by place among the sorted known values; without
    any, no row is flagged."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = known.count()
    half = n // 2
    quarter = half // 2
    upper = half + quarter + 1 if n % 2 else half + quarter
    wanted = {"a": quarter, "b": min(upper, max(n - 1, 0))}
    place = free(known, "i")[0]
    rows = numbered(known, ["v"], place)
    got = {r[place] - 1: r["v"] for r in rows.where(F.col(place).isin([p + 1 for p in wanted.values()])).collect()}
    q1, q3 = got.get(wanted["a"]), got.get(wanted["b"])
    if q1 is None:
        return lambda rows: rows.withColumns({"Outlier": F.lit(False), "ExtremeValue": F.lit(False)})
    r, c = q3 - q1, F.col(column)
    far = (c > q3 + extreme * r) | (c < q1 - extreme * r)
    out = ((c > q3 + outlier * r) & (c <= q3 + extreme * r)) | ((c < q1 - outlier * r) & (c >= q1 - extreme * r))
    return lambda rows: rows.withColumns({"Outlier": F.coalesce(out, F.lit(False)), "ExtremeValue": F.coalesce(far, F.lit(False))})


def relaggs(df: DataFrame, key: str, numbers: list[str], nominals: dict[str, list[str]], relation: str, limit: int = 20) -> DataFrame:
    """Aggregates of a bag's members by ``key``; a lone value has an infinite deviation."""
    made = []
    for c in numbers:
        deviation = F.when(F.count(c) == 1, float("inf")).otherwise(F.stddev_samp(c))
        for f, e in (("MIN", F.min(c)), ("MAX", F.max(c)), ("AVG", F.avg(c)), ("STDEV", deviation), ("SUM", F.sum(c))):
            made.append(e.alias(f"{relation}_{c}_{f}"))
    for c, values in nominals.items():
        if len(values) <= limit:
            made += [F.count(F.when(F.col(c) == v, 1)).alias(f"{relation}_{c}_{v}_CNT") for v in values]
    return df.groupBy(key).agg(*made)


def time_series_delta(df: DataFrame, columns: list[str], order: list[str], lag: int = -1, by: list[str] = (), translate: bool = False, fill: bool = True) -> DataFrame:
    """``x[t] - x[t + lag]`` under the name ``x d-1``, or ``x[t + lag]`` in place of ``x``; rows without
    a partner stay with missing cells, or go if not ``fill``."""
    made = free(df, *[f"_{c}" for c in columns])
    partner, place = free([*df.columns, *made], "_partner", "_i")
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        other = lambda c: F.lag(c, -lag).over(w) if lag < 0 else F.lead(c, lag).over(w)
        held = df.withColumns({partner: other(F.lit(1))} | {m: other(F.col(c)) for m, c in zip(made, columns)})
        held = held if fill else held.where(F.col(partner) == 1)
    else:  # over the whole table, by a join of row numbers
        rows = numbered(df, order, place)
        shifted = rows.select((F.col(place) - lag).alias(place), *[F.col(c).alias(m) for m, c in zip(made, columns)])
        held = rows.join(shifted, place, "left" if fill else "inner")
    shown = lambda m, c: F.col(m).alias(c) if translate else (F.col(c) - F.col(m)).alias(f"{c} d{lag:+d}")
    found = dict(zip(columns, made))
    return held.select([shown(found[c], c) if c in found else F.col(c) for c in df.columns])


def unit_rows(df: DataFrame, columns: list[str], order: float = 2.0, norm: float = 1.0) -> DataFrame:
    """Rows scaled to length ``norm``; a missing cell or zero length makes all the row's cells missing."""
    total = sum((F.pow(F.abs(F.col(c)), F.lit(order)) if order != 2 else F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    n = F.sqrt(total) if order == 2 else F.pow(total, F.lit(1 / order))
    return df.withColumns({c: F.when(n > 0, F.col(c) / n * norm) for c in columns})


def add_expression(df: DataFrame, expression: str, name: str = "expression") -> DataFrame:
    """A column from arithmetic over ``a1 .. aN``; ``^`` is power and ``log`` natural. NaN and infinity become missing."""
    return df.withColumn(name, _finite(compile_attributes(expression, df.columns).cast("double")))


def numeric_transform(df: DataFrame, columns: list[str], function: str = "abs") -> DataFrame:
    """A named SQL function of each cell; NaN and infinity become missing."""
    return df.withColumns({c: _finite(F.expr(f"{function}(CAST(`{c}` AS DOUBLE))")) for c in columns})


def change_date_format(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Times cut to what the pattern shows."""
    return df.withColumn(column, F.to_timestamp(F.date_format(column, pattern), pattern))


def with_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    return df.withColumn(column, F.col(column).alias(column, metadata={"domain": list(domain)}))


def domain_of(df: DataFrame, column: str) -> list[str]:
    """The declared values of a nominal column, or its distinct values in order, of which there may be ``MOST_VALUES``."""
    known = (df.schema[column].metadata or {}).get("domain")
    return known or _values(df, column)


def _values(df: DataFrame, column: str) -> list[str]:
    found = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
    held = [r[0] for r in found.orderBy("v").limit(MOST_VALUES + 1).collect()]
    if len(held) > MOST_VALUES:
        raise ValueError(f"{column} has more than {MOST_VALUES} values and is no nominal column")
    return held


def add_values(df: DataFrame, column: str, values: list[str], ordered: bool = False) -> DataFrame:
    found = list(dict.fromkeys([*domain_of(df, column), *values]))
    return with_domain(df, column, sorted(found) if ordered else found)


def swap_values(df: DataFrame, column: str, a: str, b: str) -> DataFrame:
    """Swaps two values in the domain; rows keep theirs."""
    return with_domain(df, column, [{a: b, b: a}.get(v, v) for v in domain_of(df, column)])


def class_order(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """The domain in order of frequency, equal ones by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    return with_domain(df, column, [r[0] for r in counts.orderBy(F.desc("count") if descending else "count", column).collect()])


def numeric_to_nominal(df: DataFrame, columns: list[str], decimals: int = 6) -> DataFrame:
    """Numbers as text of at most ``decimals`` places; the domain is in the order of the numbers."""
    for c in columns:
        text = F.format_string(f"%.{decimals}f", F.round(F.col(c).cast("double"), decimals))
        text = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
        shown = F.when(F.col(c).isNotNull(), F.when(text == "-0", "0").otherwise(text))
        df = df.withColumn(c, shown)
        df = with_domain(df, c, sorted(_values(df, c), key=float))
    return df


def nominal_to_string(df: DataFrame, column: str) -> DataFrame:
    """A nominal column as free text: its cells stay, its domain goes."""
    return df.withColumn(column, F.col(column).cast("string").alias(column, metadata={}))


def string_to_nominal(df: DataFrame, column: str, order: list | None = None) -> DataFrame:
    """Text as a nominal column. The domain is in order of first appearance by ``order``, or of the values."""
    if order is None:
        return with_domain(df, column, _values(df, column))
    firsts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.min(F.struct(*order)).alias("o")).orderBy("o").limit(MOST_VALUES + 1).collect()
    if len(firsts) > MOST_VALUES:
        raise ValueError(f"{column} has more than {MOST_VALUES} values and is no nominal column")
    return with_domain(df, column, [r["v"] for r in firsts])


def obfuscate(df: DataFrame) -> DataFrame:
    """Columns ``A1 ..`` and, for those with a domain, values ``V1 ..``."""
    made = []
    for i, f in enumerate(df.schema.fields):
        domain, c = (f.metadata or {}).get("domain"), F.col(f"`{f.name}`")
        if domain:
            c = F.element_at(F.create_map(*[F.lit(x) for j, v in enumerate(domain) for x in (v, f"V{j + 1}")]), c)
        made.append(c.alias(f"A{i + 1}"))
    return df.select(made)


def random_subset(df: DataFrame, fraction: float, seed: int, protect: str | None = None) -> DataFrame:
    """``fraction`` (below 1) or that many of the columns, in their order; a protected one comes last."""
    others = [c for c in df.columns if c != protect]
    n = int(fraction * len(others) + 0.5) if fraction < 1 else int(fraction)
    chosen = set(random.Random(seed).sample(others, min(n, len(others))))
    return df.select([c for c in others if c in chosen] + ([protect] if protect else []))


def add_noise(df: DataFrame, column: str, percent: float, seed: int, key: list[str]) -> DataFrame:
    """Of each value's rows, ``round(p%)`` get another value of the domain; missing cells stay."""
    domain = domain_of(df, column)
    if len(domain) < 2:
        return df
    drawn, place, value, held = free(df, "_h", "_i", "_v", "_n")
    rows = numbered_within(df.withColumn(drawn, F.xxhash64(F.lit(seed), *key)), column, [drawn, *key], place)
    counts = df.groupBy(F.col(column).alias(value)).agg(F.count("*").alias(held)).where(F.col(value).isNotNull())
    values = F.array(*[F.lit(v) for v in domain])
    at = F.array_position(values, F.col(column)) - 1
    step = F.pmod(F.xxhash64(drawn, F.lit(seed)), F.lit(len(domain) - 1)) + 1
    other = F.get(values, F.pmod(at + step, F.lit(len(domain))).cast("int"))
    rows = rows.join(counts, F.col(column) == F.col(value), "left")
    return rows.withColumn(column, F.when(F.col(place) <= F.floor(F.col(held) * percent / 100 + 0.5), other).otherwise(F.col(column))).select(df.columns)


@fitted
def supervised_to_binary(df: DataFrame, column: str, target: str) -> Apply:
    """Columns that say whether the value's rank by mean ``target`` exceeds k, for k from 1 to one less than the values."""
    means = df.where(F.col(column).isNotNull() & F.col(target).isNotNull()).groupBy(column).agg(F.avg(target).alias("m")).orderBy("m", column).collect()
    ranked = [r[column] for r in means]
    made = [F.when(F.col(column).isNotNull(), F.col(column).isin(ranked[k:]).cast("double")).alias(f"{column}={','.join(map(str, ranked[k:]))}") for k in range(1, len(ranked))]
    return lambda rows: rows.select(*[c for c in rows.columns if c != column], *made)
