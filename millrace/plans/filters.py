"""Filters as steps: fitted in sequence on one table and applied to others.

A step is ``f(df) -> DataFrame``. One that fits has a ``fit(df)`` which returns what applies to later tables;
``step`` binds a filter's other arguments. A step without ``fit`` is applied to every table by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.naming import Apply, fitted, free

Step = Callable[[DataFrame], DataFrame]


def step(f: Callable[..., DataFrame], *args, **options) -> Step:
    """A filter with its arguments, for ``chain`` and the like."""
    run = lambda df: f(df, *args, **options)
    if hasattr(f, "fit"):
        run.fit = lambda df: f.fit(df, *args, **options)
    return run


def _fit(s: Step, df: DataFrame) -> Apply:
    return s.fit(df) if hasattr(s, "fit") else s


def streamable(s: Step) -> bool:
    """Whether a step may run on a stream: it fits nothing."""
    return not hasattr(s, "fit")


@fitted
def chain(df: DataFrame, steps: list[Step]) -> Apply:
    """Filters in sequence; each is fitted on what the ones before give."""
    applies = []
    for s in steps:
        applies.append(_fit(s, df))
        df = applies[-1](df)

    def apply(rows: DataFrame) -> DataFrame:
        for a in applies:
            rows = a(rows)
        return rows

    return apply


@fitted
def by_columns(df: DataFrame, parts: list[tuple[list[str], Step]], key: list[str], drop_unused: bool = False, target: str | None = None) -> Apply:
    """A filter for each set of columns, side by side. ``key`` names the rows: a filter sees it besides its columns and
    must keep one row a key. Columns of no set follow, and ``target`` comes last."""
    applies = [_fit(s, df.select(*key, *columns)) for columns, s in parts]
    used = {c for columns, _ in parts for c in columns} | set(key)
    rest = [c for c in df.columns if c not in used and c != target]

    def apply(rows: DataFrame) -> DataFrame:
        found, seen = rows.select(*key, *([] if drop_unused else rest), *([target] if target and target not in key else [])), []
        for i, ((columns, _), a) in enumerate(zip(parts, applies)):
            part = a(rows.select(*key, *columns))
            made = [c for c in part.columns if c not in key]
            named = [c if c not in seen else f"{i + 1}_{c}" for c in made]
            seen += named
            part = part.toDF(*[*[c for c in part.columns if c in key], *named]) if part.columns[: len(key)] == key else part.select(*key, *made).toDF(*key, *named)
            n = part.groupBy(*key).count().where("count > 1").limit(1).count()
            if n:
                raise ValueError("a filter of one part gave several rows a key")
            found = found.join(part, key)
        return found.select(*key, *seen, *([] if drop_unused else rest), *([target] if target and target not in key else []))

    return apply


def without_class(s: Step, target: str) -> Step:
    """A step that does not see the class: the class column is taken off as text under a name of its own and put back."""

    def hidden(df: DataFrame) -> tuple[DataFrame, str]:
        name = free(df, f"_hidden_{target}")[0]
        return df.withColumnRenamed(target, name), name

    def fit(df: DataFrame) -> Apply:
        held, _ = hidden(df)
        inner = _fit(s, held)
        return lambda rows: inner(hidden(rows)[0]).withColumnRenamed(hidden(rows)[1], target)

    run = lambda df: fit(df)(df)
    run.fit = fit
    return run


def batch_filter(fit: Callable[..., Apply]) -> Callable[..., DataFrame]:
    """A filter of two passes from a function that fits: the template for filters of one's own."""
    return fitted(fit)


def row_filter(expression: Callable[[DataFrame], dict[str, Column]], keep: Callable[[DataFrame], Column] | None = None) -> Step:
    """A filter of one pass from column expressions and a predicate: legal on streams."""

    def run(df: DataFrame) -> DataFrame:
        return (df.where(keep(df)) if keep else df).withColumns(expression(df))

    return run


def assign_class(df: DataFrame, target: str | None) -> DataFrame:
    """Marks the class column in the columns' metadata; None unmarks it."""
    made = []
    for f in df.schema.fields:
        metadata = {k: v for k, v in (f.metadata or {}).items() if k != "class"} | ({"class": True} if f.name == target else {})
        made.append(F.col(f"`{f.name}`").alias(f.name, metadata=metadata))
    return df.select(made)


def class_column(df: DataFrame) -> str | None:
    return next((f.name for f in df.schema.fields if (f.metadata or {}).get("class")), None)


def pick_class_value(df: DataFrame, target: str, value: str) -> DataFrame:
    """Marks the positive class, which then leads the domain."""
    from millrace.operators.columns import domain_of

    domain = domain_of(df, target)
    if value not in domain:
        raise ValueError(f"{target} has no value {value}")
    held = dict(df.schema[target].metadata or {}) | {"domain": [value, *[v for v in domain if v != value]], "positive": value}
    return df.withColumn(target, F.col(target).alias(target, metadata=held))


def tagged(df: DataFrame, kind: str) -> DataFrame:
    """Rows marked as ``train`` or ``test`` in a column ``_set``."""
    return df.withColumn("_set", F.lit(kind))
