"""Names of helper columns, apart from the user's in any case, and filters that are fitted once and applied often."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame

Apply = Callable[[DataFrame], DataFrame]


def free(df: DataFrame | list[str], *names: str) -> list[str]:
    """The names, with underscores until none is one of the table's."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def fitted(fit: Callable[..., Apply]) -> Callable[..., DataFrame]:
    """``f(df, ...)`` fits on ``df`` and applies to it; ``f.fit(df, ...)`` gives what applies to later tables, with
    the statistics of the first."""

    @wraps(fit)
    def once(df: DataFrame, *args, **options) -> DataFrame:
        return fit(df, *args, **options)(df)

    once.fit = fit
    return once
