"""Special functions for the tails of distributions, on numbers and, as ``column(f)``, on columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ln_gamma = math.lgamma
gamma = math.gamma
erf = math.erf
erfc = math.erfc


def column(f: Callable[..., float | None]) -> Callable[..., Column]:
    """``f`` on columns of doubles: missing cells, and arguments outside its domain, give missing cells."""

    def one(*cells):
        try:
            return None if any(c is None or math.isnan(c) for c in cells) else f(*cells)
        except (ValueError, OverflowError, ZeroDivisionError):
            return None

    @F.pandas_udf("double")
    def run(table: pd.DataFrame) -> pd.Series:
        return pd.Series([one(*cells) for cells in zip(*(table[c] for c in table))], dtype="float64")

    return lambda *columns: run(F.struct(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))


def normal_probability(x: float) -> float:
    """The share of the standard normal distribution below ``x``."""
    return math.erfc(-x / math.sqrt(2)) / 2


def normal_inverse(p: float) -> float:
    """Where the standard normal distribution reaches ``p``: bisection, then Newton steps."""
    if not 0 < p < 1:
        raise ValueError("a probability between 0 and 1 is needed")
    low, high = -40.0, 40.0
    for _ in range(30):
        middle = (low + high) / 2
        low, high = (middle, high) if normal_probability(middle) < p else (low, middle)
    x = (low + high) / 2
    for _ in range(4):
        density = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        x -= (normal_probability(x) - p) / density if density else 0.0
    return x


def _continued(terms: Iterable[float]) -> float:
    """``1 / (1 + t1 / (1 + t2 / ...))``, by ratios of successive convergents."""
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for t in terms:
        d = 1 / ((1 + t * d) or tiny)
        c = (1 + t / c) or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 / value


def incomplete_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0 or a <= 0:
        return 0.0
    if x > 1 and x > a:
        return 1 - incomplete_gamma_complement(a, x)
    total = term = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def incomplete_gamma_complement(a: float, x: float) -> float:
    if x <= 0 or a <= 0:
        return 1.0
    if x < 1 or x < a:
        return 1 - incomplete_gamma(a, x)

    def terms():
        for k in range(1, 2000):
            yield (k - a) / x
            yield k / x

    return math.exp(a * math.log(x) - x - math.lgamma(a)) / x * _continued(terms())


def beta_fraction1(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function in ``x``."""

    def terms():
        for k in range(1000):
            yield -x * (a + k) * (a + b + k) / ((a + 2 * k) * (a + 2 * k + 1))
            yield x * (k + 1) * (b - k - 1) / ((a + 2 * k + 1) * (a + 2 * k + 2))

    return _continued(terms())


def beta_fraction2(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function in ``x / (1 - x)``."""
    z = x / (1 - x)

    def terms():
        for k in range(1000):
            yield -z * (a + k) * (b - 1 - k) / ((a + 2 * k) * (a + 2 * k + 1))
            yield z * (k + 1) * (a + b + k) / ((a + 2 * k + 1) * (a + 2 * k + 2))

    return _continued(terms())


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if a <= 0 or b <= 0 or not 0 <= x <= 1:
        raise ValueError("outside the domain")
    if x in (0, 1):
        return float(x)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / a * beta_fraction1(a, b, x)


def chi_squared_probability(x: float, df: float) -> float:
    """The share of the chi-squared distribution above ``x``."""
    return incomplete_gamma_complement(df / 2, x / 2) if x > 0 else 1.0


def f_probability(f: float, df1: float, df2: float) -> float:
    """The share of the F distribution above ``f``."""
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def student_two_sided(t: float, df: float) -> float:
    """The share of Student's distribution farther from 0 than ``t``."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def binomial_standard_error(p: float, n: float) -> float:
    return math.sqrt(p * (1 - p) / n) if n else 0.0


def monic_polynomial(x: float, coefficients: list[float]) -> float:
    """A polynomial whose highest coefficient is 1 and not given; the others from high to low."""
    value = 1.0
    for c in coefficients:
        value = value * x + c
    return value


def ln_factorial(x: float) -> float:
    return math.lgamma(x + 1)


def log2_binomial(a: float, b: float) -> float:
    """Ways to choose ``b`` of ``a``, as a binary logarithm."""
    if b > a:
        raise ValueError("cannot choose more than there are")
    return (ln_factorial(a) - ln_factorial(b) - ln_factorial(a - b)) / math.log(2)


def log2_multinomial(a: float, parts: list[float]) -> float:
    """Ways to part ``a`` into groups of the given sizes."""
    if sum(parts) > a + 1e-9:
        raise ValueError("the parts are larger than the whole")
    return (ln_factorial(a) - sum(map(ln_factorial, parts))) / math.log(2)
