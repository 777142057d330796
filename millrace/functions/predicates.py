"""The expression languages over columns, each compiled to built-in expressions.

Predicates: ``ATTn`` and ``CLASS``, comparisons, ``is``, ``ismissing``, ``not``, ``and``, ``or``. Attribute
expressions: arithmetic over ``aN`` with ``^``. Mathematical expressions: arithmetic and ``ifelse`` over
given names. ``and`` and ``or`` (also ``&`` and ``|``) share one level and bind to the left; ``not``
(also ``!``) binds tighter. A comparison with a missing cell is false, and so its negation is true.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|'([^']*)'|([A-Za-z_]\w*)|(<=|>=|[<>=()+*/,^&|!-]))")
_MATH = {"abs": F.abs, "sqrt": F.sqrt, "log": F.log, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "rint": F.rint, "floor": F.floor, "ceil": F.ceil}
_TESTS = ("<", ">", "<=", ">=", "=")


def over(a: Column, b: Column) -> Column:
    """Division of doubles, in which a zero divisor gives infinity or NaN."""
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


class _Parser:
    def __init__(self, text: str, resolve: Callable[[str], Column | None]):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.tokens.append((("num", "str", "word", "sign")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at, self.resolve = 0, resolve

    def whole(self, rule: Callable[[], Column]) -> Column:
        found = rule()
        if self.at < len(self.tokens):
            raise ValueError(f"left over: {self.tokens[self.at :]}")
        return found

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> str:
        if self.at >= len(self.tokens) or wanted and not self.peek(*wanted):
            raise ValueError(f"expected {' or '.join(wanted) or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def boolean(self) -> Column:
        left = self.negated()
        while self.peek("and", "or", "&", "|"):
            both = self.take() in ("and", "&")
            right = self.negated()
            left = left & right if both else left | right
        return left

    def negated(self) -> Column:
        if self.peek("not", "!"):
            self.take()
            return ~self.negated()
        if self.peek("true", "false"):
            return F.lit(self.take() == "true")
        if self.peek("ismissing"):
            self.take(), self.take("(")
            found = self.cell()
            self.take(")")
            return found.isNull()
        if self.peek("("):
            start = self.at
            try:
                self.take()
                inner = self.boolean()
                self.take(")")
                if not self.peek(*_TESTS, "+", "-", "*", "/", "^"):
                    return inner
            except ValueError:
                pass
            self.at = start
        left = self.sum()
        if self.peek("is"):
            self.take()
            return F.coalesce(left == F.lit(self.take()), F.lit(False))
        op = self.take(*_TESTS)
        right = self.sum()
        test = {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right, "=": left == right}[op]
        return F.coalesce(test & ~F.isnan(left.cast("double")) & ~F.isnan(right.cast("double")), F.lit(False))

    def sum(self) -> Column:
        left = self.product()
        while self.peek("+", "-"):
            left = left + self.product() if self.take() == "+" else left - self.product()
        return left

    def product(self) -> Column:
        left = self.power()
        while self.peek("*", "/"):
            left = left * self.power() if self.take() == "*" else over(left, self.power())
        return left

    def power(self) -> Column:
        left = self.factor()
        while self.peek("^"):
            self.take()
            left = F.pow(left, self.factor())
        return left

    def factor(self) -> Column:
        if self.peek("-", "+"):
            return -self.factor() if self.take() == "-" else self.factor()
        if self.peek("("):
            self.take()
            inner = self.sum()
            self.take(")")
            return inner
        if self.peek("ifelse", "pow"):
            name = self.take()
            self.take("(")
            first = self.boolean() if name == "ifelse" else self.sum()
            self.take(",")
            a = self.sum()
            if name == "pow":
                self.take(")")
                return F.pow(first, a)
            self.take(",")
            b = self.sum()
            self.take(")")
            return F.when(first, a).otherwise(b)
        if self.peek(*_MATH) and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "(":
            f = _MATH[self.take()]
            self.take("(")
            inner = self.sum()
            self.take(")")
            return f(inner)
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "num":
            return F.lit(float(self.take()))
        return self.cell()

    def cell(self) -> Column:
        name = self.take()
        found = self.resolve(name)
        if found is None:
            raise ValueError(f"no column is named {name}")
        return found


def _place(name: str, prefix: str, columns: list[str]) -> Column | None:
    m = re.fullmatch(prefix + r"(\d+)", name)
    return F.col(f"`{columns[int(m[1]) - 1]}`") if m and 1 <= int(m[1]) <= len(columns) else None


def compile_predicate(text: str, columns: list[str], class_column: str | None = None) -> Column:
    target = F.col(f"`{class_column or columns[-1]}`")
    p = _Parser(text, lambda n: target if n == "CLASS" else _place(n, "ATT", columns))
    return p.whole(p.boolean)


def compile_attributes(text: str, columns: list[str]) -> Column:
    """Arithmetic over ``a1 .. aN``; ``^`` is power, binds to the left, and tighter than the other signs."""
    p = _Parser(text, lambda n: _place(n, "a", columns))
    return p.whole(p.sum)


def compile_math(text: str, names: dict[str, Column]) -> Column:
    """Arithmetic and ``ifelse(test, a, b)`` over the given names."""
    p = _Parser(text, names.get)
    return p.whole(p.sum)
