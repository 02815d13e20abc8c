"""Predicates of a query: ranges of one variable's attribute, and comparisons of two variables' attributes."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq}
FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
#: column(variable, attribute)
Lookup = Callable[[str, str], Column]


@dataclass(frozen=True)
class Range:
    """low <= variable.attribute <= high; either side may be open or strict."""

    var: str
    attr: str
    low: float | None = None
    high: float | None = None
    low_strict: bool = False
    high_strict: bool = False

    def column(self, value: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = value > self.low if self.low_strict else value >= self.low
        if self.high is not None:
            side = value < self.high if self.high_strict else value <= self.high
            out = side if self.low is None else out & side
        return out

    def __str__(self) -> str:
        name = f"{self.var}.{self.attr}"
        left = "" if self.low is None else f"{self.low:g} {'<' if self.low_strict else '<='} "
        right = "" if self.high is None else f" {'<' if self.high_strict else '<='} {self.high:g}"
        return f"{left}{name}{right}"


@dataclass(frozen=True)
class Linear:
    """variable.attribute * times + plus."""

    var: str
    attr: str
    times: float = 1.0
    plus: float = 0.0

    @property
    def plain(self) -> bool:
        return self.times == 1 and self.plus == 0

    def column(self, lookup: Lookup) -> Column:
        out = lookup(self.var, self.attr)
        if not self.plain:
            out = out.cast("double")
        if self.times != 1:
            out = out * self.times
        return out + self.plus if self.plus else out

    def __str__(self) -> str:
        times = "" if self.times == 1 else f" * {self.times:g}"
        plus = "" if self.plus == 0 else f" {'+' if self.plus > 0 else '-'} {abs(self.plus):g}"
        return f"{self.var}.{self.attr}{times}{plus}"


@dataclass(frozen=True)
class Compare:
    """left op right, evaluated when the later of the two variables is bound; without effect on paths that lack one."""

    left: Linear
    op: str
    right: Linear

    @property
    def vars(self) -> frozenset[str]:
        return frozenset((self.left.var, self.right.var))

    @property
    def equality(self) -> bool:
        return self.op == "=" and self.left.plain and self.right.plain

    def column(self, lookup: Lookup) -> Column:
        return COMPARE[self.op](self.left.column(lookup), self.right.column(lookup))

    def implied(self, var: str, low: float, high: float) -> Range | None:
        """The range of the other variable's attribute that the range [low, high] of `var`'s attribute leaves possible."""
        mine, other, op = (self.left, self.right, self.op) if var == self.left.var else (self.right, self.left, FLIPPED[self.op])
        if other.times == 0:
            return None
        ends = sorted(((x * mine.times + mine.plus) - other.plus) / other.times for x in (low, high))
        if other.times < 0:
            op = FLIPPED[op]
        if op in ("<", "<="):  # mine <= other
            return Range(other.var, other.attr, low=ends[0], low_strict=op == "<")
        if op in (">", ">="):
            return Range(other.var, other.attr, high=ends[1], high_strict=op == ">")
        return Range(other.var, other.attr, ends[0], ends[1])

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"
