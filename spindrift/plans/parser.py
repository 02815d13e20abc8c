"""The statement language.

    CREATE TABLE t (c TYPE, c INT, c FLOAT.2, c DOUBLE.2, c CHAR[n], c TIMESTAMP)
    CREATE INDEX i USING {BITMAP | TREE | INTERVAL | SCAN} ON t (c, ...)
    PATTERN p FROM t USING strategy WHERE predicate AND ... WITHIN n unit RETURN {tuples | COUNT(*)}

    p := T v | KP(T v) | KS(T v) | NEG(T v) | SEQ(p, ...) | AND(p, p, ...) | OR(p, p, ...)
    predicate := n <= v.a <= n | v.a <= n | n <= v.a | v.a * n + n <= w.a * n + n

Any white space separates; keywords may be in either case; types, variables and columns keep theirs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import patterns
from .patterns import NOT, ONE, PLUS, STAR, Op, Pattern, Var
from .predicates import COMPARE, FLIPPED, Compare, Linear, Range

ANY, NEXT, STRICT = "any", "next", "strict"
STRATEGIES = {"SKIP_TILL_ANY_MATCH": ANY, "SKIP_TILL_NEXT_MATCH": NEXT, "STRICT_CONTIGUOUS": STRICT}
#: Microseconds in units of time; a bare number or "units" is in the table's own unit.
UNITS = {"HOUR": 3_600_000_000, "MIN": 60_000_000, "SEC": 1_000_000, "MILLI": 1_000, "DAY": 86_400_000_000}
KINDS = {"KP": PLUS, "KS": STAR, "NEG": NOT}
LAYOUTS = ("BITMAP", "TREE", "INTERVAL", "SCAN")

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_][A-Za-z0-9_]*)|(<=|>=|!=|[-+*/<>=(),.\[\]]))")


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Query:
    pattern: Pattern
    table: str
    strategy: str
    ranges: tuple[Range, ...]
    compares: tuple[Compare, ...]
    within: int
    unit: str | None  # None: the table's own
    count: bool

    @property
    def paths(self) -> list[patterns.Path]:
        return patterns.paths(self.pattern)


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, str], ...]  # name and TYPE, INT, FLOAT, DOUBLE, CHAR or TIMESTAMP
    scales: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class CreateIndex:
    name: str
    layout: str
    table: str
    columns: tuple[str, ...]


class _Tokens:
    def __init__(self, text: str):
        self.items: list[str] = []
        at, text = 0, text.strip().rstrip(";").rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected text: {text[at : at + 20]!r}")
            self.items.append(m[1] or m[2] or m[3])
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ""

    def next(self) -> str:
        if self.at >= len(self.items):
            raise ParseError("the statement ends too early")
        self.at += 1
        return self.items[self.at - 1]

    def word(self) -> str:
        if not re.match(r"[A-Za-z_]", self.peek()):
            raise ParseError(f"a name was expected, not {self.peek()!r}")
        return self.next()

    def is_(self, *words: str) -> bool:
        return all(self.peek(i).upper() == w for i, w in enumerate(words))

    def take(self, *words: str) -> None:
        for w in words:
            if self.next().upper() != w:
                raise ParseError(f"{w} was expected, not {self.items[self.at - 1]!r}")

    def number(self) -> float:
        sign = 1.0
        while self.peek() in ("-", "+"):
            sign *= -1 if self.next() == "-" else 1
        try:
            return sign * float(self.next())
        except ValueError:
            raise ParseError(f"a number was expected, not {self.items[self.at - 1]!r}") from None

    def end(self) -> None:
        if self.peek():
            raise ParseError(f"unexpected text after the statement: {self.peek()!r}")


def parse(text: str) -> Query | CreateTable | CreateIndex:
    t = _Tokens(text)
    if t.is_("CREATE", "TABLE"):
        return _table(t)
    if t.is_("CREATE", "INDEX"):
        return _index(t)
    if t.is_("PATTERN"):
        return _query(t)
    raise ParseError("a statement begins with CREATE TABLE, CREATE INDEX or PATTERN")


def parse_pattern(text: str) -> Pattern:
    t = _Tokens(text)
    out = _pattern(t)
    t.end()
    return out


def _pattern(t: _Tokens) -> Pattern:
    head = t.word()
    if t.peek() != "(":
        return Var(head, t.word(), ONE)
    t.take("(")
    if head.upper() in KINDS:
        out: Pattern = Var(t.word(), t.word(), KINDS[head.upper()])
        t.take(")")
        return out
    if head.upper() not in ("SEQ", "AND", "OR"):
        raise ParseError(f"unknown operator {head!r}")
    parts = [_pattern(t)]
    while t.peek() == ",":
        t.next()
        parts.append(_pattern(t))
    t.take(")")
    if head.upper() != "SEQ" and len(parts) < 2:
        raise ParseError(f"{head.upper()} needs two parts")
    return parts[0] if len(parts) == 1 else Op(head.upper(), tuple(parts))


def _linear(t: _Tokens) -> Linear | float:
    """A variable's attribute or a number, times and plus numbers."""
    if re.match(r"[A-Za-z_]", t.peek()):
        var = t.word()
        t.take(".")
        attr = t.word()
        times = plus = 0.0
        times = 1.0
        while t.peek() in ("*", "/"):
            op, x = t.next(), t.number()
            if op == "/" and x == 0:
                raise ParseError("division by zero")
            times = times * x if op == "*" else times / x
        while t.peek() in ("+", "-"):
            plus += t.number() if t.next() == "+" else -t.number()
        return Linear(var, attr, times, plus)
    return t.number()


def _predicate(t: _Tokens) -> Range | Compare:
    parts: list[Linear | float] = [_linear(t)]
    ops: list[str] = []
    while t.peek() in COMPARE:
        ops.append(t.next())
        parts.append(_linear(t))
    shape = "".join("v" if isinstance(p, Linear) else "n" for p in parts)
    if shape == "vv":
        return Compare(parts[0], ops[0], parts[1])
    if shape == "nv":
        parts, ops, shape = parts[::-1], [FLIPPED[ops[0]]], "vn"
    if shape not in ("vn", "nvn"):
        raise ParseError("a predicate compares an attribute with numbers or with another attribute")
    value = parts[shape.index("v")]
    if value.times <= 0:
        raise ParseError("a range needs a positive factor")
    at = lambda x: (x - value.plus) / value.times
    if shape == "nvn":
        if any(op not in ("<", "<=") for op in ops):
            raise ParseError("a range is written low <= v.a <= high")
        return Range(value.var, value.attr, at(parts[0]), at(parts[2]), ops[0] == "<", ops[1] == "<")
    x, op = at(parts[1]), ops[0]
    if op == "=":
        return Range(value.var, value.attr, x, x)
    return Range(value.var, value.attr, low=x, low_strict=op == ">") if op[0] == ">" else Range(value.var, value.attr, high=x, high_strict=op == "<")


def _query(t: _Tokens) -> Query:
    t.take("PATTERN")
    pattern = _pattern(t)
    t.take("FROM")
    table = t.word()
    if t.next().upper() not in ("USING", "USE"):
        raise ParseError("USING was expected")
    strategy = t.word().upper()
    if strategy not in STRATEGIES:
        raise ParseError(f"unknown strategy {strategy}; there are {', '.join(STRATEGIES)}")
    predicates: list[Range | Compare] = []
    if t.is_("WHERE"):
        t.next()
        predicates.append(_predicate(t))
        while t.is_("AND"):
            t.next()
            predicates.append(_predicate(t))
    t.take("WITHIN")
    amount = t.number()
    unit = next((u for u in UNITS if t.peek().upper().startswith(u)), None)
    if not t.is_("RETURN"):
        t.word()
    t.take("RETURN")
    result = " ".join(t.items[t.at :]).upper()
    if not result:
        raise ParseError("RETURN needs tuples or COUNT(*)")
    patterns.check(pattern)
    names = {v.name for v in patterns.variables(pattern)}
    for p in predicates:
        for v in [p.var] if isinstance(p, Range) else sorted(p.vars):
            if v not in names:
                raise ParseError(f"unknown variable {v}")
    if amount < 0:
        raise ParseError("WITHIN needs a length of time")
    return Query(pattern, table, STRATEGIES[strategy], tuple(p for p in predicates if isinstance(p, Range)), tuple(p for p in predicates if isinstance(p, Compare)), int(amount), unit, "COUNT" in result)


def _table(t: _Tokens) -> CreateTable:
    t.take("CREATE", "TABLE")
    name = t.word()
    t.take("(")
    columns, scales = [], {}
    while True:
        column, kind = t.word(), t.word().upper()
        if kind not in ("TYPE", "INT", "FLOAT", "DOUBLE", "CHAR", "TIMESTAMP"):
            raise ParseError(f"unknown type {kind}")
        if kind in ("FLOAT", "DOUBLE") and t.peek() == ".":
            t.next()
            scales[column] = int(t.number())
        elif kind in ("FLOAT", "DOUBLE") and t.peek().startswith("."):
            scales[column] = int(t.next()[1:])
        if kind == "CHAR" and t.peek() == "[":
            t.take("[")
            t.number()
            t.take("]")
        columns.append((column, kind))
        if t.next() == ")":
            break
    t.end()
    kinds = [k for _, k in columns]
    if kinds.count("TYPE") != 1 or kinds.count("TIMESTAMP") != 1:
        raise ParseError("a table has one TYPE and one TIMESTAMP column")
    return CreateTable(name, tuple(columns), scales)


def _index(t: _Tokens) -> CreateIndex:
    t.take("CREATE", "INDEX")
    name = t.word()
    t.take("USING")
    layout = t.word().upper()
    if layout not in LAYOUTS:
        raise ParseError(f"unknown layout {layout}; there are {', '.join(LAYOUTS)}")
    t.take("ON")
    table = t.word()
    t.take("(")
    columns = [t.word()]
    while t.next() == ",":
        columns.append(t.word())
    t.end()
    return CreateIndex(name, layout, table, tuple(columns))
