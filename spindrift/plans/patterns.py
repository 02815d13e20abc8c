"""Pattern trees and their decomposition into linear paths."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

ONE, PLUS, STAR, NOT = "one", "plus", "star", "not"


@dataclass(frozen=True)
class Var:
    """An event variable; kind says whether it binds one event, one or more, any number, or forbids events."""

    type: str
    name: str
    kind: str = ONE

    def __str__(self) -> str:
        inner = f"{self.type} {self.name}"
        return inner if self.kind == ONE else f"{ {PLUS: 'KP', STAR: 'KS', NOT: 'NEG'}[self.kind] }({inner})"


@dataclass(frozen=True)
class Op:
    """SEQ, AND or OR of two or more parts."""

    op: str
    parts: tuple[Pattern, ...]

    def __str__(self) -> str:
        return f"{self.op}({', '.join(map(str, self.parts))})"


Pattern = Var | Op
Path = tuple[Var, ...]


def variables(p: Pattern) -> list[Var]:
    """Leaves from left to right."""
    return [p] if isinstance(p, Var) else [v for part in p.parts for v in variables(part)]


def types(p: Pattern) -> dict[str, str]:
    return {v.name: v.type for v in variables(p)}


def paths(p: Pattern) -> list[Path]:
    """The linear paths: AND is either order of whole sub-patterns, OR the paths of each part; more than two parts of
    an AND nest from the left."""
    if isinstance(p, Var):
        return [(p,)]
    if p.op == "SEQ":
        return [sum(combined, ()) for combined in product(*map(paths, p.parts))]
    if p.op == "OR":
        return [path for part in p.parts for path in paths(part)]
    out = paths(p.parts[0])
    for part in p.parts[1:]:
        other = paths(part)
        out = [a + b for a, b in product(out, other)] + [b + a for b, a in product(other, out)]
    return out


def length(p: Pattern) -> int:
    """Variables of a match at most: OR counts its longest part."""
    if isinstance(p, Var):
        return 1
    each = [length(part) for part in p.parts]
    return max(each) if p.op == "OR" else sum(each)


def only_at(p: Pattern, name: str, side: int) -> bool:
    """Whether the variable is the first (side 0) or last (side -1) of every path that it is on."""
    on = [path for path in paths(p) if any(v.name == name for v in path)]
    return bool(on) and all(path[side].name == name for path in on)


def in_order(p: Pattern) -> list[str]:
    """Variables and operators as they stand between them."""
    if isinstance(p, Var):
        return [p.name]
    out: list[str] = []
    for i, part in enumerate(p.parts):
        out += ([p.op] if i else []) + in_order(part)
    return out


def tree(p: Pattern, depth: int = 0) -> str:
    pad = "  " * depth
    return f"{pad}{p}" if isinstance(p, Var) else "\n".join([f"{pad}{p.op}", *(tree(part, depth + 1) for part in p.parts)])


def check(p: Pattern) -> None:
    names = [v.name for v in variables(p)]
    if len(set(names)) < len(names):
        raise ValueError("a variable name is used twice")
    for path in paths(p):
        if path[0].kind != ONE or path[-1].kind != ONE:
            raise ValueError(f"a path begins and ends with a plain variable: {', '.join(map(str, path))}")
        if any(a.kind == NOT and b.kind == NOT for a, b in zip(path, path[1:], strict=False)):
            raise ValueError("two negated variables stand side by side")
