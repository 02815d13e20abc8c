"""Sequential matching within a key, for patterns whose events share one: jobs, users, devices.

The events of a key are read in order, in Arrow batches, and runs that have timed out are dropped, so a key's memory
is the runs and events of one window. Keys whose windows hold more than a machine does go by `matching`, which splits
every key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.parser import ANY, NEXT
from ..plans.patterns import NOT, ONE, PLUS, STAR, Path
from ..plans.predicates import COMPARE, Compare, Range


class Runs:
    """Runs of one path over events in order; `feed` returns the matches that an event completes."""

    def __init__(self, path: Path, ranges: tuple[Range, ...], compares: tuple[Compare, ...], window: int, strategy: str, runs: list | None = None):
        if any(v.kind != ONE for v in path):
            raise ValueError("the sequential matcher takes plain variables")
        self.path, self.window, self.strategy = path, window, strategy
        self.ranges = [[r for r in ranges if r.var == v.name] for v in path]
        names = [v.name for v in path]
        self.compares: list[list[Compare]] = [[] for _ in path]
        for c in compares:
            if c.vars <= set(names):
                self.compares[max(names.index(v) for v in c.vars)].append(c)
        self.runs: list[list[dict]] = runs or []

    def _binds(self, i: int, event: dict, bound: list[dict]) -> bool:
        if event["_type"] != self.path[i].type:
            return False
        for r in self.ranges[i]:
            x = event[r.attr]
            if x is None or x != x:
                return False
            if r.low is not None and (x <= r.low if r.low_strict else x < r.low):
                return False
            if r.high is not None and (x >= r.high if r.high_strict else x > r.high):
                return False
        at = {v.name: e for v, e in zip(self.path, [*bound, event], strict=False)}
        for c in self.compares[i]:
            sides = []
            for s in (c.left, c.right):
                x = at[s.var][s.attr]
                if x is None or x != x:
                    return False
                sides.append(x if s.plain else x * s.times + s.plus)
            if not COMPARE[c.op](*sides):
                return False
        return True

    def feed(self, event: dict) -> list[list[dict]]:
        kept, done, grown = [], [], []
        for run in self.runs:
            if event["_ts"] - run[0]["_ts"] > self.window:
                continue
            if self._binds(len(run), event, run):
                longer = [*run, event]
                (done if len(longer) == len(self.path) else grown).append(longer)
                if self.strategy == NEXT:
                    continue
            kept.append(run)
        if self._binds(0, event, []):
            (done if len(self.path) == 1 else grown).append([event])
        self.runs = kept + grown
        return done


class Windows:
    """Matches of a path with loops and negations, found when the window of their first event is over.

    `feed` takes events in order and returns the matches whose windows it ends; `rest` those of the windows still
    open. Events are kept for one window. A match is a dict of variables: of a loop, its last event and the number of
    events under the name with "#"; an empty loop has no event.
    """

    def __init__(self, path: Path, ranges: tuple[Range, ...], compares: tuple[Compare, ...], window: int, strategy: str, events: list[dict] | None = None):
        self.path, self.window, self.strategy, self.ranges = path, window, strategy, ranges
        self.compares = {v.name: [c for c in compares if v.name in c.vars] for v in path}
        self.events: list[dict] = events or []  # those of open windows, "_open" marking candidates of the first variable

    def _binds(self, v, event: dict, bound: dict[str, dict]) -> bool:
        if event["_type"] != v.type:
            return False
        for r in self.ranges:
            if r.var == v.name:
                x = event[r.attr]
                if x is None or x != x or r.low is not None and (x <= r.low if r.low_strict else x < r.low) or r.high is not None and (x >= r.high if r.high_strict else x > r.high):
                    return False
        at = {**bound, v.name: event}
        for c in self.compares[v.name]:
            if not c.vars <= self._seen | {v.name}:
                continue  # decided when its other variable is bound
            sides = []
            for s in (c.left, c.right):
                x = at[s.var][s.attr] if at.get(s.var) is not None else None
                if x is None or x != x:
                    return False
                sides.append(x if s.plain else x * s.times + s.plus)
            if not COMPARE[c.op](*sides):
                return False
        return True

    def _from(self, events: list[dict], place: int, last: int, bound: dict, gap: tuple | None) -> Iterator[dict]:
        """Matches that bind the variables from `place` on, after the event at `last`; gap: a negation and where it begins."""
        if place == len(self.path):
            yield bound
            return
        v = self.path[place]
        self._seen = {u.name for u in self.path[:place] if u.kind != NOT}
        if v.kind == NOT:
            yield from self._from(events, place + 1, last, bound, (v, last))
            return
        fits = [i for i in range(last + 1, len(events)) if self._binds(v, events[i], bound)]
        if v.kind == ONE:
            for i in fits[:1] if self.strategy == NEXT else fits:
                found = {**bound, v.name: events[i]}
                if gap is not None:
                    self._seen = {u.name for u in self.path[: place + 1] if u.kind != NOT}
                    if any(self._binds(gap[0], events[j], found) for j in range(gap[1] + 1, i)):
                        continue
                yield from self._from(events, place + 1, i, found, None)
            return
        if v.kind == STAR:
            yield from self._from(events, place + 1, last, {**bound, v.name: None, v.name + "#": 0}, gap)
        for k, i in enumerate(fits, 1):
            yield from self._from(events, place + 1, i, {**bound, v.name: events[i], v.name + "#": k}, gap)

    def _closed(self, first: int) -> list[dict]:
        start = self.events[first]
        end = first
        while end < len(self.events) and self.events[end]["_ts"] <= start["_ts"] + self.window:
            end += 1
        return list(self._from(self.events[:end], 1, first, {self.path[0].name: start}, None))

    def feed(self, event: dict) -> list[dict]:
        out = self.passed(event["_ts"])
        self._seen = set()
        self.events.append({**event, "_open": self._binds(self.path[0], event, {})})
        return out

    def passed(self, ts: int) -> list[dict]:
        """The matches of windows that end before ts; what no open window needs is dropped."""
        out = []
        for i, event in enumerate(self.events):
            if event["_open"] and event["_ts"] + self.window < ts:
                out += self._closed(i)
                event["_open"] = False
        keep = next((i for i, e in enumerate(self.events) if e["_open"]), len(self.events))
        del self.events[:keep]
        return out

    def rest(self) -> list[dict]:
        out = [m for i, e in enumerate(self.events) if e["_open"] for m in self._closed(i)]
        self.events = []
        return out


def result_columns(path: Path) -> list[str]:
    """ts and seq of the variables that a match binds, and k of loops."""
    return [f"{v.name}__{x}" for v in path if v.kind != NOT for x in (("ts", "seq", "k") if v.kind in (PLUS, STAR) else ("ts", "seq"))]


def result_row(path: Path, match: dict) -> list:
    out: list = []
    for v in path:
        if v.kind != NOT:
            event = match[v.name]
            out += [None, None] if event is None else [event["_ts"], event["_seq"]]
            out += [match[v.name + "#"]] if v.kind in (PLUS, STAR) else []
    return out


def match_keyed(events: DataFrame, key: str, path: Path, ranges: tuple[Range, ...], compares: tuple[Compare, ...], window: int, strategy: str = ANY) -> DataFrame:
    """key, and ts and seq of each variable (k besides of loops), of the matches whose events have equal keys; rows without
    one match nothing."""
    names, plain = result_columns(path), all(v.kind == ONE for v in path)
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, current = None, None

        def frame(out: list) -> Iterator[pd.DataFrame]:
            if out:  # Arrow takes no string key from a frame without rows
                yield pd.DataFrame(out, columns=[key, *names]).astype({n: "Int64" for n in names})

        def done() -> list:
            return [(current, *result_row(path, m)) for m in runs.rest()] if runs is not None and not plain else []

        for batch in batches:
            out = []
            for event in batch.to_dict("records"):
                if runs is None or event[key] != current:
                    out += done()
                    runs, current = (Runs if plain else Windows)(path, ranges, compares, window, strategy), event[key]
                found = runs.feed(event)
                out += [(current, *(e[x] for e in m for x in ("_ts", "_seq"))) for m in found] if plain else [(current, *result_row(path, m)) for m in found]
            yield from frame(out)
        yield from frame(done())

    found = events.filter(F.col("_type").isin(sorted({v.type for v in path})) & F.col(key).isNotNull())
    return found.repartition(key).sortWithinPartitions(key, "_ts", "_seq").mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"`{n}` long" for n in names))
