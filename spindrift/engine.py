"""The engine: tables, queries, matches and explanations."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import matching, pruning, statistics, versions
from .operators.matching import Matcher, name
from .plans import patterns
from .plans.parser import ANY, STRICT, CreateIndex, CreateTable, Query, parse
from .sources.tables import EventTable, column_of, struct_of, write_events

PREFILTERS = (None, "buckets", "intervals")
#: Events of a bucket that are meant to meet in one task, and buckets of a window at most.
TASK_ROWS, MOST_SPLITS = 2_000_000, 64


@dataclass
class Engine:
    """Answers pattern queries over registered event tables.

    prefilter: None, "buckets" or "intervals": what prunes events before matching; answers are the same.
    splits: buckets a window is cut into; 0 chooses by the events of the fullest window, TASK_ROWS a bucket.
    """

    spark: SparkSession
    prefilter: str | None = None
    splits: int = 1
    arrays: bool = False

    def __post_init__(self) -> None:
        if self.prefilter not in PREFILTERS:
            raise ValueError(f"there are the prefilters {PREFILTERS}")
        self.tables: dict[str, EventTable] = {}
        self.schemas: dict[str, CreateTable] = {}
        self.layouts: dict[str, CreateIndex] = {}
        self._shares: dict[tuple[str, str], dict[str, float]] = {}

    def register(self, name: str, df: DataFrame, type_col: str, ts_col: str, seq_col: str, versioned: bool = False, fixed_point: bool = False, scales: dict[str, int] | None = None) -> EventTable:
        """A table of events. versioned: of rows with one type and time only the last written counts."""
        if versioned:
            df = versions.latest(df, [type_col, ts_col], seq_col)
        self.tables[name] = EventTable(df, type_col, ts_col, seq_col, scales or {}, fixed_point)
        return self.tables[name]

    def sql(self, text: str) -> DataFrame | None:
        """Runs a statement; a pattern query gives its matches, or their number."""
        statement = parse(text)
        if isinstance(statement, CreateTable):
            self.schemas[statement.name] = statement
            self.load(statement.name, self.spark.createDataFrame([], struct_of(statement).add("seq", "long")))
            return None
        if isinstance(statement, CreateIndex):
            if statement.table not in self.tables:
                raise ValueError(f"unknown table {statement.table}")
            if statement.table in self.layouts:
                raise ValueError(f"{statement.table} has a layout already")
            self.layouts[statement.table] = statement
            return None
        return self.count(statement) if statement.count else self.match(statement)

    def write(self, table: str, path: str, mode: str = "append", **how) -> EventTable:
        """Writes a table and registers what was written: in the layout of its index if it has one, else by type and time.

        With an index, ranges of its attributes skip the row groups that hold none of them.
        """
        layout, old = self.layouts.get(table), self.tables[table]
        write_events(old, path, mode, index=layout.columns if layout else (), **how)
        self.tables[table] = replace(old, df=self.spark.read.parquet(path))
        return self.tables[table]

    def load(self, table: str, df: DataFrame, seq_col: str = "seq", **how) -> EventTable:
        """Rows of a table that CREATE TABLE declared."""
        schema = self.schemas[table]
        return self.register(table, df, column_of(schema, "TYPE"), column_of(schema, "TIMESTAMP"), seq_col, scales=schema.scales, **how)

    def _query(self, query: str | Query) -> tuple[Query, EventTable]:
        found = parse(query) if isinstance(query, str) else query
        if not isinstance(found, Query):
            raise ValueError("this is no pattern query")
        if found.table not in self.tables:
            raise ValueError(f"unknown table {found.table}")
        return found, self.tables[found.table]

    def matcher(self, query: str | Query) -> Matcher:
        q, table = self._query(query)
        attrs = sorted({r.attr for r in q.ranges} | {s.attr for c in q.compares for s in (c.left, c.right)})
        found = Matcher(table.events(attrs), q.ranges, q.compares, table.window(q.within, q.unit), ANY if q.strategy == STRICT else q.strategy, self.splits or 1, self.arrays)
        return found if self.splits else replace(found, splits=self.splits_for(found, sorted({v.type for path in q.paths for v in path})))

    def splits_for(self, matcher: Matcher, types: list[str], rows: int = TASK_ROWS) -> int:
        """Buckets to cut a window into, so that the events of the fullest one are about `rows`; one number is collected."""
        at = matcher.events.filter(F.col("_type").isin(types)).groupBy(matching.bucket(F.col("_ts"), max(1, matcher.window)).alias("b")).count()
        return min(MOST_SPLITS, max(1, math.ceil((at.agg(F.max("count").alias("n")).first()["n"] or 0) / rows)))

    def path_matches(self, query: str | Query, path: patterns.Path, where: dict[str, Column] | None = None) -> DataFrame:
        q, _ = self._query(query)
        m = self.matcher(q)
        if where:
            m = replace(m, where=where)
        if q.strategy == STRICT:
            return matching.contiguous(m.events, path, q.ranges, q.compares, m.window)
        if self.prefilter == "buckets" and len(path) > 1:
            m = replace(m, events=pruning.by_buckets(m, path))
        elif self.prefilter == "intervals" and len(path) > 1:
            m = replace(m, events=pruning.by_intervals(m, path, pruning.driver(path, self.selectivities(q))))
        return m.run(path)

    def selectivities(self, query: str | Query) -> dict[str, float]:
        """The share of events that may bind each variable, one number a variable, computed once a query."""
        q, table = self._query(query)
        key = (repr(q), str(id(table.df)))
        if key not in self._shares:
            found = statistics.selectivity(self.matcher(q).events, {v.name: v.type for path in q.paths for v in path}, q.ranges)
            self._shares[key] = {r["var"]: r["selectivity"] for r in found.collect()}
        return self._shares[key]

    def match(self, query: str | Query, where: dict[str, Column] | None = None, having: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """path (from 0), and ts and seq of every variable: null where a path lacks it. Paths are a union of bags.

        where: by variable, a further condition on the attributes of the events that may bind it (those that the query names,
        _type, _ts and _seq). having: what becomes of the matches of each path before paths are united.
        """
        q, _ = self._query(query)
        if q.strategy == STRICT and where:
            raise ValueError("strict contiguity takes no further conditions")
        out = None
        for i, path in enumerate(q.paths):
            found = self.path_matches(q, path, where)
            found = (having(found) if having else found).withColumn("path", F.lit(i))
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        order = [c for v in patterns.variables(q.pattern) for c in out.columns if c.startswith(f"{v.name}__")]
        return out.select("path", *order)

    def count(self, query: str | Query) -> DataFrame:
        """matches: their number, without forming those of paths that sums can count."""
        q, _ = self._query(query)
        m = self.matcher(q)
        if q.strategy == STRICT or not all(matching.countable(m, path) for path in q.paths):
            return self.match(q).agg(F.count("*").alias("matches"))
        each = reduce(DataFrame.unionAll, (matching.counted(m, path) for path in q.paths))
        return each.agg(F.sum("n").cast("long").alias("matches"))

    def subtract(self, short: str | Query, longer: str | Query, without: str) -> DataFrame:
        """The matches of `short` less the projections of those of `longer`, which has the variable `without` besides.

        Under ANY, where that variable stands alone between two others of a path and no comparison names it, a match is a
        projection if an event that may bind it lies between its neighbours. Then neither side is formed to be subtracted:
        the matches are those of `short` with the variable negated.
        """
        a, b = (self._query(q)[0] for q in (short, longer))
        if not (len(a.paths) == len(b.paths) == 1 and all(v.kind == patterns.ONE for q in (a, b) for v in q.paths[0])):
            return matching.subtract(self.match(a), self.match(b), without)
        path = b.paths[0]
        rest = tuple(v for v in path if v.name != without)
        same = (a.table, a.strategy, a.within, a.unit, set(a.compares)) == (b.table, b.strategy, b.within, b.unit, set(b.compares)) and set(a.ranges) == {r for r in b.ranges if r.var != without}
        inner = rest == a.paths[0] and len(rest) == len(path) - 1 and without not in (path[0].name, path[-1].name)
        if a.strategy != ANY or not same or not inner or any(without in c.vars for c in b.compares):
            return matching.subtract(self.match(a), self.match(b), without)
        return self.match(replace(b, pattern=patterns.Op("SEQ", tuple(replace(v, kind=patterns.NOT) if v.name == without else v for v in path))))

    def events_of(self, query: str | Query, matches: DataFrame) -> DataFrame:
        """The matches with a struct of the whole event for every variable, fetched by sequence number."""
        q, table = self._query(query)
        for v in patterns.variables(q.pattern):
            key = name(v.name, "seq")
            if key in matches.columns:
                payload = table.df.select(F.col(table.seq_col).cast("long").alias("_key"), F.struct(*table.df.columns).alias(v.name))
                matches = matches.join(payload, F.col(key) == F.col("_key"), "left").drop("_key")
        return matches

    def explain(self, query: str | Query) -> str:
        """The pattern, its paths, predicates by variable, and the physical plan."""
        q, table = self._query(query)
        lines = [patterns.tree(q.pattern), f"window: {table.window(q.within, q.unit)}, strategy: {q.strategy}, prefilter: {self.prefilter}"]
        for i, path in enumerate(q.paths):
            lines.append(f"path {i}: {' '.join(map(str, path))}")
            for k, v in enumerate(path):
                bound = {x.name for x in path[: k + 1]}
                own = [str(r) for r in q.ranges if r.var == v.name] + [str(c) for c in q.compares if v.name in c.vars and c.vars <= bound]
                lines.append(f"  {v}: {' AND '.join(own) or '-'}")
        plan = self.match(q)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n".join([*lines, plan])

    def run_all(self, texts: list[str]) -> list[dict]:
        """Counts and seconds of many queries."""
        out = []
        for text in texts:
            began = time.monotonic()
            n = self.count(text).first()["matches"]
            out.append({"query": text, "matches": n, "seconds": time.monotonic() - began})
        return out

    def phases(self, query: str | Query) -> dict[str, float]:
        """Seconds of the phases of a query, one after the other: filter (the time buckets that may hold a match), scan
        (the events in them, read and kept) and match; and the rows that each gives, paths added up."""
        q, _ = self._query(query)
        out = dict.fromkeys(("filter", "scan", "match", "buckets", "events", "matches"), 0)
        for path in q.paths:
            m, began = self.matcher(q), time.monotonic()
            found = pruning.buckets(m, path).persist()
            events = None
            try:
                out["buckets"] += found.count()
                out["filter"], began = out["filter"] + time.monotonic() - began, time.monotonic()
                events = pruning.by_buckets(m, path, found).persist()
                out["events"] += events.count()
                out["scan"], began = out["scan"] + time.monotonic() - began, time.monotonic()
                run = matching.contiguous(m.events, path, q.ranges, q.compares, m.window) if q.strategy == STRICT else replace(m, events=events).run(path)
                out["matches"] += run.count()
                out["match"] += time.monotonic() - began
            finally:
                found.unpersist()
                if events is not None:
                    events.unpersist()
        return out


def same_counts(a: list[dict], b: list[dict]) -> list[str]:
    """Queries that two runs answer differently."""
    if len(a) != len(b):
        warnings.warn("the runs have different numbers of queries", stacklevel=2)
    return [x["query"] for x, y in zip(a, b, strict=False) if x["matches"] != y["matches"]]
