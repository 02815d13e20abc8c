"""The registered queries over the events and orders tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import scalars
from .operators import matching, pruning, statistics, versions
from .operators.keyed import match_keyed
from .plans.parser import NEXT, Query, parse
from .sources.tables import EventTable
from .streaming import matcher as streams

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}
HOUR = 3_600_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def engine(spark: SparkSession, sf_dir: str, **how) -> Engine:
    out = Engine(spark, **how)
    out.register("events", _events(spark, sf_dir), "event_type", "ts", "event_id")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out.register("orders", orders, "o_orderpriority", "o_orderdate", "o_orderkey")
    return out


def _ids(matches: DataFrame, path: bool = False) -> DataFrame:
    return matches.select(*(["path"] if path else []), *(c for c in matches.columns if c.endswith(("__seq", "__k"))))


def _text(pattern: str, where: str = "", within: str = "1 hour", strategy: str = "ANY", table: str = "events", result: str = "tuples") -> str:
    return f"PATTERN {pattern} FROM {table} USING SKIP_TILL_{strategy}_MATCH {'WHERE ' + where if where else ''} WITHIN {within} RETURN {result}"


# ---- SQL for the oracles

_E = "e AS (SELECT event_id AS seq, epoch_us(ts) AS ts, event_type AS type, user_id, value FROM events)"
_O = "e AS (SELECT o_orderkey AS seq, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS ts, o_orderpriority AS type, o_totalprice AS value, o_custkey AS user_id FROM orders)"
Step = tuple[str, str, str]  # variable, type, further conditions on the variables bound so far


def _any_body(steps: list[Step], window: int) -> str:
    (v, t, cond), *rest = steps
    out = f"FROM e {v}"
    for (w, u, c), prev in zip(rest, steps, strict=False):
        out += f" JOIN e {w} ON {w}.type = '{u}' AND ({w}.ts > {prev[0]}.ts OR {w}.ts = {prev[0]}.ts AND {w}.seq > {prev[0]}.seq) AND {w}.ts <= {v}.ts + {window}" + (f" AND {c}" if c else "")
    return f"{out} WHERE {v}.type = '{t}'" + (f" AND {cond}" if cond else "")


def _any_sql(steps: list[Step], window: int = HOUR, source: str = _E) -> str:
    return f"WITH {source} SELECT {', '.join(f'{v}.seq AS {v}__seq' for v, _, _ in steps)} {_any_body(steps, window)}"


def _next_ctes(steps: list[Step], window: int, prefix: str = "s") -> tuple[str, str]:
    """CTEs for a greedy chain; rows are structs named as the variables."""
    (v, t, cond), *rest = steps
    ctes = [f"{prefix}1 AS (SELECT {v} FROM e {v} WHERE {v}.type = '{t}'" + (f" AND {cond}" if cond else "") + ")"]
    bound = [v]
    for i, (w, u, c) in enumerate(rest, 2):
        last, keep = bound[-1], ", ".join(f"any_value(s.{b}) AS {b}" for b in bound)
        cc = c
        for b in bound:
            cc = cc.replace(f"{b}.", f"s.{b}.")
        cc = cc.replace(f"{w}.", "x.") if c else ""
        ctes.append(
            f"{prefix}{i} AS (SELECT {keep}, min({{'ts': x.ts, 'seq': x.seq, 'type': x.type, 'user_id': x.user_id, 'value': x.value}}) AS {w} FROM {prefix}{i - 1} s JOIN e x ON x.type = '{u}' "
            f"AND (x.ts > s.{last}.ts OR x.ts = s.{last}.ts AND x.seq > s.{last}.seq) AND x.ts <= s.{v}.ts + {window}" + (f" AND {cc}" if cc else "") + f" GROUP BY s.{v}.seq)"
        )
        bound.append(w)
    return ", ".join(ctes), f"{prefix}{len(steps)}"


def _next_sql(steps: list[Step], window: int = HOUR, source: str = _E) -> str:
    ctes, last = _next_ctes(steps, window)
    return f"WITH {source}, {ctes} SELECT {', '.join(f'{v}.seq AS {v}__seq' for v, _, _ in steps)} FROM {last}"


def _union_sql(branches: list[list[Step]], names: list[str], strategy: str = "any", window: int = HOUR) -> str:
    ctes, selects = [_E], []
    for i, steps in enumerate(branches):
        have = [v for v, _, _ in steps]
        columns = ", ".join(f"{v}.seq AS {v}__seq" if v in have else f"CAST(NULL AS BIGINT) AS {v}__seq" for v in names)
        if strategy == "any":
            selects.append(f"SELECT {i} AS path, {columns} {_any_body(steps, window)}")
        else:
            c, last = _next_ctes(steps, window, f"p{i}_")
            ctes.append(c)
            selects.append(f"SELECT {i} AS path, {columns} FROM {last}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(selects)}"


def _add(name: str, run: Run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _pattern(name: str, text: str, sql: str, path: bool = False, count: bool = False, **how) -> None:
    if count:
        _add(name, lambda spark, d: engine(spark, d, **how).count(text), f"SELECT count(*) AS matches FROM ({sql})")
    else:
        _add(name, lambda spark, d: _ids(engine(spark, d, **how).match(text), path), sql)


VIEW, CLICK, BUY, ERROR = ("v1", "view", ""), ("v2", "click", ""), ("v3", "purchase", ""), ("v4", "error", "")
FLAGSHIP = _text("SEQ(view v1, click v2, purchase v3)", "0 <= v1.value <= 30 AND v2.value >= v1.value * 1.003 AND v3.value <= v2.value * 0.997", strategy="NEXT")
_FLAG = [("v1", "view", "v1.value BETWEEN 0 AND 30"), ("v2", "click", "v2.value >= v1.value * 1.003"), ("v3", "purchase", "v3.value <= v2.value * 0.997")]

# filters and candidates
_sel = "SELECT event_id AS seq, event_type AS type FROM events WHERE "


def _filtered(text: str):
    def run(spark: SparkSession, d: DataFrame) -> DataFrame:
        e = engine(spark, d)
        q = parse(text)
        m, found = e.matcher(q), None
        for path in q.paths:
            for v in path:
                part = m.candidates(v).select(F.col(f"{v.name}__seq").alias("seq"), F.lit(v.type).alias("type"))
                found = part if found is None else found.unionAll(part)
        return found.distinct()

    return run


_add("scan_type_filter", _filtered(_text("SEQ(view v1)")), _sel + "event_type = 'view'")
_add("ic_two_sided", _filtered(_text("SEQ(view v1)", "10 <= v1.value < 50")), _sel + "event_type = 'view' AND value >= 10 AND value < 50")
_add("ic_one_sided", _filtered(_text("SEQ(click v1)", "v1.value > 20")), _sel + "event_type = 'click' AND value > 20")
_add("candidate_or_filter", _filtered(_text("SEQ(view v1, click v2)", "v1.value <= 10 AND 40 <= v2.value")), _sel + "event_type = 'view' AND value <= 10 OR event_type = 'click' AND value >= 40")

# sequences
_pattern("seq2_any", _text("SEQ(view v1, click v2)"), _any_sql([VIEW, CLICK]))
_pattern("seq3_any", _text("SEQ(view v1, click v2, purchase v3)"), _any_sql([VIEW, CLICK, BUY]))
_pattern("seq3_any_count", _text("SEQ(view v1, click v2, purchase v3)", within="15 minutes", result="COUNT(*)"), _any_sql([VIEW, CLICK, BUY], HOUR // 4), count=True)
_pattern("seq5_any_count", _text("SEQ(view a, click b, view c, click d, purchase f)", "a.value <= 40", "30 minutes", result="COUNT(*)"), _any_sql([("a", "view", "a.value <= 40"), ("b", "click", ""), ("c", "view", ""), ("d", "click", ""), ("f", "purchase", "")], HOUR // 2), count=True)
_pattern("seq3_any_dc", FLAGSHIP.replace("NEXT", "ANY"), _any_sql(_FLAG))
_pattern("seq2_next", _text("SEQ(view v1, click v2)", strategy="NEXT"), _next_sql([VIEW, CLICK]))
_pattern("seq3_next", _text("SEQ(view v1, click v2, purchase v3)", strategy="NEXT"), _next_sql([VIEW, CLICK, BUY]))
_pattern("seq3_next_dc", FLAGSHIP, _next_sql(_FLAG))
_pattern("seq4_next_count", _text("SEQ(view v1, click v2, purchase v3, error v4)", within="2 hours", strategy="NEXT", result="COUNT(*)"), _next_sql([VIEW, CLICK, BUY, ERROR], 2 * HOUR), count=True)
_pattern("seq_dc_linear", _text("SEQ(view v1, click v2)", "v1.value * 2 + 1 <= v2.value / 2 - 3 AND v2.user_id < v1.user_id + 500"), _any_sql([VIEW, ("v2", "click", "v1.value * 2 + 1 <= v2.value / 2 - 3 AND v2.user_id < v1.user_id + 500")]))
_pattern("seq_dc_cross_attribute", _text("SEQ(view v1, click v2)", "v1.value >= v2.user_id"), _any_sql([VIEW, ("v2", "click", "v1.value >= v2.user_id")]))
_pattern("seq_same_type", _text("SEQ(view v1, view v2)"), _any_sql([VIEW, ("v2", "view", "")]))
_pattern("seq_same_type_next", _text("SEQ(view v1, view v2)", strategy="NEXT"), _next_sql([VIEW, ("v2", "view", "")]))
_PRIORITY = [("v1", "1-URGENT", "v1.value >= 250000"), ("v2", "2-HIGH", "v2.value >= v1.value")]


def _ties(strategy: str, window: int):
    """Types that are no names in the language: the query is built, not parsed."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from .plans.patterns import Op, Var
        from .plans.predicates import Compare, Linear, Range

        pattern = Op("SEQ", (Var("1-URGENT", "v1"), Var("2-HIGH", "v2")))
        q = Query(pattern, "orders", strategy, (Range("v1", "o_totalprice", low=250000.0),), (Compare(Linear("v2", "o_totalprice"), ">=", Linear("v1", "o_totalprice")),), window, None, False)
        return _ids(engine(spark, d).match(q))

    return run


_add("seq_orders_ties", _ties("any", 0), _any_sql(_PRIORITY, 0, _O))
_add("seq_orders_ties_next", _ties("next", 48 * HOUR), _next_sql(_PRIORITY, 48 * HOUR, _O))
_USERS = [VIEW, ("v2", "click", "v2.user_id = v1.user_id"), ("v3", "purchase", "v3.user_id = v2.user_id")]
_BY_USER = "v1.user_id = v2.user_id AND v2.user_id = v3.user_id"
_pattern("seq_keyed_user", _text("SEQ(view v1, click v2, purchase v3)", _BY_USER, "24 hours"), _any_sql(_USERS, 24 * HOUR))
_pattern("seq_keyed_user_next", _text("SEQ(view v1, click v2, purchase v3)", _BY_USER, "24 hours", "NEXT"), _next_sql(_USERS, 24 * HOUR))


def _sequential(strategy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = parse(_text("SEQ(view v1, click v2, purchase v3)", _BY_USER, "24 hours", strategy))
        e = engine(spark, d)
        found = match_keyed(e.tables["events"].events(["user_id"]), "user_id", q.paths[0], q.ranges, q.compares, 24 * HOUR, q.strategy)
        return _ids(found)

    return run


_add("keyed_sequential", _sequential("ANY"), _any_sql(_USERS, 24 * HOUR))
_add("keyed_sequential_next", _sequential("NEXT"), _next_sql(_USERS, 24 * HOUR))


def _contiguous(spark: SparkSession, d: str) -> DataFrame:
    q = parse("PATTERN SEQ(view v1, click v2) FROM events USING STRICT_CONTIGUOUS WHERE v2.value >= v1.value WITHIN 1 hour RETURN tuples")
    m = engine(spark, d).matcher(replace(q, strategy="any"))
    events = engine(spark, d).tables["events"].events(["user_id", "value"])
    return _ids(matching.contiguous(events, q.paths[0], q.ranges, q.compares, m.window, ["user_id"]))


_add("strict_contiguous_user", _contiguous, f"WITH {_E}, n AS (SELECT *, lead(seq) OVER w AS s2, lead(ts) OVER w AS t2, lead(type) OVER w AS y2, lead(value) OVER w AS x2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)) SELECT seq AS v1__seq, s2 AS v2__seq FROM n WHERE type = 'view' AND y2 = 'click' AND x2 >= value AND t2 <= ts + {HOUR}")

def _contiguous_all(spark: SparkSession, d: str) -> DataFrame:
    return _ids(engine(spark, d).match("PATTERN SEQ(view v1, click v2) FROM events USING STRICT_CONTIGUOUS WHERE v2.value >= v1.value WITHIN 1 hour RETURN tuples"))


_add("strict_contiguous", _contiguous_all, ORACLES["strict_contiguous_user"].replace("PARTITION BY user_id ", ""))


def _where(spark: SparkSession, d: str) -> DataFrame:
    """Extension points: a condition on one variable's events, and a function of the matches."""
    e = engine(spark, d)
    text = _text("SEQ(view v1, click v2)", "v1.value >= 0", "20 minutes")
    return _ids(e.match(text, {"v1": F.col("value") % 2 < 1}, lambda found: found.filter("v2__seq - v1__seq > 2")))


_add("extension_points", _where, _any_sql([("v1", "view", "v1.value % 2 < 1 AND v1.value >= 0"), ("v2", "click", "v2.seq - v1.seq > 2")], HOUR // 3))

# conjunction, disjunction, nesting
_pattern("and2", _text("AND(view v1, click v2)"), _union_sql([[VIEW, CLICK], [CLICK, VIEW]], ["v1", "v2"]), path=True)
_pattern("and2_next", _text("AND(view v1, click v2)", strategy="NEXT"), _union_sql([[VIEW, CLICK], [CLICK, VIEW]], ["v1", "v2"], "next"), path=True)
_pattern("and_of_seq", _text("AND(SEQ(view v1, click v2), SEQ(purchase v3, error v4))", within="30 minutes"), _union_sql([[VIEW, CLICK, BUY, ERROR], [BUY, ERROR, VIEW, CLICK]], ["v1", "v2", "v3", "v4"], window=HOUR // 2), path=True)
_pattern("seq_of_and", _text("SEQ(AND(view v1, click v2), AND(purchase v3, error v4))", within="30 minutes", strategy="NEXT"), _union_sql([[VIEW, CLICK, BUY, ERROR], [VIEW, CLICK, ERROR, BUY], [CLICK, VIEW, BUY, ERROR], [CLICK, VIEW, ERROR, BUY]], ["v1", "v2", "v3", "v4"], "next", HOUR // 2), path=True)
_pattern("or2", _text("OR(view v1, click v2)", "v1.value <= 5 AND v2.value <= 5"), _union_sql([[("v1", "view", "v1.value <= 5")], [("v2", "click", "v2.value <= 5")]], ["v1", "v2"]), path=True)
_pattern("seq_or", _text("SEQ(view v1, OR(click v2, purchase v3))", "v2.value >= v1.value AND v3.value < v1.value"), _union_sql([[VIEW, ("v2", "click", "v2.value >= v1.value")], [VIEW, ("v3", "purchase", "v3.value < v1.value")]], ["v1", "v2", "v3"]), path=True)
_pattern("nested_p3", _text("SEQ(view v1, AND(click v2, purchase v3), error v4)", "v4.value >= v1.value"), _union_sql([[VIEW, CLICK, BUY, ("v4", "error", "v4.value >= v1.value")], [VIEW, BUY, CLICK, ("v4", "error", "v4.value >= v1.value")]], ["v1", "v2", "v3", "v4"]), path=True)

# negation and loops
_GAP = "NOT EXISTS (SELECT 1 FROM e x WHERE x.type = 'error' AND (x.ts > {a}.ts OR x.ts = {a}.ts AND x.seq > {a}.seq) AND (x.ts < {b}.ts OR x.ts = {b}.ts AND x.seq < {b}.seq))"
_negated_next = _next_ctes([VIEW, CLICK], HOUR)
_pattern("neg_between", _text("SEQ(view v1, NEG(error n), click v2)", strategy="NEXT"), f"WITH {_E}, {_negated_next[0]}, flat AS (SELECT v1, v2 FROM {_negated_next[1]}) SELECT v1.seq AS v1__seq, v2.seq AS v2__seq FROM flat WHERE {_GAP.format(a='v1', b='v2')}")
_pattern("neg_between_any", _text("SEQ(view v1, NEG(error n), click v2)", within="20 minutes"), f"{_any_sql([VIEW, CLICK], HOUR // 3)} AND {_GAP.format(a='v1', b='v2')}")


def _subtract(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    short, longer = (_text(pattern, within="20 minutes") for pattern in ("SEQ(view v1, click v2)", "SEQ(view v1, error n, click v2)"))
    return _ids(e.subtract(short, longer, "n"))


_add("neg_subtract", _subtract, f"{_any_sql([VIEW, CLICK], HOUR // 3)} AND {_GAP.format(a='v1', b='v2')}")

_loop_ctes, _loop_last = _next_ctes([VIEW, CLICK], HOUR)
_PLUS = (
    f"WITH {_E}, {_loop_ctes}, looped AS (SELECT s.v1, s.v2, x.ts AS lts, x.seq AS lseq, row_number() OVER (PARTITION BY s.v1.seq ORDER BY x.ts, x.seq) AS k FROM {_loop_last} s JOIN e x ON x.type = 'error' AND (x.ts > s.v2.ts OR x.ts = s.v2.ts AND x.seq > s.v2.seq) AND x.ts <= s.v1.ts + {HOUR}@more@), "
    f"done AS (SELECT any_value(l.v1.seq) AS v1__seq, any_value(l.v2.seq) AS v2__seq, any_value(l.lseq) AS n__seq, l.k AS n__k, min({{'ts': x.ts, 'seq': x.seq}}).seq AS v3__seq FROM looped l JOIN e x ON x.type = 'purchase' AND (x.ts > coalesce(l.lts, l.v2.ts) OR x.ts = coalesce(l.lts, l.v2.ts) AND x.seq > coalesce(l.lseq, l.v2.seq)) AND x.ts <= l.v1.ts + {HOUR} GROUP BY l.v1.seq, l.k) SELECT * FROM done"
)
_pattern("kleene_plus", _text("SEQ(view v1, click v2, KP(error n), purchase v3)", strategy="NEXT"), _PLUS.replace("@more@", ""))
_pattern("kleene_star", _text("SEQ(view v1, click v2, KS(error n), purchase v3)", strategy="NEXT"), _PLUS.replace("@more@", f" UNION ALL SELECT v1, v2, NULL, NULL, 0 FROM {_loop_last}"))

# pruning
_pattern("bucket_prefilter", _text("SEQ(view v1, click v2, purchase v3)", "v1.value <= 10 AND v3.value >= 60"), _any_sql([("v1", "view", "v1.value <= 10"), CLICK, ("v3", "purchase", "v3.value >= 60")]), prefilter="buckets")
_pattern("interval_prefilter", _text("SEQ(view v1, click v2, purchase v3)", "v1.value <= 10 AND v3.value >= 60"), _any_sql([("v1", "view", "v1.value <= 10"), CLICK, ("v3", "purchase", "v3.value >= 60")]), prefilter="intervals")
_NEG, _KP = _text("SEQ(view v1, NEG(error n), click v2)", strategy="NEXT"), _text("SEQ(view v1, click v2, KP(error n), purchase v3)", strategy="NEXT")
for _mode in ("buckets", "intervals"):
    _pattern(f"neg_{_mode}", _NEG, ORACLES["neg_between"], prefilter=_mode)
    _pattern(f"kleene_plus_{_mode}", _KP, ORACLES["kleene_plus"], prefilter=_mode)
    _pattern(f"kleene_star_{_mode}", _KP.replace("KP", "KS"), ORACLES["kleene_star"], prefilter=_mode)
_pattern("or_prefilter", _text("SEQ(view v1, OR(click v2, purchase v3))", "v1.value <= 5"), _union_sql([[("v1", "view", "v1.value <= 5"), CLICK], [("v1", "view", "v1.value <= 5"), BUY]], ["v1", "v2", "v3"]), path=True, prefilter="buckets")


def _points(spark: SparkSession, d: str, type: str) -> DataFrame:
    return engine(spark, d).tables["events"].events([]).filter(F.col("_type") == type).select(F.col("_ts").alias("ts"), F.col("_seq").alias("seq"))


_TEN = 600_000_000
_ISLANDS = f"""p AS (SELECT ts - {_TEN} AS lo, ts + {_TEN} AS hi FROM e WHERE type = 'error'), m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p),
g AS (SELECT *, sum(new) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM m), s AS (SELECT min(lo) AS lo, max(hi) AS hi FROM g GROUP BY i)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return pruning.islands(pruning.intervals(_points(spark, d, "error"), _TEN), 2 * _TEN)


_add("interval_islands", _spans, f"WITH {_E}, {_ISLANDS} SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM s")
_add("interval_semijoin", lambda spark, d: pruning.keep_points(_points(spark, d, "click"), _spans(spark, d), 2 * _TEN).select("seq"), f"WITH {_E}, {_ISLANDS} SELECT seq FROM e WHERE type = 'click' AND EXISTS (SELECT 1 FROM s WHERE e.ts BETWEEN lo AND hi)")
_add("interval_hit_semijoin", lambda spark, d: pruning.keep_spans(_spans(spark, d), _points(spark, d, "purchase"), 2 * _TEN), f"WITH {_E}, {_ISLANDS} SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM s WHERE EXISTS (SELECT 1 FROM e WHERE type = 'purchase' AND ts BETWEEN lo AND hi)")
_add(
    "overlap_semijoin",
    lambda spark, d: pruning.keep_overlapping(pruning.intervals(_points(spark, d, "click"), 60_000_000, "left"), _spans(spark, d), 2 * _TEN),
    f"WITH {_E}, {_ISLANDS} SELECT DISTINCT ts AS lo, ts + 60000000 AS hi FROM e WHERE type = 'click' AND EXISTS (SELECT 1 FROM s WHERE s.lo <= e.ts + 60000000 AND e.ts <= s.hi)",
)
_add("seq_time_pairs", lambda spark, d: matching.time_pairs(_points(spark, d, "view"), _points(spark, d, "click"), HOUR).select("lseq", "rseq"), f"WITH {_E} SELECT a.seq AS lseq, b.seq AS rseq FROM e a JOIN e b ON b.ts - a.ts BETWEEN 0 AND {HOUR} WHERE a.type = 'view' AND b.type = 'click'")


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    q = parse(_text("SEQ(view v1, click v2, purchase v3)", "v1.value <= 10 AND v3.value >= 60"))
    return pruning.buckets(engine(spark, d).matcher(q), q.paths[0]).select(F.col("_bucket").alias("bucket"))


_add(
    "bucket_intersection",
    _buckets,
    f"WITH {_E}, b AS (SELECT *, ts // {HOUR} AS b FROM e) (SELECT b + unnest([0, 1]) AS bucket FROM b WHERE type = 'view' AND value <= 10) INTERSECT (SELECT b + unnest([-1, 0, 1]) FROM b WHERE type = 'click') INTERSECT (SELECT b + unnest([-1, 0]) FROM b WHERE type = 'purchase' AND value >= 60)",
)

# postings as sets
_add("postings_intersect", lambda spark, d: _events(spark, d).filter("event_type = 'view' AND value >= 20").select(F.col("event_id").alias("seq")).intersect(_events(spark, d).filter("event_type = 'view' AND value <= 60").select(F.col("event_id").alias("seq"))), "SELECT event_id AS seq FROM events WHERE event_type = 'view' AND value >= 20 INTERSECT SELECT event_id FROM events WHERE event_type = 'view' AND value <= 60")
_add("postings_union", lambda spark, d: _events(spark, d).filter("value >= 60").select(F.col("event_id").alias("seq")).union(_events(spark, d).filter("event_type = 'error'").select(F.col("event_id").alias("seq"))).dropDuplicates(["seq"]), "SELECT event_id AS seq FROM events WHERE value >= 60 UNION SELECT event_id FROM events WHERE event_type = 'error'")
_add("rows_of_postings", lambda spark, d: _fetch(spark, d), "SELECT event_id, user_id, props FROM events WHERE event_type = 'error' AND value >= 60")


def _fetch(spark: SparkSession, d: str) -> DataFrame:
    from .sources.tables import fetch

    table = engine(spark, d).tables["events"]
    return fetch(table, table.df.filter("event_type = 'error' AND value >= 60").select(F.col("event_id").alias("seq"))).select("event_id", "user_id", "props")


def _payload(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    return e.events_of(FLAGSHIP, e.match(FLAGSHIP)).select(F.col("v1.event_id").alias("id1"), F.col("v1.props").alias("props1"), F.col("v3.event_id").alias("id3"), F.col("v3.user_id").alias("user3"))


_flag_ctes, _flag_last = _next_ctes(_FLAG, HOUR)
_add("match_events", _payload, f"WITH {_E}, {_flag_ctes} SELECT v1.seq AS id1, p.props AS props1, v3.seq AS id3, v3.user_id AS user3 FROM {_flag_last} m JOIN events p ON p.event_id = m.v1.seq")

# statistics
_add("arrival_rates", lambda spark, d: statistics.arrival_rates(engine(spark, d).tables["events"].events([])).select(F.col("_type").alias("type"), "n", F.round(F.col("rate") * 3.6e9, 6).alias("per_hour")), f"WITH {_E} SELECT type, count(*) AS n, round(count(*) / (SELECT max(ts) - min(ts) FROM e) * 3.6e9, 6) AS per_hour FROM e GROUP BY type")
_add("cluster_synopsis", lambda spark, d: statistics.synopsis(engine(spark, d).tables["events"].events(["value"]), ["value"], 1024).withColumnRenamed("_type", "type"), f"WITH {_E} SELECT seq // 1024 AS block, type, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts, min(value) AS min_value, max(value) AS max_value FROM e GROUP BY ALL")
_add("related_clusters", lambda spark, d: statistics.overlapping(statistics.synopsis(engine(spark, d).tables["events"].events(["value"]), ["value"], 64), "error", list(parse(_text("SEQ(error v1)", "95 <= v1.value")).ranges)).select("block", "n"), f"WITH {_E} SELECT seq // 64 AS block, count(*) AS n FROM e WHERE type = 'error' GROUP BY 1 HAVING max(value) >= 95")
_add("selectivity", lambda spark, d: statistics.selectivity(engine(spark, d).tables["events"].events(["value"]), {"v1": "view", "v2": "click"}, parse(_text("SEQ(view v1, click v2)", "10 <= v1.value <= 50 AND v2.value > 20")).ranges).select("var", F.round("selectivity", 9).alias("selectivity")), f"WITH {_E} SELECT 'v1' AS var, round(count(*) FILTER (type = 'view' AND value BETWEEN 10 AND 50) / count(*), 9) AS selectivity FROM e UNION ALL SELECT 'v2', round(count(*) FILTER (type = 'click' AND value > 20) / count(*), 9) FROM e")
_add("reservoir_sample", lambda spark, d: statistics.sample(engine(spark, d).tables["events"].events(["value"]), 5000).select(F.col("_seq").alias("seq"), F.col("_type").alias("type"), "value"), f"WITH {_E} SELECT seq, type, value FROM e ORDER BY md5(seq || '|0'), seq LIMIT 5000")

# updates, deletes, order of arrival
_VERSIONS = "v AS (SELECT event_id AS seq, date_trunc('hour', ts) AS ts, event_type AS type, user_id, value FROM events)"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "event_type", "user_id", "value")


_LATEST = f"{_VERSIONS}, l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY type, ts ORDER BY seq DESC) = 1)"
_add("latest_version", lambda spark, d: versions.latest(_versions(spark, d), ["event_type", "ts"], "event_id").select("event_id", "user_id"), f"WITH {_LATEST} SELECT seq AS event_id, user_id FROM l")
_add("tombstones", lambda spark, d: versions.without_deleted(_versions(spark, d), ["event_type", "ts"], "event_id", F.col("value") < 20).select("event_id", "user_id"), f"WITH {_LATEST} SELECT seq AS event_id, user_id FROM l WHERE value >= 20")


def _updated(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    e.register("events", _versions(spark, d), "event_type", "ts", "event_id", versioned=True)
    return _ids(e.match(_text("SEQ(view v1, click v2)", "v2.value >= v1.value", "3 hours")))


_add("seq_with_updates", _updated, f"WITH {_LATEST}, e AS (SELECT seq, epoch_us(ts) AS ts, type, user_id, value FROM l) SELECT v1.seq AS v1__seq, v2.seq AS v2__seq {_any_body([VIEW, ('v2', 'click', 'v2.value >= v1.value')], 3 * HOUR)}")


def _shuffled(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    e.register("events", _events(spark, d).repartition(5, F.xxhash64("event_id")), "event_type", "ts", "event_id")
    return _ids(e.match(_text("SEQ(view v1, click v2)")))


_add("out_of_order_seq", _shuffled, _any_sql([VIEW, CLICK]))


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    e.register("events", _events(spark, d), "event_type", "ts", "event_id", fixed_point=True, scales={"value": 0})
    return _ids(e.match(_text("SEQ(view v1, click v2)", "v1.value = v2.value")))


_add("fixed_point", _fixed, _any_sql([VIEW, ("v2", "click", "trunc(v1.value) = trunc(v2.value)")]))

# codes
_by = (["type"], ["ts", "seq"])


def _codes(spark: SparkSession, d: str) -> DataFrame:
    rows = engine(spark, d).tables["events"].events([]).select(F.col("_type").alias("type"), F.col("_ts").alias("ts"), F.col("_seq").alias("seq"))
    rows = rows.withColumns({"dod": scalars.delta_of_delta(F.col("ts"), *_by), "d": scalars.delta(F.col("ts"), *_by)})
    rows = rows.withColumns({"z": scalars.zigzag(F.col("dod")), "back": scalars.undelta(F.col("d"), *_by)})
    return rows.select("seq", "d", "dod", "z", scalars.varint_bytes(F.col("z")).alias("bytes"), (scalars.unzigzag(F.col("z")) - F.col("dod")).alias("lost"), "back")


_add(
    "codec_zigzag_delta",
    _codes,
    f"WITH {_E}, l AS (SELECT *, lag(ts) OVER w AS a, lag(ts, 2) OVER w AS b FROM e WINDOW w AS (PARTITION BY type ORDER BY ts, seq)), q AS (SELECT seq, ts, ts - coalesce(a, 0) AS d, CASE WHEN b IS NOT NULL THEN ts - 2 * a + b WHEN a IS NOT NULL THEN ts - a ELSE ts END AS dod FROM l), z AS (SELECT *, CASE WHEN dod >= 0 THEN 2 * dod ELSE -2 * dod - 1 END AS z FROM q) SELECT seq, d, dod, z, CAST(CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 WHEN z < 268435456 THEN 4 WHEN z < 34359738368 THEN 5 WHEN z < 4398046511104 THEN 6 WHEN z < 562949953421312 THEN 7 WHEN z < 72057594037927936 THEN 8 ELSE 9 END AS INTEGER) AS bytes, 0 AS lost, ts AS back FROM z",
)

# streams


def _folder(spark: SparkSession) -> str:
    """A folder that all machines share: in the one that the cluster names, one of our own only where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines share")
    return f"{named or tempfile.mkdtemp(prefix='spindrift-')}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """The events as a stream, and one closing event a year later."""
    rows = spark.readStream.schema(_events(spark, d).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    last = _events(spark, d).agg(F.max("ts").cast("timestamp").alias("t")).select(F.lit(streams.CLOSING).alias("_type"), (F.col("t") + F.expr("INTERVAL 366 DAYS")).alias("_time"), F.lit(-1).cast("long").alias("_seq"), F.lit(-1).cast("long").alias("user_id"), F.lit(0.0).alias("value"))
    last.write.parquet(f"{folder}/closing")
    closing = spark.readStream.schema(last.schema).parquet(f"{folder}/closing")
    events = rows.select(F.col("event_type").alias("_type"), F.col("ts").cast("timestamp").alias("_time"), F.col("event_id").alias("_seq"), F.col("user_id").cast("long").alias("user_id"), "value")
    return events.unionByName(closing)


def _stream_next(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    q = parse(_text("SEQ(view v1, click v2, purchase v3)", "v2.value >= v1.value", "24 hours", "NEXT"))
    found = streams.match_stream(_stream(spark, d, folder), "user_id", q.paths[0], q.ranges, q.compares, 24 * HOUR, NEXT)
    return _ids(streams.collected(found, folder, "matches"))


_add("stream_seq_next", _stream_next, _next_sql([VIEW, ("v2", "click", "v2.value >= v1.value AND v2.user_id = v1.user_id"), ("v3", "purchase", "v3.user_id = v1.user_id")], 24 * HOUR))


def _stream_of(pattern: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        folder = _folder(spark)
        q = parse(_text(pattern, "", "24 hours", "NEXT"))
        found = streams.match_stream(_stream(spark, d, folder), "user_id", q.paths[0], q.ranges, q.compares, 24 * HOUR, NEXT)
        return _ids(streams.collected(found, folder, "matches"))

    return run


_SAME_USER, _DAY = "user_id = v1.user_id", 24 * HOUR
_user_ctes, _user_last = _next_ctes([VIEW, ("v2", "click", f"v2.{_SAME_USER}")], _DAY)
_after_last = "(x.ts > coalesce(l.lts, l.v2.ts) OR x.ts = coalesce(l.lts, l.v2.ts) AND x.seq > coalesce(l.lseq, l.v2.seq))"
_USER_PLUS = (
    f"WITH {_E}, {_user_ctes}, looped AS (SELECT s.v1, s.v2, x.ts AS lts, x.seq AS lseq, row_number() OVER (PARTITION BY s.v1.seq ORDER BY x.ts, x.seq) AS k FROM {_user_last} s JOIN e x ON x.type = 'error' AND x.user_id = s.v1.user_id AND (x.ts > s.v2.ts OR x.ts = s.v2.ts AND x.seq > s.v2.seq) AND x.ts <= s.v1.ts + {_DAY}@more@), "
    f"done AS (SELECT any_value(l.v1.seq) AS v1__seq, any_value(l.v2.seq) AS v2__seq, any_value(l.lseq) AS n__seq, l.k AS n__k, min({{'ts': x.ts, 'seq': x.seq}}).seq AS v3__seq FROM looped l JOIN e x ON x.type = 'purchase' AND x.user_id = l.v1.user_id AND {_after_last} AND x.ts <= l.v1.ts + {_DAY} GROUP BY l.v1.seq, l.k) SELECT * FROM done"
)
_add("stream_kleene_plus", _stream_of("SEQ(view v1, click v2, KP(error n), purchase v3)"), _USER_PLUS.replace("@more@", ""))
_add("stream_kleene_star", _stream_of("SEQ(view v1, click v2, KS(error n), purchase v3)"), _USER_PLUS.replace("@more@", f" UNION ALL SELECT v1, v2, NULL, NULL, 0 FROM {_user_last}"))
_add("stream_neg", _stream_of("SEQ(view v1, NEG(error n), click v2)"), f"WITH {_E}, {_user_ctes}, flat AS (SELECT v1, v2 FROM {_user_last}) SELECT v1.seq AS v1__seq, v2.seq AS v2__seq FROM flat WHERE {_GAP.format(a='v1', b='v2').replace('x.type', 'x.user_id = v1.user_id AND x.type')}")


def _stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    side = lambda t: _stream(spark, d, f"{folder}/{t}").filter(F.col("_type") == t).select(F.col("_time").alias("time"), F.col("_seq").alias("seq"))
    return streams.collected(streams.pairs_of_streams(side("view"), side("click"), 900), folder, "pairs")


_add("stream_pairs_any", _stream_pairs, f"WITH {_E} SELECT a.seq AS lseq, b.seq AS rseq {_any_body([('a', 'view', ''), ('b', 'click', '')], HOUR // 4)}")
