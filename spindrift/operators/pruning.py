"""Window pruning: replay intervals, interval semi-joins and bucket intersection. None of it changes an answer.

What prunes grows with the time that events cover, not with their number. Where that is at most MOST_BROADCAST windows it
goes to every task, so no events are shuffled to be pruned; beyond, both sides are shuffled by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket
from ..plans.patterns import NOT, STAR, Path
from .matching import Matcher, name

LEFT, RIGHT, MIDDLE = "left", "right", "middle"
#: Buckets, or spans in each bucket that they touch, that are sent to every task (24 bytes each and a hash table's room).
MOST_BROADCAST = 200_000


def intervals(points: DataFrame, window: int, side: str = MIDDLE, ts: str = "ts") -> DataFrame:
    """lo and hi of the time in which a match with one of the points may lie, one row a point."""
    lo = F.col(ts) - (0 if side == LEFT else window)
    hi = F.col(ts) + (0 if side == RIGHT else window)
    return points.select(lo.alias("lo"), hi.alias("hi"))


def covered(points: DataFrame, window: int, side: str = MIDDLE, ts: str = "ts") -> DataFrame:
    """The time that `intervals` cover, in spans of up to three windows that may overlap, at most one for each window of time.

    Intervals are as long as a window or longer, so those that begin within one window of time overlap one another.
    """
    spans = intervals(points, window, side, ts)
    return spans.groupBy(bucket(F.col("lo"), max(1, window)).alias("_part")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_part")


def islands(spans: DataFrame, width: int) -> DataFrame:
    """Spans (lo, hi), each at most `width` long, merged where they overlap or touch.

    Spans are sorted within stretches of time of 64 widths. A span reaches over the end of its stretch by a width at
    most, so only islands at the ends of a stretch may go on in its neighbours. These are merged again in stretches 64
    times as long, and so on until one holds all; each level has the ends of the one before, a 64th of its time.
    """
    width = max(1, width)

    def merged(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("lo", "hi")
        reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
        marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*by, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")

    ends = spans.agg(F.min("lo").alias("first"), F.max("lo").alias("last")).first()
    rows, done, stretch = spans.select("lo", "hi"), None, 64 * width
    while ends["first"] is not None:
        part = bucket(F.col("lo"), stretch)
        local = merged(rows.select("lo", "hi", part.alias("_part")), ["_part"])
        if ends["first"] // stretch == ends["last"] // stretch:
            rows = local.select("lo", "hi")
            break
        inner = (F.col("lo") > F.col("_part") * stretch + width) & (F.col("hi") < (F.col("_part") + 1) * stretch)
        settled = local.filter(inner).select("lo", "hi")
        done = settled if done is None else done.unionAll(settled)
        rows, stretch = local.filter(~inner).select("lo", "hi"), stretch * 64
        if stretch > 1 << 62:  # the two sides of time zero
            rows = merged(rows.withColumn("_all", F.lit(0)), ["_all"]).select("lo", "hi")
            break
    return rows if done is None else rows.unionAll(done)


def _reach(spans: DataFrame, width: int) -> DataFrame:
    """Spans in each bucket that they touch."""
    return spans.withColumn("_b", F.explode(F.sequence(bucket(F.col("lo"), width), bucket(F.col("hi"), width))))


def keep_points(points: DataFrame, spans: DataFrame, width: int, ts: str = "ts", few: bool = False) -> DataFrame:
    """The points that lie in a span (both ends included). few: whether every task may get all spans."""
    width = max(1, width)
    at, reach = points.withColumn("_pb", bucket(F.col(ts), width)), _reach(spans, width)
    return at.join(F.broadcast(reach) if few else reach, (F.col("_pb") == F.col("_b")) & (F.col(ts) >= F.col("lo")) & (F.col(ts) <= F.col("hi")), "left_semi").drop("_pb")


def keep_spans(spans: DataFrame, points: DataFrame, width: int, ts: str = "ts", few: bool = False) -> DataFrame:
    """The spans that hold a point. few: whether every task may get all spans, of which few hold the same point."""
    width = max(1, width)
    at, reach = points.select(F.col(ts).alias("_t"), bucket(F.col(ts), width).alias("_pb")), _reach(spans, width)
    on = (F.col("_pb") == F.col("_b")) & (F.col("_t") >= F.col("lo")) & (F.col("_t") <= F.col("hi"))
    held = at.join(F.broadcast(reach), on) if few else reach.join(at, on, "left_semi")
    return held.select(*spans.columns).distinct()


def keep_overlapping(spans: DataFrame, others: DataFrame, width: int) -> DataFrame:
    """The spans that share a point of time with one of the others."""
    width = max(1, width)
    b = _reach(others.select("lo", "hi"), width).select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("_b").alias("_ob"))
    return _reach(spans, width).join(b, (F.col("_b") == F.col("_ob")) & (F.col("lo") <= F.col("_hi")) & (F.col("_lo") <= F.col("hi")), "left_semi").select(*spans.columns).distinct()


def _needed(path: Path) -> list[int]:
    """Places of the variables that every match binds: not negated ones, nor those a star may leave empty."""
    return [i for i, v in enumerate(path) if v.kind not in (NOT, STAR)]


def _few(events: DataFrame, width: int, each: int = 1) -> bool:
    """Whether `each` rows for every bucket of the time that events cover may go to every task; two numbers are collected."""
    ends = events.agg(F.min("_ts").alias("first"), F.max("_ts").alias("last")).first()
    return ends["first"] is None or each * ((ends["last"] - ends["first"]) // width + 2) <= MOST_BROADCAST


def buckets(matcher: Matcher, path: Path) -> DataFrame:
    """_bucket: the time buckets that may hold part of a match, those in reach of a candidate of every needed variable."""
    width, found = max(1, matcher.window), None
    needed = _needed(path)
    for i in needed:
        v = path[i]
        at = matcher.candidates(v).select(bucket(F.col(name(v.name, "ts")), width).alias("_b")).distinct()
        steps = (0, 1) if i == 0 else (-1, 0) if i == len(path) - 1 else (-1, 0, 1)
        at = at.select(F.explode(F.array(*(F.col("_b") + s for s in steps))).alias("_bucket"), F.lit(i).alias("_var"))
        found = at if found is None else found.unionAll(at)
    return found.distinct().groupBy("_bucket").agg(F.count("*").alias("n")).filter(F.col("n") == len(needed)).select("_bucket")


def by_buckets(matcher: Matcher, path: Path, found: DataFrame | None = None) -> DataFrame:
    """The matcher's events in buckets that may hold a match of the path (`found`, if those are known)."""
    events, width = matcher.events.filter(F.col("_type").isin(sorted({v.type for v in path}))), max(1, matcher.window)
    found = buckets(matcher, path) if found is None else found
    return events.withColumn("_bucket", bucket(F.col("_ts"), width)).join(F.broadcast(found) if _few(events, width) else found, "_bucket", "left_semi").drop("_bucket")


def by_intervals(matcher: Matcher, path: Path, driver: int = 0) -> DataFrame:
    """The matcher's events within reach of a candidate of the driving variable, then of every other needed one."""
    window, needed = matcher.window, _needed(path)
    if driver not in needed:
        raise ValueError("this variable may be unbound in a match")
    events = matcher.events.filter(F.col("_type").isin(sorted({v.type for v in path})))
    side = LEFT if driver == 0 else RIGHT if driver == len(path) - 1 else MIDDLE
    v = path[driver]
    spans = islands(covered(matcher.candidates(v), window, side, name(v.name, "ts")), 3 * window)
    few = _few(events, max(1, window), 3)  # an island is longer than the window and touches a bucket more than it covers
    for i in needed:
        if i != driver:
            v = path[i]
            spans = keep_spans(spans, matcher.candidates(v), 2 * window, name(v.name, "ts"), few)
    return keep_points(events, spans, 2 * window, "_ts", few)


def driver(path: Path, selectivity: dict[str, float]) -> int:
    """The place of the variable to drive by: the least share of events, those in the middle counting twice, as their
    intervals are twice as long."""
    return min(_needed(path), key=lambda i: (selectivity[path[i].name] * (1 if i in (0, len(path) - 1) else 2), i))
