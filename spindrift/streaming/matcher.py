"""Pattern matching over streams, with the answers of the batch engine.

Events arrive in any order; each key's events wait in state until the watermark has passed them and are then matched
in the order (time, sequence). Runs that the window has left behind are dropped. Patterns with loops or negations
give the matches of an event when its window is over. An event that comes later than the
watermark allows is left out, as in any event-time aggregation.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import bucket
from ..operators.keyed import Runs, Windows, result_columns, result_row
from ..plans.parser import ANY
from ..plans.patterns import ONE, Path
from ..plans.predicates import Compare, Range

#: The type of an event that binds nothing: sent after the last one, it lets the watermark pass all others.
CLOSING = "__closing__"


def match_stream(events: DataFrame, key: str, path: Path, ranges: tuple[Range, ...], compares: tuple[Compare, ...], window: int, strategy: str = ANY, delay: str = "0 seconds") -> DataFrame:
    """key, and ts and seq of each variable, of the matches within each key of a streaming `events`.

    events: _type, _time (timestamp), _seq, the key and attributes; window in microseconds. Without a key of the data,
    a constant column serves, and the stream is matched in one place.
    """
    names, plain = result_columns(path), all(v.kind == ONE for v in path)
    kind = events.schema[key].dataType.simpleString()
    types = sorted({v.type for v in path})

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, runs, passed = pickle.loads(state.get[0]) if state.exists else ([], [], -1)
        watermark = state.getCurrentWatermarkMs()
        for frame in frames if not state.hasTimedOut else ():
            waiting += [e for e in frame.to_dict("records") if e["_type"] in types and e["_ts"] // 1000 > passed]
        ready = sorted((e for e in waiting if e["_ts"] // 1000 <= watermark), key=lambda e: (e["_ts"], e["_seq"]))
        waiting = [e for e in waiting if e["_ts"] // 1000 > watermark]
        if plain:
            matcher = Runs(path, ranges, compares, window, strategy, runs)
            out = [(keys[0], *(e[x] for e in m for x in ("_ts", "_seq"))) for event in ready for m in matcher.feed(event)]
            open_runs = [r for r in matcher.runs if (r[0]["_ts"] + window) // 1000 >= watermark]
            ends = [(r[0]["_ts"] + window) // 1000 for r in open_runs]
        else:
            matcher = Windows(path, ranges, compares, window, strategy, runs)
            found = [m for event in ready for m in matcher.feed(event)] + matcher.passed(watermark * 1000)
            out, open_runs = [(keys[0], *result_row(path, m)) for m in found], matcher.events
            ends = [(e["_ts"] + window) // 1000 for e in open_runs if e["_open"]]
        if waiting or open_runs:
            state.update((pickle.dumps((waiting, open_runs, max(passed, watermark))),))
            due = min([e["_ts"] // 1000 for e in waiting] + ends)
            state.setTimeoutTimestamp(max(due, watermark) + 1)
        elif state.exists:
            state.remove()
        if out:  # Arrow takes no string key from a frame without rows
            yield pd.DataFrame(out, columns=[key, *names]).astype({n: "Int64" for n in names})

    marked = events.withWatermark("_time", delay).withColumn("_ts", F.unix_micros("_time"))
    return marked.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, " + ", ".join(f"`{n}` long" for n in names), "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def pairs_of_streams(left: DataFrame, right: DataFrame, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """lseq and rseq of all pairs (ANY) of two streams (time, seq) with 0 <= right - left <= seconds.

    A join of streams needs an equality: the bucket of the left time, which the right offers for both buckets that it
    may be reached from. State older than the window is dropped by the watermarks.
    """
    width = max(1, seconds) * 1_000_000
    a = left.withWatermark("time", delay).select(F.col("time").alias("lt"), F.col("seq").alias("lseq"), bucket(F.unix_micros("time"), width).alias("lb"))
    b = right.withWatermark("time", delay).select(F.col("time").alias("rt"), F.col("seq").alias("rseq"), bucket(F.unix_micros("time"), width).alias("b"))
    b = b.withColumn("rb", F.explode(F.array(F.col("b"), F.col("b") - 1))).drop("b")
    later = (F.col("rt") > F.col("lt")) | (F.col("rt") == F.col("lt")) & (F.col("rseq") > F.col("lseq"))
    on = (F.col("lb") == F.col("rb")) & (F.col("rt") >= F.col("lt")) & (F.col("rt") <= F.col("lt") + F.expr(f"INTERVAL {int(seconds)} SECONDS")) & later
    return a.join(b, on).select("lseq", "rseq")


def collected(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """What the stream gives for all input that is there now, written to a folder that all machines share and read."""
    out = f"{folder}/{name}"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
