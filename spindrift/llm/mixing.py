"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's share of all words, at most `most` times the words it has; what is over goes to the
others by weight. Every document of a source then expects target / words copies. The whole part is given; of the
fractions two at a time meet, and words move from one to the other until one of the two is 0 or 1, either way with
the probability that keeps both expectations. A pair's words together stay the same, so a source's sum moves only
when its very last document is rounded: the words taken miss the target by less than one document.

Pairs meet within chunks of documents, dealt by a hash of doc_id; what is left of each source in a chunk, one
document at most, goes up a tree that joins FAN of them at a time. Random numbers come from a seed and the documents
that meet, so reruns agree, however the rows are partitioned.

Null texts have size 0, as have texts without words; such documents are taken 0 words. Null sources are one source,
the last. Repeated rows are documents of their own. A table without words has targets 0. An empty table gives an
empty one. Columns other than doc_id, source and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, clean_text

#: Documents that are rounded together on average, and residuals that meet in one step of the tree.
CHUNK, FAN = 4096, 64
#: Sizes of documents are whole numbers of words, so a share of a copy below this is none.
_EPSILON = 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size and target of every source; `sizes` has source and size.

    With caps c and weights w, sources in order of c / w reach their caps first: with k of them capped, the others get
    w times level, level = what the capped leave / the weights of the others. The first k at which nobody is above
    its cap is the result that repeated resharing ends at. The window runs over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    each = each.withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    each = each.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("gone"),
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
    )
    # The level if this source is the first that is not capped; it is right for the first source whose cap allows it.
    each = each.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone")))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    each = each.withColumn("level", F.max_by(F.when(fits, F.col("level")), F.when(fits, -F.col("gone"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return each.select("source", "source_size", target.alias("target"))


def _uniform(seed: int, a, b) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{a}|{b}".encode(), digest_size=7).digest()) / (1 << 56)


def pivot(frame: pd.DataFrame, seed: int, last: bool = False) -> pd.DataFrame:
    """Rounds `share` of the rows, source by source and in order of key; one row of a source at most keeps a fraction.

    last: that one is rounded as well.
    """
    frame = frame.sort_values(["slot", "key", "size", "share"], kind="stable", ignore_index=True)
    share, size, slot, key = frame["share"].to_numpy(float, copy=True), frame["size"].to_numpy(float), frame["slot"].to_numpy(), frame["key"].to_numpy()
    held = -1
    for i in np.flatnonzero((share > _EPSILON) & (share < 1 - _EPSILON)):
        if held < 0 or slot[held] != slot[i]:
            if last and held >= 0:
                share[held] = float(_uniform(seed, key[held], "end") < share[held])
            held = i
            continue
        # in words: what `held` can gain and i lose, and the other way about
        up = min((1 - share[held]) * size[held], share[i] * size[i])
        down = min(share[held] * size[held], (1 - share[i]) * size[i])
        move = up if _uniform(seed, key[held], key[i]) * (up + down) < down else -down
        share[held] += move / size[held]
        share[i] -= move / size[i]
        for j in (held, i):
            if share[j] < _EPSILON or share[j] > 1 - _EPSILON:
                share[j] = round(share[j])
        held = i if 0 < share[i] < 1 else held if 0 < share[held] < 1 else -1
    if last and held >= 0:
        share[held] = float(_uniform(seed, key[held], "end") < share[held])
    return frame.assign(share=np.where(share < _EPSILON, 0.0, np.where(share > 1 - _EPSILON, 1.0, share)))


_ROUNDED = "chunk long, slot long, key string, row long, size long, share double"


def _step(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    return rows.groupBy("chunk", *(["slot"] if "tree" in rows.columns else [])).applyInPandas(lambda frame: pivot(frame, seed, last)[[x.split()[0] for x in _ROUNDED.split(", ")]], _ROUNDED)


def copies(sizes: DataFrame, goals: DataFrame, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """row and copies of every row of `sizes` (row, key, source, size) that is to be taken.

    goals: source and target, of every source. Rows of no words are not taken.
    """
    slots = goals.filter("source_size > 0").select("source", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("slot"), (F.col("target") / F.col("source_size")).alias("expected"))
    rows = sizes.filter("size > 0").join(F.broadcast(slots) if _few(goals) else slots, sizes["source"].eqNullSafe(slots["source"])).select("row", "key", "size", "slot", "expected")
    n = rows.count()
    chunks = max(1, math.ceil(n / chunk))
    whole = F.floor(F.col("expected") + _EPSILON)
    rows = rows.select("row", "key", "size", "slot", whole.cast("long").alias("whole"), F.greatest(F.col("expected") - whole, F.lit(0.0)).alias("share"))
    fixed = rows.select("row", F.col("whole").alias("n")).filter("n > 0")
    state = rows.filter(F.col("share") > _EPSILON).select(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(chunks)).alias("chunk"), "slot", "key", "row", "size", "share")
    state = checkpointed(_step(state, seed, chunks == 1))
    done = [state.filter("share = 1").select("row", F.lit(1).cast("long").alias("n"))]
    while chunks > 1:
        chunks = math.ceil(chunks / FAN)
        left = state.filter("share > 0 and share < 1").withColumn("chunk", F.floor(F.col("chunk") / FAN)).withColumn("tree", F.lit(1))
        state = checkpointed(_step(left, seed, chunks == 1))
        done.append(state.filter("share = 1").select("row", F.lit(1).cast("long").alias("n")))
    for part in done:
        fixed = fixed.unionAll(part)
    return fixed.groupBy("row").agg(F.sum("n").alias("copies"))


def _few(goals: DataFrame, bound: int = 10_000) -> bool:
    """Whether the sources are few enough to broadcast; beyond that they are joined like any table."""
    return goals.limit(bound + 1).count() <= bound


def _key(size: Column) -> Column:
    """What a document is known by: rows with equal keys have equal texts, so they may stand for each other."""
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("source").cast("string"), F.lit("null")), size, F.xxhash64(clean_text()))


def _mixed(documents: DataFrame, weights: tuple[int, ...], most: int, seed: int, chunk: int) -> DataFrame:
    size = word_count(clean_text())
    sizes = documents.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), _key(size).alias("key"))
    sizes = checkpointed(sizes.withColumn("row", F.monotonically_increasing_id()))
    goals = checkpointed(targets(sizes, weights, most))
    taken = copies(sizes, goals, seed, chunk)
    named = goals.withColumnRenamed("source", "of")
    out = sizes.join(taken, "row", "left").join(F.broadcast(named) if _few(goals) else named, F.col("source").eqNullSafe(F.col("of")))
    return out.withColumn("copies", F.coalesce("copies", F.lit(0)))


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, copies counted) of every document."""
    out = _mixed(documents, weights, most, seed, chunk)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def resample(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns."""
    each = _mixed(documents, weights, most, seed, chunk).groupBy(F.col("key").alias("__key")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).filter("__copies > 0")
    known = documents.withColumn("__own", _key(word_count(clean_text()))).join(each, F.col("__own") == F.col("__key"))
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(1)))  # rows of one key are alike
    known = known.withColumn("__n", F.floor(F.col("__copies") / F.col("__rows")) + (place <= F.col("__copies") % F.col("__rows")).cast("long"))
    return known.withColumn("__one", F.explode(F.array_repeat(F.lit(1), F.col("__n").cast("int")))).select(*(F.col(f"`{c}`") for c in documents.columns))
