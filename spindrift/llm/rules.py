"""Quality rules: plain limits, and robust multivariate outliers of each language and source.

DataFrame functions alone. The statistics of a text become a vector of transformed shares. For each group of language
and source the estimate of mean and covariance whose covariance has the least determinant, among those of the share H of the rows, is sought
by concentration: the rows nearest to an estimate give the next one, which never has a greater determinant. Each group
has STARTS starts: medians and spreads, all rows, and two draws of about DRAWN rows. All take FIRST steps; the start
that has come to the least determinant goes on until no group's determinant falls any more, SETTLE steps at most. A
row whose squared Mahalanobis distance from the estimate is beyond the CONFIDENCE quantile of chi-squared is rejected.

Every step is two sums over all rows, pre-aggregated in each task: counts by bin of the distance, of which the
H-quantile is read, and moments of whole numbers (components in thousandths) over the rows up to that bin. So nothing
is sampled but two of the starts, no group meets in one task, and sums do not depend on their order: reruns agree.
Group tables come back to the rows by a join in which groups are spread over SALTS keys.

Null texts have no words; null languages and sources are groups of their own. A group of fewer than LEAST rows has no
estimate and is judged by the estimate over all rows. Components have a least variance, which is added to theirs, so that constant ones (or a
group of equal rows) give finite distances. Repeated rows count as often as they are there; equal rows get equal
verdicts. An empty table gives an empty one; other columns are not read. A text of n words takes O(n log n).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, clean_text

#: The share of rows that an estimate rests on, rows that a group needs, keys of a group.
H, LEAST, SALTS = 0.75, 50, 16
#: Starts of a group, rows that those of drawn rows begin with, steps of all starts, and of the best one at most.
STARTS, DRAWN, FIRST, SETTLE = 4, 24, 2, 20
#: Logarithms of determinants that differ by no more are the same.
SAME = 1e-3
#: The probability with which a row of a normal group is kept.
CONFIDENCE = 1 - 1e-9
#: Components in thousandths, and for each the least standard deviation, in thousandths.
COMPONENTS = {"word_length": 60, "symbols": 250, "duplicate_lines": 100, "repeated_words": 100, "capitals": 60}
SCALE = 1000
_SPACES = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """What is counted by characters."""
    bare = F.translate(text, " \t\n\x0b\f\r", "")
    return {
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    }


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of every text."""
    text = clean_text()
    rows = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    words = F.filter(F.split("text", _SPACES), lambda x: x != "")
    rows = rows.select("doc_id", "lang", "source", *(c.alias(k) for k, c in statistics(F.col("text")).items()), lines.alias("lines"), words.alias("words"))
    rows = rows.select("doc_id", "lang", "source", "word_chars", "n_symbols", "n_capitals", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("words").cast("long").alias("n_words"), _windows().alias("windows"))
    rows = rows.withColumn("again", F.size("windows") > F.size(F.array_distinct("windows")))
    return rows.withColumn("n_repeat_words", F.when(F.col("again"), _covered()).otherwise(F.lit(0)).cast("long")).drop("windows", "again")


def _windows() -> Column:
    """A 64-bit hash of each window of three words."""
    starts = F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))


def _covered() -> Column:
    """Words in windows that are found twice or more: windows sorted by hash, equal neighbours kept, their words counted once."""
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        hit = F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)), x["i"]))
        starts = F.filter(hit, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    return F.element_at(F.transform(F.array(placed), count), 1)  # the sorted windows, bound once


def vectors(measured: DataFrame) -> DataFrame:
    """The rows with a base verdict and components in thousandths, as whole numbers."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_words") / 40, F.col("n_dup_lines"), F.lit(1))
    parts = {
        "word_length": F.log1p(F.col("word_chars") / n),
        "symbols": F.log1p(F.col("n_symbols") * 100 / n),
        # one line that comes twice, such as a title at both ends, is nothing unusual
        "duplicate_lines": F.sqrt(F.greatest(F.col("n_dup_lines") - 1, F.lit(0)) / lines),
        "repeated_words": F.sqrt(F.col("n_repeat_words") / n),
        "capitals": F.sqrt(F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))),
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select("*", failed.alias("base_failed"), *(F.round(parts[k] * SCALE).cast("long").alias(k) for k in COMPONENTS))


_KEYS = ("lang", "source")


def chi_squared(x: float, degrees: int) -> float:
    """The probability that a chi-squared variable is below x, by the series of the incomplete gamma function."""
    term = total = 1 / math.gamma(degrees / 2 + 1)
    k = 0
    while term > 1e-17 * total:
        k += 1
        term *= x / 2 / (degrees / 2 + k)
        total += term
    return total * (x / 2) ** (degrees / 2) * math.exp(-x / 2)


def quantile(probability: float, degrees: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared(middle, degrees) < probability else (low, middle)
    return high


#: The nearest rows spread less than all: what makes their covariance that of a normal group.
FACTOR = H / chi_squared(quantile(H, len(COMPONENTS)), len(COMPONENTS) + 2)
CUT = quantile(CONFIDENCE, len(COMPONENTS))


def _of_groups(rows: DataFrame, groups: DataFrame, keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """Two tables with a row a group."""
    named = groups.withColumnsRenamed({k: f"g_{k}" for k in keys})
    return rows.join(named, reduce(lambda a, b: a & b, (rows[k].eqNullSafe(named[f"g_{k}"]) for k in keys))).drop(*(f"g_{k}" for k in keys))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with what `groups` has of their group, salted: no key has more than its share of a hot group.

    A row comes as often as its group is in `groups`.
    """
    spread = groups.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))).withColumnsRenamed({k: f"g_{k}" for k in _KEYS})
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int"))
    on = salted["lang"].eqNullSafe(spread["g_lang"]) & salted["source"].eqNullSafe(spread["g_source"]) & (salted["salt"] == spread["salt"])
    return salted.join(spread, on, "left").drop("g_lang", "g_source", "salt")


def _middle(rows: DataFrame) -> DataFrame:
    """Of each group its rows, and the median and spread (a robust standard deviation) of each component."""
    names = list(COMPONENTS)
    long = rows.select(*_KEYS, F.explode(F.array(*(F.struct(F.lit(k).alias("part"), (F.round(F.col(k) / 5) * 5).cast("long").alias("v")) for k in names))).alias("x")).select(*_KEYS, "x.*")
    counted = long.groupBy(*_KEYS, "part", "v").count()

    def half(counted: DataFrame, name: str) -> DataFrame:
        group = Window.partitionBy(*_KEYS, "part")
        so_far, total = F.sum("count").over(group.orderBy("v")), F.sum("count").over(group)
        return counted.select(*_KEYS, "part", "v", "count", so_far.alias("c"), total.alias("n")).groupBy(*_KEYS, "part").agg(F.min(F.when(2 * F.col("c") >= F.col("n"), F.col("v"))).alias(name), F.max("n").alias("n"))

    middle = half(counted, "median")
    away = _of_groups(counted, middle.drop("n"), (*_KEYS, "part")).select(*_KEYS, "part", F.abs(F.col("v") - F.col("median")).alias("v"), "count", "median").groupBy(*_KEYS, "part", "v", "median").agg(F.sum("count").alias("count"))
    both = _of_groups(middle, half(away, "mad").drop("n"), (*_KEYS, "part"))
    each = [F.max(F.when(F.col("part") == k, F.col(x))).alias(f"{x}_{k}") for k in names for x in ("median", "mad")]
    return both.groupBy(*_KEYS).agg(F.max("n").alias("n"), *each)


_PAIRS = [(a, b) for i, a in enumerate(COMPONENTS) for b in list(COMPONENTS)[: i + 1]]
_ESTIMATE = [*(f"m_{a}" for a in COMPONENTS), *(f"l_{a}_{b}" for a, b in _PAIRS), "determinant"]


def _from_middle(middle: DataFrame) -> DataFrame:
    """The estimate that medians and spreads give, without covariances."""
    spread = {k: F.greatest(1.4826 * F.col(f"mad_{k}"), F.lit(float(least))) for k, least in COMPONENTS.items()}
    sides = ((spread[a] if a == b else F.lit(0.0)).alias(f"l_{a}_{b}") for a, b in _PAIRS)
    return middle.select(*_KEYS, F.lit(0).alias("start"), *(F.col(f"median_{a}").cast("double").alias(f"m_{a}") for a in COMPONENTS), *sides, F.lit(math.inf).alias("determinant"))


def _moments(rows: DataFrame) -> DataFrame:
    """Of each group and start the mean and, by Cholesky, what turns a difference from it into independent components.

    determinant is the logarithm of the covariance's.
    """
    names = list(COMPONENTS)
    sums = rows.groupBy(*_KEYS, "start").agg(F.count("*").alias("k"), *(F.expr(f"sum({a}) AS s_{a}") for a in names), *(F.expr(f"sum({a} * {b}) AS p_{a}_{b}") for a, b in _PAIRS))
    covariance = (f"(p_{a}_{b} / k - s_{a} / k * s_{b} / k) * {FACTOR!r}D + {COMPONENTS[a] ** 2 if a == b else 0}D AS c_{a}_{b}" for a, b in _PAIRS)
    out = sums.selectExpr(*_KEYS, "start", *(f"s_{a} / k AS m_{a}" for a in names), *covariance)
    for j, b in enumerate(names):  # column by column
        rest = lambda a: " - ".join([f"c_{a}_{b}", *(f"l_{a}_{c} * l_{b}_{c}" for c in names[:j])])  # noqa: B023, E731
        out = out.selectExpr("*", f"sqrt(greatest({rest(b)}, 1e-6D)) AS l_{b}_{b}")
        if j + 1 < len(names):
            out = out.selectExpr("*", *(f"({rest(a)}) / l_{b}_{b} AS l_{a}_{b}" for a in names[j + 1 :]))
    determinant = " + ".join(f"2 * ln(l_{a}_{a})" for a in names)
    return out.selectExpr("*", f"{determinant} AS determinant").select(*_KEYS, "start", *_ESTIMATE)


def _mahalanobis() -> str:
    """The squared distance by forward substitution."""
    z: dict[str, str] = {}
    for a in COMPONENTS:
        z[a] = f"(({' - '.join([a, f'm_{a}', *(f'l_{a}_{b} * {z[b]}' for b in z)])}) / l_{a}_{a})"
    return " + ".join(f"{x} * {x}" for x in z.values())


def _distances(rows: DataFrame, estimates: DataFrame, *further: str) -> DataFrame:
    """rows with their distance from each estimate of their group, and what `further` names of the estimates."""
    return _with_groups(rows, estimates).selectExpr(*rows.columns, *further, f"{_mahalanobis()} AS distance")


#: Distances are counted in bins of equal width of their logarithm, half a percent each.
_BINS, _PER = 4000, 200.0


def _bin(distance: Column) -> Column:
    return F.least(F.lit(_BINS), F.floor(F.log1p(distance) * _PER)).cast("int")


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates of the share H of each group, in whole bins, that is nearest to the present ones."""
    counted = _distances(rows, estimates, "start").groupBy(*_KEYS, "start", _bin(F.col("distance")).alias("bin")).count()
    group = Window.partitionBy(*_KEYS, "start")  # _BINS rows at most
    edge = counted.select(*_KEYS, "start", "bin", F.sum("count").over(group.orderBy("bin")).alias("c"), F.sum("count").over(group).alias("n"))
    edge = edge.groupBy(*_KEYS, "start").agg(F.min(F.when(F.col("c") >= H * F.col("n"), F.col("bin"))).alias("edge"))
    edged = _of_groups(estimates, edge, (*_KEYS, "start"))
    return checkpointed(_moments(_distances(rows, edged, "start", "edge").filter(_bin(F.col("distance")) <= F.col("edge"))))


def _least(estimates: DataFrame) -> DataFrame:
    """Of each group the estimate of least determinant."""
    return estimates.groupBy(*_KEYS).agg(F.min(F.struct("determinant", "start", *(c for c in _ESTIMATE if c != "determinant"))).alias("e")).select(*_KEYS, "e.*")


def _begun(rows: DataFrame) -> DataFrame:
    """The estimates that all starts begin with; a row is drawn by its hash, so that reruns agree."""
    middle = checkpointed(_middle(rows))
    lot = lambda start: F.pmod(F.xxhash64(F.lit(start), "doc_id", *COMPONENTS), F.col("n")) < DRAWN
    starts = F.array_compact(F.array(F.lit(1), *(F.when(lot(k), F.lit(k)) for k in range(2, STARTS))))
    drawn = _with_groups(rows, middle.select(*_KEYS, "n")).withColumn("start", F.explode(starts))
    return _from_middle(middle).unionByName(_moments(drawn))


def estimate(rows: DataFrame) -> DataFrame:
    """The estimates of every group of `rows` (doc_id, word_chars, lang, source and COMPONENTS): one row each."""
    found = checkpointed(_begun(rows))
    for _ in range(FIRST):
        found = _concentrated(rows, found)
    found = checkpointed(_least(found))
    for _ in range(SETTLE):
        step = _concentrated(rows, found)
        fell = _of_groups(step.select(*_KEYS, "determinant"), found.select(*_KEYS, F.col("determinant").alias("before"))).filter(F.col("determinant") < F.col("before") - SAME)
        done = fell.isEmpty()
        found = checkpointed(_least(found.unionByName(step)))
        if done:
            break
    return found.drop("start", "determinant")


def judge(documents: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, n_words, the statistics, base_failed, distance (null if base_failed) and kept of every document."""
    rows = checkpointed(vectors(measure(documents)))
    passed = rows.filter(~F.col("base_failed"))
    size = passed.groupBy(*_KEYS).agg((F.count("*") >= LEAST).alias("large"))
    # Small groups go by one estimate over all rows, under a name that no language has.
    grouped = _with_groups(passed, size).withColumns({"lang": F.when(F.col("large"), F.col("lang")).otherwise(F.lit("\0all")), "source": F.when(F.col("large"), F.col("source")).otherwise(F.lit("\0all"))}).drop("large")
    grouped = checkpointed(grouped)
    everything = passed.select("doc_id", "word_chars", F.lit("\0all").alias("lang"), F.lit("\0all").alias("source"), *COMPONENTS)
    own = grouped.filter("lang IS NULL OR lang != '\0all'").select("doc_id", "word_chars", "lang", "source", *COMPONENTS)
    found = estimate(own.unionByName(everything))
    judged = _distances(grouped, found).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance")
    failed = rows.filter("base_failed").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut))
