"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of a text are standardised and mapped to cosines of random projections, which approximate a Gaussian
kernel. Each partition of the learnt rows sums its part of the normal equations; their sum is solved for ridge
scores, and pool-adjacent-violators on rows set aside turns scores into probabilities, linearly between blocks.

Null texts count as empty, and an empty text has the statistics of one (zeros). Ties get equal scores, as do repeated
rows. Without labelled rows of both kinds every score is 0.5. An empty table gives an empty one; other columns are not
read. A text's statistics take time in proportion to its length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, checkpointed, labelled_sample, small_batches, text_udf

#: Labelled rows that are learnt from, at most: those with the smallest hashes of doc_id.
SAMPLE = 20_000
MODULUS, HELD_OUT = 3, 1
#: Partitions of the sample, each of which sends one matrix of FEATURES x FEATURES to the driver.
PARTS, FEATURES = 12, 256

_UPPER, _LOWER, _DIGITS = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = np.frombuffer(b"#*$%&|<>=~^_{}[]\\@", np.uint8)
_STOPS = np.frombuffer(b".,;:", np.uint8)
_SIGNS = np.frombuffer(b"!?", np.uint8)


def statistics(text: str) -> list[float]:
    data = text.encode()
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    words = data.split()
    k = len(words)
    if not k:
        return [0.0] * 18
    freq = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, k)
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(lines))
    share = counts[counts > 0] / n
    letters = max(1.0, counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum())
    top = freq.most_common(3)
    return [
        math.log1p(k),
        lengths.mean(),
        lengths.std(),
        math.log1p(lengths.max()),
        counts[_UPPER].sum() / letters,
        counts[_DIGITS].sum() / n,
        math.log1p(100 * counts[_SYMBOLS].sum() / k),
        math.log1p(100 * counts[_SIGNS].sum() / k),
        counts[_STOPS].sum() / k,
        counts[128:].sum() / n,
        len(freq) / k**0.9,
        top[0][1] / k,
        sum(c for _, c in top) / k,
        1 - distinct / len(lines),
        math.log1p(k / len(lines)),
        -(share * np.log(share)).sum(),
        sum(c for w, c in freq.items() if w.isupper()) / k,
        counts[124] / k,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(x or "") for x in texts], float).reshape(-1, 18)


@dataclass(frozen=True)
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]  # ridge score and calibrated probability, both ascending

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[np.ones(len(z)), math.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and mean y of the blocks, equal x being one row to begin with."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of x, sum of y
    i = 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and x[order[j + 1]] == x[order[i]]:
            j += 1
        part = order[i : j + 1]
        blocks.append([float(len(part)), float(x[part].sum()), float(y[part].sum())])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        i = j + 1
    w, sx, sy = np.array(blocks).T
    # Shrunk a little to the middle: no block of a few rows claims certainty.
    return sx / w, (sy + 0.5) / (w + 1)


def learn(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE, width: int = FEATURES, gamma: float = 0.05, ridge: float = 1e-3, seed: int = 11) -> Scorer | None:
    """The scorer of at most `bound` labelled rows that are not held out; one in four of them calibrates."""
    sample = labelled_sample(documents, labels, "quality", MODULUS, HELD_OUT, bound)
    measure = text_udf("x array<double>, part int", lambda: lambda text: (statistics(text), zlib.crc32(text.encode()) % 4))
    rows = checkpointed(sample.select("label", measure("text").alias("m")).select("label", "m.*").repartition(PARTS, F.xxhash64("x")))
    n, dims = rows.groupBy("label").count().collect(), 18
    if len(n) < 2:
        return None
    weight = {r["label"]: sum(x["count"] for x in n) / (2 * r["count"]) for r in n}
    moments = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    rng = np.random.default_rng(seed)
    omega = rng.normal(0, math.sqrt(2 * gamma), (dims, width - 1))
    scorer = Scorer(np.array([r["m"] for r in moments]), np.array([r["s"] if r["s"] > 1e-9 else 1.0 for r in moments]), omega, rng.uniform(0, 2 * math.pi, width - 1), np.zeros(width), (np.zeros(1), np.zeros(1)))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            z, y = scorer.lift(np.stack(batch["x"].to_numpy())), batch["label"].to_numpy(float)
            w = np.where(y == 1, weight[1], weight[0])
            a += (z * w[:, None]).T @ z
            b += (w * y) @ z
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    parts = rows.filter("part > 0").mapInPandas(sums, "a binary, b binary").collect()  # PARTS matrices
    a = sum(np.frombuffer(r["a"]).reshape(width, width) for r in parts)
    b = sum(np.frombuffer(r["b"]) for r in parts)
    total = max(1.0, float(a[0, 0]))
    beta = np.linalg.solve(a / total + ridge * np.diag([0.0] + [1.0] * (width - 1)) + 1e-9 * np.eye(width), b / total)
    fitted = Scorer(scorer.mean, scorer.scale, omega, scorer.phase, beta, scorer.steps)
    held = rows.filter("part = 0").select("x", "label").toPandas()  # `bound` rows at most
    if held["label"].nunique() < 2:
        held = rows.select("x", "label").toPandas()
    return Scorer(scorer.mean, scorer.scale, omega, scorer.phase, beta, isotonic(np.round(fitted.raw(np.stack(held["x"].to_numpy())), 9), held["label"].to_numpy(float)))


def score_table(documents: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.clip(np.round(scorer.probability(matrix(batch)), 12), 0, 1) if scorer else np.full(len(batch), 0.5))

    rows = small_batches(documents).select("doc_id", F.pandas_udf(apply, "double")(F.col("text").cast("string")).alias("score"))
    return rows.select("doc_id", F.coalesce(bucket(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
