"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length.

Folding lowers case, takes look-alike letters of other scripts and digits inside words for the Latin letters they
resemble (a 1 is read as i and, in a second pass, as l), drops invisible characters and puts one space for everything
between words. Entries are whole words or
beginnings of words; a match inside an exception phrase does not count. Entries and weights are learnt from labelled
texts: the log of how much oftener a word is found in toxic texts than in others, less one standard error of that. A
small list of insults comes with the module; those that the labelled texts do not speak against stay in the lexicon. A logistic curve over the weights found, whole and per word, gives the score.

Null and empty texts have no match and get the curve's value for that. Ties among entries go by weight, support, then
text, so reruns agree. Without labelled rows of both kinds the module's list and a fixed curve are used. Equal texts
get equal scores, repeated rows included; an empty table gives an empty one; other columns are not read. Folding and
matching take time in proportion to a text's length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, checkpointed, giving_back, in_few_tasks, labelled_sample, small_batches, text_udf

#: Labelled rows that are learnt from, at most: those with the smallest hashes of doc_id.
SAMPLE = 20_000
MODULUS, HELD_OUT = 5, 0

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans("абвгеёіїјкмнорстухѕԁԛԝάαβγεικνορτυχ", "a6breeiijkmhopctyxsdqwaabyeikvoptux")
# What digits and signs inside words stand for.
LEET = str.maketrans("013456789@$", "oieasgtbgas")
LEET_L = {**LEET, ord("1"): "l"}
# Invisible characters.
INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
# Insults that are known without labels, and phrases in which words of the list mean no insult.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "jerk", "bastard")
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash collection", "trash pickup", "clown fish", "class clown", "clown college", "sore loser award", "pond scum removal", "soap scum")

_FULLWIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}
_BETWEEN = {i: " " for i in range(128) if not chr(i).isalnum()}
_TABLE = {**{ord(c): " " for c in "–—‘’“”«»„…¡¿·•|"}, **_BETWEEN, **HOMOGLYPHS, **_FULLWIDTH}
_MIXED = re.compile(r"(?<![0-9])[0-9@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9@$]+(?![0-9])")
_MARK = re.compile(r"[0-9@$]")


def fold(text: str, leet: dict[int, str | int] = LEET) -> str:
    """Words with one space before, between and after them."""
    text = text.lower()
    if not text.isascii():
        text = text.translate({**INVISIBLE, **_FULLWIDTH}).lower() if any(c in text for c in "​‍­‌⁠﻿") or re.search("[！-～]", text) else text
    if _MARK.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(leet), text)
    return f" {' '.join(text.translate(_TABLE).split())} "


@dataclass(frozen=True)
class Lexicon:
    """entries: folded, ' word ' for a whole word and ' stem' for the beginning of one, with their weights."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.6, 12.0)  # constant, log of the weight found, weight per word
    _cache: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "curve": self.curve, "_cache": []}

    def automaton(self):
        if not self._cache:
            found = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                found.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                if (folded := fold(phrase)) not in self.entries:
                    found.add_word(folded, (len(folded), None))
            found.make_automaton()
            self._cache.append(found)
        return self._cache[0]

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the entries found; of those that begin at one word the heaviest, exceptions left out."""
        if not self.entries:
            return []
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for last, (n, weight) in self.automaton().iter(folded):
            begin = last + 1 - n
            if weight is None:
                spared.append((begin, last + 1))
            elif begin not in best or weight > best[begin][1]:
                best[begin] = (last + 1, weight)
        return [(a, b, w) for a, (b, w) in sorted(best.items()) if not any(x <= a and b <= y for x, y in spared)]

    def measures(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        found = self.matches(folded)
        if "1" in text and (other := fold(text, LEET_L)) != folded:
            best: dict[int, float] = {}  # both foldings have their words at the same places
            for begin, _, w in found + self.matches(other):
                best[begin] = max(w, best.get(begin, w))
            weight = sum(best[begin] for begin in sorted(best))
        else:
            weight = sum(w for _, _, w in found)
        return math.log1p(weight), weight / (folded.count(" ") + 20)

    def score(self, text: str) -> float:
        x, y = self.measures(text)
        constant, a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, constant + a * x + b * y))))


DEFAULT = Lexicon({f" {fold(word).strip()} ": 5.0 for word in INSULTS})


def _candidates(folded: str, longest: int = 24) -> set[str]:
    words = {w for w in folded.split() if 3 <= len(w) <= longest and not w.isdigit()}
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in range(4, min(9, len(w)))}


def _counts(sample: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """entry and n: in how many texts each candidate (each of `only`) is found; summed in each task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                each = _candidates(fold(text))
                found.update(each if only is None else each & only)
        if found:  # Arrow takes no string column from a frame without rows
            yield pd.DataFrame({"entry": list(found), "n": list(found.values())}, columns=["entry", "n"])

    return sample.select("text").mapInPandas(giving_back(count), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _rate(k: int, toxic: int, c: int, others: int) -> float:
    return math.log((k + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (others + 1)) - math.sqrt(1 / (k + 0.5) + 1 / (c + 0.5))


def learn(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE, share: float = 0.01, least: int = 3, weight: float = 2.8, entries: int = 5_000) -> Lexicon:
    """The lexicon and curve of a sample of at most `bound` labelled rows that are not held out.

    An entry is found in at least `share` of the toxic texts and in `least` of them; its weight is at least `weight`;
    the `entries` heaviest are kept. A stem or word that begins like a heavier entry says nothing new and is left out, as is
    a stem that other texts have too and whose toxic texts a heavier entry mostly accounts for. Equal texts are one, toxic
    if one of them is labelled so.
    """
    sample = labelled_sample(documents, labels, "toxic", MODULUS, HELD_OUT, bound)
    sample = checkpointed(in_few_tasks(sample.groupBy("text").agg(F.max("label").alias("label"))))
    n = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    toxic, others = n.get(1, 0), n.get(0, 0)
    if not toxic or not others:
        return DEFAULT
    support = max(least, math.ceil(share * toxic))
    # In `support` of the toxic texts each, so the candidates number at most the sample's words / support.
    top = _counts(sample.filter("label = 1")).filter(F.col("n") >= support).orderBy(F.desc("n"), "entry").limit(20 * entries)
    found = {row["entry"]: row["n"] for row in top.collect()}
    clean = {row["entry"]: row["n"] for row in _counts(sample.filter("label = 0"), frozenset(found)).collect()}
    rated = sorted(((_rate(k, toxic, clean.get(e, 0), others), k, len(e), e) for e, k in found.items()), key=lambda x: (-x[0], -x[1], -x[2], x[3]))
    kept: dict[str, float] = {}
    longer: dict[str, int] = {}  # by stem, the support of the best entry kept that begins with it
    for rate, k, _, entry in rated:
        if rate < weight or len(kept) >= entries:
            break
        told = any(entry[:i] in kept for i in range(5, len(entry))) or clean.get(entry) and longer.get(entry, 0) >= 0.7 * k
        if not told:
            kept[entry] = round(rate, 4)
            for i in range(5, len(entry)):
                longer[entry[:i]] = max(longer.get(entry[:i], 0), k)
    kept = {e: w for e, w in DEFAULT.entries.items() if e not in kept and not any(rate < weight and e == entry for rate, _, _, entry in rated)} | kept
    lexicon = Lexicon(kept)
    measure = text_udf("x double, y double", lambda: lexicon.measures)
    rows = sample.select("label", measure("text").alias("m")).select("label", "m.*").toPandas()  # `bound` rows at most
    return Lexicon(kept, curve=_logistic(rows[["x", "y"]].to_numpy(), rows["label"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float, float]:
    """Newton's method, the two kinds of rows weighing alike; coefficients below 0 would punish matches and become 0."""
    design = np.c_[np.ones(len(x)), x]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * len(y) ** 0.5 * beta * (0, 1, 1)
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag((1e-6, ridge * len(y) ** 0.5, ridge * len(y) ** 0.5))
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(0.0, float(beta[1])), max(0.0, float(beta[2]))


def scorer(lexicon: Lexicon):
    """A function of a text column that gives a struct with score."""
    return text_udf("score double", lambda: lambda text: (lexicon.score(text),))


def score_table(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = small_batches(documents).select("doc_id", scorer(lexicon)(F.col("text").cast("string")).alias("r")).select("doc_id", F.col("r.score").alias("score"))
    return rows.select("doc_id", F.coalesce(bucket(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents whose score is below 0.5, unchanged."""
    return small_batches(documents).filter(scorer(lexicon)(F.col("text").cast("string"))["score"] < 0.5)
