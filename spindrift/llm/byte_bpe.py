"""Byte-level BPE by a hierarchical-bitmap rank queue.

Each merge rank has a bucket of the positions at which that merge was seen. A two-level bitmap over the ranks tells
which buckets hold something: find-first-set on the summary word and then on one word of the lower level gives the
lowest rank without a comparison, and an entry whose pair has changed meanwhile is skipped when it comes up. Tokens
are a doubly linked list over byte positions, so that a merge costs constant time and a pre-token of n bytes costs
O(n log n), however long it is. One queue merges all pre-tokens of a group of texts that the worker has not met: pairs
never span two of them, so the lowest rank of all is the lowest of its own pre-token too.

Null texts count as empty and give no ids. Empty texts, ties (equal ranks merge from the left), repeated rows, empty
tables and further columns need no special care: a row's result depends on its text alone.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, small_batches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Ranks that share one word of the lower bitmap, as a power of two.
SPAN = 8
#: New pre-tokens whose ids a worker takes up before it forgets those it has not met since as many before, and the
#: longest that it remembers: 800,000 of 64 characters at most.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
#: As REMEMBERED, where ids are given too.
BESIDE_IDS = 50_000
#: Ids that are decoded at once.
DECODED = 1 << 16
#: Characters of the texts whose pre-tokens are merged in one queue; a longer text has a queue of its own.
TOGETHER = 250_000
_LOW, _BITS = (1 << SPAN) - 1, [1 << i for i in range(1 << SPAN)]


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Merges:
    """The ranks by pairs of ids, and the rank queue over any number of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.end = max(ranks.values(), default=0) + 1  # stands between pre-tokens: no token, so it is in no pair
        #: By id, what it makes with the id to its right, and with the id to its left.
        self.with_right: list[dict[int, int]] = [{}] * (self.end + 1)
        self.with_left: list[dict[int, int]] = [{}] * (self.end + 1)
        rank_of = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = rank_of(token[:cut]), rank_of(token[cut:])
                if left is not None and right is not None:
                    for known, one, other in ((self.with_right, left, right), (self.with_left, right, left)):
                        if not known[one]:
                            known[one] = {}
                        known[one][other] = rank
        self.single = np.array([rank_of(bytes((i,)), self.end) for i in range(256)])
        self.first = np.full(1 << 16, -1)  # ranks of pairs of bytes
        for i, left in enumerate(self.single.tolist()):
            for j, right in enumerate(self.single.tolist()):
                self.first[i << 8 | j] = self.with_right[left].get(right, -1)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers.

        Positions are bytes of all pre-tokens one after the other, a byte between two of them. A bucket is sorted when
        its rank comes up, so equal ranks merge from the left; what a merge leaves at a lower rank comes before the
        rest of the bucket.
        """
        if not pieces:
            return []
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        codes = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        n = len(codes)
        tokens = self.single[codes]
        tokens[ends] = self.end
        pairs = np.full(n, -1)
        pairs[:-1] = self.first[codes[:-1].astype(np.int64) << 8 | codes[1:]]
        pairs[ends] = -1
        pairs[ends[ends > 0] - 1] = -1
        order = np.argsort(pairs, kind="stable")
        order = order[np.searchsorted(pairs[order], 0) :]
        found, starts = np.unique(pairs[order], return_index=True)
        buckets: list[list[int] | None] = [None] * self.end
        lower = [0] * ((self.end >> SPAN) + 1)
        summary, order = 0, order.tolist()
        for rank, at, to in zip(found.tolist(), starts.tolist(), np.append(starts, len(order))[1:].tolist(), strict=True):
            buckets[rank] = order[at:to]
            lower[rank >> SPAN] |= _BITS[rank & _LOW]
            summary |= 1 << (rank >> SPAN)
        token, pair = tokens.tolist(), pairs.tolist()
        after = list(range(1, n + 1))  # where the token that begins here ends, which is where the next one begins
        before = list(range(-1, n - 1))
        with_right, with_left = self.with_right, self.with_left
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = lower[high]
            rank = high << SPAN | (word & -word).bit_length() - 1
            word &= word - 1
            lower[high] = word
            if not word:
                summary &= summary - 1
            bucket, buckets[rank] = buckets[rank], None
            bucket.sort()
            right_rank, left_rank = with_right[rank].get, with_left[rank].get
            for done, at in enumerate(bucket, 1):
                if pair[at] != rank:
                    continue  # stale
                gone = after[at]
                after[at] = end = after[gone]
                left = before[at]
                before[end] = at
                token[at] = rank
                token[gone] = pair[gone] = -1
                waits = False
                new = right_rank(token[end], -1)
                pair[at] = new
                if new >= 0:
                    if other := buckets[new]:
                        other.append(at)
                    else:
                        buckets[new] = [at]
                        lower[new >> SPAN] |= _BITS[new & _LOW]
                        summary |= _BITS[new >> SPAN]
                        waits = new < rank
                new = left_rank(token[left], -1)
                pair[left] = new
                if new >= 0:
                    if other := buckets[new]:
                        other.append(left)
                    else:
                        buckets[new] = [left]
                        lower[new >> SPAN] |= _BITS[new & _LOW]
                        summary |= _BITS[new >> SPAN]
                        waits |= new < rank
                if waits and done < len(bucket):
                    buckets[rank] = bucket[done:]
                    lower[high] |= _BITS[rank & _LOW]
                    summary |= _BITS[high]
                    break
        ids = np.array(token)
        whole = (ids >= 0) & (ids != self.end)
        to = (4 * np.cumsum(whole)[ends]).tolist()
        out = ids[whole].astype("<u4").tobytes()
        return [out[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]


class Codec(dict):
    """Encodes and decodes; as a dictionary, the bytes of the ids of pre-tokens seen lately. `older` holds those that
    were seen before: one that is met again is seen lately, the others go when as many have come."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, room: int | None = None):
        super().__init__()
        self.room = REMEMBERED if room is None else room
        self.ranks = ranks
        self.older: dict[str, bytes] = {}
        self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)
        self.split = regex.compile(pattern).findall
        self.merges = Merges(ranks)

    def learn(self, pieces: set[str]) -> None:
        """Takes up the ids of pre-tokens that are not known yet: one token if there is such a one, else by the queue."""
        merged, older = [], self.older.get
        for piece in pieces:
            known = older(piece)
            if known is not None:
                self[piece] = known
                continue
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                merged.append((piece, raw))
            else:
                self[piece] = whole.to_bytes(4, "little")
        for (piece, _), ids in zip(merged, self.merges([raw for _, raw in merged]), strict=True):
            self[piece] = ids

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; new pre-tokens share one queue."""
        split = [self.split(text) for text in texts]
        found = [list(map(self.get, pieces)) for pieces in split]
        new = {piece for pieces, ids in zip(split, found, strict=True) if None in ids for piece, x in zip(pieces, ids, strict=True) if x is None}
        if new:
            self.learn(new)
            found = [list(map(self.get, pieces)) if None in ids else ids for pieces, ids in zip(split, found, strict=True)]
            for piece in new:
                if len(piece) > REMEMBERED_CHARS:
                    del self[piece]
            if len(self) > self.room:
                self.older = dict(self)
                self.clear()
        return list(map(b"".join, found))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """encode_all by groups of texts that hold TOGETHER characters, or are one."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > TOGETHER:
                yield from self.encode_all(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield from self.encode_all(held)

    def forget(self) -> None:
        self.older = {}
        self.clear()

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; one that is no token's raises IndexError."""
        found = np.frombuffer(ids, "<u4")
        return b"".join(self._decode(found[i : i + DECODED]) for i in range(0, len(found), DECODED))

    def _decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        if not sizes.all():
            raise IndexError("an id without a token")
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


_codecs: dict[int, Codec] = {}


def _codec(content: bytes, pattern: str, room: int | None = None) -> Codec:
    """The codec of this worker, which later tasks use again."""
    key = hash((zlib.crc32(content), pattern, room))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(content), pattern, room)
    return _codecs[key]


def _shared(spark: SparkSession, vocabulary: str):
    """The vocabulary file, read once by the driver; its size does not depend on the data (under 1 MB here)."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spark: SparkSession, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
    """A function of a text column that gives the array of ids."""
    shared = _shared(spark, vocabulary)

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value, pattern, BESIDE_IDS)
        for batch in batches:
            yield pd.Series([np.frombuffer(ids, "<i4") for ids in codec.encode_batch(x or "" for x in batch)])
        codec.forget()

    return F.pandas_udf(giving_back(encode), "array<int>")


def decoder(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A function of an array of ids that gives the bytes they stand for; null gives none."""
    shared = _shared(spark, vocabulary)

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value, public_tokenizers.PATTERN)
        for batch in batches:
            yield pd.Series([codec.decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in batch])

    return F.pandas_udf(decode, "binary")


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(spark: SparkSession, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, ids: bool = False):
    """A function of a text column: n_tokens, ids_sha256 and decoded_sha256 of its ids and of what they decode to, and,
    where asked for, the ids themselves (array of int).

    Without ids, workers know between their tasks the pre-tokens that they have met; with ids, whose batches are far
    larger, a worker remembers fewer (BESIDE_IDS), forgets them at the end of each task and gives freed memory back.
    """
    shared, schema = _shared(spark, vocabulary), DIGESTS + ", ids array<int>" * ids
    columns = [x.split()[0] for x in schema.split(", ")]

    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value, pattern, BESIDE_IDS if ids else None)
        for batch in batches:
            rows = []
            for found in codec.encode_batch(x or "" for x in batch):
                row = (len(found) // 4, hashlib.sha256(found).hexdigest(), hashlib.sha256(codec.decode(found)).hexdigest())
                rows.append((*row, np.frombuffer(found, "<i4")) if ids else row)
            yield pd.DataFrame(rows, columns=columns)
        if ids:
            codec.forget()

    return F.pandas_udf(giving_back(digest) if ids else digest, schema)


def encode_table(documents: DataFrame, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, and, where asked for, its ids."""
    f = digests(documents.sparkSession, vocabulary, ids=ids)
    return small_batches(documents).select("doc_id", f(F.col("text").cast("string")).alias("r")).select("doc_id", "r.*")
