"""Integer codes that pack many values into bytes: varint and simple8b, with their decoders.

Both take arrays of whole numbers of 0 and more; signed ones and times go through `scalars.zigzag` and `scalars.delta`
first. As functions of columns they run in Arrow batches, an array at a time; null arrays stay null, empty ones give no bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# simple8b's packings, values in a word and bits of each; the first two hold runs of zeros... of ones.
PACKINGS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: What a word of simple8b can hold at most.
LARGEST = (1 << 60) - 1


def varint(values: np.ndarray) -> bytes:
    """Groups of 7 bits, lowest first; the top bit of a byte tells that another one follows."""
    x = np.asarray(values, np.uint64)
    if not len(x):
        return b""
    groups = x[:, None] >> np.arange(0, 64, 7, dtype=np.uint64)  # 10 groups hold 64 bits
    size = np.maximum(1, (groups != 0).sum(1))
    place = np.arange(groups.shape[1])
    used = place < size[:, None]
    out = (groups & np.uint64(127)).astype(np.uint8) | (place < size[:, None] - 1).astype(np.uint8) << 7
    return out[used].tobytes()


def unvarint(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(x < 128)
    if not len(ends) or ends[-1] != len(x) - 1:
        raise ValueError("the last value has no end")
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(x)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((x & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def simple8b(values: np.ndarray) -> bytes:
    """Words of 64 bits: 4 bits name the packing, 60 hold as many values as fit at the width of the widest.

    Runs of 240 or 120 ones take a word without values.
    """
    x = np.asarray(values, np.uint64)
    if len(x) and int(x.max()) > LARGEST:
        raise ValueError("a value has more than 60 bits")
    bits = np.array([int(v).bit_length() for v in x], np.int64)
    words, at = [], 0
    while at < len(x):
        for selector, (n, width) in enumerate(PACKINGS):
            if n > len(x) - at:
                continue
            if width == 0:
                if (x[at : at + n] == 1).all():
                    words.append(selector << 60)
                    break
            elif bits[at : at + n].max() <= width:
                word = selector << 60
                for i, v in enumerate(x[at : at + n].tolist()):
                    word |= v << i * width
                words.append(word)
                break
        at += n
    return np.array(words, "<u8").tobytes()


def unsimple8b(data: bytes) -> np.ndarray:
    out = []
    for word in np.frombuffer(data, "<u8").tolist():
        n, width = PACKINGS[word >> 60]
        out += [1] * n if width == 0 else [word >> i * width & (1 << width) - 1 for i in range(n)]
    return np.array(out, np.uint64)


def _packer(pack):
    def apply(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else pack(np.asarray(x)) for x in batch], dtype=object)

    return F.pandas_udf(apply, "binary")


def _unpacker(unpack):
    def apply(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unpack(bytes(x)).astype(np.int64) for x in batch], dtype=object)

    return F.pandas_udf(apply, "array<bigint>")


def varint_pack(values: Column) -> Column:
    return _packer(varint)(values)


def varint_unpack(data: Column) -> Column:
    return _unpacker(unvarint)(data)


def simple8b_pack(values: Column) -> Column:
    return _packer(simple8b)(values)


def simple8b_unpack(data: Column) -> Column:
    return _unpacker(unsimple8b)(data)
