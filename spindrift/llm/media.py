"""Media columns: content-addressed payloads in tar shards.

A payload (here a text's UTF-8 bytes, padded to full rows) is stored losslessly as the 8-bit samples of a grey PNG
image, a member of a tar shard that is named by the digest of the payload. Rows carry digest, shard, offset and
length. Metadata columns come from range reads of the image header alone; payloads are read when asked for.

Tasks write their shards straight to the shared folder, under names of their own, and only then hand on the rows that
refer to them: a task that runs twice leaves a shard that no row names. Payloads that several tasks stored get one
address, the smallest, so a digest means one place.

Null texts count as empty; an empty text is one row of zeros. Equal texts, repeated rows included, give equal values.
An empty table gives an empty one. Columns other than doc_id and text are neither read nor returned. Memory is one
Arrow batch and one payload.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, small_batches

#: Samples in a row of an image; payloads are padded to full rows.
WIDTH = 64
#: A task begins another shard beyond this size.
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
FEATURES = "digest string, width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey image with the samples in rows of WIDTH, unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    body = np.zeros((len(rows), WIDTH + 1), np.uint8)
    body[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), 4)) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int]:
    """Width and height, from the first HEADER_BYTES bytes of an image."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR" or struct.unpack(">I", data[29:33])[0] != zlib.crc32(data[12:29]):
        raise ValueError("not the header of an image")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    if (depth, colour) != (8, 0):
        raise ValueError("not 8-bit grey samples")
    return width, height


def from_png(data: bytes) -> bytes:
    width, height = read_header(data)
    at, packed = HEADER_BYTES, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("an image chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


class ShardWriter:
    """Writes payloads that it has not seen yet to tar shards under `root`, a folder that all machines share."""

    def __init__(self, root: str):
        self.files, self.path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        self.root = root.rstrip("/")
        self.seen: dict[str, tuple[str, int, int]] = {}
        self.out, self.name, self.at = None, "", 0
        self.files.create_dir(self.path, recursive=True)

    def put(self, digest: str, data: bytes) -> tuple[str, int, int]:
        found = self.seen.get(digest)
        if found is None:
            if self.out is None:
                self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
                self.out = self.files.open_output_stream(f"{self.path.rstrip('/')}/{self.name}")
            member = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
            member.size = len(data)
            head = member.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            found = self.seen[digest] = (f"{self.root}/{self.name}", self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
            if self.at >= SHARD_BYTES:
                self.close()
        return found

    def close(self) -> None:
        """Ends the shard. What it holds is no longer remembered, so that memory stays bounded."""
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out, self.seen = None, {}


def store(documents: DataFrame, root: str | None = None) -> DataFrame:
    """STORED: where the payload of each document is. The shards are written when this returns."""
    root = root or f"{shared_dir(documents.sparkSession)}/media-{uuid.uuid4().hex}"

    def write(batches):
        writer = ShardWriter(root)
        held = []
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = (text or "").encode()
                data = payload(raw)
                digest = hashlib.sha256(data).hexdigest()
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(raw), digest, *(writer.seen.get(digest) or writer.put(digest, to_png(data)))))
            held.append(rows)
            if writer.out is None:  # rows are handed on once their shard is complete
                yield from map(_frame, held)
                held = []
        writer.close()
        yield from map(_frame, held)

    return checkpointed(small_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(write, STORED))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in STORED.split(", ")])
    return frame.astype({"doc_id": "Int64"})


def addresses(stored: DataFrame) -> DataFrame:
    """One place for each digest."""
    return stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranges(batch: pd.DataFrame):
    """Each row of a batch with its shard opened, shard by shard."""
    shard, source = None, None
    for row in batch.itertuples(index=False):
        if row.shard != shard:
            if source:
                source.close()
            files, path = fs.FileSystem.from_uri(row.shard) if ":" in row.shard else (fs.LocalFileSystem(), row.shard)
            shard, source = row.shard, files.open_input_file(path)
        yield row, source
    if source:
        source.close()


def headers(places: DataFrame) -> DataFrame:
    """digest, width and height, by reading HEADER_BYTES bytes of each image."""

    def read(batches):
        for batch in batches:
            rows = [(row.digest, *read_header(source.read_at(HEADER_BYTES, row.offset))) for row, source in _ranges(batch)]
            yield pd.DataFrame(rows, columns=["digest", "width", "height"])

    return places.mapInPandas(read, "digest string, width long, height long")


def feature(samples: bytes) -> str:
    """Mean sample, mean step between neighbouring samples, share of zeros and share of samples over 127."""
    x = np.frombuffer(samples, np.uint8)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return f"{x.sum(dtype=np.int64) / len(x):.4f},{step / max(1, len(x) - 1):.4f},{np.count_nonzero(x == 0) / len(x):.4f},{np.count_nonzero(x > 127) / len(x):.4f}"


def features(places: DataFrame) -> DataFrame:
    """FEATURES of every stored payload: sizes from a range read of the header, the rest from the stored bytes, decoded."""

    def read(batches):
        for batch in batches:
            rows = []
            for row, source in _ranges(batch):
                width, height = read_header(source.read_at(HEADER_BYTES, row.offset))
                media = source.read_at(row.length, row.offset)
                data = from_png(media)
                if len(data) != width * height:
                    raise ValueError("an image has another size than its header says")
                rows.append((row.digest, width, height, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").mapInPandas(read, FEATURES)


def media_table(documents: DataFrame, root: str | None = None) -> DataFrame:
    """doc_id, n_bytes and FEATURES without digest, width and height, for every document."""
    stored = store(documents, root)
    return stored.select("doc_id", "n_bytes", "digest").join(features(addresses(stored)), "digest").select("doc_id", "n_bytes", *(x.split()[0] for x in FEATURES.split(", ")[3:]))
