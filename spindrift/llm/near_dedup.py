"""Near-duplicate documents by a MinHash LSH forest, with exact confirmation.

1. Every text becomes its set of shingles (64-bit hashes) and a MinHash signature. Equal sets are one class, so copies
   are not compared with each other.
2. Each of TREES orders of signature values sorts all classes. Classes with a common prefix of BASE values are
   neighbours; where more than DENSE share one, the region goes by longer prefixes, up to DEEP values, and beyond that
   by stretches of DENSE neighbours in the order. Sorting is by range, so a hot prefix is spread over tasks by what
   follows in it, and the border of two tasks may cut a region.
3. In a region one-bit sketches of the signatures tell which neighbours may be similar enough. If they are few, all
   such pairs are candidates. A large family of near copies instead gives the pairs of its most central member, each
   member's nearest neighbour, and neighbours in the order whose common prefix is longer yet.
4. Candidates are confirmed on full sets, the nearest neighbours first, then what still joins two components.
5. Members of large families, of regions that were split and of those at borders that are still apart are compared with
   every other member of the BASE values' region that may be similar and is not in their component, tile by tile, so
   what steps 2 and 3 spared loses no link. Time for this grows with the square of such a region, less its largest component.

Candidates are sought by probability: the 32 trees begin with disjoint values, so a pair of similarity 0.8 shares a
prefix of 5 in some of them with probability 0.999997, and its sketches, the same in all trees, are near enough with probability 0.999997 again; both
rise fast with the similarity. Links are exact, and the class a component is named by is its smallest doc_id.

Null and empty texts, and texts without words, have no shingles and are linked with nothing: their component is their
own doc_id. Fewer words than a shingle has are one shingle. Repeated rows are copies; a null doc_id is named by the
others of its component, and is null and kept where there is none. An empty table gives an empty one. Other columns
are not read. Memory is one batch, one text's set or one region of DENSE rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, GroupedData, Observation
from pyspark.sql import functions as F

from .common import checkpointed, giving_back, in_few_tasks, small_batches, split_by_keys

WORDS, SIMILARITY = 4, 80
#: VALUES are the bits of a sketch; the signature has POSITIONS values, so that no two trees begin with a common one.
VALUES, TREES, BASE, DEEP, DENSE, TILE = 128, 32, 5, 9, 1024, 512
POSITIONS = TREES * BASE
#: Rows of a tile where only sketches meet.
SKETCH_TILE = 4096
#: Keys over which the members of one family are spread where they meet its largest component.
SALTS = 64
#: Links that one task settles, in some 100 MB; more are shrunk by distributed rounds first.
SETTLED = 1 << 20
#: Rounds of `components` that go by the nodes' own order.
PLAIN_ROUNDS = 6
#: Probability with which the sketches of a pair of just the similarity sought may hide it: what the forest misses too.
MISS = 3e-6

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_random = np.random.default_rng(20240229)
_TIMES = _random.integers(0, 1 << 31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _random.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)
_FIRST = _random.permutation(POSITIONS).reshape(TREES, BASE)
#: Positions by tree: each is among the first BASE of one tree, and among the further ones of one other at most.
_ORDERS = np.hstack([_FIRST] + [np.roll(_FIRST[:, i], i + 1)[:, None] for i in range(DEEP - BASE)])


class _Words(dict):
    """Hashes of the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """The distinct shingles of k words, as sorted hashes."""
    words = text.encode().lower().split()  # ASCII: only A-Z change, only ASCII white space separates
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += _mixed(h[i : n - k + 1 + i] + _MIX[i % 8]) * _MIX[(i + 3) % 8]
    return np.unique(_mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048, None] * _TIMES + _PLUS).min(0), out=out)
    return out


def _base(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, cls (what the set is known by; null if it is empty) and sig of every document."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, cls, sig = [], [], []
            for text in batch["text"]:
                found = shingles(text or "", k)
                n.append(len(found))
                cls.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sig.append(signature(found).tobytes() if len(found) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": n, "cls": cls, "sig": sig})
        _words.clear()  # an idle worker holds no words

    return small_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(giving_back(read), "doc_id long, n_shingles long, cls binary, sig binary")


# ---- the forest

def _branches(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: key (tree and BASE values), deeper (further values, 16 bits each), sketch, nid."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.iloc[start : start + 2048]
                sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(-1, POSITIONS)
                bits = np.packbits((sig[:, :VALUES] * np.uint32(0x9E3779B1) >> np.uint32(16) & np.uint32(1)).astype(bool), axis=1).view(np.int64)
                values = sig[:, _ORDERS].astype(np.uint64)  # classes x trees x DEEP
                key = np.repeat(np.arange(1, TREES + 1, dtype=np.uint64)[None] * _MIX[2], len(sig), 0)
                for i in range(BASE):
                    key = _mixed(key + values[:, :, i] * _MIX[3])
                deeper = np.zeros_like(key)
                for i in range(BASE, DEEP):
                    deeper = deeper << np.uint64(16) | _mixed(values[:, :, i] * _MIX[4]) >> np.uint64(48)
                n = len(sig)
                yield pd.DataFrame({
                    "key": key.view(np.int64).T.ravel(), "deeper": deeper.view(np.int64).T.ravel(),
                    "s0": np.tile(bits[:, 0], TREES), "s1": np.tile(bits[:, 1], TREES), "nid": np.tile(part["nid"].to_numpy(np.int64), TREES),
                })
                assert n == len(part)

    return classes.select("nid", "sig").mapInPandas(giving_back(grow), "key long, deeper long, s0 long, s1 long, nid long")


def sketch_bits(similarity: int) -> int:
    """The fewest bits, of VALUES, that sketches of a pair of this similarity (in percent) exceed with MISS at most.

    Each bit differs with half the probability with which the pair's signature values do.
    """
    p, left = (100 - similarity) / 200, 1.0
    for bits in range(VALUES):
        left -= comb(VALUES, bits) * p**bits * (1 - p) ** (VALUES - bits)
        if left <= MISS:
            return bits
    return VALUES


def _apart(rows: np.ndarray, i, j) -> np.ndarray:
    """Bits in which the sketches of rows i and j differ. rows: s0 and s1."""
    x = (rows[i] ^ rows[j]).view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    return np.bitwise_count(x[..., 0]).astype(np.int16) + np.bitwise_count(x[..., 1])


def _region(sketch: np.ndarray, deeper: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, int]:
    """Candidate pairs of a region (positions i, j and bits apart), whether they are all there are, and the centre."""
    m = len(sketch)
    near_i, near_j, near_d = [], [], []
    degree = np.zeros(m, np.int64)
    for a in range(0, m, 256):
        i = np.arange(a, min(m, a + 256))
        d = _apart(sketch, i[:, None], np.arange(m)[None])
        hit = (d <= bits) & (i[:, None] != np.arange(m)[None])
        degree[i] = hit.sum(1)
        x, y = np.nonzero(hit & (i[:, None] < np.arange(m)[None]))
        near_i.append(i[x])
        near_j.append(y)
        near_d.append(d[x, y])
    i, j, d = map(np.concatenate, (near_i, near_j, near_d))
    centre = int(degree.argmax())
    if len(i) <= 4 * m:
        return i, j, d, True, centre
    best = np.full(m, 1 << 62)
    for a, b in ((i, j), (j, i)):
        np.minimum.at(best, a, d.astype(np.int64) << 32 | b)
    longer = deeper.view(np.uint64) >> np.uint64(32)  # two values more than the region's prefix
    pick = (i == centre) | (j == centre) | (j == i + 1) & (longer[i] == longer[j]) | (best[i] == (d.astype(np.int64) << 32 | j)) | (best[j] == (d.astype(np.int64) << 32 | i))
    return i[pick], j[pick], d[pick], False, centre


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _neighbours(branches: DataFrame, bits: int) -> DataFrame:
    """Candidates (a, b, apart) with region null, and members (a = nid, s0, s1) of regions that did not give all pairs.

    Such are also regions that were split, which are one region each here, and those at the borders of a task.
    """

    def regions(key: np.ndarray, deeper: np.ndarray, lo: int, hi: int, depth: int):
        if hi - lo <= DENSE:
            if hi - lo > 1:
                yield lo, hi, False
        elif depth == DEEP - BASE:
            for a in range(lo, hi, DENSE):
                yield a, min(hi, a + DENSE), True
        else:
            cuts = _runs(deeper[lo:hi].view(np.uint64) >> np.uint64(16 * (DEEP - BASE - 1 - depth))) + lo
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield from regions(key, deeper, int(a), int(b), depth + 1)

    def look(key, deeper, sketch, nid, first: bool, last_one: bool) -> pd.DataFrame | None:
        cuts = _runs(key)
        size = np.diff(cuts)
        parted = size > DENSE
        parted[:1] |= first
        parted[-1:] |= last_one
        pairs = cuts[:-1][size == 2]
        d = _apart(sketch, pairs, pairs + 1)
        pairs, d = pairs[d <= bits], d[d <= bits]
        out_a, out_b, out_d = [nid[pairs]], [nid[pairs + 1]], [d]
        members = [(xxhash.xxh3_64_intdigest(key[cuts[k]].tobytes()), np.arange(cuts[k], cuts[k + 1])) for k in np.flatnonzero(parted)]
        for k in np.flatnonzero(size > 2):
            last = None
            for lo, hi, cut in regions(key, deeper, int(cuts[k]), int(cuts[k + 1]), 0):
                i, j, apart, whole, centre = _region(sketch[lo:hi], deeper[lo:hi], bits)
                out_a.append(nid[lo + i])
                out_b.append(nid[lo + j])
                out_d.append(apart)
                if not whole and not parted[k]:
                    members.append((xxhash.xxh3_64_intdigest(key[lo].tobytes() + deeper[lo].tobytes() + nid[lo].tobytes()), np.arange(lo, hi)))
                if cut and last is not None:  # stretches of one long region hang together by their centres
                    out_a.append(nid[[last]])
                    out_b.append(nid[[lo + centre]])
                    out_d.append(_apart(sketch, [last], [lo + centre]))
                last = lo + centre
        a, b, d = map(np.concatenate, (out_a, out_b, out_d))
        frame = pd.DataFrame({"region": pd.array([pd.NA] * len(a), "Int64"), "a": np.minimum(a, b), "b": np.maximum(a, b), "apart": d.astype(np.int32), "s0": np.int64(0), "s1": np.int64(0)}).drop_duplicates(["a", "b"])
        if members:
            at = np.concatenate([x for _, x in members])
            ids = np.repeat(np.array([r for r, _ in members], np.uint64).view(np.int64), [len(x) for _, x in members])
            frame = pd.concat([frame, pd.DataFrame({"region": pd.array(ids, "Int64"), "a": nid[at], "b": np.int64(-1), "apart": np.int32(0), "s0": sketch[at, 0], "s1": sketch[at, 1]})])
        return frame

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        first = True  # the first key may have rows that are not in the frame

        def done(frame: pd.DataFrame, last_one: bool) -> pd.DataFrame:
            sketch = np.ascontiguousarray(frame[["s0", "s1"]].to_numpy(np.int64))
            return look(*(frame[c].to_numpy(np.int64) for c in ("key", "deeper")), sketch, frame["nid"].to_numpy(np.int64), first, last_one)

        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) < 200_000:
                continue
            frame = pd.concat(kept, ignore_index=True)
            last = frame["key"].iloc[-1]
            cut = int(np.searchsorted(frame["key"].to_numpy(), last, "left"))
            alone = cut == 0
            if alone:  # all rows have one key: what follows is another stretch of it
                cut = len(frame)
            yield done(frame.iloc[:cut], alone)
            kept, first = [frame.iloc[cut:]], alone
        frame = pd.concat(kept, ignore_index=True) if kept else None
        if frame is not None and len(frame):
            yield done(frame, True)

    ordered = branches.repartitionByRange("key", "deeper").sortWithinPartitions("key", "deeper", "nid")
    return ordered.mapInPandas(giving_back(walk), "region long, a long, b long, apart int, s0 long, s1 long")


# ---- confirmation

def _sets(documents: DataFrame, classes: DataFrame, involved: DataFrame, k: int) -> DataFrame:
    """nid and full set of the classes that are in some pair, from the text of the document each is named by."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(text or "", k).tobytes() for text in batch["text"]]
            same = [xxhash.xxh3_128_digest(x) == bytes(c) for x, c in zip(found, batch["cls"], strict=True)]
            yield pd.DataFrame({"nid": batch["nid"], "found": found})[same].drop_duplicates("nid")
        _words.clear()

    wanted = checkpointed(in_few_tasks(classes.join(involved, "nid", "left_semi").select("nid", "cls", "rep")))
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    texts, _ = split_by_keys(texts, F.col("id"), wanted.select("rep"))  # most texts are in no pair and stay where they are
    return texts.join(wanted, texts["id"].eqNullSafe(wanted["rep"])).select("nid", "cls", "text").mapInPandas(giving_back(read), "nid long, found binary").dropDuplicates(["nid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch[["a", "b"]][ok]

    x, y = sets.select(F.col("nid").alias("a"), F.col("found").alias("x")), sets.select(F.col("nid").alias("b"), F.col("found").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(giving_back(confirm), "a long, b long")


def _gathered_rows(df: DataFrame, rows: int = 50_000) -> tuple[DataFrame, int]:
    """df, written to the shared folder and read in as many partitions as its count asks for, and that count.

    What is left after the forest is a small part of the input; spread over as many tasks as the input, its many joins
    would leave more file heads than rows. Rows are counted as they are written, without a job of its own.
    """
    seen = Observation()
    out = checkpointed(in_few_tasks(df).observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return out.coalesce(max(1, -(-n // rows))), n


def _gathered(df: DataFrame, rows: int = 50_000) -> DataFrame:
    return _gathered_rows(df, rows)[0]


def _settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links (a, b) and the smallest node that can be reached from it.

    Trees of nodes, each under a smaller one: links hang the root of one tree under that of another, and paths are
    shortened until every node is right under its root.
    """
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        one, other = root[x], root[y]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root != root[root]).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that can be reached) of every node of the links (a, b).

    Up to SETTLED links are settled by one task. While there are more, each round sends every node to the first of
    itself and its neighbours, and goes on with the links between different ones. First means smallest, which settles
    families in a few rounds; after PLAIN_ROUNDS rounds, smallest by a hash of its own, so that long chains in order
    shrink by a share each time too.
    """

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = list(batches)
        if any(map(len, kept)):
            nodes, root = _settled(*(np.concatenate([x[c].to_numpy(np.int64) for x in kept]) for c in "ab"))
            yield pd.DataFrame({"node": nodes, "root": root})

    edges, left = _gathered_rows(links.filter("a != b").select("a", "b"))
    roots, number = None, 0
    while left > SETTLED:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: F.xxhash64(F.lit(number), c)) if number >= PLAIN_ROUNDS else (lambda c: F.col(c))  # noqa: B023, E731
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("m"))).alias("x"))
        step = _gathered(least.select("node", F.when(F.col("x.r") < rank("node"), F.col("x.m")).otherwise(F.col("node")).alias("to")))
        roots = step.select("node", F.col("to").alias("root")) if roots is None else _moved(roots, step.select("node", F.col("to").alias("root")))
        x, y = step.select(F.col("node").alias("a"), F.col("to").alias("ra")), step.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges, left = _gathered_rows(edges.join(x, "a").join(y, "b").filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        number += 1
    settled = _gathered(edges.coalesce(1).mapInPandas(giving_back(settle), "node long, root long"))
    if roots is None:
        return settled
    roots = _moved(roots, settled)
    if number <= PLAIN_ROUNDS:
        return roots  # the smallest already
    smallest = roots.groupBy("root").agg(F.min("node").alias("least"))
    return _gathered(roots.join(smallest, "root").select("node", F.col("least").alias("root")))


def _moved(roots: DataFrame, step: DataFrame) -> DataFrame:
    """roots whose own roots, as nodes of step, have a root there."""
    return _gathered(roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of different components, with their roots."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    out = pairs.join(a, "a", "left").join(b, "b", "left").withColumns({f"r{x}": F.coalesce(f"r{x}", x) for x in "ab"})
    return out.filter("ra != rb")


def _joined(roots: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """roots after further links among `pairs`, which know the roots of their ends."""
    between = links.join(pairs.select("a", "b", "ra", "rb"), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    more = components(between)
    return _gathered(_moved(roots, more).unionAll(more.join(roots, "node", "left_anti")))


def _counted(each: DataFrame) -> DataFrame:
    """each of the families of several components, with the largest one (hub), its rows (most) and the family's (all)."""
    counted = each.groupBy("family", "root").agg(F.count("*").alias("n"))
    hub = counted.groupBy("family").agg(F.max(F.struct("n", "root"))["root"].alias("hub"), F.sum("n").alias("all"), F.count("*").alias("parts"), F.max("n").alias("most")).filter("parts > 1")
    # Salted: a family may hold most rows, and a join by it alone would leave all its tiles in one task.
    spread = hub.drop("parts").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return each.withColumn("salt", F.pmod(F.xxhash64("nid"), F.lit(SALTS)).cast("int")).join(spread, ["family", "salt"]).drop("salt")


def _tiles(known: DataFrame, rows: int, *kinds: str) -> GroupedData:
    """Pairs of tiles: members outside their family's hub (sought), and all members."""
    known = known.withColumns({"tiles": F.ceil(F.col("all") / rows), "rests": F.ceil((F.col("all") - F.col("most")) / rows)})
    dealt, kinds = F.xxhash64("nid"), ("nid", "family", "root", "s0", "s1", *kinds)
    against = known.select(*kinds, F.pmod(dealt, "tiles").alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("rest"), F.lit(False).alias("sought"))
    sought = known.filter("root != hub").select(*kinds, F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.pmod(dealt, "rests").alias("rest"), F.lit(True).alias("sought"))
    return against.unionAll(sought).groupBy("family", "tile", "rest")


def _left_over(members: DataFrame, roots: DataFrame, sets: Callable[[DataFrame], DataFrame], bits: int, similarity: int) -> DataFrame:
    """Links (a, b, ra, rb) between members of one family that are in different components.

    Regions that share a member are one family. Each of its members outside its largest component meets all others:
    both sides are dealt into tiles, a pair of tiles to a group, so that no task holds more. First only sketches meet,
    in tiles of SKETCH_TILE rows; members that are near one of another component meet again with their sets, in
    tiles of TILE rows, and only confirmed links leave those.
    """
    least = members.groupBy("region").agg(F.min("nid").alias("b"))
    family = components(members.join(least, "region").select(F.col("nid").alias("a"), "b"))
    each = members.groupBy("nid").agg(F.first("s0").alias("s0"), F.first("s1").alias("s1")).join(family.withColumnsRenamed({"node": "nid", "root": "family"}), "nid")
    each = _gathered(each.join(roots.withColumnsRenamed({"node": "nid"}), "nid", "left").withColumn("root", F.coalesce("root", "nid")))

    def near_ones(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[frame["sought"]], frame[~frame["sought"]]
        sketch_x, sketch_y = (np.ascontiguousarray(z[["s0", "s1"]].to_numpy(np.int64)) for z in (x, y))
        root_x, root_y = x["root"].to_numpy(np.int64), y["root"].to_numpy(np.int64)
        hit_x, hit_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for a in range(0, len(x), 256):
            apart = np.bitwise_count((sketch_x[a : a + 256, None, 0] ^ sketch_y[None, :, 0]).view(np.uint64))
            apart += np.bitwise_count((sketch_x[a : a + 256, None, 1] ^ sketch_y[None, :, 1]).view(np.uint64))
            hit = (apart <= bits) & (root_x[a : a + 256, None] != root_y[None])
            hit_x[a : a + 256] = hit.any(1)
            hit_y |= hit.any(0)
        return pd.DataFrame({"nid": np.unique(np.concatenate((x["nid"].to_numpy(np.int64)[hit_x], y["nid"].to_numpy(np.int64)[hit_y])))})

    near = _gathered(_tiles(_counted(each), SKETCH_TILE).applyInPandas(near_ones, "nid long").distinct())
    known = _counted(_gathered(each.join(near, "nid"))).join(sets(near), "nid")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[frame["sought"]].reset_index(drop=True), frame[~frame["sought"]].reset_index(drop=True)
        out: list[tuple[int, int, int, int]] = []
        if len(x) and len(y):
            sketch_x, sketch_y = (np.ascontiguousarray(z[["s0", "s1"]].to_numpy(np.int64)) for z in (x, y))
            found = [np.frombuffer(z, np.uint64) for z in y["found"]]
            size, root = np.array(list(map(len, found))), y["root"].to_numpy(np.int64)
            every, begin = np.concatenate(found), np.concatenate(([0], np.cumsum(size)[:-1]))
            for i in range(len(x)):
                mine = np.frombuffer(x["found"][i], np.uint64)
                near = (root != x["root"][i]) & (np.bitwise_count((sketch_y ^ sketch_x[i]).view(np.uint64)).sum(1, dtype=np.int64) <= bits)
                if not near.any():
                    continue
                at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
                both = np.add.reduceat((mine[at] == every).astype(np.int64), begin)
                hits = np.flatnonzero(near & (100 * both >= similarity * (len(mine) + size - both)))
                for j in hits[np.unique(root[hits], return_index=True)[1]]:  # one link to each component
                    out.append((x["nid"][i], y["nid"][j], x["root"][i], root[j]))
        return pd.DataFrame(out, columns=["a", "b", "ra", "rb"], dtype="int64")

    return _tiles(known, TILE, "found").applyInPandas(meet, "a long, b long, ra long, rb long")


def dedup(documents: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, and its class and component (null without shingles)."""
    bits = sketch_bits(similarity)
    base = checkpointed(_base(documents, words))
    classes = base.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = checkpointed(classes.withColumn("nid", F.monotonically_increasing_id()))
    found = checkpointed(_neighbours(_branches(classes), bits))
    pairs = _gathered(found.filter("region IS NULL").groupBy("a", "b").agg(F.min("apart").alias("apart")))
    members, dense = _gathered_rows(found.filter("region IS NOT NULL").select("region", F.col("a").alias("nid"), "s0", "s1"))

    involved = pairs.select(F.col("a").alias("nid")).unionAll(pairs.select(F.col("b").alias("nid"))).distinct()
    sets = _gathered(_sets(documents, classes, involved, words), 5_000)

    ends = pairs.select("a", "b", "apart", F.col("a").alias("x"), F.col("b").alias("y")).unionAll(pairs.select("a", "b", "apart", F.col("b").alias("x"), F.col("a").alias("y")))
    nearest = ends.groupBy("x").agg(F.min(F.struct("apart", "y", "a", "b")).alias("n")).select("n.a", "n.b").distinct()
    roots = components(_confirmed(nearest, sets, similarity))

    tried = _gathered(_across(pairs.select("a", "b"), roots))
    roots = _joined(roots, _confirmed(tried.select("a", "b"), sets, similarity), tried)

    if dense:
        rest = _gathered(_left_over(members, roots, lambda nids: _gathered(_sets(documents, classes, nids, words), 5_000), bits, similarity))
        roots = _joined(roots, rest.select("a", "b"), rest)

    named = classes.select("cls", "nid", "rep").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "root").select(F.col("cls").alias("c"), F.col("root").alias("component"), "component_id")
    out = base.select("doc_id", "n_shingles", "cls").join(named, F.col("cls") == F.col("c"), "left")
    component_id = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"), "cls", "component")


def drop_near_copies(documents: DataFrame, **how) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; a row that repeats stays once.

    The verdict comes back by doc_id, so different texts under one doc_id stay or go together. Documents whose id no
    verdict against it and no second row has are passed on as they are; only the others are shuffled.
    """
    found = checkpointed(in_few_tasks(dedup(documents, **how).select(F.col("doc_id").alias("__id"), "kept")))
    each = found.groupBy("__id").agg(F.count("*").alias("n"), F.max(F.col("kept").cast("int")).alias("kept"))
    doubtful, clear = split_by_keys(documents, F.col("doc_id").cast("long"), each.filter("n > 1 OR kept = 0").select("__id"))
    kept = each.filter("kept = 1").select(F.col("__id").alias("__kept_id"))
    stay = doubtful.join(kept, doubtful["doc_id"].eqNullSafe(kept["__kept_id"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return clear.unionByName(stay)
