"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct shingles of five words, ASCII letters lower-cased. Documents with equal sets
form one class, told by a digest, and only one representative goes on, however many copies there are. All
signature coordinates come from two permutations of a circle of places: the first scatters the elements, the
second ranks them, shifted by 1, 2, 3, ... places round the circle. Bands of coordinates name buckets; a bit of
each coordinate makes a sketch, and only pairs whose sketches differ little become candidates.

Within a bucket no pair list is made. The members are held against one hub; verified links are merged into
components, and only members of different components are held against the next hub. When the pairs left across
components are few, or after ``ROUNDS`` hubs, all that are left are verified, so no candidate link is lost.
Links are confirmed on the full sets: 100 * intersection >= 75 * union.

Fewer than five words make one shingle; null and empty texts, and texts of white space, have no set and are
alone. An id that stands for several texts is one document that has all their links. A null id links with nothing.
Equal rows are all kept or all dropped by their id; other columns, whatever their names, go through untouched. Texts
are read in slices of bounded size, long ones whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import components, linked_groups, with_both
from tallyforge.llm.shared import sliced, written

WORDS, PERCENT = 5, 75
BANDS, ROWS = 40, 5
#: Coordinates in all, of which one bit each makes the sketch; places of the circle, as a power of two.
COORDINATES, CIRCLE = 2048, 22
#: Bits that sketches of linked sets may differ in: of 2048, sets at 0.75 differ in 256 on average (deviation 15),
#: and in more than 323 about three times in a million.
SKETCH_BITS = 323
#: Words of the sketch that are compared first, and the bits they may differ in: 512 bits differ in 64 on average
#: (deviation 7.5) at 0.75, and in more than 106 about once in a hundred million.
FIRST_WORDS, FIRST_BITS = 8, 106
ROUNDS = 2
#: Pairs across components per candidate document, up to which they are verified without another hub.
FEW = 4

# Fixed odd multipliers of the word positions in a shingle, and of the rows in a band.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def _scatter(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    tokens = text.encode().lower().split() if text else []
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    if n < words:
        return _scatter(np.array([int((hashed * _MIX[:n]).sum(dtype=np.uint64)) ^ n], dtype=np.uint64))
    total = hashed[: n - words + 1] * _MIX[0]
    for k in range(1, words):
        total += hashed[k : n - words + 1 + k] * _MIX[k % 5]
    return np.unique(_scatter(total))


_CIRCLES: dict[int, np.ndarray] = {}


def _circle(coordinates: int) -> np.ndarray:
    """Row i: what the second permutation gives at places i + 1, i + 2, ... round the circle."""
    if coordinates not in _CIRCLES:
        order = np.random.default_rng(7).permutation(1 << CIRCLE).astype(np.uint32)
        _CIRCLES[coordinates] = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates]])[1:], coordinates)
    return _CIRCLES[coordinates]


def signature(elements: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash of a set: the first permutation scatters its elements round the circle, the second, shifted
    by one place for each coordinate, ranks them; uint32 least ranks."""
    places = _scatter(elements ^ np.uint64(0x51ED270B7A5F3C1D)) >> np.uint64(64 - CIRCLE)
    circle = _circle(coordinates)
    out = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(places), 32):  # few enough rows to stay in the processor's cache
        np.minimum(out, circle[places[at : at + 32]].min(axis=0), out=out)
    return out


def band_keys(sign: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket name per band."""
    cut = sign[: bands * rows].reshape(bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        total = _scatter(total * _MIX[0] + cut[:, k])
    return total.view(np.int64)


def sketch(sign: np.ndarray) -> np.ndarray:
    """One bit of a hash of each coordinate, packed into 64-bit words."""
    bits = ((sign * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def sets(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, digest, keys and sketch of every row; null from digest on for empty sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sizes, digests, keys, sketches = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                sign = signature(found, max(COORDINATES, bands * rows)) if len(found) else None
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(band_keys(sign, bands, rows) if len(found) else None)
                sketches.append(sketch(sign[:COORDINATES]) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "th", "n_shingles", "digest", "keys", "sketch"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, n_shingles long, digest binary, keys array<long>, sketch array<long>")


def _near():
    """What every link meets: set sizes that allow it, and sketches that differ in few bits."""

    def differ(words: range):
        one = [F.bit_count(F.col("nx.s")[k].bitwiseXOR(F.col("ny.s")[k])) for k in words]
        return sum(one[1:], one[0])

    sizes = 100 * F.least("nx.n", "ny.n") >= PERCENT * F.greatest("nx.n", "ny.n")
    return sizes & (differ(range(FIRST_WORDS)) <= FIRST_BITS) & (differ(range(COORDINATES // 64)) <= SKETCH_BITS)


def _alike(n: np.ndarray, s: np.ndarray, m: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The condition of ``_near`` for every two of the sets (n, s) and (m, t): sizes and sketches."""
    s, t = s.view(np.uint64), t.view(np.uint64)
    good = 100 * np.minimum(n[:, None], m[None, :]) >= PERCENT * np.maximum(n[:, None], m[None, :])
    some = sum(np.bitwise_count(s[:, None, k] ^ t[None, :, k]).astype(np.uint16) for k in range(FIRST_WORDS))
    x, y = np.nonzero(good & (some <= FIRST_BITS))
    for at in range(0, len(x), 100_000):
        a, b = x[at : at + 100_000], y[at : at + 100_000]
        good[a, b] = np.bitwise_count(s[a] ^ t[b]).sum(axis=1) <= SKETCH_BITS
    return good & (some <= FIRST_BITS)


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are alike enough. ``texts``: node, text."""
    kind = texts.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, None  # pairs come sorted by b, so a hub's set is made once
        for whole in batches:
            for batch in sliced([whole], "va"):
                kept = []
                for k, (ta, tb) in enumerate(zip(batch.column(2), batch.column(3))):
                    tb = tb.as_py()
                    if tb != last_text:
                        last_text, last = tb, shingles(tb)
                    mine = shingles(ta.as_py())
                    if 100 * min(len(mine), len(last)) < percent * max(len(mine), len(last)):
                        continue
                    common = len(np.intersect1d(mine, last, assume_unique=True))
                    if 100 * common >= percent * (len(mine) + len(last) - common):
                        kept.append(k)
                yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return with_both(pairs, texts, "text").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    found = written(sets(docs, bands, rows))
    of_set = found.filter("digest is not null and doc_id is not null").groupBy("digest")
    classes = of_set.agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("s"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))  # written, so the numbers stay
    banded = classes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    met = banded.join(shared, "key").select("key", "node")
    members = written(met.join(classes.select("node", F.struct("n", "s").alias("n")), "node").select("key", "node", "n"))
    nodes = members.select("node").distinct().join(classes.select("node", F.col("least.doc_id").alias("least_id"), F.col("least.th").alias("least_th")), "node")
    whose = (F.col("doc_id") == F.col("least_id")) & (F.xxhash64("text") == F.col("least_th"))
    texts = written(docs.select("doc_id", "text").join(nodes, whose).select("node", "text").dropDuplicates(["node"]))
    count = texts.count()

    roots, links = linked_groups(members, lambda pairs: verified(pairs, texts), count, rounds, few, _near(), classes.select("node", "keys"), _alike)
    # An id that stands for several sets links them.
    ids = found.filter("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low != high").select("doc_id")
    several = found.filter("digest is not null").join(ids, "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "node"), "digest")
    bridges = written(several.join(several.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").filter("node != b").select(F.col("node").alias("a"), "b"))
    if not bridges.isEmpty():
        roots = components(links.unionByName(bridges))
    of_class = written(classes.select("digest", "node", F.col("least.doc_id").alias("least")).join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")))
    smallest = of_class.groupBy("root").agg(F.min("least").alias("component"))
    of_class = of_class.join(smallest, "root").select("digest", "component")
    placed = found.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    return placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: the rows of ``docs`` whose id is its component's smallest, once for equal rows."""
    component = near_duplicates(docs).filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(component, "doc_id", "left_anti").dropDuplicates(docs.columns).select(*docs.columns)


def minhash_query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
