"""Cropped and edited copies of images by local descriptors.

Grey images are searched for corners (Harris responses with non-maximum suppression) at several scales; all of them
count, so they grow with the image's area. Around each corner the intensity centroid gives an orientation, and
``BITS`` brightness comparisons of point pairs, turned by it, give a binary descriptor. Descriptors meet through
Hamming tables: each of ``TABLES`` tables is keyed by ``KEY`` bits of its own choice, and images that share an entry
are candidates. A pair is a link if at least ``INLIERS`` of its matches (mutually nearest descriptors that differ in
at most ``NEAR`` bits) agree on one scale, turn and shift.

Images with equal pixels form one class by digest, and only one representative is described, however many copies
there are. Table entries are not expanded into pairs: in each round, every image is held against one hub, the least
image that it shares an entry with; links become components, and only images that share an entry with another component go
on. All pairs that are left after ``ROUNDS`` hubs are verified, so no candidate link is lost. Two descriptors meet
with a chance that falls with the bits they differ in, so the search is not exact: of pairs of noisy copies, 99 in a
hundred share an entry (``tests/llm`` measures the whole against brute force over all pairs).

``image``: bytes of a binary PGM or PPM, or an 8-bit grey or RGB PNG without interlacing. Images smaller than
``LEAST`` pixels a side are enlarged to that. Null, empty or unreadable images have no corners and match nothing but
their equals; flat images likewise. Of corners with equal responses neither counts where they touch. A null id gets no
group; an id that stands for several images is in the group of each, by row. Other columns, whatever their names, are ignored. Large images
are described in steps of bounded size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import linked_by_hubs, with_both
from tallyforge.llm.shared import sliced, written

SCALES, RATIO, LEAST = 4, 2**0.5, 48
RADIUS = 16
BITS, TABLES, KEY = 256, 8, 48
NEAR = 48  # most differing bits of a descriptor match
INLIERS, TURN, GROWTH, SHIFT = 6, 30.0, 0.5, 4.0
ROUNDS = 3
#: Corners described, or descriptors compared, in one step.
STEP = 512


def _tests() -> tuple[np.ndarray, np.ndarray]:
    """Point pairs of the binary tests (BITS, 2, 2) and the bits that key each table (TABLES, KEY), drawn from fixed seeds."""
    points = np.clip(np.random.default_rng(20).normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 1, RADIUS - 1)
    rng = np.random.default_rng(5)
    return points, np.stack([rng.choice(BITS, KEY, replace=False) for _ in range(TABLES)])


TESTS, KEYED = _tests()


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels of an image as float32, or None where the bytes are no image that is read."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            head = re.match(rb"P[56]\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
            width, height, depth = int(head[1]), int(head[2]), 3 if data[:2] == b"P6" else 1
            pixels = np.frombuffer(data, np.uint8, width * height * depth, head.end()).reshape(height, width, depth)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            pixels = _png(data)
        else:
            return None
        return pixels.astype(np.float32).mean(axis=2) if pixels.size else None
    except (ValueError, TypeError, KeyError, zlib.error, IndexError):
        return None


def _png(data: bytes) -> np.ndarray:
    at, body, header = 8, b"", None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IHDR":
            header = data[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    width, height = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big")
    depth = {0: 1, 2: 3, 4: 2, 6: 4}[header[9]]
    if header[8] != 8 or header[12]:
        raise ValueError("only 8-bit images without interlacing")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * depth + 1)
    out = np.zeros((height, width * depth), np.uint8)
    above = np.zeros(width * depth, np.int32)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int32)
        if kind == 0:
            now = line
        elif kind == 2:
            now = (line + above) & 255
        else:
            now = np.zeros_like(line)
            for x in range(len(line)):
                left = now[x - depth] if x >= depth else 0
                corner = above[x - depth] if x >= depth else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                now[x] = (line[x] + guess) & 255
        out[y], above = now, now
    pixels = out.reshape(height, width, depth)
    return pixels[:, :, : 1 if depth < 3 else 3]


def _blur(x: np.ndarray) -> np.ndarray:
    """Binomial smoothing over five pixels each way."""
    for axis in (0, 1):
        p = np.pad(x, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = x.shape[axis]
        part = lambda k, p=p, axis=axis, n=n: p[k : k + n] if axis == 0 else p[:, k : k + n]
        x = (part(0) + 4 * part(1) + 6 * part(2) + 4 * part(3) + part(4)) / 16
    return x


def _resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    ys = np.clip((np.arange(height) + 0.5) * x.shape[0] / height - 0.5, 0, x.shape[0] - 1)
    xs = np.clip((np.arange(width) + 0.5) * x.shape[1] / width - 0.5, 0, x.shape[1] - 1)
    y0, x0 = np.minimum(ys.astype(int), max(x.shape[0] - 2, 0)), np.minimum(xs.astype(int), max(x.shape[1] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = (ys - y0)[:, None].astype(np.float32), (xs - x0)[None].astype(np.float32)
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Key points (x, y, size, turn in degrees) in pixels of the image, and their descriptors as packed bits (n, BITS / 8)."""
    points, found = [np.empty((0, 4))], [np.empty((0, BITS // 8), np.uint8)]
    if image is None or min(image.shape) < 8:
        return points[0], found[0]
    level, scale = image, 1.0
    if min(image.shape) < LEAST:
        scale = min(image.shape) / LEAST
        level = image = _resized(image, max(LEAST, round(image.shape[0] / scale)), max(LEAST, round(image.shape[1] / scale)))
    offsets = np.arange(-RADIUS, RADIUS + 1)
    oy, ox = np.meshgrid(offsets, offsets, indexing="ij")
    disc = oy * oy + ox * ox <= RADIUS * RADIUS
    oy, ox = oy[disc], ox[disc]
    tx, ty = TESTS[None, :, :, 0], TESTS[None, :, :, 1]
    grown = 1.0
    for _ in range(SCALES):
        smooth = _blur(level)
        gy, gx = np.gradient(smooth)
        a, b, c = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        near = np.pad(response, 1, mode="constant", constant_values=-np.inf)
        around = np.max([near[1 + dy : near.shape[0] - 1 + dy, 1 + dx : near.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], axis=0)
        edge = RADIUS + 2
        inside = np.zeros_like(response, dtype=bool)
        inside[edge:-edge, edge:-edge] = True
        every_y, every_x = np.nonzero((response > around) & inside & (response > 1.0))
        padded = np.pad(smooth, RADIUS, mode="edge")
        for at in range(0, len(every_y), STEP):
            ys, xs = every_y[at : at + STEP], every_x[at : at + STEP]
            patch = padded[ys[:, None] + oy + RADIUS, xs[:, None] + ox + RADIUS]
            turn = np.arctan2((patch * oy).sum(axis=1), (patch * ox).sum(axis=1))
            cos, sin = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
            px = np.clip(np.rint(xs[:, None, None] + tx * cos - ty * sin), 0, smooth.shape[1] - 1).astype(int)
            py = np.clip(np.rint(ys[:, None, None] + tx * sin + ty * cos), 0, smooth.shape[0] - 1).astype(int)
            values = smooth[py, px]
            found.append(np.packbits(values[:, :, 0] < values[:, :, 1], axis=1))
            points.append(np.stack([xs * scale, ys * scale, np.full(len(xs), scale), np.degrees(turn)], axis=1))
        grown *= RATIO
        scale *= RATIO
        if min(image.shape) / grown < LEAST:
            break
        level = _resized(_blur(image), int(image.shape[0] / grown), int(image.shape[1] / grown))
    return np.concatenate(points), np.concatenate(found)


def consensus(first: np.ndarray, second: np.ndarray) -> int:
    """Most matched key points (rows of x, y, size, turn on both sides) that agree on one similarity transform.

    Each match proposes one; corners at one spot, found at several scales, count once.
    """
    if len(first) < 2:
        return len(first)
    turn = np.radians(second[:, 3] - first[:, 3])
    size = second[:, 2] / first[:, 2]
    _, spot = np.unique(np.rint(first[:, :2] / 2), axis=0, return_inverse=True)
    one_spot = np.zeros((len(first), spot.max() + 1), np.float32)
    one_spot[np.arange(len(first)), spot.ravel()] = 1
    best = 0
    for at in range(0, len(first), STEP):
        k = slice(at, at + STEP)
        c, s = (np.cos(turn[k]) * size[k])[:, None], (np.sin(turn[k]) * size[k])[:, None]
        dx, dy = first[None, :, 0] - first[k, None, 0], first[None, :, 1] - first[k, None, 1]
        away = np.hypot(c * dx - s * dy + second[k, None, 0] - second[None, :, 0], s * dx + c * dy + second[k, None, 1] - second[None, :, 1])
        angle = np.abs((np.degrees(turn[None, :] - turn[k, None]) + 180) % 360 - 180)
        agree = (away <= SHIFT + 0.05 * np.hypot(dx, dy)) & (angle <= TURN) & (np.abs(np.log2(size[None, :] / size[k, None])) <= GROWTH)
        best = max(best, int(((agree.astype(np.float32) @ one_spot) > 0).sum(axis=1).max()))
    return best


def _matches(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of mutually nearest packed descriptors that differ in at most NEAR bits; of ties the first is nearest."""
    x, y = np.ascontiguousarray(x).view(np.uint64), np.ascontiguousarray(y).view(np.uint64)
    to, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    back, back_least = np.zeros(len(y), np.int64), np.full(len(y), BITS + 1)
    for at in range(0, len(x), STEP):
        away = sum(np.bitwise_count(x[at : at + STEP, None, w] ^ y[None, :, w]).astype(np.int16) for w in range(x.shape[1]))
        to[at : at + STEP], least[at : at + STEP] = away.argmin(axis=1), away.min(axis=1)
        here = away.min(axis=0)
        better = here < back_least
        back[better], back_least[better] = away.argmin(axis=0)[better] + at, here[better]
    rows = np.flatnonzero((back[to] == np.arange(len(x))) & (least <= NEAR))
    return rows, to[rows]


def agreement(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Inliers of two described images: mutual nearest descriptors within NEAR bits, then consensus."""
    if not len(a[0]) or not len(b[0]):
        return 0
    rows, other = _matches(a[1], b[1])
    return consensus(a[0][rows], b[0][other]) if len(rows) >= INLIERS else len(rows)


def table_keys(packed: np.ndarray) -> np.ndarray:
    """The distinct entries of an image's descriptors: the table and its KEY bits as one integer."""
    bits = np.unpackbits(packed, axis=1)
    keys = []
    for table, own in enumerate(KEYED):
        part = np.zeros((len(bits), 8), np.uint8)
        part[:, 2:] = np.packbits(bits[:, own], axis=1)
        keys.append(part.view(">u8").ravel().astype(np.int64) | table << KEY)
    return np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)


def described(images: DataFrame) -> DataFrame:
    """id, digest, points and bits (packed) of every row of ``images`` (id, image)."""
    kind = images.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "image"):
            digests, points, bits = [], [], []
            for data in batch.column(1).to_pylist():
                image = decode(data)
                p, d = describe(image)
                digests.append(hashlib.blake2b(image.tobytes() + str(image.shape).encode() if image is not None else b"?" + (data or b""), digest_size=16).digest())
                points.append(p.astype("<f4").tobytes())
                bits.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(points, pa.binary()), pa.array(bits, pa.binary())], names=["id", "digest", "points", "bits"])

    return images.select("id", "image").mapInArrow(run, f"id {kind}, digest binary, points binary, bits binary")


def _shared_entries(classes: DataFrame) -> DataFrame:
    """key, node and hub (the least node of the entry) of the table entries that two nodes or more share.

    Entries are sorted by key, so that one pass tells those that occur twice without holding an entry's nodes.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "bits", 1 << 18):
            own = [table_keys(np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)) for bits in batch.column(1).to_pylist()]
            nodes = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if own else np.empty(0, np.int64)), pa.array(nodes)], names=["key", "node"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub, out = None, None, False  # of the run that the last batch ended in: key, least node, and whether that is out
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            fresh = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
            hubs = np.where(begin >= 0, nodes[begin], nodes[0] if hub is None else hub)
            keep = ~fresh  # all but the least node; that one is added once
            more = np.concatenate([keep[1:], [False]]) & fresh
            late = not fresh[0] and not out  # the least node was the last row of the batch before
            rows = np.flatnonzero(keep | more)
            names, places, who = keys[rows], hubs[rows], nodes[rows]
            if late:
                names, places, who = np.append(names, last), np.append(places, hub), np.append(who, hub)
            last, hub, out = keys[-1], hubs[-1], not fresh[-1]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(who), pa.array(places)], names=["key", "node", "hub"])

    found = classes.select("node", "bits").mapInArrow(entries, "key long, node long")
    return found.repartition("key").sortWithinPartitions("key", "node").mapInArrow(repeated, "key long, node long, hub long")


def _confirmed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose images agree geometrically."""
    values = classes.select("node", F.struct("points", "bits").alias("v"))

    def unpacked(column: pa.Array) -> list:
        points, bits = column.field("points").to_pylist(), column.field("bits").to_pylist()
        return [(np.frombuffer(p, "<f4").reshape(-1, 4).astype(float), np.frombuffer(d, np.uint8).reshape(-1, BITS // 8)) for p, d in zip(points, bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                kept = [k for k, (one, two) in enumerate(zip(unpacked(batch.column(2)), unpacked(batch.column(3)))) if agreement(one, two) >= INLIERS]
                yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return with_both(pairs, values, "v").mapInArrow(run, "a long, b long")


def copies(images: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """id, n_corners, class_id (smallest id of equal pixels) and group_id (smallest id of linked classes) of every row."""
    found = written(described(images))
    classes = found.filter("id is not null").groupBy("digest").agg(F.min("id").alias("least"), F.first("points").alias("points"), F.first("bits").alias("bits"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))  # written, so the numbers stay
    roots = linked_by_hubs(written(_shared_entries(classes.filter(F.length("bits") > 0))), lambda pairs: _confirmed(pairs, classes), rounds)
    of_class = written(classes.select("digest", "node", "least").join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")))
    of_class = of_class.join(of_class.groupBy("root").agg(F.min("least").alias("group_id")), "root").select("digest", F.col("least").alias("class_id"), "group_id")
    whose = F.col("id").isNotNull()
    placed = found.select("id", "digest", (F.length("points") / 16).cast("int").alias("n_corners")).join(of_class, "digest", "left")
    return placed.select("id", "n_corners", *[F.when(whose, F.col(c)).alias(c) for c in ("class_id", "group_id")])


_TEXTURES: dict[tuple[int, int], np.ndarray] = {}


def _textures(count: int, side: int) -> np.ndarray:
    """Fixed smooth textures, one for each number of a vector: (count, side * side)."""
    if (count, side) not in _TEXTURES:
        rng = np.random.default_rng(count)
        out = np.empty((count, side * side), np.float32)
        for k in range(count):
            x = rng.normal(size=(side, side))
            for _ in range(6):
                x = _blur(x)
            out[k] = (x / x.std()).ravel()
        _TEXTURES.clear()
        _TEXTURES[count, side] = out
    return _TEXTURES[count, side]


def rendered(vectors: DataFrame, side: int = 80) -> DataFrame:
    """id and image (PGM) of every row of (id, embedding): the sum of fixed smooth textures, weighted by the vector.

    Vectors that point nearly the same way give nearly the same image, others unlike ones. Null numbers count as
    zero; null or empty vectors give a null image.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = []
                for v in batch.column(1).to_pylist():
                    if not v:
                        out.append(None)
                        continue
                    x = np.nan_to_num(np.array([y or 0.0 for y in v]), posinf=0.0, neginf=0.0)
                    x = x / (np.linalg.norm(x) or 1.0)
                    grey = np.clip(np.rint(127.5 + 50 * (x @ _textures(len(v), side))), 0, 255).astype(np.uint8)
                    out.append(b"P5 %d %d 255\n" % (side, side) + grey.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "image"])

    return vectors.select("id", "embedding").mapInArrow(run, f"id {kind}, image binary")


def media_query(embeddings: DataFrame) -> DataFrame:
    """The tables hold no images, so each embedding is rendered as one; one row per vector."""
    found = copies(rendered(embeddings.select(F.col("vec_id").alias("id"), "embedding")))
    return found.select(F.col("id").alias("vec_id"), "n_corners", "class_id", "group_id")
