"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has, for every depth from none to ``DEPTH`` preceding bytes, a node
whose Krichevsky-Trofimov estimate is learnt from the training texts. The tree weighting mixes the estimates of all
depths: a node's block probability is half its own estimate and half the product of its children's, which fixes how
much of a prediction comes from each depth. Contexts are whole bytes and end at the beginning of their text, before
which END is read; END, which no UTF-8 text holds, also follows each text, so that lengths carry probability.

The tree is sparse and lies in distributed tables that grow with the corpus. A cell is a context of ``DEPTH`` bytes
and the byte after it; cells of all texts are counted in the training texts (held-out ones may count nothing). Cells
under one context of ``SPLIT`` bytes form a group: its subtree is worked out in memory, the levels above are a few
aggregations, and what they give comes back to each group. A node that training never saw predicts as its parent
does. The result is a table of the log probability of every cell that any text holds.

The base score is an add-one unigram score over words, which are told by 64-bit hashes (any two of a hundred million
words collide with a chance of 1 in 3,700). Both tables grow without bound, so only their most frequent rows, at most
``HEAD`` words and ``CELLS`` cells, are broadcast; the other words and cells of each document are joined with the
tables, and nothing is dropped.

Null and empty texts hold the end token and END alone. Repeated rows count as often as they occur, ties do not matter,
and other columns, whatever their names, are ignored. Texts are read in slices of bounded size, long ones whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import held_out, sliced, written

PARTS, HELD = 7, 2
#: Preceding bytes of the longest context (at most 6), and of the contexts whose subtrees are worked out in memory.
DEPTH, SPLIT = 5, 3
END = 0xFF
END_TOKEN = b"\n"  # no word holds white space
#: Words and cells that are broadcast at most.
HEAD, CELLS = 1 << 19, 1 << 20
#: Distinct cells or words that a counting task holds before they go out, and cells of one step over subtrees.
HELD_KEYS, STEP = 1_500_000, 60_000


def joined_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, each followed by END, and where each text begins."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(x) + 1 for x in raw], dtype=np.int64)
    return np.frombuffer(bytes([END]).join(raw) + bytes([END]), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of the texts, lower-cased, each text followed by the end token, and where it begins."""
    tokens: list[bytes] = []
    starts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        starts[k] = len(tokens)
        if t:
            tokens += t.encode().lower().split()
        tokens.append(END_TOKEN)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)).view(np.int64), starts


def cells(data: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The cell of every position: the preceding bytes, nearest first, then the byte itself, as one integer."""
    out = data.astype(np.int64)
    for d in range(1, depth + 1):
        out[d:] |= data[:-d].astype(np.int64) << (8 * (depth + 1 - d))
    for offset in range(depth):  # what comes before a text's beginning reads as END
        at = starts + offset
        out[at[at < len(out)]] |= ((1 << (8 * (depth - offset))) - 1) << 8
    return out


def counted(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the sums of their weights."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x of at least one half."""
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift -= np.where(small, np.log(x), 0.0)
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a run with these counts."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return np.where(a + b > 0, _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - math.log(math.pi) - _log_gamma(a + b + 1), 0.0)


def _sql_log_gamma(x: Column) -> Column:
    rising = x
    for k in range(1, 8):
        rising = rising * (x + F.lit(float(k)))
    y = x + F.lit(8.0)
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(rising)


def _sql_log_block() -> Column:
    a, b = F.col("n0").cast("double"), F.col("n1").cast("double")
    value = _sql_log_gamma(a + 0.5) + _sql_log_gamma(b + 0.5) - F.lit(math.log(math.pi)) - _sql_log_gamma(a + b + 1.0)
    return F.when(a + b > 0, value).otherwise(0.0)


class Subtrees:
    """The subtrees of some contexts of ``split`` bytes, from their cells (sorted) and counts.

    A node is a context of some depth and the first bits of the next byte: its number is the context, then a byte
    with a one before those bits. ``levels`` go from the deepest up to ``split``; each has the nodes' numbers, the
    counts of zeros and ones, the logarithms of their own and of their weighted block probability, and for each node
    its place in the level above.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, split: int):
        symbol, context = keys & 255, keys >> 8
        shifts = np.arange(8)[:, None]
        self.bit = (symbol >> (7 - shifts)) & 1
        ids = ((context << 8) | (1 << shifts) | (symbol >> (8 - shifts))).ravel()
        weight = np.broadcast_to(counts, self.bit.shape).ravel().astype(np.float64)
        ids, self.node = np.unique(ids, return_inverse=True)
        ones = np.bincount(self.node, weights=weight * self.bit.ravel(), minlength=len(ids))
        zeros = np.bincount(self.node, weights=weight, minlength=len(ids)) - ones
        own = log_block(zeros, ones)
        self.levels = [(ids, zeros, ones, own, own)]
        self.above = []
        for _ in range(depth - split):
            ids, up = np.unique((ids >> 16 << 8) | (ids & 255), return_inverse=True)
            below = np.bincount(up, weights=self.levels[-1][4], minlength=len(ids))
            zeros = np.bincount(up, weights=zeros, minlength=len(ids))
            ones = np.bincount(up, weights=ones, minlength=len(ids))
            own = log_block(zeros, ones)
            self.levels.append((ids, zeros, ones, own, np.logaddexp(own, below) - math.log(2)))
            self.above.append(up)

    def log10(self, mixed: np.ndarray, rest: np.ndarray, estimate: np.ndarray) -> np.ndarray:
        """log10 probability of every cell, from what comes down to the nodes of the top level: the part of the
        prediction mixed so far, the weight that is left, and the estimate of the deepest node that training saw."""
        for k in range(len(self.levels) - 1, -1, -1):
            _, zeros, ones, own, weighted = self.levels[k]
            seen = zeros + ones > 0
            here = (ones + 0.5) / (zeros + ones + 1)
            share = np.where(seen, np.exp(own - weighted - math.log(2)) if k else 1.0, 0.0)
            mixed, rest, estimate = mixed + rest * share * here, rest * (1 - share), np.where(seen, here, estimate)
            if k:
                up = self.above[k - 1]
                mixed, rest, estimate = mixed[up], rest[up], estimate[up]
        one = (mixed + rest * estimate)[self.node].reshape(self.bit.shape)
        return np.log10(np.where(self.bit == 1, one, 1 - one)).sum(axis=0)


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def _groups(cells_table: DataFrame, depth: int, split: int) -> DataFrame:
    """One row per context of ``split`` bytes: its cells and counts, and the nodes of the top of its subtree."""
    low = 8 * (depth - split + 1)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ids, zeros, ones, _, weighted = Subtrees(keys, counts, depth, split).levels[-1]
        groups, edges = np.unique(keys >> low, return_index=True)
        at, nodes = np.append(edges, len(keys)), np.append(np.searchsorted(ids >> 8, groups), len(ids))
        columns = [pa.array(groups), _lists(keys, at), _lists(counts, at), _lists(ids & 255, nodes), _lists(zeros, nodes), _lists(ones, nodes), _lists(weighted, nodes)]
        return pa.RecordBatch.from_arrays(columns, names=["context", "cells", "counts", "heap", "n0", "n1", "lw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys, counts = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([counts, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(keys >> low, keys[-1] >> low)) if len(keys) >= STEP else 0  # whole groups
            if cut:
                yield rows(keys[:cut], counts[:cut])
                keys, counts = keys[cut:], counts[cut:]
        if len(keys):
            yield rows(keys, counts)

    dealt = cells_table.select("cell", "c").repartition(F.shiftright("cell", low)).sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "context long, cells array<long>, counts array<long>, heap array<long>, n0 array<double>, n1 array<double>, lw array<double>")


def tree(cells_table: DataFrame, depth: int = DEPTH, split: int = SPLIT) -> DataFrame:
    """cell, c and lp (log10 probability) of every row of ``cells_table`` (cell, c), which names each cell once."""
    groups = written(_groups(cells_table, depth, split))
    zipped = F.explode(F.arrays_zip("heap", "n0", "n1", "lw")).alias("x")
    levels = [groups.select("context", zipped).select("context", "x.heap", "x.n0", "x.n1", "x.lw")]
    half = F.lit(math.log(2))
    for _ in range(split):
        up = levels[0].groupBy(F.shiftright("context", 8).alias("context"), "heap").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below")).withColumn("own", _sql_log_block())
        top = F.greatest("own", "below")
        levels.insert(0, written(up.withColumn("lw", top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("below") - top)) - half)))
    state = None
    for k in range(split):
        here = levels[k].withColumn("up", F.shiftright("context", 8))
        if state is None:
            here = here.withColumns({"mixed": F.lit(0.0), "rest": F.lit(1.0), "estimate": F.lit(0.5)})
        else:
            here = here.join(state.withColumnRenamed("context", "up"), ["up", "heap"])
        n = F.col("n0") + F.col("n1")
        share = F.when(n > 0, F.exp(F.col("own") - F.col("lw") - half)).otherwise(0.0)
        guess = (F.col("n1") + 0.5) / (n + 1)
        state = here.select(
            "context", "heap", (F.col("mixed") + F.col("rest") * share * guess).alias("mixed"), (F.col("rest") * (1 - share)).alias("rest"), F.when(n > 0, guess).otherwise(F.col("estimate")).alias("estimate")
        )
    nodes = levels[-1].select("context", "heap", F.shiftright("context", 8).alias("up"))
    nodes = nodes.join(state.withColumnRenamed("context", "up"), ["up", "heap"]) if state is not None else nodes.withColumns({"mixed": F.lit(0.0), "rest": F.lit(1.0), "estimate": F.lit(0.5)})
    sent = nodes.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("heap", "mixed", "rest", "estimate"))).alias("state"))  # 255 nodes at most
    low = 8 * (depth - split + 1)

    def rows(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        flat = lambda k: np.concatenate([p.column(k).flatten().to_numpy(zero_copy_only=False) for p in parts])
        keys, counts = flat(0), flat(1)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        names = np.concatenate([np.repeat(p.column(2).to_numpy(), np.diff(p.column(3).offsets.to_numpy())) for p in parts])
        state = [np.concatenate([p.column(3).flatten().field(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(4)]
        place = np.argsort((names << 8) | state[0])
        found = Subtrees(keys, counts, depth, split).log10(*(x[place] for x in state[1:]))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), pa.array(found)], names=["cell", "c", "lp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in sliced(batches, "cells", 8 * STEP):
            parts.append(batch)
            size += len(batch.column(0).flatten())
            if size >= STEP:
                yield rows(parts)
                parts, size = [], 0
        if parts:
            yield rows(parts)

    return groups.select("context", "cells", "counts").join(sent, "context").select("cells", "counts", "context", "state").mapInArrow(run, "cell long, c long, lp double")


def _counts(docs: DataFrame, depth: int) -> DataFrame:
    """Training counts c of words (word: true, key) and of the cells of all texts (word: false, key), written."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def out(word: bool, found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found[0]), 50_000):
            keys, counts = (x[at : at + 50_000] for x in found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), word)), pa.array(keys), pa.array(counts)], names=["word", "key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        for batch in sliced(batches, "text"):
            texts, apart = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            training = [t for t, x in zip(texts, apart) if not x]
            if training:
                held[True].append(np.unique(word_hashes(training)[0], return_counts=True))
            for some, weight in ((training, 1), ([t for t, x in zip(texts, apart) if x], 0)):
                if some:
                    keys, n = np.unique(cells(*joined_texts(some), depth), return_counts=True)
                    held[False].append((keys, n * weight))
            for word, parts in held.items():
                if sum(len(x[0]) for x in parts[1:]) > HELD_KEYS:
                    parts[:] = [merged(parts)]
                    if len(parts[0][0]) > HELD_KEYS:
                        yield from out(word, parts.pop())
        for word, parts in held.items():
            if parts:
                yield from out(word, merged(parts))

    marked = docs.select("text", held_out(F.col("doc_id"), PARTS, HELD).alias("apart"))
    return written(marked.mapInArrow(run, "word boolean, key long, c long").groupBy("word", "key").agg(F.sum("c").alias("c")))


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of the highest counts, all with at least the same one: no more than ``most``, whatever the table holds."""
    level = F.when(F.col("c") < 1024, F.col("c")).otherwise(1000 + F.floor(F.log2("c") * 4))
    levels = table.filter("c > 0").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("least")).collect()  # 1,300 at most
    least, many = None, 0
    for level in levels:
        many += level["n"]
        if many > most:
            break
        least = level["least"]
    return table.filter(F.col("c") >= least) if least is not None else table.limit(0)


#: Odd multipliers that give a key its places in a table.
PLACES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _slot(keys: np.ndarray, bits: int, place: np.uint64) -> np.ndarray:
    return ((keys.view(np.uint64) * place) >> np.uint64(64 - bits)).astype(np.int64)


def placed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values and whether there is one, by place; earlier keys are placed first. The few that find all their
    places taken are left out, and go by the join instead."""
    bits = max(1, (2 * len(keys) - 1).bit_length())
    at_keys, at_values, used = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, values.dtype), np.zeros(1 << bits, bool)
    left = np.arange(len(keys))
    for place in PLACES:
        slot = _slot(keys[left], bits, place)
        free = np.flatnonzero(~used[slot])
        where, first = np.unique(slot[free], return_index=True)
        rows = left[free[first]]
        at_keys[where], at_values[where], used[where] = keys[rows], values[rows], True
        left = np.delete(left, free[first])
    return at_keys, at_values, used


def looked_up(keys: np.ndarray, starts: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each text (from ``starts``): the sum of the values that the table has, how many keys it has not, and which."""
    at_keys, at_values, used = table
    found, rest = np.zeros(len(keys)), None
    for place in PLACES:
        asked = keys if rest is None else keys[rest]
        slot = _slot(asked, len(used).bit_length() - 1, place)
        hit = (at_keys[slot] == asked) & used[slot]
        if rest is None:
            found, rest = np.where(hit, at_values[slot], 0).astype(np.float64), np.flatnonzero(~hit)
        else:
            found[rest[hit]] = at_values[slot[hit]]
            rest = rest[~hit]
    whose = np.searchsorted(starts, rest, side="right") - 1
    order = np.lexsort((keys[rest], whose))
    whose, missing = whose[order], keys[rest][order]
    fresh = np.flatnonzero(np.concatenate([[True], (whose[1:] != whose[:-1]) | (missing[1:] != missing[:-1])])) if len(rest) else np.empty(0, np.int64)
    times = np.diff(np.append(fresh, len(rest))).astype(np.int64)
    edges = np.searchsorted(whose[fresh], np.arange(len(starts) + 1)).astype(np.int32)
    lost = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(missing[fresh]), pa.array(times)], names=["key", "k"]))
    return np.add.reduceat(found, starts), np.bincount(whose, minlength=len(starts)), lost


def score(docs: DataFrame, head: int = HEAD, cells_sent: int = CELLS, depth: int = DEPTH, split: int = SPLIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row."""
    spark = docs.sparkSession
    counts = _counts(docs, depth)
    n, v = counts.filter("word").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = math.log10(n + v + 1)
    words = counts.filter("word").select("key", "c", (F.log10(F.col("c") + F.lit(1.0)) - F.lit(below)).alias("lp"))
    table = written(tree(counts.filter("not word").select(F.col("key").alias("cell"), "c"), depth, split)).withColumnRenamed("cell", "key")

    def sent(values: DataFrame, most: int, kind: type) -> tuple:
        rows = most_frequent(values, most).select("key", "lp", "c").toArrow()
        order = np.argsort(-rows["c"].to_numpy(), kind="stable")
        return placed(rows["key"].to_numpy()[order], rows["lp"].to_numpy()[order].astype(kind))

    tables = spark.sparkContext.broadcast((sent(words, head, np.float64), sent(table, cells_sent, np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_cells = tables.value
        for batch in sliced(batches, "text"):
            texts = batch.column(1).to_pylist()
            tokens, at = word_hashes(texts)
            base, unknown, rare = looked_up(tokens, at, of_words)
            n_tokens = np.diff(np.append(at, len(tokens)))
            data, starts = joined_texts(texts)
            model, _, far = looked_up(cells(data, starts, depth), starts, of_cells)
            columns = [batch.column(0), pa.array(n_tokens), pa.array(n_tokens - unknown), pa.array(base), pa.array(model), pa.array(np.diff(np.append(starts, len(data))) - 1), rare, far]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes", "words", "cells"])

    kind, lists = docs.schema["doc_id"].dataType.simpleString(), "array<struct<key:long,k:long>>"
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, n_bytes long, words {lists}, cells {lists}")
    # Equal ids may stand for several rows, so what is rare is joined by row.
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))
    asked = [scored.select("row", F.lit(word).alias("word"), F.explode(c).alias("t")).select("row", "word", "t.key", "t.k") for word, c in ((True, "words"), (False, "cells"))]
    known = words.withColumn("word", F.lit(True)).unionByName(table.withColumn("word", F.lit(False)))
    more = asked[0].unionByName(asked[1]).join(known, ["word", "key"], "left")
    exact = (F.col("k") * F.coalesce("lp", F.lit(-below))).cast("decimal(38,18)")  # sums that do not depend on the order of rows
    more = more.groupBy("row").agg(F.sum(F.when(F.col("word"), exact)).alias("more_base"), F.sum(F.when(F.col("word") & F.col("c").isNotNull(), F.col("k"))).alias("more_known"), F.sum(F.when(~F.col("word"), exact)).alias("more_model"))
    whole = scored.drop("words", "cells").join(more, "row", "left")
    plus = lambda c, m, zero: (F.col(c) + F.coalesce(F.col(m), F.lit(zero))).alias(c)
    whole = whole.withColumns({m: F.col(m).cast("double") for m in ("more_base", "more_model")})
    whole = whole.select("doc_id", "n_tokens", "n_bytes", plus("base_score", "more_base", 0.0), plus("n_known", "more_known", 0), plus("score", "more_model", 0.0))
    return whole.select(
        "doc_id",
        held_out(F.col("doc_id"), PARTS, HELD).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(n)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "n_bytes",
        (-F.col("score") / F.lit(math.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def score_query(docs: DataFrame) -> DataFrame:
    return score(docs)
