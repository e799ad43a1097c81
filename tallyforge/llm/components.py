"""Connected components of a link table, groups linked by verified candidates, and joins of pairs with large values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import sliced, written


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) of every node of ``links`` (a, b), written.

    Each pass hangs a node's larger neighbours, then its smaller ones, on the smallest; a logarithmic number of
    passes reaches the fixpoint. Each pass is written, so a lost executor costs one pass at most.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    for _ in range(most):
        # Stars: every node hangs on one other, and none on a node that hangs itself.
        sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("int").alias("hangs")))
        uneven = sides.groupBy("node").agg(F.count("*").alias("n"), F.count("hangs").alias("hangs")).filter("hangs > 0 and n > 1")
        if uneven.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most} passes")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def with_both(pairs: DataFrame, values: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """``pairs`` (a, b) with the values of both, as ``va`` and ``vb``, those of one b near each other.

    A hub meets many nodes: its pairs are dealt into parts of about ``most``, and its value is repeated once per part.
    """
    first, second = values.select(F.col("node").alias("a"), F.col(column).alias("va")), values.select(F.col("node").alias("b"), F.col(column).alias("vb"))
    hot = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")).filter("parts > 1")
    if hot.isEmpty():
        return pairs.join(first, "a").join(second, "b").select("a", "b", "va", "vb")
    hot = written(hot)  # at most one row for each ``most`` pairs
    dealt = pairs.join(first, "a").join(hot, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int"))
    second = second.join(hot, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(second, ["b", "part"]).select("a", "b", "va", "vb")


def _paired(rows: DataFrame, near) -> DataFrame:
    """Distinct (a, b) with a > b of rows (x, y, nx, ny) that ``near`` allows."""
    return rows.filter((F.col("x") != F.col("y")) & near).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def pairs_in_buckets(placed: DataFrame, alike: Callable, block: int = 512) -> DataFrame:
    """Pairs (a, b) with a > b of nodes of different roots that share a bucket and are ``alike``, each pair once.

    ``placed``: key, node, root, n, s and keys (a node's keys by band) of the nodes of each bucket. A bucket's nodes
    are dealt into blocks of about ``block``, and every two blocks meet in a group of their own, so neither a task nor
    a group grows with the bucket. ``alike`` (of sizes and sketches of both sides) gives a matrix.
    """
    parts = placed.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    dealt = placed.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"), (F.col("own") >= F.col("other")).alias("second"), "node", "root", "n", "s", "keys")

    def wide(column) -> np.ndarray:
        flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy()
        return flat.reshape(len(column), -1)

    def compared(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        first, second = (np.flatnonzero(group[c].to_numpy()) for c in ("first", "second"))
        node, root, n, key = (group[c].to_numpy() for c in ("node", "root", "n", "key"))
        s, keys = wide(group["s"]), wide(group["keys"])
        good = alike(n[first], s[first], n[second], s[second]) & (root[first][:, None] != root[second][None, :])
        x, y = np.nonzero(good)
        x, y = first[x], second[y]
        shared = keys[x] == keys[y]
        lead = keys[x, shared.argmax(axis=1)] == key[x]  # this bucket is the first that they share
        keep = lead & (node[x] > node[y]) if group["i"][0].as_py() == group["j"][0].as_py() else lead
        x, y = x[keep], y[keep]
        return np.maximum(node[x], node[y]), np.minimum(node[x], node[y])

    def whole_groups(held: pa.Table, end: bool) -> tuple[list, pa.Table]:
        """The pairs of the groups of ``held``, and the rows of the last group, which may go on."""
        key, i, j = (held[c].to_numpy() for c in ("key", "i", "j"))
        edges = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        edges = [0, *edges.tolist(), len(key)]
        last = len(edges) - (1 if end else 2)
        found = [compared(held.slice(edges[g], edges[g + 1] - edges[g])) for g in range(last) if edges[g + 1] - edges[g] > 1]
        return found, held.slice(edges[last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                now = pa.Table.from_batches([batch.slice(at, 4096)])
                found, held = whole_groups(now if held is None else pa.concat_tables([held, now]), False)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])
        if held is not None and held.num_rows:
            found, _ = whole_groups(held, True)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def linked_groups(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], count: int, rounds: int, few: float, near, keys: DataFrame, alike: Callable
) -> tuple[DataFrame, DataFrame]:
    """node and root of the nodes that candidate buckets and ``verify`` link, and the links themselves.

    ``members``: written rows (key, node, n) of buckets with two nodes or more; ``verify`` turns pairs (a, b) into
    those of them that are links; ``near`` is a condition on (nx, ny) that every link meets, and ``alike`` the same of
    many pairs at once, as in ``pairs_in_buckets``; ``keys``: node and keys, a node's keys by band.

    No bucket is expanded into pairs at first. Its nodes are held against one hub, links are merged, and only nodes
    that are not known to be in one component are held against the next hub. Once the pairs left across
    components are at most ``few`` times ``count``, or after ``rounds`` hubs, all of them are verified: no link
    between different components is lost, whatever the buckets hold.
    """
    near = F.lit(True) if near is None else near
    first = members.groupBy("key").agg(F.min_by(F.struct("node", "n"), "node").alias("h"))
    pairs = written(_paired(members.join(first, "key").select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("h.node").alias("y"), F.col("h.n").alias("ny")), near))
    checked, links = pairs, written(verify(pairs))
    # Until there are components, a node's smallest linked hub stands for its component.
    roots, settled = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), False
    for turn in range(rounds + 1):
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        each = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
        across_of = each.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.count("*").alias("roots")).filter("roots > 1")
        across_of = written(across_of.select("key", ((F.col("m") * F.col("m") - F.col("squares")) / 2).alias("across")))
        left = across_of.agg(F.coalesce(F.sum("across"), F.lit(0.0))).first()[0]
        if not left:
            break
        if left > few * count and not settled and turn < rounds:
            roots, settled = components(links), True
            continue
        last = left <= few * count or turn == rounds
        placed = placed.join(across_of.select("key"), "key")
        if last:
            placed = placed.join(keys, "node").select("key", "node", "root", F.col("n.n").alias("n"), F.col("n.s").alias("s"), "keys")
            across = pairs_in_buckets(written(placed), alike)
        else:
            hubs = placed.groupBy("key").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64(F.lit(turn), "node")).alias("h"))
            across = placed.join(hubs, "key").filter("root != h.root").select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("h.node").alias("y"), F.col("h.n").alias("ny"))
        pairs = written((across if last else _paired(across, near)).join(checked, ["a", "b"], "left_anti"))
        more = written(verify(pairs))
        checked, links = checked.unionByName(pairs), links.unionByName(more)
        if last:
            return components(links), links
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return (roots if settled else components(links)), links


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The keys of ``rows`` (key, node) whose nodes are of several components.

    Nodes learn their component one row a node, with all their keys, and only a batch's distinct keys leave it.
    """
    each = rows.groupBy("node").agg(F.collect_list("key").alias("keys")).join(roots, "node", "left").select("keys", F.coalesce("root", "node").alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "keys", 8 << 20):
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            keys, root = lists.flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), lists.value_lengths().to_numpy())
            order = np.argsort(keys, kind="stable")
            own, begin = np.unique(keys[order], return_index=True)
            ends = [f.reduceat(root[order], begin) for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, ends)], names=["key", "low", "high"])

    found = each.mapInArrow(run, "key long, low long, high long")
    return found.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high").select("key")


def linked_by_hubs(members: DataFrame, verify: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """node and root of the nodes that shared buckets and ``verify`` link.

    ``members``: written rows (key, node, hub) of the buckets with two nodes or more; hub is a bucket's least node. In
    each round a node is held against one hub only, so a round's pairs are no more than the nodes. Then the buckets
    whose nodes are all of one component go, and the next round takes the least hub of the rest by a fresh order. All
    pairs across components that are left after ``rounds`` rounds are verified: no candidate link is lost.
    """
    checked = written(members.filter("node != hub").groupBy("node").agg(F.min("hub").alias("hub")).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")))
    links = written(verify(checked))
    left = members.select("key", "node")
    for turn in range(1, rounds + 1):
        roots = components(links)
        placed = left.join(_mixed(left, roots), "key").join(roots, "node", "left")
        placed = written(placed.select("key", "node", F.coalesce("root", "node").alias("root")))
        if placed.isEmpty():
            return roots
        if turn == rounds:
            break
        order = F.xxhash64(F.lit(turn), "node")
        hubs = placed.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("hub"), F.col("root").alias("hub_root"))).alias("h")).select("key", "h.*")
        pairs = placed.join(hubs, "key").filter("root != hub_root").select("o", F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"), "node")
        pairs = pairs.join(checked, ["a", "b"], "left_anti").groupBy("node").agg(F.min(F.struct("o", "a", "b")).alias("p"))
        pairs = written(pairs.select("p.a", "p.b").distinct())
        checked, links, left = checked.unionByName(pairs), links.unionByName(written(verify(pairs))), placed.select("key", "node")
    x = placed.select("key", F.col("node").alias("x"), F.col("root").alias("rx"))
    y = placed.select("key", F.col("node").alias("y"), F.col("root").alias("ry"))
    pairs = x.join(y, "key").filter("x > y and rx != ry").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    return components(links.unionByName(written(verify(written(pairs.join(checked, ["a", "b"], "left_anti"))))))
