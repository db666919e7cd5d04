"""Connected components by re-hanging neighbours on the smallest one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.shared import written

#: Links that a task looks at together.
BLOCK = 1_000_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, root), root the smallest node reachable.

    Alternates "large star" and "small star" steps: every node's neighbours are re-hung on the smallest one, until all
    components are stars. A step is an aggregation (combined before the shuffle, so a node with very many links costs
    little) and an equi-join that adaptive execution may split. Each round is written to the shared folder; the number of
    rounds grows with the logarithm of the longest path, and one aggregation tells after each whether all are stars.
    Nodes without links do not appear. Loops and repeated links are allowed, null ends are dropped.
    """

    def hung(links: DataFrame, small: bool) -> DataFrame:
        # small star: from each node to its smaller neighbours; large star: over all neighbours, re-hanging the larger.
        both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a")
        if small:
            return out.select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b"))
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def tidy(links: DataFrame) -> DataFrame:
        return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def settled(links: DataFrame) -> bool:
        """Whether every node hangs on one root, which hangs on none."""
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("under"))
        ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("under")))
        loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("under").alias("under")).where("up + under > 1")
        return loose.count() == 0

    now = written(tidy(edges.select("a", "b").where("a is not null and b is not null")), "links")
    rounds = 0
    while not settled(now):
        if rounds == max_rounds:
            raise RuntimeError(f"components: not settled in {max_rounds} rounds")
        now = written(tidy(hung(tidy(hung(now, False)), True)), "links")
        rounds += 1
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def hung_on_least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a few links, and the least that each is joined to: roots go under smaller ones they meet, then all nodes
    under their root, in a number of rounds that grows with the logarithm of the nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            return nodes, nodes[root]
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(up := root[root], root):
            root = up


def by_blocks(edges: DataFrame, joined: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str, block: int) -> DataFrame:
    """What joined makes of blocks of links (a, b; a <= b) that are neighbours by key."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= block:
                yield joined(*(np.concatenate([r.column(k).to_numpy() for r in held]) for k in (0, 1)))
                held, n = [], 0
        if n:
            yield joined(*(np.concatenate([r.column(k).to_numpy() for r in held]) for k in (0, 1)))

    links = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return links.repartitionByRange("a", "b").mapInArrow(pieces, schema)


def components_by_pieces(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """As ``components``, for nodes that are bigints: tasks first join what hangs together within blocks of links that are neighbours
    by key, then ``components`` joins these pieces where a node is in several. What is left for its rounds are the pieces, not
    the links: few, where links are between near keys, and no more than nodes at worst."""

    def joined(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, least = hung_on_least(a, b)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "piece"])

    found = by_blocks(edges, joined, "node bigint, piece bigint", block)
    # a node is in no more pieces than there are blocks
    of = written(found.groupBy("node").agg(F.collect_set("piece").alias("pieces")).withColumn("piece", F.array_min("pieces")), "pieces")
    root = components(of.where("size(pieces) > 1").select(F.explode("pieces").alias("a"), F.col("piece").alias("b")))
    return of.select("node", "piece").join(root.withColumnRenamed("node", "piece"), "piece", "left").select("node", F.coalesce("root", "piece").alias("root"))


def sides_on_least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``hung_on_least``, with the side of each node (0: that of the least) and whether a ring of odd length is in its piece.

    Each node stands for two, one for either side, and a link joins those of different sides.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, n = at[: len(a)], at[len(a) :], len(nodes)
    twice, root = hung_on_least(np.concatenate([u, u + n]), np.concatenate([v + n, v]))
    near, far = root[:n], root[n:]
    least = np.minimum(near, far)
    return nodes, nodes[least], (near != least).astype(np.int32), near == far


def sides_by_pieces(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, side, odd) of links between bigints: 0 for the side of the least node of each component, 1 for the other; odd where a
    ring of odd length leaves no sides. Pieces are made as in ``components_by_pieces``, then each stands for two, one for
    either side, and nodes in several pieces join them."""

    def joined(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in sides_on_least(a, b)], names=["node", "piece", "side", "odd"])

    found = by_blocks(edges, joined, "node bigint, piece bigint, side int, odd boolean", block)
    of = found.groupBy("node").agg(F.collect_set(F.struct("piece", "side")).alias("of"), F.max("odd").alias("odd"))
    of = written(of.withColumn("own", F.array_min("of")), "pieces")
    several = of.where("size(of) > 1").select(F.explode("of").alias("p"), "own")
    turned = lambda p, x: F.struct(p["piece"].alias("piece"), F.pmod(p["side"] + x, F.lit(2)).alias("side"))
    links = several.select(F.explode(F.array(*(F.struct(turned(F.col("p"), x).alias("a"), turned(F.col("own"), x).alias("b")) for x in (0, 1)))).alias("l")).select("l.a", "l.b")
    root = components(links).groupBy(F.col("node.piece").alias("piece")).agg(F.min("root").alias("least"), F.min_by("root", "node.side").alias("near"), F.max("root").alias("most"))
    root = root.select("piece", (F.col("near") != F.col("least")).cast("int").alias("turn"), (F.col("least") == F.col("most")).alias("ring"))
    wide = of.select("node", "own.piece", "own.side", "odd").join(root, "piece", "left")
    side = F.pmod(F.col("side") + F.coalesce("turn", F.lit(0)), F.lit(2)).alias("side")
    return wide.select("node", side, (F.col("odd") | F.coalesce("ring", F.lit(False))).alias("odd"))
