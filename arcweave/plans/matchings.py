"""Maximum matchings of bipartite graphs, whose arcs are read in one direction and never rewritten.

The matching starts as what free vertices of the left propose and free vertices of the right accept, round by round. Then trees grow
from all vertices of the left that are free, along arcs to the right and back along the matching. A vertex of the right
joins one tree, so the trees share none, and each that gets to a free vertex changes the matching along the way there. Rounds
end when one side has no free vertex (no matching is larger) or no tree gets to one. What changes is the table of pairs, and
as few vertices are free after the proposals, a round mostly reads the arcs once a level, against small tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.shared import written

#: Proposals end when a round adds less than one pair in so many.
FEW = 20


def proposed(arcs: DataFrame) -> DataFrame:
    """(src, dst): a matching, each pair an arc, that leaves few pairs of free neighbours."""
    pairs, total, salt, left = [], 0, 0, arcs
    while True:
        salt += 1
        asked = left.groupBy("src").agg(F.min_by("dst", F.xxhash64(F.lit(salt), "src", "dst")).alias("dst"))
        new = written(asked.groupBy("dst").agg(F.min_by("src", F.xxhash64(F.lit(salt), "src")).alias("src")).select("src", "dst"), "pairs")
        pairs.append(new)
        n = new.count()
        total += n
        if n * FEW <= total:
            return reduce(DataFrame.unionByName, pairs)
        left = written(left.join(new.select("src"), "src", "left_anti").join(new.select("dst"), "dst", "left_anti").select("src", "dst"), "open")


def grown(arcs: DataFrame, pairs: DataFrame, free: DataFrame, salt: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Trees from the free vertices (src): for each level the table (dst, src, root) of what joins them, src the vertex before; and
    (root, dst, level), for each tree that gets to free vertices one of those on its first level that has any."""
    mate, turn = pairs.withColumnRenamed("src", "mate"), F.xxhash64(F.lit(salt), "src", "dst")
    ends, trees, hits = free.select("src", F.col("src").alias("root")), [], []
    while True:
        new = arcs.join(ends, "src").groupBy("dst").agg(*(F.min_by(k, turn).alias(k) for k in ("src", "root")))
        if trees:
            new = new.join(reduce(DataFrame.union, [t.select("dst") for t in trees]), "dst", "left_anti")
        new = written(new.join(mate, "dst", "left").select("dst", "src", "root", "mate"), "trees")
        n, at_end = new.agg(F.count("*"), F.count_if(F.col("mate").isNull())).first()
        if not n:
            break
        trees.append(new)
        if at_end:
            hits.append(new.where("mate is null").groupBy("root").agg(F.min("dst").alias("dst")).withColumn("level", F.lit(len(trees))))
        if n == at_end:
            break
        ends = new.where("mate is not null").select(F.col("mate").alias("src"), "root")
        if hits:  # trees that are through do not go on
            ends = ends.join(reduce(DataFrame.union, [t.where("mate is null").select("root") for t in trees]), "root", "left_anti")
    return trees, reduce(DataFrame.unionByName, hits) if hits else None


def changed(pairs: DataFrame, trees: list[DataFrame], hits: DataFrame) -> DataFrame:
    """The pairs after the change along the way from each hit back to its root."""
    new, walk = [], None
    for level in range(len(trees), 0, -1):
        at = hits.where(F.col("level") == level).select("dst")
        at = at if walk is None else at.union(walk)
        step = written(trees[level - 1].join(at, "dst", "left_semi").select("src", "dst", "root"), "way")
        new.append(step.select("src", "dst"))
        # the vertex before is not free unless it is the root: the way goes on through its mate
        walk = pairs.join(step.where("src <> root").select("src"), "src", "left_semi").select("dst")
    joined = reduce(DataFrame.unionByName, new)
    return written(pairs.join(joined.select("src"), "src", "left_anti").select("src", "dst").unionByName(joined), "pairs")


def stored(arcs: DataFrame) -> DataFrame:
    """The arcs (src, dst), each once, in the shared folder, by the left, so that what is combined by it is combined where it is read."""
    return written(arcs.select("src", "dst").where("src is not null and dst is not null").repartition("src").distinct(), "arcs")


def matched(arcs: DataFrame, kept: bool = False) -> tuple[DataFrame, DataFrame]:
    """(src, dst), a maximum matching of the arcs (src, dst) from left to right, and (dst), those of its vertices on the right
    that belong to a least cover; of the other pairs the left one does. kept: the arcs are ``stored`` already."""
    arcs = arcs if kept else stored(arcs)
    left, right = (written(arcs.select(k).distinct(), "vertices") for k in ("src", "dst"))
    n_left, n_right = left.count(), right.count()
    pairs, salt = written(proposed(arcs), "pairs"), 0
    while True:
        n = pairs.count()
        if n == n_left:
            return pairs, pairs.select("dst").where(F.lit(False))
        if n == n_right:
            return pairs, pairs.select("dst")
        salt += 1
        trees, hits = grown(arcs, pairs, written(left.join(pairs, "src", "left_anti"), "free"), salt)
        if hits is None:
            return pairs, reduce(DataFrame.unionByName, [t.select("dst") for t in trees])
        pairs = changed(pairs, trees, hits)


def least_cover(arcs: DataFrame, kept: bool = False) -> DataFrame:
    """(key): a least set of vertices that touches all arcs (src, dst), whose sides share no vertex. It has one end of each pair of a maximum
    matching: the right one where alternating paths from free vertices of the left lead there."""
    pairs, reached = matched(arcs, kept)
    met = reached.select("dst", F.lit(True).alias("met"))
    return pairs.join(met, "dst", "left").select(F.when(F.col("met"), F.col("dst")).otherwise(F.col("src")).alias("key"))


def uncovered(arcs: DataFrame, cover: DataFrame) -> DataFrame:
    """(src, dst): the arcs that no vertex (key) of the cover touches."""
    return arcs.join(cover.select(F.col("key").alias("src")), "src", "left_anti").join(cover.select(F.col("key").alias("dst")), "dst", "left_anti")
