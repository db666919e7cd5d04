"""Signed networks (labels '+' and '-') and centrality."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.functions.algebra import BALANCED, CLUSTERED, sign_to_balanced, sign_to_clustered
from arcweave.operators.matrices import Matrix
from arcweave.plans import twins
from arcweave.plans.closure import diagonal_is_one, geodesic_levels, symmetric_star_closure
from arcweave.plans.components import components
from arcweave.plans.graphs import weak_components
from arcweave.plans.shared import written


def positive(g: Matrix) -> Matrix:
    return g.filter(lambda s: s == "+")


def negative(g: Matrix) -> Matrix:
    return g.filter(lambda s: s == "-")


def clustering_candidate(g: Matrix) -> DataFrame:
    """(id, cluster): components over positive arcs; if any clustering exists this is one."""
    return weak_components(positive(g)).withColumnRenamed("root", "cluster")


def is_clustered(g: Matrix) -> bool:
    """No negative arc within a component of positive arcs."""
    g = g.stored()
    c = written(clustering_candidate(g), "clusters")
    ends = negative(g).cells.join(c.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst")
    return ends.where("a = b").isEmpty()


def is_clustered_by_closure(g: Matrix) -> bool:
    """The same by the closure of positive arcs. For small graphs."""
    return negative(g).keep(symmetric_star_closure(positive(g).booleans())).is_empty()


def is_clustered_by_walks(g: Matrix) -> bool:
    """The same by the labels of all closed walks. For small graphs."""
    return diagonal_is_one(g.map(sign_to_clustered, CLUSTERED).symmetric())


def is_balanced(g: Matrix) -> bool:
    """No closed walk with an odd number of negative arcs, directions ignored.

    Each vertex has two copies; positive arcs join equal copies, negative ones different copies. The network is balanced if
    no vertex is connected to its other copy.
    """
    a, b = 2 * F.col("src"), 2 * F.col("dst")
    other = F.when(F.col("val") == "-", 1).otherwise(0)
    double = g.cells.select(a.alias("a"), (b + other).alias("b")).unionByName(g.cells.select((a + 1).alias("a"), (b + 1 - other).alias("b")))
    found = components(double)
    return found.groupBy(F.floor(F.col("node") / 2).alias("v")).agg(F.count("*").alias("n"), F.countDistinct("root").alias("roots")).where("n = 2 and roots = 1").isEmpty()


def is_balanced_by_walks(g: Matrix) -> bool:
    """The same by the labels of all closed walks. For small graphs."""
    return diagonal_is_one(g.map(sign_to_balanced, BALANCED).symmetric())


#: Pairs of vertices whose shortest walks are counted at once; more are taken in blocks of sources.
PAIRS = 2_000_000_000


def betweenness(g: Matrix, closed_walks: bool = True, pairs: int = PAIRS) -> DataFrame:
    """(id, num, den, val): for each vertex t the sum over ordered pairs (v, w), v and w other than t, of the share of
    shortest walks from v to w that pass t; as an exact fraction in lowest terms and as a double.

    Pairs with v = w count if v lies on a cycle, unless closed_walks is off. Sources are taken in blocks, all of a block at
    once: forward, level by level, their shortest walks are counted; backward every vertex hands to its predecessors, for
    each number of walks c, how many of its continuations end at a vertex with c of them. So a level is one join of the
    frontier with the arcs, and what is summed are whole numbers of c-ths; fractions are added at the very end, for each
    vertex a row for each c. All that is done for one vertex of each kind (see ``twins``): no shortest walk passes through a
    twin of its first or last vertex in between, so what holds for one holds for all.
    """
    q = twins.quotient(g)
    n = q.matrix.n_rows()
    blocks = max(1, -(-n * n // pairs))
    parts = [_dependencies(q, None if blocks == 1 else F.pmod(F.xxhash64("src"), F.lit(blocks)) == b, closed_walks) for b in range(blocks)]
    per_count = reduce(DataFrame.unionByName, parts).groupBy("t", "den").agg(F.sum("num").alias("num"))

    def added(pdf):
        import pandas as pd

        num, den = 0, 1
        for n, c in zip(pdf.num, pdf.den):
            num, den = num * int(c) + int(n) * den, den * int(c)
            k = gcd(num, den)
            num, den = num // k, den // k
        return pd.DataFrame({"kind": [int(pdf.t.iloc[0])], "num": [str(num)], "den": [str(den)], "val": [num / den]})

    sums = per_count.groupBy("t").applyInPandas(added, "kind bigint, num string, den string, val double").join(q.of, "kind").drop("kind")
    return g.rows.join(sums, "id", "left").select("id", F.coalesce("num", F.lit("0")).alias("num"), F.coalesce("den", F.lit("1")).alias("den"), F.coalesce("val", F.lit(0.0)).alias("val"))


def _dependencies(q: twins.Quotient, sources: Column | None, closed_walks: bool) -> DataFrame:
    """(t, den, num): over the sources, walks through t on shortest walks between pairs that have den of them, in whole
    numbers (num / den is the share). A source and a vertex that a walk goes on to count once for each of their twins."""
    g, times = q.matrix, q.sizes.withColumnRenamed("times", "n")
    found = geodesic_levels(g, sources, sizes=q.sizes)
    arcs = written(g.cells.select(F.col("src").alias("t"), "dst").join(times.withColumnRenamed("id", "dst"), "dst"), "arcs")
    empty = g.spark.createDataFrame([], "t bigint, den decimal(38,0), num decimal(38,0)")
    sums, handed = [empty], None
    total = lambda c: F.sum(c.cast("decimal(38,0)")).cast("decimal(38,0)").alias("num")
    for k in range(len(found), 1, -1):
        # walks that end here: of one that starts at a twin of its end, or closes, only the former counts without closed walks
        least = F.when(F.col("src") == F.col("dst"), F.lit(0 if closed_walks else 1)).otherwise(F.lit(0))
        both = found[k - 1].select("src", "dst", F.col("cnt").alias("den"), F.lit(1).cast("decimal(38,0)").alias("num"), least.alias("less"))
        if handed is not None:
            both = both.unionByName(handed.select("src", F.col("t").alias("dst"), "den", "num", F.lit(0).alias("less")))
        at = found[k - 2].select("src", F.col("dst").alias("t"), "cnt")
        step = both.join(arcs, "dst").where("n > less").join(at, ["src", "t"]).groupBy("src", "t", "cnt", "den").agg(total(F.col("num") * (F.col("n") - F.col("less"))))
        handed = written(step, "handed")
        of_all = F.col("n") * F.col("cnt") * F.col("num")
        sums.append(handed.join(times.withColumnRenamed("id", "src"), "src").groupBy("t", "den").agg(total(of_all)))
    return written(reduce(DataFrame.unionByName, sums).groupBy("t", "den").agg(F.sum("num").cast("decimal(38,0)").alias("num")), "dependencies")
