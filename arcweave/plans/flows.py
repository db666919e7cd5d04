"""Maximum flows by many paths at once.

A phase labels vertices with their distance to the sink over arcs with residual capacity, level by level, and keeps the arcs that
it meets there, which lead one step closer. It sends flow through them in two sweeps. Forward, level by level from the
source, each vertex proposes what it was offered to its successors, in proportion to what these can take. Backward from the
sink, each vertex accepts of the offers made to it as much as its own proposals were accepted, in the same proportion. What is
accepted is a flow; it takes at least one path's worth and, as vertices of a level act at the same time, usually that of a
great many. A phase costs a few jobs a level, whatever the number of paths; labels are made anew until the source has none.

Whole capacities stay whole: shares are differences of rounded running sums. Running sums of a vertex are made in two
steps, by buckets of its arcs, where it is a hub, and what hubs are joined to is broadcast, so that a hub's arcs are not one task's. All other kinds are filled arc by arc.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.operators.matrices import Matrix
from arcweave.plans import levels
from arcweave.plans.shared import written

#: Arcs of a vertex whose running sum one task may make, and buckets of arcs where a vertex has more.
HUB, BUCKETS = 100_000, 256
ABOVE = (Window.unboundedPreceding, -1)


def whole_kind(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal") and kind.endswith(",0)")


def met(arcs: DataFrame, table: DataFrame, on: str, hubs: Sequence[int] = (), how: str = "inner") -> DataFrame:
    """arcs joined to a table that has a vertex once; the rows of hubs, whose arcs would come to one task each, are broadcast."""
    if not hubs:
        return arcs.join(table, on, how)
    is_hub = F.col(on).isin(list(hubs))
    return arcs.where(~is_hub).join(table.where(~is_hub), on, how).unionByName(arcs.where(is_hub).join(F.broadcast(table.where(is_hub)), on, how))


def apportioned(arcs: DataFrame, totals: DataFrame, at: str, by: str, kind: str, hubs: Sequence[int] = ()) -> DataFrame:
    """arcs with ``part``: of the total of its vertex (totals: at, total; null: without end) what goes to each arc, at most its
    weight. at names the column that the arcs of one vertex share, by the one that tells them apart.

    Where the total is below the sum of weights, whole kinds share in proportion, other kinds by ascending ``by``. Sums and running
    sums of ``hubs`` are made by buckets of a vertex's arcs first.
    """
    if hubs:
        is_hub = F.col(at).isin(list(hubs))
        rest = apportioned(arcs.where(~is_hub), totals.where(~is_hub), at, by, kind)
        rows = arcs.where(is_hub).join(F.broadcast(totals.where(is_hub)), at)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(BUCKETS)))
        held = rows.groupBy(at, "bucket").agg(F.sum("weight").alias("held"))
        whole = Window.partitionBy(at)
        heads = held.select(at, "bucket", F.sum("held").over(whole).alias("sum"), F.coalesce(F.sum("held").over(whole.orderBy("bucket").rowsBetween(*ABOVE)), F.lit(0)).alias("ahead"))
        rows = rows.join(F.broadcast(heads), [at, "bucket"])  # a row for each bucket of a hub
        within = Window.partitionBy(at, "bucket")
    else:
        within = Window.partitionBy(at)
        rows = arcs.join(totals, at).withColumns({"sum": F.sum("weight").over(within), "ahead": F.lit(0)})
    rows = rows.withColumn("before", F.col("ahead") + F.coalesce(F.sum("weight").over(within.orderBy(by).rowsBetween(*ABOVE)), F.lit(0)))
    if whole_kind(kind):
        wide = lambda c: c.cast("decimal(19,0)")
        upto = lambda x: F.call_function("div", wide(x) * wide(F.col("total")), wide(F.col("sum")))
        share = upto(F.col("before") + F.col("weight")) - upto(F.col("before"))
    else:
        share = F.greatest(F.least(F.col("weight"), F.col("total") - F.col("before")), F.lit(0))
    rows = rows.withColumn("part", F.when(F.col("total") < F.col("sum"), share).otherwise(F.col("weight")).cast(kind)).select(*arcs.columns, "part")
    return rows.unionByName(rest) if hubs else rows


def sweep(open_: list[DataFrame], source: int, kind: str, hubs: Sequence[int] = ()) -> DataFrame:
    """(src, dst, val): a flow from the source to the sink; open_: (src, dst, weight), the arcs from each level to the next lower
    one, those into the sink first. The source is in the last level and the sink the only vertex of the lowest."""
    # what leaves the source is not limited, so that its arcs are not shared out, nor are, backward, those into the sink
    proposals = [written(open_[-1].where(F.col("src") == source).select("src", "dst", "weight"), "proposals")]
    for arcs in reversed(open_[:-1]):
        offered = proposals[-1].groupBy(F.col("dst").alias("src")).agg(F.sum("weight").alias("total"))
        made = apportioned(arcs.select("src", "dst", "weight"), offered, "src", "dst", kind, hubs).where("part > 0").select("src", "dst", F.col("part").alias("weight"))
        proposals.append(written(made, "proposals"))
    accepted = [proposals[-1].withColumnRenamed("weight", "val")]
    for made in reversed(proposals[:-1]):
        taken = accepted[-1].groupBy(F.col("src").alias("dst")).agg(F.sum("val").alias("total"))
        accepted.append(written(apportioned(made, taken, "dst", "src", kind, hubs).where("part > 0").select("src", "dst", F.col("part").alias("val")), "accepted"))
    return reduce(DataFrame.unionByName, accepted)


def open_arcs(residual: DataFrame, source: int, sink: int, kind: str, hubs: Sequence[int] = ()) -> list[DataFrame] | None:
    """For each level of distance to the sink, up to that of the source, the arcs (src, dst, weight) that lead from it to the next lower
    one; None if the source is not among the vertices that reach the sink. No weight is more than the arcs of its target
    could carry on, all the way down."""
    spark = residual.sparkSession
    level = spark.range(sink, sink + 1).select(F.col("id").alias("dst"), F.lit(None).cast(kind).alias("room"))
    seen, out = level.select("dst"), []
    while True:
        new = met(met(residual, level, "dst", hubs), seen.withColumnRenamed("dst", "src"), "src", hubs, "left_anti")
        out.append(written(new.select("src", "dst", F.least("val", "room").cast(kind).alias("weight")), "open"))
        level = written(out[-1].groupBy(F.col("src").alias("dst")).agg(F.sum("weight").alias("room")), "distances")
        n, at_source = level.agg(F.count("*"), F.max(F.col("dst") == source)).first()
        if at_source:
            return out
        if not n:
            return None
        seen = seen.union(level.select("dst"))


def maximum_flow(capacity: Matrix, source: int, sink: int) -> tuple[Matrix, Matrix]:
    """(flow, residual). Source and sink must differ. Flow is what the residual lacks of the capacity, so that of two opposite
    arcs of the network only one carries the difference."""
    if source == sink:
        raise ValueError("source and sink are the same vertex")
    capacity = capacity.stored()
    # few: no more than twice the arcs by HUB
    ends = capacity.cells.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").count()
    hubs = sorted({source, sink, *(r.v for r in ends.where(F.col("count") > HUB).collect())})

    def step(residual: Matrix) -> Matrix | None:
        open_ = open_arcs(residual.cells, source, sink, capacity.algebra.kind, hubs)
        if open_ is None:
            return None
        along = residual.like(sweep(open_, source, capacity.algebra.kind, hubs))
        both_ways = along.negated().cells.unionByName(along.transposed().cells)  # one aggregation of the residual for both
        changed = residual.plus(residual.like(both_ways), drop_zeros=True)
        return replace(capacity, cells=written(changed.cells, "residual"), kept=True)

    residual = levels.improve(capacity.without_zeros(), step)
    flow = capacity.cells.join(residual.cells.withColumnRenamed("val", "left"), ["src", "dst"], "left").withColumn("val", F.col("val") - F.coalesce("left", F.lit(0)))
    return capacity.like(flow.where("val > 0")), residual
