"""Queries on graphs: bipartiteness, components, matchings, covers, flows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.algebra import UNIT, free as lists, widest
from arcweave.functions.paths import empty_path
from arcweave.operators import products
from arcweave.operators.matrices import Matrix
from arcweave.operators.vectors import Vec
from arcweave.plans import levels, matchings
from arcweave.plans.closure import star_closure
from arcweave.plans.components import components_by_pieces, sides_by_pieces
from arcweave.plans.shared import written

# --- components


def weak_components(g: Matrix) -> DataFrame:
    """(id, root): the connected components of the graph without directions; root is the least vertex of each."""
    cells = g.cells.where("src < dst") if g.both_ways else g.cells
    found = components_by_pieces(cells.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return g.rows.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))


def component_count(g: Matrix) -> DataFrame:
    return weak_components(g).agg(F.countDistinct("root").alias("n"))


def per_root(g: Matrix, mult=products.reached, merge: bool = False) -> DataFrame:
    """(root, level, key): for the least vertex not yet reached, the levels from it along arcs, again and again; merge: see
    ``levels.steps``."""
    found = componentwise(g, lambda start, graph, within: levels.steps(start, graph, mult, candidates=within, merge=merge).select("key", "level"))
    return found.select("root", "level", "key")


def least_ancestors(g: Matrix) -> DataFrame:
    """(id, root): the least vertex from which arcs lead to each vertex, itself included.

    Smaller roots are passed on along arcs; a round looks only at vertices whose root the last one changed. Rounds may be many,
    so their joins merge: broadcasts of every round would add up on the driver.
    """
    g = g.stored()
    arcs = g.cells.select("src", F.col("dst").alias("id")).join(g.rows.hint("merge"), "id", "left_semi")
    found = changed = written(g.rows.select("id", F.col("id").alias("root")), "ancestors")
    while not changed.isEmpty():
        offers = changed.select(F.col("id").alias("src"), "root").hint("merge").join(arcs, "src").groupBy("id").agg(F.min("root").alias("offer"))
        changed = written(offers.hint("merge").join(found, "id").where("offer < root").select("id", F.col("offer").alias("root")), "changed")
        new = changed.withColumnRenamed("root", "new").hint("merge")
        found = written(found.join(new, "id", "left").select("id", F.coalesce("new", "root").alias("root")), "ancestors")
    return found


def componentwise(g: Matrix, f: Callable[[Vec, Matrix, DataFrame | None], DataFrame], whole: bool = True) -> DataFrame:
    """root and the columns of f: f(start, graph, candidates) applied to each component, from its least vertex.

    f returns rows with a column key, the vertex a row speaks of; what it returns counts as the component. If f speaks of
    all that its start reaches (``whole``), it gets the roots of all components at once, and its rows are dealt to components by
    key. On graphs whose arcs do not all go both ways roots come in ascending order and what one reaches is lost to later
    ones. The first to reach a vertex is then its least ancestor: no smaller root could have taken it, or anything
    on the way to it. So vertices are labelled with that, and arcs between different labels go. Other functions are
    applied root by root, each among the vertices left.
    """
    g = g.stored()
    if whole:
        turned = g.cells.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        both_ways = g.both_ways or g.cells.join(turned, ["src", "dst"], "left_anti").isEmpty()
        root = written(weak_components(g) if both_ways else least_ancestors(g), "roots")
        inside = g
        if not both_ways:
            a, b = root.withColumnsRenamed({"id": "src", "root": "a"}), root.withColumnsRenamed({"id": "dst", "root": "b"})
            inside = g.like(g.cells.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("a = b")).stored()
        start = Vec(root.where("id = root").select(F.col("id").alias("key"), F.lit(True).alias("val")))
        found = f(start, inside, None)
        return found.join(root, F.col("key") == F.col("id")).select("root", *found.columns)
    left, out = written(g.rows.select(F.col("id").alias("key")), "left"), []
    while True:
        least = left.agg(F.min("key")).first()[0]
        if least is None:
            break
        start = Vec(left.where(F.col("key") == least).withColumn("val", F.lit(True)))
        found = f(start, g, left)
        out.append(written(found.select(F.lit(least).alias("root"), *found.columns), "found"))
        left = written(left.join(out[-1], "key", "left_anti"), "left")
    if not out:  # no vertices: f of nothing has the columns
        none = Vec(left.withColumn("val", F.lit(True)))
        out.append(f(none, g, left).select(F.lit(None).cast("bigint").alias("root"), "*"))
    return reduce(DataFrame.unionByName, out)


def collections(g: Matrix) -> DataFrame:
    """(root, key): what each root of ``per_root`` reaches."""
    return per_root(g).select("root", "key")


# --- bipartite graphs


def sides(g: Matrix) -> DataFrame:
    """(key, side): 0 for even and 1 for odd levels of each component's search."""
    return per_root(g).select("key", (F.col("level") % 2).alias("side"))


def is_weak_bipartition(g: Matrix, side: DataFrame) -> bool:
    """Whether no arc joins vertices of one side (key, side)."""
    a, b = side.withColumnsRenamed({"key": "src", "side": "s"}), side.withColumnsRenamed({"key": "dst", "side": "t"})
    return g.cells.join(a, "src").join(b, "dst").where("s = t").isEmpty()


def bipartition(g: Matrix) -> DataFrame | None:
    """(key, side), or None if the graph has none. Side 0 is that of the least vertex of each component."""
    g = g.stored()
    if g.both_ways:
        found = written(sides_by_pieces(g.cells.where("src <= dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))), "sides")
        if not found.where("odd").isEmpty():
            return None
        return g.rows.join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias("key"), F.coalesce("side", F.lit(0)).alias("side"))
    side = written(sides(g), "sides")
    return side if is_weak_bipartition(g, side) else None


def is_bipartite(g: Matrix) -> bool:
    return bipartition(g) is not None


def is_bipartite_by_closure(g: Matrix) -> bool:
    """No closed walk of odd length: the identity misses a · star(a · a). For small graphs."""
    a = g.booleans()
    odd = products.mat_mat(a, star_closure(products.mat_mat(a, a, True)), True)
    return a.identity().keep(odd).is_empty()


def is_bipartite_by_even_walks(g: Matrix) -> bool:
    """No arc joins ends of a walk of even length: one product less. For small graphs."""
    a = g.booleans()
    return a.keep(star_closure(products.mat_mat(a, a, True))).is_empty()


def inner_arcs(g: Matrix, keys: Vec) -> Vec:
    """Successors of a set that lie in the set."""
    return products.reached(keys, g).keep(keys)


# --- matchings (graphs whose arcs go both ways)


def _flip(m: Matrix, rest: Matrix, arcs: DataFrame) -> tuple[Matrix, Matrix]:
    """Arcs change places between matching and rest; arcs: (src, dst), both ways."""
    moved = Matrix(arcs.select("src", "dst", F.lit(True).alias("val")), m.rows, UNIT)
    flipped = [written(x.symmetric_difference(moved).cells, "flipped") for x in (m, rest)]
    return replace(m, cells=flipped[0], kept=True), replace(rest, cells=flipped[1], kept=True)


def _arcs_of_paths(paths: DataFrame) -> DataFrame:
    """(src, dst), both ways, of a column of vertex arrays."""
    n = F.greatest(F.size("path") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("path", F.lit(1), n), F.slice("path", F.lit(2), n), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    arcs = paths.select(F.explode(pairs).alias("p")).select("p.src", "p.dst")
    return arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def augmenting_path(m: Matrix, rest: Matrix) -> DataFrame | None:
    """(path): a shortest path that alternates between rest and matching and joins two unmatched vertices, to the least
    such vertex; None if there is none."""
    free = m.without_successors()
    start = free.constant(empty_path(), lists("bigint"))
    first = products.extended_path(start, rest)
    hit = levels.shortest(first, free, [m, rest], products.extended_path, candidates=m.rows.select(F.col("id").alias("key")))
    found = hit.some().select(F.concat("val", F.array("key")).alias("path"))
    found = written(found, "path")
    return None if found.isEmpty() else found


def maximum_matching(g: Matrix) -> tuple[Matrix, Matrix]:
    """(matching, the other arcs), one augmenting path per round."""
    g = g.units().stored()

    def step(state):
        path = augmenting_path(*state)
        return None if path is None else _flip(*state, _arcs_of_paths(path))

    return levels.improve((g.emptied().stored(), g), step)


def augmenting_paths(m: Matrix, rest: Matrix, left: DataFrame | None = None) -> DataFrame:
    """(path_id, path): a maximal set of disjoint shortest augmenting paths; with ``left`` (key) those from there.

    The first step, from unmatched vertices over rest, is part of the forest, so that paths begin where they should.
    """
    free = m.without_successors()
    starts, ends = (free, free) if left is None else (free.keep(Vec(left)), free.drop(Vec(left)))
    first = written(products.predecessor_arcs(starts, rest).select("vertex", "pred"), "first")
    start = Vec(first.select(F.col("vertex").alias("key")).distinct().withColumn("val", F.lit(True)))
    within = m.rows.select(F.col("id").alias("key"))
    found = levels.forest(start, [m, rest], ends, first, within)
    return levels.prune(found, ends.df)


def maximum_matching_by_phases(g: Matrix, left: DataFrame | None = None) -> tuple[Matrix, Matrix]:
    """(matching, the other arcs), all disjoint shortest augmenting paths per round: few rounds. For bipartite graphs.

    With ``left`` (key), the vertices of one side, ``matchings.matched`` does it over arcs in one direction.
    """
    g = g.units().stored()
    if left is not None:
        pairs, _ = matchings.matched(g.cells.join(left.select(F.col("key").alias("src")), "src", "left_semi").select("src", "dst"))
        both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        m = g.like(both.withColumn("val", F.lit(True))).stored()
        return m, g.drop(m)

    def step(state):
        paths = written(augmenting_paths(*state), "paths")
        return None if paths.isEmpty() else _flip(*state, _arcs_of_paths(paths))

    return levels.improve((g.emptied().stored(), g), step)


# --- vertex covers


def alternating_reachable(m: Matrix, rest: Matrix, within: Vec) -> Vec:
    """What alternating paths reach from unmatched vertices of ``within``."""
    s = levels.reachable(m.without_successors().keep(within), [rest, m], products.reached)
    s = s.like(written(s.df, "reached"))
    return s.union(products.reached(s, rest))


def minimum_vertex_cover(g: Matrix) -> DataFrame | None:
    """(key): a least set of vertices that touches every arc of a bipartite graph; None for other graphs. Where the sides are known,
    ``matchings.least_cover`` does it over arcs in one direction."""
    g = g.stored()
    side = bipartition(g)
    if side is None:
        return None
    left = side.where("side = 0").select(F.col("key").alias("src"))
    return matchings.least_cover(g.cells.join(left, "src", "left_semi").select("src", "dst"))


def approximate_vertex_cover(g: Matrix) -> DataFrame:
    """(key): a vertex cover of at most twice the least size.

    Greedy: the least vertex that still has an uncovered predecessor, with its least such predecessor, both join the cover,
    again and again. Each round settles all picks that no smaller pick could take away: a pick (target, predecessor) whose
    two ends touch no pick with a smaller target among all open ones. So the result is that of the one-by-one order.
    """
    arcs = written(g.cells.select("src", "dst"), "open")
    cover = g.spark.createDataFrame([], "key bigint")
    while True:
        # each arc's turn comes in the order (dst, src); an arc first among all arcs at both of its ends is picked now
        order = F.struct("dst", "src")
        ends = arcs.select("src", "dst", order.alias("turn"), F.explode(F.array_distinct(F.array("src", "dst"))).alias("end"))
        least = ends.groupBy("end").agg(F.min("turn").alias("turn"))
        picked = arcs.join(least.withColumnsRenamed({"end": "src", "turn": "a"}), "src").join(least.withColumnsRenamed({"end": "dst", "turn": "b"}), "dst")
        picked = picked.where((F.col("a") == order) & (F.col("b") == order))
        new = written(picked.select(F.explode(F.array("src", "dst")).alias("key")).distinct(), "picked")
        if new.isEmpty():
            return cover
        cover = written(cover.union(new), "cover")
        arcs = written(arcs.join(new.withColumnRenamed("key", "src"), "src", "left_anti").join(new.withColumnRenamed("key", "dst"), "dst", "left_anti").select("src", "dst"), "open")


# --- flows


def augmenting_flow_path(residual: Matrix, source: int, sink: int) -> tuple[list[int], float] | None:
    """A shortest path of positive residual capacity and its bottleneck: one row comes back."""
    spark = residual.spark
    start = Vec(spark.range(source, source + 1).select(F.col("id").alias("key"), F.struct(empty_path().alias("path"), F.lit(None).cast(residual.algebra.kind).alias("width")).alias("val")), widest(residual.algebra.kind))
    end = Vec.keys_of(spark, [sink])
    within = residual.rows.select(F.col("id").alias("key")).union(spark.range(sink, sink + 1).toDF("key")).distinct()
    row = levels.shortest(start, end, residual, products.extended_bottleneck, within).df.first()
    return None if row is None else ([*row.val.path, row.key], row.val.width)


def maximum_flow(capacity: Matrix, source: int, sink: int) -> tuple[Matrix, Matrix]:
    """(flow, residual): shortest augmenting paths until the sink is out of reach, one a round, each of least predecessors.
    Source and sink must differ. ``flows.maximum_flow`` sends many paths in a round; its flow has the same value.

    A path takes its bottleneck from the residual of its arcs and gives it to the opposite ones. Flow is what the residual
    lacks of the capacity, so that of two opposite arcs of the network only one carries the difference.
    """
    if source == sink:
        raise ValueError("source and sink are the same vertex")
    capacity = capacity.stored()

    def step(residual):
        found = augmenting_flow_path(residual, source, sink)
        if found is None:
            return None
        path, width = found
        arcs = residual.spark.createDataFrame(pa.table({"src": path[:-1], "dst": path[1:]})).withColumn("val", F.lit(width).cast(capacity.algebra.kind))
        along = residual.like(arcs)
        changed = residual.minus(along).plus(along.transposed(), drop_zeros=True)
        return replace(capacity, cells=written(changed.cells, "residual"), kept=True)

    residual = levels.improve(capacity.without_zeros(), step)
    flow = capacity.cells.join(residual.cells.withColumnRenamed("val", "left"), ["src", "dst"], "left").withColumn("val", F.col("val") - F.coalesce("left", F.lit(0)))
    return capacity.like(flow.where("val > 0")), residual


def minimum_cut(residual: Matrix, source: int) -> DataFrame:
    """(key): the source's side of a least cut, from the residual of a maximum flow."""
    start = Vec.keys_of(residual.spark, [source])
    return levels.reachable(start, residual, products.reached).df.select("key")


def cut_capacity(capacity: Matrix, side: DataFrame) -> DataFrame:
    """One row val: the capacity of the arcs that leave the side."""
    leaving = capacity.cells.join(side.withColumnRenamed("key", "src"), "src", "left_semi").join(side.withColumnRenamed("key", "dst"), "dst", "left_anti")
    return leaving.agg(F.coalesce(F.sum("val"), F.lit(0)).cast(capacity.algebra.kind).alias("val"))


def balance(g: Matrix) -> DataFrame:
    """(key, val): what leaves each vertex less what enters it."""
    out = g.cells.select(F.col("src").alias("key"), "val")
    into = g.cells.select(F.col("dst").alias("key"), (-F.col("val")).alias("val"))
    return out.unionByName(into).groupBy("key").agg(F.sum("val").cast(g.algebra.kind).alias("val"))
