"""Loops that run level by level: breadth-first levels, reachability, shortest paths, forests.

Each round is one product with the graphs, an anti-join against what was seen and one write to the shared folder, which
ends its lineage. Frontier and seen vertices are tables of any size; the driver holds a row count per round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.operators import products
from arcweave.operators.matrices import Matrix
from arcweave.operators.vectors import Vec
from arcweave.plans.shared import written

Step = Callable[[Vec, Matrix], Vec]
MAX_ROUNDS = 10_000
#: Levels whose tables are read one by one before they are merged into one table.
MERGE_EVERY = 8


class Rounds(RuntimeError):
    """A loop did not settle within its limit."""


def _as_list(x, n: int) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x] * n


def _ends(current: DataFrame, target: DataFrame | None) -> bool:
    """Whether a level is empty or meets the target: one job."""
    if target is None:
        return current.isEmpty()
    met = current.select("key").join(target.select("key", F.lit(True).alias("hit")), "key", "left")
    n, hits = met.agg(F.count("*"), F.count("hit")).first()
    return n == 0 or hits > 0


def steps(start: Vec, graphs: Matrix | list[Matrix], mults: Step | list[Step] = products.first_vector_label, candidates: DataFrame | None = None, target: DataFrame | None = None, max_rounds: int = MAX_ROUNDS, merge: bool = False) -> DataFrame:
    """Levels (level, key, val) from the start vector, which is level 0.

    One step passes through all graphs in turn; only where it ends counts as seen. New vertices must be among the
    candidates (column key; default: the rows of the first graph). With a target (column key) the loop ends at the first
    level that meets it. With ``merge`` nothing is broadcast, so that levels, be they many, send no tables through the driver;
    without it small levels spare a shuffle of the graphs. Where all rows are candidates the loop also ends when none is left, which
    spares the product, often the largest, that would find no more.
    """
    held = (lambda df: df.hint("merge")) if merge else (lambda df: df)
    gs = [g.stored() for g in _as_list(graphs, 1)]
    ms = _as_list(mults, len(gs))
    within = gs[0].rows.select(F.col("id").alias("key")) if candidates is None and gs else candidates
    current = written(start.df.select("key", "val"), "level")
    levels = [current.select(F.lit(0).alias("level"), "key", "val")]
    seen = [current.select("key")]
    n, left = current.count(), None
    if candidates is None and gs:
        left = within.join(held(current.select("key")), "key", "left_anti").count()
    for k in range(1, max_rounds + 1):
        if not gs or left == 0 or (n == 0 if target is None else _ends(current, target)):
            break
        v = start.like(current)
        for m, g in zip(ms, gs):
            v = m(v.like(held(v.df)), g)
        new = v.df.select("key", "val").join(held(within.select("key")), "key", "left_semi")
        new = new.join(held(reduce(DataFrame.union, seen)), "key", "left_anti")
        current = written(new, "level")
        n = current.count()
        left = None if left is None else left - n
        levels.append(current.select(F.lit(k).alias("level"), "key", "val"))
        seen.append(current.select("key"))
        if len(seen) > MERGE_EVERY:
            seen = [written(reduce(DataFrame.union, seen), "seen")]
            levels = [written(reduce(DataFrame.unionByName, levels), "levels")]
    else:
        raise Rounds(f"levels: more than {max_rounds} rounds")
    return reduce(DataFrame.unionByName, levels)


def reachable(start: Vec, graphs, mults: Step | list[Step] = products.first_vector_label, seed: Vec | None = None, candidates: DataFrame | None = None) -> Vec:
    """All levels as one vector (the earlier level wins), over a seed whose entries come last."""
    found = start.like(steps(start, graphs, mults, candidates).select("key", "val"))
    return found if seed is None else found.union(seed)


def shortest(start: Vec, target: Vec, graphs, mults: Step | list[Step] = products.first_vector_label, candidates: DataFrame | None = None) -> Vec:
    """The part of the first level that meets the target, restricted to it; empty if none does."""
    goal = target.df.select("key")
    hit = steps(start, graphs, mults, candidates, goal).join(goal, "key", "left_semi")
    first = hit.agg(F.min("level").alias("level"))
    return start.like(hit.join(F.broadcast(first), "level").select("key", "val"))  # one row


def distance(start: Vec, graphs, candidates: DataFrame | None = None) -> DataFrame:
    """(level, key) of all vertices reached."""
    return steps(start.units(), graphs, products.reached, candidates).select("level", "key")


def forest(start: Vec, graphs, target: Vec | None = None, first: DataFrame | None = None, candidates: DataFrame | None = None, max_rounds: int = MAX_ROUNDS, goal_only: bool = False) -> DataFrame:
    """Predecessor arcs (level, at, vertex, pred, label) that lead from level to level, up to the first level that meets
    the target. ``at`` numbers the graphs of a step. Roots have level 0 and no predecessor.

    ``first`` holds arcs (vertex, pred) that lead into the start from before it (level 0, kept in the forest). With ``goal_only`` the
    level that meets the target has the arcs to it alone: these are looked for first, before the level's others, often the most of
    all, are joined and written.
    """
    gs = [g.stored() for g in _as_list(graphs, 1)]
    bound = candidates is not None or len(gs) > 1 or not gs[0].ends  # else arcs lead to rows anyway
    within = gs[0].rows.select(F.col("id").alias("key")) if candidates is None else candidates
    goal = None if target is None else target.df.select("key")
    current = written(start.df.select("key"), "level")
    none = F.lit(None).cast("bigint")
    out = [current.select(F.lit(0).alias("level"), F.lit(0).alias("at"), F.col("key").alias("vertex"), none.alias("pred"), F.lit(None).cast("string").alias("label"))]
    if first is not None:
        out[0] = first.select(F.lit(0).alias("level"), F.lit(0).alias("at"), "vertex", "pred", F.lit(None).cast("string").alias("label"))
    seen = current
    for k in range(1, max_rounds + 1):
        if _ends(current, goal):
            break
        keys, arcs = current, []
        for at, g in enumerate(gs):
            step = products.predecessor_arcs(Vec(keys.withColumn("val", F.lit(True))), g)
            columns = F.lit(k).alias("level"), F.lit(at).alias("at"), "vertex", "pred", F.col("label").cast("string").alias("label")
            if at + 1 == len(gs):
                if bound:
                    step = step.join(within.select(F.col("key").alias("vertex")), "vertex", "left_semi")
                if goal_only and goal is not None:
                    # no target was seen yet, or the loop had ended
                    met = written(step.join(goal.select(F.col("key").alias("vertex")), "vertex", "left_semi").select(*columns), "arcs")
                    if not met.isEmpty():
                        return reduce(DataFrame.unionByName, [*out, *arcs, met])
                step = step.join(seen.select(F.col("key").alias("vertex")), "vertex", "left_anti")
            step = written(step.select(*columns), "arcs")
            arcs.append(step)
            keys = step.select(F.col("vertex").alias("key")).distinct()
        out += arcs
        current = written(keys, "level")
        seen = written(seen.union(current), "seen")
    else:
        raise Rounds(f"forest: more than {max_rounds} rounds")
    return reduce(DataFrame.unionByName, out)


def improve(state, step, max_rounds: int = MAX_ROUNDS):
    """Applies step to the state until it returns None; the last state."""
    for _ in range(max_rounds):
        new = step(state)
        if new is None:
            return state
        state = new
    raise Rounds(f"still improving after {max_rounds} rounds")


# --- disjoint paths

#: Levels that a walk passes in one plan, and rounds that may pass without a path before the rest is searched one by one.
PLAN_LEVELS, STALLS = 8, 3


def layered(found: DataFrame, target: DataFrame) -> tuple[DataFrame, dict[int, DataFrame], int] | None:
    """A forest's vertices and arcs by depth, as far as they lie on the way to a target of the first depth that meets one:
    roots (vertex), arcs (vertex, pred) of depths 1 to n, and n; None if no target is met. A step through several graphs
    counts a depth for each of them."""
    goal = target.select(F.col("key").alias("vertex"))
    n_graphs = (found.agg(F.max("at")).first()[0] or 0) + 1
    flat = found.withColumn("depth", F.when(F.col("pred").isNull() & (F.col("level") == 0), 0).otherwise(F.col("level") * n_graphs - (n_graphs - 1) + F.col("at")))
    # only where a step ends a vertex is reached; roots are, unless arcs lead into them from before
    led = not found.where("level = 0 and pred is not null").isEmpty()
    flat = flat.withColumn("depth", F.col("depth") + 1 if not led else F.when(F.col("level") == 0, 1).otherwise(F.col("depth") + 1))
    meets = flat.where((F.col("level") == 0) | (F.col("at") == n_graphs - 1)).join(goal, "vertex", "left_semi").agg(F.min("depth")).first()[0]
    flat = flat.select("depth", "vertex", "pred")
    if led:
        before = flat.where("depth = 1").select(F.lit(0).alias("depth"), F.col("pred").alias("vertex"), F.lit(None).cast("bigint").alias("pred"))
        flat = flat.unionByName(before.distinct())
    if meets is None:
        return None
    bottom, keep, arcs = 0 if led else 1, goal, {}
    for d in range(meets, bottom - 1, -1):
        layer = written(flat.where(F.col("depth") == d).join(keep.select("vertex"), "vertex", "left_semi").select("vertex", "pred").distinct(), "layer")
        arcs[d - bottom] = layer
        keep = layer.where("pred is not null").select(F.col("pred").alias("vertex")).distinct()
    return arcs.pop(0).select("vertex"), arcs, meets - bottom


def _walked(tokens: DataFrame, arcs: dict[int, DataFrame], depth: int, salt: int, share_start: bool) -> DataFrame:
    """(token, at, path) of the tokens that get from ``depth`` down to the roots. At each level a token picks its least
    predecessor (in later rounds, salt 2 and up, one by a hash, so that tokens spread), and a predecessor takes the least
    token that picks it; others stay behind."""
    for d in range(depth, 0, -1):
        step = tokens.select("token", "at").join(arcs[d].withColumnRenamed("vertex", "at"), "at")
        pick = F.min("pred") if salt == 1 else F.min_by("pred", F.xxhash64(F.lit(salt), "token", "pred"))
        step = step.groupBy("token").agg(pick.alias("pred"))
        if d > 1 or not share_start:
            step = step.groupBy("pred").agg(F.min("token").alias("token"))
        # paths stay out of the aggregations, which then need no sorts
        step = step.join(tokens, "token").select("token", F.col("pred").alias("at"), F.concat(F.array("pred"), "path").alias("path"))
        tokens = written(step, "tokens") if (depth - d + 1) % PLAN_LEVELS == 0 else step
    return tokens


def _exclusive(path: Column, share_start: bool, share_end: bool) -> Column:
    """The vertices of a path that no other path may hold."""
    return F.slice(path, 2 if share_start else 1, F.greatest(F.size(path) - int(share_start) - int(share_end), F.lit(0)))


def prune(found: DataFrame, target: DataFrame, share_start: bool = False, share_end: bool = False) -> DataFrame:
    """path_id, path: a maximal set of disjoint paths of a forest from level 0 to the targets of its last level.

    Vertices may be shared at the start or end if so asked. In each round tokens walk from all targets that are left down
    the levels at once; of tokens that want one vertex the least goes on, and of paths that meet at different levels the one
    of the least token stays, so a round finds a path at least and mostly a good part of all. Then the vertices of
    the new paths go, and with them, level by level from the roots, what is no longer connected to a root. It ends when no
    target is. Where steps lead through several graphs walks may come back to a vertex; if rounds find no others, the rest
    is searched in one task.
    """
    spark, schema = found.sparkSession, "path_id bigint, path array<bigint>"
    known = layered(found, target)
    if known is None:
        return spark.createDataFrame([], schema)
    roots, arcs, depth = known
    if depth == 0:
        return roots.distinct().select(F.col("vertex").alias("path_id"), F.array("vertex").alias("path"))
    chosen: list[DataFrame] = []
    stalls, salt = 0, 0
    while stalls < STALLS:
        salt += 1
        if share_end:
            tokens = arcs[depth].groupBy(F.col("pred").alias("token")).agg(F.min("vertex").alias("end")).select("token", F.col("token").alias("at"), F.array("token", "end").alias("path"))
            walked = _walked(tokens, arcs, depth - 1, salt, share_start)
        else:
            tokens = arcs[depth].select(F.col("vertex").alias("token")).distinct().select("token", F.col("token").alias("at"), F.array("token").alias("path"))
            walked = _walked(tokens, arcs, depth, salt, share_start)
        walked = written(walked.withColumn("own", _exclusive(F.col("path"), share_start, share_end)), "walked")
        if walked.isEmpty():
            break
        simple = walked.where(F.size(F.array_distinct("own")) == F.size("own"))
        met = simple.select("token", F.explode("own").alias("vertex"))
        least = met.groupBy("vertex").agg(F.min("token").alias("least"))
        beaten = met.join(least, "vertex").where("token <> least").select("token").distinct()
        new = written(simple.join(beaten, "token", "left_anti").select("token", "path", "own"), "paths")
        if new.isEmpty():
            stalls += 1
            continue
        stalls = 0
        chosen.append(new.select(F.col("token").alias("path_id"), "path"))
        used = new.select(F.explode("own").alias("vertex"))
        roots = written(roots.join(used, "vertex", "left_anti"), "roots")
        alive = roots
        for d in range(1, depth + 1):
            left = arcs[d] if share_end and d == depth else arcs[d].join(used, "vertex", "left_anti")
            arcs[d] = written(left.join(alive.select(F.col("vertex").alias("pred")), "pred", "left_semi").select("vertex", "pred"), "layer")
            alive = arcs[d].select("vertex").distinct()
    else:
        chosen.append(_searched(roots, arcs, depth, share_start, share_end))
    return reduce(DataFrame.unionByName, chosen) if chosen else spark.createDataFrame([], schema)


def _searched(roots: DataFrame, arcs: dict[int, DataFrame], depth: int, share_start: bool, share_end: bool) -> DataFrame:
    """The same in one task, depth first, for the rest whose walks come back to a vertex."""
    parts = [roots.select(F.lit(0).alias("depth"), "vertex", F.lit(None).cast("bigint").alias("pred"))]
    parts += [arcs[d].select(F.lit(d).alias("depth"), "vertex", "pred") for d in arcs]

    def choose(pdf):
        import pandas as pd

        steps: dict[tuple[int, int], list[int]] = {}
        for d, v, p in sorted(pdf.dropna(subset=["pred"])[["depth", "vertex", "pred"]].itertuples(index=False)):
            steps.setdefault((int(d), int(v)), []).append(int(p))
        ends = sorted({int(v) for v in pdf.loc[pdf.depth == depth, "vertex"]})
        paths = _greedy(steps, ends, depth, share_start, share_end)
        return pd.DataFrame({"path_id": [p[-2] if share_end else p[-1] for p in paths], "path": paths})

    return reduce(DataFrame.unionByName, parts).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(choose, "path_id bigint, path array<bigint>")


def _greedy(arcs, ends: list[int], depth: int, share_start: bool, share_end: bool) -> list[list[int]]:
    """Paths from level 0 to the ends, chosen one after the other by ascending vertex; each vertex is used once."""
    used: set[int] = set()
    paths: list[list[int]] = []

    def search(top: int, level: int):
        """Depth first without recursion: a path of vertices from ``top`` on this level down to level 0, or None."""
        trail, options = [], [iter([top])]
        while options:
            v = next(options[-1], None)
            if v is None:
                options.pop()
                if trail:
                    trail.pop()
                continue
            at = level - len(trail)
            if v in used:
                continue
            if at == 0:
                if not share_start:
                    used.add(v)
                return trail + [v]
            used.add(v)
            trail.append(v)
            options.append(iter(arcs.get((at, v), ())))
        return None

    for e in ends:
        if not share_end:
            found = search(e, depth)
            if found:
                paths.append(found[::-1])
        else:
            for p in arcs.get((depth, e), ()):
                found = search(p, depth - 1)
                if found:
                    paths.append(found[::-1] + [e])
    return paths


Strategy = Callable[[DataFrame, DataFrame], DataFrame]


def least_paths(found: DataFrame, target: DataFrame) -> DataFrame:
    """path_id, path: for each target of the first level that meets them (its id is the path's) the path of least
    predecessors; such paths may share vertices. For forests of one graph: a join per level, nothing in one task."""
    goal = target.select(F.col("key").alias("vertex"))
    best = written(found.where("pred is not null").groupBy("level", "vertex").agg(F.min("pred").alias("pred")), "least")
    hit = found.join(goal, "vertex", "left_semi").select("level", "vertex").distinct()
    meets = hit.agg(F.min("level")).first()[0]
    paths = hit.where(F.col("level") == F.lit(meets)).select(F.col("vertex").alias("path_id"), F.col("vertex").alias("at"), F.array("vertex").alias("path"))
    for d in range(meets or 0, 0, -1):
        step = best.where(F.col("level") == d).select(F.col("vertex").alias("at"), "pred")
        paths = paths.join(step, "at").select("path_id", F.col("pred").alias("at"), F.concat(F.array("pred"), "path").alias("path"))
    return paths.select("path_id", "path")


def paths_by(strategy: Strategy, start: Vec, target: Vec, graphs, first: DataFrame | None = None) -> DataFrame:
    """Shortest paths from start to target as a strategy picks them from the predecessor forest: strategy(forest, target)."""
    return strategy(forest(start, graphs, target, first), target.df)


def disjoint_paths(start: Vec, target: Vec, graphs, share_start: bool = False, share_end: bool = False, first: DataFrame | None = None) -> DataFrame:
    """Shortest paths from start to target that are disjoint (up to their ends, if so asked)."""
    return prune(forest(start, graphs, target, first, goal_only=True), target.df, share_start, share_end)
