"""Approval voting: rows are players, columns alternatives, an arc is an approval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.algebra import NUMBER
from arcweave.operators.matrices import Matrix
from arcweave.operators.vectors import Vec

#: Players at most in a search over all subsets.
MAX_PLAYERS = 24


def players(v: Matrix) -> Vec:
    """All rows, also those without an approval."""
    return v.vertices()


def votes(v: Matrix, of: Vec | None = None) -> Vec:
    """Approvals of each alternative, by all players or the given ones."""
    cells = v.cells if of is None else v.restrict_rows(of).cells
    return Vec(cells.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("val")), NUMBER)


def results(v: Matrix) -> Vec:
    return votes(v)


def winners(v: Matrix, of: Vec | None = None) -> Vec:
    """The alternatives of most approvals, all ties."""
    return votes(v, of).restrict_to_greatest()


def at_least(v: Matrix, alternative: int) -> DataFrame:
    """One row val: so many players at least must go before the alternative can win."""
    return votes(v).df.agg((F.coalesce(F.max("val"), F.lit(0)) - F.coalesce(F.max(F.when(F.col("key") == alternative, F.col("val"))), F.lit(0))).alias("val"))


def lower_bounds(v: Matrix) -> DataFrame:
    """(key, val): at_least of every alternative that has votes."""
    found = votes(v).df
    top = found.agg(F.max("val").alias("top"))
    return found.join(F.broadcast(top)).select("key", (F.col("top") - F.col("val")).alias("val"))  # one row


def subsets(v: Matrix, at_least_size: int = 0) -> DataFrame:
    """(mask, size): all subsets of the players 0 to n-1 with at least so many members, as bit masks."""
    n = v.n_rows()
    if n > MAX_PLAYERS:
        raise ValueError(f"{n} players have too many subsets; the limit is {MAX_PLAYERS}")
    return v.spark.range(1 << n).select(F.col("id").alias("mask"), F.bit_count("id").alias("size")).where(F.col("size") >= at_least_size)


def minimal_removal(v: Matrix, alternative: int) -> DataFrame:
    """One row (attempt, players): the first set of players, by size and then by mask, without whose votes the
    alternative wins or nobody has votes; attempt is its place among the sets of the lower bound's size and more.

    All sets are judged in one plan: the votes left to an alternative are counted on the mask of its approvers, one row
    per alternative.
    """
    v = v.stored()
    bound = at_least(v, alternative).first().val
    mask = F.sum(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("src").cast("int")))
    approvers = v.cells.groupBy("dst").agg(mask.alias("approvers"))
    sets = subsets(v, int(bound))
    left = F.bit_count(F.col("approvers").bitwiseAND(F.bitwise_not(F.col("mask"))))
    # one row per alternative, and there are few in a vote of at most MAX_PLAYERS players
    held = sets.join(F.broadcast(approvers)).groupBy("mask", "size").agg(F.max(left).alias("top"), F.coalesce(F.max(F.when(F.col("dst") == alternative, left)), F.lit(0)).alias("own"))
    if v.cells.isEmpty():
        held = sets.select("mask", "size", F.lit(0).alias("top"), F.lit(0).alias("own"))
    best = held.where("top = 0 or (own = top and own > 0)").orderBy("size", "mask").limit(1)
    place = sets.select(F.col("mask").alias("m"), F.col("size").alias("s")).join(F.broadcast(best), (F.col("s") < F.col("size")) | ((F.col("s") == F.col("size")) & (F.col("m") <= F.col("mask"))))
    n = v.n_rows()
    members = F.filter(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: F.call_function("getbit", F.col("mask"), i.cast("int")) == 1)
    return place.groupBy("mask").agg(F.count("*").alias("attempt")).select("attempt", members.alias("players"))
