"""Set operations on keyed tables: DataFrames with unique keys (columns ``on``) and a value column ``val``.

Each is one equi-join or one aggregation, so that Catalyst picks broadcast, shuffled or sort-merge by size. Where two
operands hold the same key the left one comes first; over several operands the earlier one does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, CELL = ("key",), ("src", "dst")
Op = Callable[[Column, Column], Column]


def _sides(a: DataFrame, b: DataFrame, on, how: str) -> DataFrame:
    """Joined on the keys; l and r are structs holding val, null where a side has no such key."""
    left = a.select(*on, F.struct(F.col("val").alias("x")).alias("l"))
    right = b.select(*on, F.struct(F.col("val").alias("x")).alias("r"))
    return left.join(right, list(on), how)


def _l() -> Column:
    return F.col("l")["x"]


def _r() -> Column:
    return F.col("r")["x"]


def intersect(a: DataFrame, b: DataFrame, op: Op, on=KEY) -> DataFrame:
    """Keys of both, with op(left, right)."""
    return _sides(a, b, on, "inner").select(*on, op(_l(), _r()).alias("val"))


def intersect_with_key(a: DataFrame, b: DataFrame, op: Callable[..., Column], on=KEY) -> DataFrame:
    """Keys of both, with op(key columns..., left, right)."""
    return _sides(a, b, on, "inner").select(*on, op(*[F.col(k) for k in on], _l(), _r()).alias("val"))


def keep_left(a: DataFrame, b: DataFrame, on=KEY) -> DataFrame:
    """Rows of a whose key is in b."""
    return a.join(b.select(*on), list(on), "left_semi")


def keep_right(a: DataFrame, b: DataFrame, on=KEY) -> DataFrame:
    """Keys of both with b's values."""
    return keep_left(b, a, on)


def difference(a: DataFrame, b: DataFrame, on=KEY) -> DataFrame:
    """Rows of a whose key is not in b."""
    return a.join(b.select(*on), list(on), "left_anti")


def difference_with(a: DataFrame, b: DataFrame, op: Op, on=KEY) -> DataFrame:
    """Rows of a; where b has the key the value becomes op(left, right), and the row goes if that is null."""
    out = _sides(a, b, on, "left").withColumn("kept", F.when(F.col("r").isNull(), F.col("l")).otherwise(F.struct(op(_l(), _r()).alias("x"))))
    return out.where(F.col("r").isNull() | F.col("kept")["x"].isNotNull()).select(*on, F.col("kept")["x"].alias("val"))


def merge(a: DataFrame, b: DataFrame, both: Op, left: Callable[[Column], Column] | None = None, right: Callable[[Column], Column] | None = None, on=KEY) -> DataFrame:
    """Full outer join: both(l, r) where both sides have the key, else left(l) or right(r); a missing branch drops rows."""
    out = _sides(a, b, on, "full")
    has_l, has_r = F.col("l").isNotNull(), F.col("r").isNotNull()
    keep = (has_l & has_r) | (has_l if left else F.lit(False)) & ~has_r | (has_r if right else F.lit(False)) & ~has_l
    val = F.when(has_l & has_r, both(_l(), _r()))
    if left:
        val = val.when(has_l, left(_l()))
    if right:
        val = val.when(has_r, right(_r()))
    return out.where(keep).select(*on, val.alias("val"))


def union_with(a: DataFrame, b: DataFrame, op: Op, on=KEY) -> DataFrame:
    same = lambda x: x
    return merge(a, b, op, same, same, on)


def union_left(a: DataFrame, b: DataFrame, on=KEY) -> DataFrame:
    """All keys; a's value where both have one."""
    return a.select(*on, "val").unionByName(difference(b, a, on).select(*on, "val"))


def union_right(a: DataFrame, b: DataFrame, on=KEY) -> DataFrame:
    return union_left(b, a, on)


def tagged(parts: list[DataFrame], on=KEY) -> DataFrame:
    """All rows of all parts with the position ``at`` of their part."""
    return reduce(DataFrame.unionByName, [p.select(*on, "val", F.lit(k).alias("at")) for k, p in enumerate(parts)])


def union_many(parts: list[DataFrame], op: Op, on=KEY) -> DataFrame:
    """n-ary union; values of a key are folded by op in the order of the parts: op(first, op(second, ...))."""
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("at", "val"))))
    folded = tagged(parts, on).groupBy(*on).agg(rows.alias("xs"))
    rest, last = F.slice("xs", F.lit(2), F.size("xs")), F.get("xs", F.lit(0))["val"]
    return folded.select(*on, F.aggregate(rest, last, lambda acc, s: op(s["val"], acc)).alias("val"))


def union_first(parts: list[DataFrame], on=KEY) -> DataFrame:
    """n-ary union, the earliest part that has a key wins."""
    return tagged(parts, on).groupBy(*on).agg(F.min_by(F.struct("val"), "at")["val"].alias("val"))


def union_lists(parts: list[DataFrame], on=KEY) -> DataFrame:
    """n-ary union of arrays: those of a key joined in the order of the parts."""
    rows = F.array_sort(F.collect_list(F.struct("at", "val")))
    return tagged(parts, on).groupBy(*on).agg(F.flatten(F.transform(rows, lambda s: s["val"])).alias("val"))


def symmetric_difference(a: DataFrame, b: DataFrame, on=KEY) -> DataFrame:
    """Rows whose key only one side has."""
    return difference(a, b, on).select(*on, "val").unionByName(difference(b, a, on).select(*on, "val"))


def symmetric_difference_with(a: DataFrame, b: DataFrame, op: Op, on=KEY) -> DataFrame:
    """As symmetric_difference; keys of both stay with op(left, right) unless that is null."""
    out = _sides(a, b, on, "full")
    has = F.col("l").isNotNull() & F.col("r").isNotNull()
    out = out.withColumn("both", F.when(has, op(_l(), _r()))).where(~has | F.col("both").isNotNull())
    return out.select(*on, F.when(has, F.col("both")).when(F.col("l").isNotNull(), _l()).otherwise(_r()).alias("val"))
