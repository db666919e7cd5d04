"""Vectors: sparse maps from a key (bigint) to a label, one row (key, val) per filled key."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.algebra import UNIT, Algebra
from arcweave.operators import setops
from arcweave.plans.shared import written


@dataclass(frozen=True)
class Vec:
    df: DataFrame
    algebra: Algebra = UNIT

    # --- construction

    @staticmethod
    def of(spark: SparkSession, entries: Iterable[tuple[int, object]], algebra: Algebra, on_duplicate: str = "first") -> Vec:
        """From (key, value) pairs. Of repeated keys the first or the last stays, or they are an error."""
        rows = list(entries)
        kept: dict = {}
        for k, v in rows if on_duplicate != "last" else reversed(rows):
            if on_duplicate == "error" and k in kept:
                raise ValueError(f"key {k} occurs again")
            kept.setdefault(k, v)
        return Vec(spark.createDataFrame(sorted(kept.items()), f"key bigint, val {algebra.kind}"), algebra)

    @staticmethod
    def keys_of(spark: SparkSession, keys: Iterable[int]) -> Vec:
        """Unit labels on the given keys."""
        found = sorted(set(keys))
        return Vec(spark.createDataFrame(pa.table({"key": pa.array(found, pa.int64()), "val": pa.array([True] * len(found))})), UNIT)

    @staticmethod
    def empty(spark: SparkSession, algebra: Algebra = UNIT) -> Vec:
        return Vec(spark.createDataFrame([], f"key bigint, val {algebra.kind}"), algebra)

    @staticmethod
    def singleton(spark: SparkSession, key: int, val: Column, algebra: Algebra) -> Vec:
        return Vec(spark.range(key, key + 1).select(F.col("id").alias("key"), val.cast(algebra.kind).alias("val")), algebra)

    @staticmethod
    def unit(spark: SparkSession, key: int, algebra: Algebra) -> Vec:
        """One at the key."""
        return Vec.singleton(spark, key, algebra.one(), algebra)

    @staticmethod
    def first_keys(spark: SparkSession, n: int, val: Column, algebra: Algebra) -> Vec:
        """The keys 0 to n-1 with one value."""
        return Vec(spark.range(n).select(F.col("id").alias("key"), val.cast(algebra.kind).alias("val")), algebra)

    def like(self, df: DataFrame, algebra: Algebra | None = None) -> Vec:
        return replace(self, df=df, algebra=algebra or self.algebra)

    # --- reading

    def rows(self) -> DataFrame:
        return self.df.orderBy("key")

    def keys(self) -> DataFrame:
        return self.df.select("key").orderBy("key")

    def values(self) -> DataFrame:
        return self.df.orderBy("key").select("val")

    def size(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def some(self) -> DataFrame:
        """The row of the least key."""
        return self.df.orderBy("key").limit(1)

    def at(self, key: int) -> DataFrame:
        """The row of the key, or none."""
        return self.df.where(F.col("key") == key)

    def at_or(self, key: int, default: Column) -> DataFrame:
        """One row val: the label at the key, else the default."""
        return self.at(key).agg(F.coalesce(F.first(F.struct("val")), F.struct(default.cast(self.algebra.kind).alias("val")))["val"].alias("val"))

    def at_or_zero(self, key: int) -> DataFrame:
        return self.at_or(key, self.algebra.zero())

    def contains(self, key: int) -> bool:
        return not self.at(key).isEmpty()

    def least_entry(self, by: Callable[[Column], Column] = lambda v: v) -> DataFrame:
        """The row of the least value, leftmost of equals."""
        return self.df.orderBy(by(F.col("val")), "key").limit(1)

    def fold(self, merge: Callable[[Column, Column, Column], Column], start: Column, right: bool = True) -> DataFrame:
        """One row val: merge(key, value, rest) from the highest key down (right fold) or from the lowest up.

        Sequential by definition, as nothing is known of merge: one task and one array. Associative ones have ``reduced``.
        """
        xs = F.array_sort(F.collect_list(F.struct("key", "val")))
        return self.df.agg(F.aggregate(F.reverse(xs) if right else xs, start, lambda acc, s: merge(s["key"], s["val"], acc)).alias("val"))

    def bounds(self) -> DataFrame:
        return self.df.agg(F.min("key").alias("low"), F.max("key").alias("high"))

    def full_rows(self, n: int) -> DataFrame:
        """Keys 0 to n-1, null where nothing is filled."""
        return self.df.sparkSession.range(n).select(F.col("id").alias("key")).join(self.df, "key", "left")

    # --- values

    def map(self, f: Callable[[Column], Column], algebra: Algebra | None = None) -> Vec:
        return self.like(self.df.select("key", f(F.col("val")).alias("val")), algebra)

    def map_with_key(self, f: Callable[[Column, Column], Column], algebra: Algebra | None = None) -> Vec:
        return self.like(self.df.select("key", f(F.col("key"), F.col("val")).alias("val")), algebra)

    def with_keys(self) -> Vec:
        return self.map_with_key(lambda k, v: F.struct(k.alias("key"), v.alias("val")))

    def map_maybe(self, f: Callable[[Column], Column], algebra: Algebra | None = None) -> Vec:
        """Rows for which f is null go."""
        v = self.map(f, algebra)
        return v.like(v.df.where("val is not null"))

    def map_maybe_with_key(self, f: Callable[[Column, Column], Column], algebra: Algebra | None = None) -> Vec:
        v = self.map_with_key(f, algebra)
        return v.like(v.df.where("val is not null"))

    def filter(self, f: Callable[[Column], Column]) -> Vec:
        return self.like(self.df.where(f(F.col("val"))))

    def filter_with_key(self, f: Callable[[Column, Column], Column]) -> Vec:
        return self.like(self.df.where(f(F.col("key"), F.col("val"))))

    def below(self, n: int) -> Vec:
        return self.like(self.df.where(F.col("key") < n))

    def without_zeros(self) -> Vec:
        """Filled zeros go. Unit labels have no zero test and stay."""
        return self.filter(self.algebra.is_not_zero) if self.algebra.has_zero_test else self

    def constant(self, val: Column, algebra: Algebra) -> Vec:
        return self.map(lambda _: val, algebra)

    def units(self) -> Vec:
        return self.constant(F.lit(True), UNIT)

    def insert(self, key: int, val: Column, op: Callable[[Column, Column], Column] = lambda new, old: new) -> Vec:
        one = Vec.singleton(self.df.sparkSession, key, val, self.algebra)
        return self.like(setops.union_with(one.df, self.df, op))

    def delete(self, key: int) -> Vec:
        return self.like(self.df.where(F.col("key") != key))

    # --- arithmetic

    def plus(self, other: Vec, drop_zeros: bool = False) -> Vec:
        both = setops.tagged([self.df, other.df])
        out = self.like(both.groupBy("key").agg(self.algebra.total(F.col("val"), F.col("at")).alias("val")))
        return out.without_zeros() if drop_zeros else out

    def minus(self, other: Vec, drop_zeros: bool = False) -> Vec:
        return self.plus(other.negated(), drop_zeros)

    def negated(self) -> Vec:
        return self.map(self.algebra.negative)

    def scaled(self, s: Column, drop_zeros: bool = False) -> Vec:
        """s ⊗ v. With drop_zeros a zero factor leaves nothing and a factor one leaves all."""
        out = self.map(lambda v: self.algebra.times(s, v))
        return out.without_zeros() if drop_zeros else out

    def total(self) -> DataFrame:
        """One row val: the ⊕ of all labels, zero of none."""
        return self.df.agg(self.algebra.total_or_zero(F.col("val"), F.col("key")).alias("val"))

    def reduced(self, merge: Callable[[Column, Column], Column], width: int = 1024) -> DataFrame:
        """One row val: all labels merged by ascending key, null of none. For associative merges, commutative or not.

        Keys are dealt by range and sorted within; every ``width`` neighbours (a power of two) become one partial label at
        the place of their least key, until so few are left that one row holds them. No array is longer than ``width``.
        """
        joined = lambda xs: F.aggregate(F.slice(xs, F.lit(2), F.size(xs)), F.get(xs, F.lit(0))["val"], lambda acc, s: merge(acc, s["val"]))
        listed = F.array_sort(F.collect_list(F.struct("key", "val"))).alias("xs")
        rows = self.df.select("key", F.col("val").cast(self.algebra.kind).alias("val"))
        while rows.count() > width:
            dealt = rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("at", F.shiftright(F.monotonically_increasing_id(), width.bit_length() - 1))
            parts = dealt.groupBy("at").agg(listed)
            rows = written(parts.select(F.get("xs", F.lit(0))["key"].alias("key"), joined(F.col("xs")).alias("val")), "partial")
        return rows.agg(listed).select(F.when(F.size("xs") > 0, joined(F.col("xs"))).alias("val"))

    def product(self) -> DataFrame:
        """One row val: the ⊗ of all labels by ascending key, one of none."""
        kind, times = self.algebra.kind, self.algebra.times
        return self.reduced(lambda a, b: times(a, b).cast(kind)).select(F.coalesce("val", self.algebra.one().cast(kind)).alias("val"))

    def greatest(self) -> DataFrame:
        """One row val: the greatest number, at least 0."""
        return self.df.agg(F.greatest(F.coalesce(F.max("val"), F.lit(0)), F.lit(0)).cast(self.algebra.kind).alias("val"))

    def with_greatest(self) -> DataFrame:
        """Rows (key, val) whose value is the greatest, floored at 0: a vector of negative numbers has none."""
        top = self.greatest().withColumnRenamed("val", "top")
        return self.df.join(F.broadcast(top), F.col("val") == F.col("top")).select("key", "val")  # one row

    def restrict_to_greatest(self) -> Vec:
        return self.like(self.with_greatest())

    def greatest_keys(self) -> DataFrame:
        return self.with_greatest().select("key")

    # --- sets

    def intersect(self, other: Vec, op: Callable[[Column, Column], Column]) -> Vec:
        return self.like(setops.intersect(self.df, other.df, op))

    def keep(self, other: Vec) -> Vec:
        return self.like(setops.keep_left(self.df, other.df))

    def drop(self, other: Vec) -> Vec:
        return self.like(setops.difference(self.df, other.df))

    def union(self, other: Vec) -> Vec:
        return self.like(setops.union_left(self.df, other.df))

    def union_with(self, other: Vec, op: Callable[[Column, Column], Column]) -> Vec:
        return self.like(setops.union_with(self.df, other.df, op))

    def symmetric_difference(self, other: Vec) -> Vec:
        return self.like(setops.symmetric_difference(self.df, other.df))
