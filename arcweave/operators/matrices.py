"""Matrices and graphs: cells (src, dst, val) and the table of rows (id), which may hold rows without a cell.

A filled zero differs from an absent cell. Operations with ``drop_zeros`` remove zeros, the others keep them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.algebra import BOOL, UNIT, Algebra
from arcweave.functions.paths import arcs_of
from arcweave.operators import setops
from arcweave.operators.setops import CELL
from arcweave.operators.vectors import Vec
from arcweave.plans.shared import written

Op = Callable[[Column, Column], Column]


def ends_of(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@dataclass(frozen=True)
class Matrix:
    cells: DataFrame
    rows: DataFrame
    algebra: Algebra = UNIT
    kept: bool = False
    #: Known to hold every arc both ways; False where that is not known.
    both_ways: bool = False
    #: Rows are the ends of these arcs, no table of their own.
    ends: bool = False

    @staticmethod
    def of(cells: DataFrame, algebra: Algebra = UNIT, rows: DataFrame | None = None) -> Matrix:
        """From cells (src, dst, val; unit labels if there is no val); rows default to all ends of arcs."""
        if "val" not in cells.columns:
            cells = cells.withColumn("val", F.lit(True))
        cells = cells.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "val")
        return Matrix(cells, ends_of(cells) if rows is None else rows, algebra, ends=rows is None)

    def like(self, cells: DataFrame, algebra: Algebra | None = None, rows: DataFrame | None = None) -> Matrix:
        return replace(self, cells=cells.select("src", "dst", "val"), algebra=algebra or self.algebra, rows=self.rows if rows is None else rows, kept=False, both_ways=False, ends=False)

    def stored(self) -> Matrix:
        """The same matrix as tables in the shared folder, for loops that read it in every round; once is enough."""
        if self.kept:
            return self
        cells = written(self.cells, "cells")
        # ends are those of the written arcs: what arcs are made from is not gone through again
        rows = self.rows if not self.ends else cells.select(F.col("src").alias("id")).distinct() if self.both_ways else ends_of(cells)
        return replace(self, cells=cells, rows=written(rows, "rows"), kept=True)

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    def validated(self) -> Matrix:
        """Checks unique cells and that every source is a row; raises ValueError."""
        if not self.cells.groupBy("src", "dst").count().where("count > 1").isEmpty():
            raise ValueError("a cell occurs twice")
        if not self.cells.join(self.rows, F.col("src") == F.col("id"), "left_anti").isEmpty():
            raise ValueError("a source is no row")
        return self

    # --- reading

    def to_rows(self) -> DataFrame:
        """(id, row): each row's arcs (dst, val) by ascending dst; empty arrays for rows without cells."""
        arcs = self.cells.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "val"))).alias("row"))
        return self.rows.join(arcs, "id", "left").select("id", F.coalesce("row", F.array().cast(arcs.schema["row"].dataType)).alias("row")).orderBy("id")

    def show_rows(self) -> DataFrame:
        """(id, line): each row as text."""
        return self.to_rows().select("id", F.concat_ws(" ", F.transform("row", lambda a: F.concat(a["dst"].cast("string"), F.lit(":"), a["val"].cast("string")))).alias("line"))

    def is_empty(self) -> bool:
        return self.cells.isEmpty()

    def row(self, k: int) -> Vec:
        return Vec(self.cells.where(F.col("src") == k).select(F.col("dst").alias("key"), "val"), self.algebra)

    def column(self, k: int) -> Vec:
        return Vec(self.cells.where(F.col("dst") == k).select(F.col("src").alias("key"), "val"), self.algebra)

    def at(self, src: int, dst: int, default: Column | None = None) -> DataFrame:
        """One row val: the label of the cell, else the default (zero)."""
        return self.row(src).at_or(dst, self.algebra.zero() if default is None else default)

    def row_numbers(self) -> DataFrame:
        return self.rows.orderBy("id")

    def n_rows(self) -> int:
        return self.rows.count()

    def n_arcs(self) -> int:
        return self.cells.count()

    def vertices(self) -> Vec:
        return Vec(self.rows.select(F.col("id").alias("key"), F.lit(True).alias("val")))

    def with_successors(self) -> Vec:
        return Vec(self.rows.join(self.cells, F.col("id") == F.col("src"), "left_semi").select(F.col("id").alias("key"), F.lit(True).alias("val")))

    def without_successors(self) -> Vec:
        return Vec(self.rows.join(self.cells, F.col("id") == F.col("src"), "left_anti").select(F.col("id").alias("key"), F.lit(True).alias("val")))

    def successors(self, v: int, f: Callable[[Column], Column] = lambda x: x) -> Vec:
        return self.row(v).map(f)

    def predecessors(self, v: int, f: Callable[[Column], Column] = lambda x: x) -> Vec:
        """No transposed copy is needed: a filter on dst."""
        return self.column(v).map(f)

    # --- cells and rows

    def map(self, f: Callable[[Column], Column], algebra: Algebra | None = None) -> Matrix:
        return self.like(self.cells.select("src", "dst", f(F.col("val")).alias("val")), algebra)

    def map_with_keys(self, f: Callable[[Column, Column, Column], Column], algebra: Algebra | None = None) -> Matrix:
        return self.like(self.cells.select("src", "dst", f(F.col("src"), F.col("dst"), F.col("val")).alias("val")), algebra)

    def map_rows(self, f: Callable[[DataFrame], DataFrame], algebra: Algebra | None = None) -> Matrix:
        """f on the cells of all rows at once (use src as the key of a row)."""
        return self.like(f(self.cells), algebra)

    def per_vertex(self, agg: Column) -> DataFrame:
        """(id, val): an aggregate of each row's cells (columns dst, val); null for rows without cells."""
        return self.rows.join(self.cells.groupBy("src").agg(agg.alias("val")), F.col("id") == F.col("src"), "left").select("id", "val")

    def filter(self, f: Callable[[Column], Column]) -> Matrix:
        return self.like(self.cells.where(f(F.col("val"))))

    def filter_rows(self, having: Column) -> Matrix:
        """Rows stay if the aggregate condition over their cells holds (others lose their cells and themselves)."""
        kept = self.cells.groupBy("src").agg(having.alias("ok")).where("ok").select("src")
        return self.like(self.cells.join(kept, "src", "left_semi"), rows=self.rows.join(kept, F.col("id") == F.col("src"), "left_semi"))

    def without_zeros(self) -> Matrix:
        return self.filter(self.algebra.is_not_zero) if self.algebra.has_zero_test else self

    def units(self) -> Matrix:
        return self.map(lambda _: F.lit(True), UNIT)

    def booleans(self) -> Matrix:
        return self.map(lambda _: F.lit(True), BOOL)

    def constant(self, val: Column, algebra: Algebra) -> Matrix:
        return self.map(lambda _: val.cast(algebra.kind), algebra)

    def emptied(self) -> Matrix:
        return self.like(self.cells.where(F.lit(False)))

    def identity(self) -> Matrix:
        return self.like(self.rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), self.algebra.one().cast(self.algebra.kind).alias("val")))

    def partial_identity(self, keys: Vec, n: int | None = None) -> Matrix:
        """One on the diagonal at the keys; rows are 0 to n-1 (or these rows) and the keys."""
        base = self.rows if n is None else self.spark.range(n)
        cells = keys.df.select(F.col("key").alias("src"), F.col("key").alias("dst"), self.algebra.one().cast(self.algebra.kind).alias("val"))
        return self.like(cells, rows=base.union(keys.df.select("key")).distinct())

    def put(self, src: int, dst: int, val: Column, op: Op = lambda new, old: new) -> Matrix:
        """Fills or changes one cell; nothing happens if there is no such row."""
        one = self.rows.where(F.col("id") == src).select(F.col("id").alias("src"), F.lit(dst).cast("bigint").alias("dst"), val.cast(self.algebra.kind).alias("val"))
        return self.like(setops.union_with(one, self.cells, op, CELL))

    def add_arc(self, src: int, dst: int, val: Column) -> Matrix:
        return self.put(src, dst, val)

    def add_edge(self, a: int, b: int, val: Column) -> Matrix:
        return self.put(a, b, val).put(b, a, val)

    def add_path(self, path: Column, label: Column, both_ways: bool = False) -> Matrix:
        """The arcs of a path over these cells; of a repeated arc the first occurrence wins."""
        arcs = self.spark.range(1).select(F.posexplode(arcs_of(path)).alias("at", "arc")).select("at", "arc.src", "arc.dst")
        if both_ways:
            arcs = arcs.unionByName(arcs.select("at", F.col("dst").alias("src"), F.col("src").alias("dst")))
        new = arcs.groupBy("src", "dst").agg(F.min("at")).select("src", "dst", label.cast(self.algebra.kind).alias("val"))
        rows = self.rows.union(new.select("src")).distinct()
        return self.like(setops.union_left(new, self.cells, CELL), rows=rows)

    # --- arithmetic

    def plus(self, other: Matrix, drop_zeros: bool = False) -> Matrix:
        both = setops.tagged([self.cells, other.cells], CELL)
        cells = both.groupBy("src", "dst").agg(self.algebra.total(F.col("val"), F.col("at")).alias("val"))
        out = self.like(cells, rows=self.rows.union(other.rows).distinct())
        return out.without_zeros() if drop_zeros else out

    def negated(self) -> Matrix:
        return self.map(self.algebra.negative)

    def minus(self, other: Matrix) -> Matrix:
        """Difference; zeros go."""
        return self.plus(other.negated(), drop_zeros=True)

    def scaled(self, s: Column, drop_zeros: bool = False) -> Matrix:
        out = self.map(lambda v: self.algebra.times(s, v))
        return out.without_zeros() if drop_zeros else out

    def transposed(self, rows: DataFrame | None = None) -> Matrix:
        """Cells turned around. Rows: the given ones (default: these) and all former columns."""
        cells = self.cells.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "val")
        base = self.rows if rows is None else rows
        return self.like(cells, rows=base.union(cells.select("src")).distinct())

    def transposed_square(self) -> Matrix:
        """As transposed, but only sources 0 to n-1 take part, n the number of rows."""
        n = self.n_rows()
        return self.like(self.cells.where((F.col("src") >= 0) & (F.col("src") < n))).transposed(self.spark.range(n))

    def transposed_of_width(self, n: int) -> Matrix:
        return self.transposed(self.spark.range(n))

    def symmetric_with(self, op: Op) -> Matrix:
        """op(cell, turned cell) where both are filled, else the filled one."""
        other = self.transposed()
        return self.like(setops.union_with(self.cells, other.cells, op, CELL), rows=other.rows)

    def symmetric(self, drop_zeros: bool = False) -> Matrix:
        """Sum with the transpose; a cell on the diagonal is added to itself."""
        return self.plus(self.transposed(), drop_zeros)

    # --- sets of cells

    def restrict_rows(self, keys: Vec) -> Matrix:
        return self.like(self.cells.join(keys.df.select(F.col("key").alias("src")), "src", "left_semi"))

    def restrict_columns(self, keys: Vec) -> Matrix:
        return self.like(self.cells.join(keys.df.select(F.col("key").alias("dst")), "dst", "left_semi"))

    def drop_vertices(self, keys: DataFrame) -> Matrix:
        """Without the vertices (column key) and their arcs."""
        gone = keys.select("key")
        cells = self.cells.join(gone.withColumnRenamed("key", "src"), "src", "left_anti").join(gone.withColumnRenamed("key", "dst"), "dst", "left_anti")
        return self.like(cells, rows=self.rows.join(gone, F.col("id") == F.col("key"), "left_anti"))

    def intersect(self, other: Matrix, op: Op) -> Matrix:
        return self.like(setops.intersect(self.cells, other.cells, op, CELL))

    def keep(self, other: Matrix) -> Matrix:
        return self.like(setops.keep_left(self.cells, other.cells, CELL))

    def keep_other(self, other: Matrix) -> Matrix:
        """Cells of both with the other's labels."""
        return self.like(setops.keep_right(self.cells, other.cells, CELL), other.algebra)

    def drop(self, other: Matrix) -> Matrix:
        return self.like(setops.difference(self.cells, other.cells, CELL))

    def union(self, other: Matrix) -> Matrix:
        return self.like(setops.union_left(self.cells, other.cells, CELL), rows=self.rows.union(other.rows).distinct())

    def symmetric_difference(self, other: Matrix) -> Matrix:
        return self.like(setops.symmetric_difference(self.cells, other.cells, CELL), rows=self.rows.union(other.rows).distinct())

    def common_arcs(self, other: Matrix) -> Matrix:
        """Arcs of both, with unit labels."""
        return self.keep(other).units()

    # --- order of labels

    def at_most(self, other: Matrix) -> bool:
        """Whether every cell a has a ⊕ b = b with the other's cell b (absent: zero)."""
        a, zero = self.algebra, self.algebra.zero()
        wide = self.cells.join(other.cells.withColumnRenamed("val", "other"), ["src", "dst"], "left")
        return wide.where(~a.at_most(F.col("val"), F.coalesce("other", zero.cast(a.kind)))).isEmpty()

    def equals(self, other: Matrix) -> bool:
        """The same filled cells with the same labels."""
        wide = self.cells.join(other.cells.select("src", "dst", F.struct("val").alias("o")), ["src", "dst"], "full")
        return wide.where(F.col("o").isNull() | ~F.struct("val").eqNullSafe(F.col("o"))).isEmpty() and self.n_arcs() == other.n_arcs()
