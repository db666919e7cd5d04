"""Graphs from Python values and arrays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.algebra import UNIT, Algebra
from arcweave.operators.matrices import Matrix


def from_mat(spark: SparkSession, mat: Iterable[tuple[int, Iterable[tuple[int, object]]]], algebra: Algebra, validate: bool = False) -> Matrix:
    """From (row, [(column, value), ...]). With validate, rows must be 0 to n-1 in order and columns unique."""
    mat = [(r, list(arcs)) for r, arcs in mat]
    if validate and [r for r, _ in mat] != list(range(len(mat))):
        raise ValueError("rows must be numbered from 0 without gaps")
    cells: dict = {}
    for r, arcs in mat:
        for c, x in arcs:
            if validate and (r, c) in cells:
                raise ValueError(f"cell ({r}, {c}) occurs again")
            cells.setdefault((r, c), x)
    rows = spark.createDataFrame([(r,) for r in sorted({r for r, _ in mat})], "id bigint")
    return Matrix(spark.createDataFrame([(r, c, x) for (r, c), x in cells.items()], f"src bigint, dst bigint, val {algebra.kind}"), rows, algebra)


def from_rows(spark: SparkSession, rows: Iterable[Iterable[tuple[int, object]]], algebra: Algebra) -> Matrix:
    """Rows in order, numbered from 0."""
    return from_mat(spark, enumerate(rows), algebra)


def from_mappings(spark: SparkSession, rows: Iterable[dict[int, object]], algebra: Algebra) -> Matrix:
    return from_rows(spark, [r.items() for r in rows], algebra)


def from_adjacencies(spark: SparkSession, rows: Iterable[Iterable[int]]) -> Matrix:
    """Lists of successors, unit labels."""
    return from_rows(spark, [[(c, True) for c in r] for r in rows], UNIT)


def from_adjacency_column(df: DataFrame, id_col: str, arcs: Column, algebra: Algebra = UNIT) -> Matrix:
    """From a table with an array of successors (numbers, or structs dst and val) per row: nothing passes the driver."""
    exploded = df.select(F.col(id_col).cast("bigint").alias("src"), F.explode(arcs).alias("a"))
    labelled = "struct" in exploded.schema["a"].dataType.simpleString()
    cells = exploded.select("src", "a.dst", "a.val") if labelled else exploded.select("src", F.col("a").alias("dst"), F.lit(True).alias("val"))
    return Matrix.of(cells, algebra, df.select(F.col(id_col).cast("bigint").alias("id")).distinct())


def from_matrix_column(df: DataFrame, matrix: Column) -> Matrix:
    """From one row with an array of arrays of successors; positions are row numbers."""
    rows = df.select(F.posexplode(matrix).alias("id", "arcs"))
    return from_adjacency_column(rows, "id", F.col("arcs"))


def identity(spark: SparkSession, n: int, algebra: Algebra) -> Matrix:
    rows = spark.range(n)
    return Matrix(rows.limit(0).select(F.col("id").alias("src"), F.col("id").alias("dst"), algebra.one().cast(algebra.kind).alias("val")), rows, algebra).identity()


def empty(spark: SparkSession, n: int, algebra: Algebra = UNIT) -> Matrix:
    return identity(spark, n, algebra).emptied()


def read_edges(spark: SparkSession, path: str, fmt: str = "parquet", algebra: Algebra = UNIT, src: str = "src", dst: str = "dst", val: str | None = None, **options) -> Matrix:
    """From any table that Spark reads. Columns are pruned and filters pushed down by the reader."""
    df = spark.read.format(fmt).options(**options).load(path)
    cols = [F.col(src).alias("src"), F.col(dst).alias("dst")] + ([F.col(val).cast(algebra.kind).alias("val")] if val else [])
    return Matrix.of(df.select(*cols), algebra)


def write_edges(m: Matrix, path: str, fmt: str = "parquet") -> None:
    m.cells.write.format(fmt).save(path)


def domain(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    """A table val of all values of a finite algebra, for example of BALANCED_CODES."""
    return spark.createDataFrame([(v,) for v in values], "val string")
