"""Seeded random matrices with an exact number of cells: floor(density * cells of the shape).

Cells are numbered; which are filled is drawn among the numbers, so the work grows with the cells drawn, not with the shape.
"""

from __future__ import annotations

from math import log1p, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.algebra import NUMBER, UNIT, Algebra
from arcweave.operators.matrices import Matrix
from arcweave.plans.shared import written


def drawn(spark: SparkSession, total: int, n: int, seed: int) -> DataFrame:
    """(at): n different numbers below ``total``, any such set as likely as another, and the same for the same seed.

    Numbers are drawn with repetitions, the k-th draw by a hash of k, and the first n different ones are kept: of the draws
    that can be among them all but the last few are by a filter, and only those are sorted. Where more than half of all
    numbers are wanted those left out are drawn.
    """
    if n <= 0 or n >= total:
        return spark.range(total if n > 0 else 0).toDF("at")
    few = min(n, total - n)
    reach, slack = -total * log1p(-few / total), 12 * sqrt(few) + 40
    while True:
        draws = spark.range(int(reach + slack) + 1).select(F.col("id").alias("turn"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("at"))
        firsts = written(draws.groupBy("at").agg(F.min("turn").alias("turn")), "drawn")
        low = max(0, int(reach - slack))
        sure, found = firsts.agg(F.count_if(F.col("turn") < low), F.count("*")).first()
        if sure <= few <= found:
            break
        slack *= 4  # not to be expected
    rest = firsts.where(F.col("turn") >= low).orderBy("turn").limit(few - sure)
    chosen = firsts.where(F.col("turn") < low).unionByName(rest).select("at")
    return chosen if few == n else spark.range(total).toDF("at").join(chosen, "at", "left_anti")


def _valued(cells: DataFrame, low: int, high: int, seed: int, algebra: Algebra) -> DataFrame:
    span = max(1, high - low + 1)
    val: Column = F.lit(True) if algebra.kind == "boolean" else (F.lit(low) + F.pmod(F.xxhash64(F.lit(seed + 1), "src", "dst"), F.lit(span))).cast(algebra.kind)
    return cells.select("src", "dst", val.alias("val"))


def random_matrix(spark: SparkSession, rows: int, cols: int, density: float, bounds: tuple[int, int] = (0, 100), seed: int = 0, algebra: Algebra = NUMBER) -> Matrix:
    at = drawn(spark, rows * cols, int(rows * cols * density), seed)
    cells = at.select(F.expr(f"at div {max(cols, 1)}").alias("src"), (F.col("at") % max(cols, 1)).alias("dst"))
    return Matrix(_valued(cells, *bounds, seed, algebra), spark.range(rows), algebra)


def random_graph(spark: SparkSession, n: int, density: float, bounds: tuple[int, int] = (0, 100), seed: int = 0, algebra: Algebra = NUMBER) -> Matrix:
    return random_matrix(spark, n, n, density, bounds, seed, algebra)


def random_relation(spark: SparkSession, rows: int, cols: int, density: float, seed: int = 0) -> Matrix:
    return random_matrix(spark, rows, cols, density, (1, 1), seed, UNIT)


def random_diagonal(spark: SparkSession, n: int, density: float, bounds: tuple[int, int] = (0, 100), seed: int = 0, algebra: Algebra = NUMBER) -> Matrix:
    cells = drawn(spark, n, int(n * density), seed).select(F.col("at").alias("src"), F.col("at").alias("dst"))
    return Matrix(_valued(cells, *bounds, seed, algebra), spark.range(n), algebra)


def random_triangle(spark: SparkSession, n: int, density: float, bounds: tuple[int, int] = (0, 100), seed: int = 0, algebra: Algebra = NUMBER, strict: bool = False) -> Matrix:
    """Lower triangle, with the diagonal or (strict) without it."""
    total = n * (n - 1) // 2 if strict else n * (n + 1) // 2
    at = F.col("at")
    begins = lambda row: F.expr(f"({row}) * (({row}) + 1) div 2")  # noqa: E731  cells above a row
    # the root may be off by one where numbers are large; the row is put right in whole numbers
    near = drawn(spark, total, int(total * density), seed).withColumn("row", F.floor((F.sqrt(8.0 * at + 1) - 1) / 2))
    row = F.when(begins("row") > at, F.col("row") - 1).when(begins("row + 1") <= at, F.col("row") + 1).otherwise(F.col("row"))
    cells = near.withColumn("row", row).select((F.col("row") + int(strict)).alias("src"), (at - begins("row")).alias("dst"))
    return Matrix(_valued(cells, *bounds, seed, algebra), spark.range(n), algebra)
