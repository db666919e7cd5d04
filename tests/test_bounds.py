"""Work and memory that must not grow faster than the tables."""

import random

import pytest
from pyspark.sql import functions as F

from arcweave.functions import algebra as A
from arcweave.functions import paths
from arcweave.operators import products
from arcweave.operators.matrices import Matrix
from arcweave.operators.vectors import Vec
from arcweave.plans import components as parts
from arcweave.plans import graphs, levels, shared
from tests.test_loops import random_arcs


@pytest.mark.parametrize("block", [3, 40, 1_000_000])
def test_components_join_pieces(spark, block):
    arcs = random_arcs(block, 150, 130) + [(n, n + 1) for n in range(200, 300)] + [(400, 400)]
    df = spark.createDataFrame(arcs, "a bigint, b bigint")
    want = {tuple(r) for r in parts.components(df).collect()} | {(400, 400)}
    assert {tuple(r) for r in parts.components_by_pieces(df, block).collect()} == want


def test_component_rounds_get_pieces(spark, monkeypatch):
    """Rounds over a long chain see where blocks meet, not its links."""
    seen, whole = [], parts.components
    monkeypatch.setattr(parts, "components", lambda edges: seen.append(edges.count()) or whole(edges))
    found = graphs.weak_components(Matrix.of(spark.range(5000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))))
    assert found.agg(F.countDistinct("root")).first()[0] == 1 and seen[0] < 50


def test_levels_spare_the_last_product(spark):
    g = Matrix.of(spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src bigint, dst bigint"))
    calls = []
    step = lambda v, m: calls.append(1) or products.reached(v, m)
    assert {tuple(r) for r in levels.steps(Vec.keys_of(spark, [0]), g, step).select("level", "key").collect()} == {(0, 0), (1, 1), (2, 2)}
    assert len(calls) == 2


def test_paths_do_not_pass_through_the_aggregation(spark):
    rng = random.Random(5)
    arcs = [(a, b, rng.randrange(9)) for a, b in random_arcs(5, 30, 200)]
    m = Matrix.of(spark.createDataFrame(arcs, "src bigint, dst bigint, val bigint"), A.NUMBER)
    v = Vec(spark.range(3, 20).select(F.col("id").alias("key"), F.array(F.col("id") * 2).alias("val")), A.free("bigint"))
    got = products.extended_path(v, m).df
    least = {b: min(a for a, c, _ in arcs if c == b and 3 <= a < 20) for a, b, _ in arcs if 3 <= a < 20}
    assert {r.key: r.val for r in got.collect()} == {b: [2 * a, a] for b, a in least.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    width = {(a, b): w for a, b, w in arcs}
    start = Vec(spark.range(3, 20).select(F.col("id").alias("key"), F.struct(paths.empty_path().alias("path"), F.lit(5).cast("bigint").alias("width")).alias("val")), A.widest())
    wide = products.extended_bottleneck(start, m).df
    assert {r.key: (r.val.path, r.val.width) for r in wide.collect()} == {b: ([a], min(5, width[a, b])) for b, a in least.items()}


def test_session_follows_the_rows(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        shared.fit_session(spark, 600_000)
        assert spark.conf.get(names[0]) == before[names[0]]
        shared.fit_session(spark, 216_000_000)
        assert int(spark.conf.get(names[0])) == 864 and all(int(spark.conf.get(n).rstrip("b")) <= shared.TASK_BYTES for n in names[1:])
        spark.conf.set(names[2], "1m")
        shared.fit_session(spark, 1)
        assert spark.conf.get(names[2]) == "1m"
    finally:
        for n, x in before.items():
            spark.conf.set(n, x)


def test_stored_arcs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    arcs = spark.range(10).select(counted("id").alias("src"), (F.col("id") + 1).alias("dst"))
    g = Matrix.of(arcs).stored()
    assert made.value == 10 and g.rows.count() == 11
