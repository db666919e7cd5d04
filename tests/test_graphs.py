"""Golden values of small graphs, and two ways to the same answer."""

import random

import pytest
from pyspark.sql import functions as F

from arcweave.functions import algebra as A
from arcweave.functions import paths as P
from arcweave.operators import products, setops
from arcweave.operators.matrices import Matrix
from arcweave.operators.vectors import Vec
from arcweave.plans import closure, graphs, levels, social, voting
from arcweave.sources import build, random_graphs

D1 = [(0, 1, 2), (0, 2, 5), (1, 2, 1), (1, 3, 4), (2, 3, 1), (3, 4, 3), (4, 1, 2)]
B1 = [(0, 3), (0, 4), (1, 4), (2, 4), (2, 5)]
F1 = [(0, 1, 10), (0, 2, 8), (1, 3, 5), (1, 4, 4), (2, 1, 2), (2, 4, 7), (4, 3, 3), (3, 5, 9), (4, 5, 6)]


def matrix(spark, n, arcs, algebra=A.NUMBER):
    cells = spark.createDataFrame(arcs, f"src bigint, dst bigint, val {algebra.kind}")
    return Matrix(cells, spark.range(n), algebra)


def both_ways(spark, n, pairs, algebra=A.UNIT, label=True):
    arcs = [(a, b, *(x or [label])) for a, b, *x in pairs] + [(b, a, *(x or [label])) for a, b, *x in pairs]
    return matrix(spark, n, arcs, algebra)


def cells(m):
    return {(r.src, r.dst): r.val for r in m.cells.collect()}


def entries(v):
    return {r.key: r.val for r in v.df.collect()}


@pytest.fixture(scope="module")
def d1(spark):
    return matrix(spark, 6, D1)


def test_products(spark, d1):
    ones = Vec.of(spark, [(0, 1), (1, 1), (2, 1)], A.NUMBER)
    assert entries(products.vec_mat(ones, d1)) == {1: 2, 2: 6, 3: 5}
    trop = d1.map(A.finite, A.TROPICAL)
    got = products.vec_mat(ones.map(A.finite, A.TROPICAL), trop).map(A.weight_of)
    assert entries(got) == {1: 3, 2: 2, 3: 2}
    assert cells(products.mat_mat(d1, d1)) == {(0, 2): 2, (0, 3): 13, (1, 3): 1, (1, 4): 12, (2, 4): 3, (3, 1): 6, (4, 2): 2, (4, 3): 8}
    assert entries(products.least_predecessor(ones, d1)) == {1: 0, 2: 0, 3: 1}
    assert entries(products.first_matrix_label(ones, d1)) == {1: 2, 2: 5, 3: 4}
    paths = Vec(ones.df.select("key", F.array(F.array().cast("array<bigint>")).alias("val")))
    assert entries(products.extended_paths(paths, d1)) == {1: [[0]], 2: [[0], [1]], 3: [[1], [2]]}


def test_levels(spark, d1):
    def at(*start):
        out = {}
        for r in levels.distance(Vec.keys_of(spark, start), d1).collect():
            out.setdefault(r.level, set()).add(r.key)
        return [out[k] for k in sorted(out)]

    assert at(0) == [{0}, {1, 2}, {3}, {4}]
    assert at(1, 4) == [{1, 4}, {2, 3}]
    assert at(5) == [{5}]
    two = levels.steps(Vec.keys_of(spark, [0]), [d1, d1], products.reached)
    assert {(r.level, r.key) for r in two.collect()} == {(0, 0), (1, 2), (1, 3), (2, 4), (2, 1)}


def test_closures(spark, d1):
    want = {0: {1: 2, 2: 3, 3: 4, 4: 7}, 1: {1: 7, 2: 1, 3: 2, 4: 5}, 2: {1: 6, 2: 7, 3: 1, 4: 4}, 3: {1: 5, 2: 6, 3: 7, 4: 3}, 4: {1: 2, 2: 3, 3: 4, 4: 7}}
    flat = {(a, b): w for a, r in want.items() for b, w in r.items()}
    trop = d1.map(A.finite, A.TROPICAL)
    squared = closure.closure(trop).map(A.weight_of, A.NUMBER)
    assert cells(squared) == flat
    assert cells(closure.pivot_closure(trop).map(A.weight_of, A.NUMBER)) == flat
    assert len(squared.to_rows().collect()) == 6
    star = cells(closure.star_closure(matrix(spark, 6, D1, A.LEAST)))
    assert star == {**flat, **{(k, k): 0 for k in range(6)}}
    with pytest.raises(ValueError):
        closure.closure(matrix(spark, 2, [(0, 1, -1)], A.LEAST))


def test_regular_closure(spark):
    m = matrix(spark, 2, [(0, 1, "a"), (1, 0, "b")], A.Algebra("text", "string", None, None, None, None, None)).map(A.letter, A.REGULAR)
    got = closure.closure(m)
    assert set(cells(got)) == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_geodesics_and_betweenness(spark, d1):
    g = {(r.src, r.dst): (r.len, int(r.cnt)) for r in closure.geodesics(d1).collect()}
    assert (g[0, 3], g[0, 4], g[1, 1]) == ((2, 2), (3, 2), (3, 1))
    assert {r.id: r.val for r in social.betweenness(d1).collect()} == {0: 0, 1: 7, 2: 1, 3: 7, 4: 6, 5: 0}
    assert {r.id: r.val for r in social.betweenness(d1, closed_walks=False).collect()} == {0: 0, 1: 4, 2: 1, 3: 4, 4: 3, 5: 0}
    w = {(r.src, r.dst): (r.len, int(r.cnt)) for r in closure.weighted_geodesics(d1).collect()}
    assert w[0, 2] == (3, 1) and w[0, 3] == (4, 1)


def test_bipartite_matching_cover(spark):
    g = both_ways(spark, 7, B1)
    side = {r.key: r.side for r in graphs.bipartition(g).collect()}
    assert {k for k, s in side.items() if s == 0} == {0, 1, 2, 6} and {k for k, s in side.items() if s == 1} == {3, 4, 5}
    one, _ = graphs.maximum_matching(g)
    many, rest = graphs.maximum_matching_by_phases(g)
    assert one.n_arcs() == many.n_arcs() == 6 and many.n_arcs() + rest.n_arcs() == 10
    cover = {r.key for r in graphs.minimum_vertex_cover(g).collect()}
    assert len(cover) == 3 and all(a in cover or b in cover for a, b in B1)
    assert {r.key for r in graphs.approximate_vertex_cover(g).collect()} == {0, 1, 2, 3, 4, 5}
    triangle = both_ways(spark, 3, [(0, 1), (1, 2), (0, 2)])
    assert not graphs.is_bipartite(triangle) and graphs.minimum_vertex_cover(triangle) is None
    assert {r.key for r in graphs.approximate_vertex_cover(triangle).collect()} == {0, 1}
    for h in (g, triangle):
        assert graphs.is_bipartite_by_closure(h) == graphs.is_bipartite_by_even_walks(h) == graphs.is_bipartite(h)


def test_random_bipartite_graphs(spark):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(6), 6 + rng.randrange(6)) for _ in range(12)})
    g = both_ways(spark, 12, pairs)
    match = {}

    def grow(u, seen):
        for a, b in pairs:
            if a == u and b not in seen:
                seen.add(b)
                if b not in match or grow(match[b], seen):
                    match[b] = u
                    return True
        return False

    best = sum(grow(u, set()) for u in range(6))
    assert graphs.maximum_matching_by_phases(g)[0].n_arcs() == 2 * best
    assert graphs.minimum_vertex_cover(g).count() == best


def test_flow(spark):
    c = matrix(spark, 6, F1)
    flow, residual = graphs.maximum_flow(c, 0, 5)
    assert cells(flow) == {(0, 1): 9, (0, 2): 5, (1, 3): 5, (1, 4): 4, (2, 4): 5, (4, 3): 3, (3, 5): 8, (4, 5): 6}
    cut = graphs.minimum_cut(residual, 0)
    assert {r.key for r in cut.collect()} == {0, 1, 2, 4}
    assert graphs.cut_capacity(c, cut).first().val == 14
    left = {r.key: r.val for r in graphs.balance(flow).collect()}
    assert left[0] == 14 and left[5] == -14 and all(left[k] == 0 for k in (1, 2, 3, 4))
    with pytest.raises(ValueError):
        graphs.maximum_flow(c, 0, 0)


def test_signed(spark):
    sign = A.Algebra("sign", "string", None, None, None, None, None)
    cases = {
        (True, True): [(0, 1, "+"), (2, 3, "+"), (1, 2, "-"), (0, 3, "-")],
        (False, True): [(0, 1, "-"), (1, 2, "-"), (0, 2, "-")],
        (False, False): [(0, 1, "+"), (1, 2, "+"), (0, 2, "-")],
    }
    for (balanced, clustered), pairs in cases.items():
        g = both_ways(spark, 4, pairs, sign)
        assert social.is_balanced(g) == social.is_balanced_by_walks(g) == balanced
        assert social.is_clustered(g) == social.is_clustered_by_closure(g) == social.is_clustered_by_walks(g) == clustered


def test_voting(spark):
    v = matrix(spark, 6, [(a, b, True) for a, bs in enumerate([[0, 1], [0], [0, 2], [1], [2], []]) for b in bs], A.UNIT)
    assert entries(voting.results(v)) == {0: 3, 1: 2, 2: 2}
    assert entries(voting.winners(v)) == {0: 3}
    assert [voting.at_least(v, a).first().val for a in range(4)] == [0, 1, 1, 3]
    got = [tuple(voting.minimal_removal(v, a).first()) for a in range(4)]
    assert got == [(1, []), (2, [1]), (1, [0]), (36, [0, 1, 2, 3, 4])]


def test_components(spark):
    g = matrix(spark, 8, [(0, 1, True), (2, 1, True), (4, 5, True), (6, 5, True)], A.UNIT)
    assert {r.id: r.root for r in graphs.weak_components(g).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7}
    assert {(r.root, r.key) for r in graphs.collections(g).collect()} == {(0, 0), (0, 1), (2, 2), (3, 3), (4, 4), (4, 5), (6, 6), (7, 7)}


def test_disjoint_paths(spark):
    m = matrix(spark, 7, [(0, 2, True), (1, 2, True), (1, 3, True), (2, 4, True), (3, 5, True), (2, 5, True)], A.UNIT)
    found = levels.disjoint_paths(Vec.keys_of(spark, [0, 1]), Vec.keys_of(spark, [4, 5]), m)
    assert {tuple(r.path) for r in found.collect()} == {(0, 2, 4), (1, 3, 5)}
    shared = levels.disjoint_paths(Vec.keys_of(spark, [0, 1]), Vec.keys_of(spark, [4, 5]), m, share_end=True)
    assert {tuple(r.path) for r in shared.collect()} == {(0, 2, 4), (1, 3, 5)}


def test_sets(spark):
    a, b = Vec.of(spark, [(1, 1), (2, 2)], A.NUMBER), Vec.of(spark, [(2, 20), (3, 30)], A.NUMBER)
    got = lambda df: {r.key: r.val for r in df.collect()}
    assert got(setops.union_left(a.df, b.df)) == {1: 1, 2: 2, 3: 30}
    assert got(setops.union_right(a.df, b.df)) == {1: 1, 2: 20, 3: 30}
    assert got(setops.union_many([a.df, b.df, a.df], lambda x, y: x * 100 + y)) == {1: 101, 2: 2 * 100 + 20 * 100 + 2, 3: 30}
    assert got(setops.difference_with(a.df, b.df, lambda x, y: F.lit(None).cast("bigint"))) == {1: 1}
    assert got(setops.symmetric_difference(a.df, b.df)) == {1: 1, 3: 30}
    assert got(a.plus(b).df) == {1: 1, 2: 22, 3: 30}
    assert got(a.minus(a, drop_zeros=True).df) == {}
    assert Vec.of(spark, [(1, 5), (1, 6)], A.NUMBER, "last").total().first().val == 6


def test_matrix_algebra(spark, d1):
    assert cells(d1.transposed().transposed()) == cells(d1)
    assert cells(d1.minus(d1)) == {}
    assert cells(d1.symmetric())[1, 0] == 2
    assert d1.put(0, 1, F.lit(9)).at(0, 1).first().val == 9
    assert cells(d1.put(77, 1, F.lit(9))) == cells(d1)
    assert d1.at(5, 5).first().val == 0
    assert d1.equals(d1.transposed().transposed()) and not d1.equals(d1.transposed())
    assert {r.id: r.row for r in d1.to_rows().collect()}[5] == []
    m = build.from_adjacencies(spark, [[1, 2], [], [0]])
    assert set(cells(m)) == {(0, 1), (0, 2), (2, 0)} and m.n_rows() == 3
    p = build.empty(spark, 4).add_path(P.path_of([0, 1, 2, 1]), F.lit(True))
    assert set(cells(p)) == {(0, 1), (1, 2), (2, 1)}


def test_random_graphs(spark):
    assert random_graphs.random_graph(spark, 7, 0.3, seed=1).n_arcs() == 14
    assert random_graphs.random_triangle(spark, 6, 1.0, strict=True).n_arcs() == 15
    assert random_graphs.random_diagonal(spark, 6, 0.5).n_arcs() == 3
    same = [cells(random_graphs.random_matrix(spark, 3, 4, 0.5, seed=9)) for _ in range(2)]
    assert same[0] == same[1]


def test_paths(spark):
    row = spark.range(1).select(
        P.arcs_of(P.path_of([1, 2, 3])).alias("arcs"), P.arcs_of(P.empty_path()).alias("none"),
        P.reverse_path(P.step_right(P.path_of([1]), F.lit(2).cast("bigint"))).alias("rev"),
        P.interleaved(P.labelled_from(F.lit(1), F.array(F.struct(F.lit("x").alias("label"), F.lit(2).alias("vertex"))))).alias("mix"),
    ).first()
    assert [tuple(x) for x in row.arcs] == [(1, 2), (2, 3)] and row.none == [] and row.rev == [2, 1]
    assert [tuple(x) for x in row.mix] == [(1, None), (None, "x"), (2, None)]


def test_streamed_edges(spark, tmp_path):
    from arcweave.streaming import edges

    src = str(tmp_path / "in")
    schema = "src bigint, dst bigint, val bigint"
    spark.createDataFrame([(0, 1, 2), (0, 1, 3)], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = edges.maintain(stream, str(tmp_path / "out"), A.NUMBER, str(tmp_path / "cp"))
    q.processAllAvailable()
    spark.createDataFrame([(0, 1, 5), (1, 0, 1)], schema).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert cells(edges.version(spark, str(tmp_path / "out"), 1, A.NUMBER)) == {(0, 1): 10, (1, 0): 1}


# --- laws of closures on random matrices, strategies, components


@pytest.mark.parametrize("algebra", [A.BOOL, A.TROPICAL, A.pair(A.BOOL, A.TROPICAL)], ids=lambda a: a.name)
def test_closure_laws(spark, algebra):
    """The star is one plus a·star and one plus star·a, and the least solution x of x = b + a·x is star·b."""
    def labels(seed):
        m = random_graphs.random_graph(spark, 6, 0.3, (1, 9), seed)
        one = {"bool": lambda v: v % 2 == 0, "tropical": A.finite}
        made = {**one, "(bool, tropical)": lambda v: F.struct((v % 2 == 0).alias("_1"), A.finite(v).alias("_2"))}
        return m.map(made[algebra.name], algebra).stored()

    a, b = labels(1), labels(2)
    star = closure.star_closure(a).stored()
    for two in (products.mat_mat(a, star), products.mat_mat(star, a)):
        assert two.plus(a.identity()).without_zeros().equals(star)
    x = products.mat_mat(star, b).stored()
    assert b.plus(products.mat_mat(a, x)).without_zeros().equals(x.without_zeros())
    # from below: the rounds from b on stay under x and end there
    y = b
    for _ in range(6):
        y = b.plus(products.mat_mat(a, y)).stored()
        assert y.at_most(x)
    assert y.without_zeros().equals(x.without_zeros())


def test_componentwise_on_directed_graphs(spark):
    """Roots are taken in order, each among the vertices left."""
    cells = spark.createDataFrame([(2, 0, True), (0, 1, True), (3, 2, True), (3, 4, True)], "src bigint, dst bigint, val boolean")
    g = Matrix.of(cells, A.UNIT, spark.range(6))
    got = graphs.componentwise(g, lambda start, m, within: levels.distance(start, m, within).withColumn("seen", F.lit("x")))
    assert {(r.root, r.level, r.key, r.seen) for r in got.collect()} == {(0, 0, 0, "x"), (0, 1, 1, "x"), (2, 0, 2, "x"), (3, 0, 3, "x"), (3, 1, 4, "x"), (5, 0, 5, "x")}
    none = Matrix.of(cells.limit(0), A.UNIT, spark.range(0))
    assert graphs.componentwise(none, lambda s, m, w: levels.distance(s, m, w)).columns == ["root", "level", "key"]


def test_random_draw_is_exact(spark):
    """So many different numbers, the first of a long row of draws, whatever the tasks; work by the numbers drawn."""
    for total, n in ((2000, 0), (2000, 3), (2000, 700), (2000, 1000), (2000, 1995), (2000, 2000), (10**12, 50_000)):
        got = [r["at"] for r in random_graphs.drawn(spark, total, n, 4).collect()]
        assert len(got) == len(set(got)) == n and all(0 <= x < total for x in got)
        if total == 2000 and n <= 1000:
            turns = spark.range(4 * n + 1).select(F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(total)).alias("at")).collect()
            assert set(got) == set(list(dict.fromkeys(r["at"] for r in turns))[:n])
    halves = [random_graphs.drawn(spark, 100, 20, seed).where("at < 50").count() for seed in range(8)]
    assert 50 < sum(halves) < 110
    for strict in (False, True):
        every = cells(random_graphs.random_triangle(spark, 9, 1.0, strict=strict))
        assert set(every) == {(a, b) for a in range(9) for b in range(a + (not strict))}
    wide = random_graphs.random_matrix(spark, 10**6, 10**6, 1e-8, seed=2)
    assert wide.n_arcs() == 10_000 and wide.cells.select("src", "dst").distinct().count() == 10_000

