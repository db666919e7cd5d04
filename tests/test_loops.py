"""Flows, disjoint paths, betweenness, directed components, closures by blocks, ordered products and split joins on random
graphs, against plain versions."""

import random
import re
from collections import defaultdict, deque
from fractions import Fraction
from itertools import product as words_of

import pytest
from pyspark.sql import functions as F

from arcweave import catalog
from arcweave.functions import algebra as A
from arcweave.operators import products
from arcweave.operators.matrices import Matrix
from arcweave.operators.vectors import Vec
from arcweave.plans import closure, flows, graphs, levels, matchings, social
from arcweave.plans.components import components
from arcweave.sources import derive
from tests.test_graphs import cells, matrix


def random_arcs(seed, n, m):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def successors(arcs):
    out = defaultdict(list)
    for a, b, *_ in arcs:
        out[a].append(b)
    return out


def distances(out, start):
    far, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        for v in out[u]:
            if v not in far:
                far[v] = far[u] + 1
                queue.append(v)
    return far


def best_flow(arcs, source, sink):
    left = defaultdict(int)
    for a, b, c in arcs:
        left[a, b] += c
    total = 0
    while True:
        out = defaultdict(list)
        for (a, b), c in left.items():
            if c > 0:
                out[a].append(b)
        prev, queue = {source: None}, deque([source])
        while queue and sink not in prev:
            u = queue.popleft()
            for v in out[u]:
                if v not in prev:
                    prev[v] = u
                    queue.append(v)
        if sink not in prev:
            return total
        path, v = [], sink
        while prev[v] is not None:
            path.append((prev[v], v))
            v = prev[v]
        width = min(left[e] for e in path)
        for a, b in path:
            left[a, b] -= width
            left[b, a] += width
        total += width


@pytest.mark.parametrize("hub", [100_000, 2])
def test_maximum_flow(spark, monkeypatch, hub):
    monkeypatch.setattr(flows, "HUB", hub)
    rng = random.Random(1)
    arcs = [(a, b, rng.randrange(1, 50)) for a, b in random_arcs(1, 14, 45)]
    capacity = matrix(spark, 14, arcs)
    flow, residual = flows.maximum_flow(capacity, 0, 13)
    got, most = cells(flow), {(a, b): c for a, b, c in arcs}
    net = defaultdict(int)
    for (a, b), x in got.items():
        assert 0 < x <= most[a, b]
        net[a] += x
        net[b] -= x
    assert net[0] == -net[13] == best_flow(arcs, 0, 13) > 0 and not any(x for v, x in net.items() if v not in (0, 13))
    assert graphs.cut_capacity(capacity, graphs.minimum_cut(residual, 0)).first().val == net[0]


def test_shares_of_parts_that_are_not_whole(spark):
    arcs = spark.createDataFrame([(1, k, w) for k, w in enumerate([0.5, 2.25, 0.75])] + [(2, 0, 3.0)], "src bigint, dst bigint, weight double")
    totals = spark.createDataFrame([(1, 1.5), (2, None)], "src bigint, total double")
    got = {(r.src, r.dst): r.part for r in flows.apportioned(arcs, totals, "src", "dst", "double").collect()}
    assert got == {(1, 0): 0.5, (1, 1): 1.0, (1, 2): 0.0, (2, 0): 3.0}


@pytest.mark.parametrize("share", [{}, {"share_start": True}, {"share_end": True}])
def test_disjoint_paths_are_maximal(spark, share):
    """Layers of 12 vertices joined at random: starts below 12, targets from 36 on."""
    rng = random.Random(3)
    arcs = sorted({(12 * d + rng.randrange(12), 12 * (d + 1) + rng.randrange(12)) for d in range(3) for _ in range(16)})
    g = matrix(spark, 48, [(a, b, True) for a, b in arcs], A.UNIT)
    found = levels.disjoint_paths(Vec.keys_of(spark, range(12)), Vec.keys_of(spark, range(36, 48)), g, **share).collect()
    used, held = set(), set(arcs)
    for r in found:
        p = list(r.path)
        assert len(p) == 4 and p[0] < 12 and p[3] >= 36 and all(e in held for e in zip(p, p[1:]))
        own = p[1 if "share_start" in share else 0 : 3 if "share_end" in share else 4]
        assert not used & set(own)
        used |= set(own)
    assert found and len({r.path_id for r in found}) == len(found)
    reach = {v for v in range(12) if v not in used}
    for _ in range(3):
        reach = {b for a, b in arcs if a in reach and b not in used}
    assert not reach


@pytest.mark.parametrize("ends", [True, False])
def test_disjoint_paths_leave_other_arcs_out(spark, monkeypatch, ends):
    """Of the level that meets the targets only the arcs to them are written, and tokens pick without sorts."""
    arcs = [(0, 1), (0, 2), (7, 2), (1, 3), (2, 4)] + [(k, 10 + j) for k in (1, 2) for j in range(100)]
    df, rows, sorts = spark.createDataFrame(arcs, "src bigint, dst bigint"), [], []

    def seen(df, label, kept=levels.written):
        got = kept(df, label)
        if label == "arcs":
            rows.append(got.count())
        if label == "walked":
            sorts.append("SortAggregate" in df._jdf.queryExecution().executedPlan().toString())
        return got

    monkeypatch.setattr(levels, "written", seen)
    g = Matrix.of(df, rows=None if ends else spark.range(200).select("id"))
    found = levels.disjoint_paths(Vec.keys_of(spark, [0, 7]), Vec.keys_of(spark, [3, 4]), g)
    got = {tuple(r.path) for r in found.collect()}
    assert got == {(0, 1, 3), (7, 2, 4)} or got in ({(0, 1, 3)}, {(0, 2, 4)})
    assert sum(rows) == 5 and sorts and not any(sorts)


def test_matching_of_long_paths(spark):
    """A chain whose least choices leave both ends open, so that every arc has to change places."""
    pairs = [(k, k + 1) for k in range(1, 10)] + [(0, 2), (9, 11)]
    both = [(a, b, True) for a, b in pairs] + [(b, a, True) for a, b in pairs]
    m, rest = graphs.maximum_matching_by_phases(matrix(spark, 12, both, A.UNIT))
    got = cells(m)
    assert len(got) == 10 and len({a for a, _ in got}) == 10 and set(got) <= {(a, b) for a, b, _ in both} and len(cells(rest)) == len(both) - 10


def plain_betweenness(n, arcs, closed):
    out, ways = successors(arcs), {}
    for s in range(n):
        count, far, level = {}, {}, {v: 1 for v in out[s]}
        k = 1
        while level:
            for v, c in level.items():
                far[v], count[v] = k, c
            after = defaultdict(int)
            for v, c in level.items():
                for w in out[v]:
                    if w not in far:
                        after[w] += c
            level, k = after, k + 1
        ways[s] = (far, count)
    sums = dict.fromkeys(range(n), Fraction(0))
    for v in range(n):
        for w, length in ways[v][0].items():
            for t in range(n):
                if t in (v, w) or v == w and not closed:
                    continue
                if t in ways[v][0] and w in ways[t][0] and ways[v][0][t] + ways[t][0][w] == length:
                    sums[t] += Fraction(ways[v][1][t] * ways[t][1][w], ways[v][1][w])
    return sums


@pytest.mark.parametrize("closed, pairs", [(True, 10**9), (False, 100)])
def test_betweenness(spark, closed, pairs):
    arcs = random_arcs(5, 16, 45)
    g = matrix(spark, 16, [(a, b, 1) for a, b in arcs])
    got = {r.id: Fraction(int(r.num), int(r.den)) for r in social.betweenness(g, closed, pairs).collect()}
    assert got == plain_betweenness(16, arcs, closed) and any(x.denominator > 1 for x in got.values())


@pytest.mark.parametrize("arcs", [random_arcs(1, 60, 40), random_arcs(2, 60, 90), [(k, k + 1) for k in range(40)], [(9, 0), (9, 1), (0, 0)], []])
def test_components_against_search(spark, arcs):
    """Loops and repeated links count for nothing; a long chain takes several rounds, stars none, an empty table gives no rows."""
    near = successors(arcs + [(b, a) for a, b in arcs])
    want = {}
    for root in sorted({x for a, b in arcs if a != b for x in (a, b)}):
        queue = deque([root] if root not in want else [])
        while queue:
            x = queue.popleft()
            if x not in want:
                want[x] = root
                queue.extend(near[x])
    links = spark.createDataFrame(arcs + arcs[:3], "a bigint, b bigint")
    found = components(links).collect()
    assert {r.node: r.root for r in found} == want and len(found) == len(want)


def test_directed_components(spark):
    """Least ancestors give what root after root finds."""
    arcs = random_arcs(6, 30, 34)
    g = matrix(spark, 30, [(a, b, True) for a, b in arcs], A.UNIT)
    out, taken, want = successors(arcs), set(), set()
    for r in range(30):
        if r not in taken:
            far = distances({a: [b for b in out[a] if b not in taken] for a in range(30)}, r)
            want |= {(r, k, v) for v, k in far.items()}
            taken |= set(far)
    search = lambda start, graph, within: levels.steps(start, graph, products.reached, candidates=within).select("key", "level")
    assert {(r.root, r.level, r.key) for r in graphs.per_root(g).collect()} == want
    few = matrix(spark, 8, [(5, 0, True), (5, 6, True), (1, 6, True), (6, 7, True), (7, 1, True)], A.UNIT)
    one_by_one = graphs.componentwise(few, search, whole=False)
    assert {tuple(r) for r in one_by_one.select("root", "level", "key").collect()} == {tuple(r) for r in graphs.per_root(few).select("root", "level", "key").collect()}


def test_closure_by_blocks(spark):
    arcs = random_arcs(7, 10, 24)
    one = F.struct(A.finite(F.lit(1)).alias("len"), A.finite(F.lit(1)).alias("cnt"))
    g = matrix(spark, 10, [(a, b, 1) for a, b in arcs])
    for size in (3, 16):
        got = {k: (v["len"].w, v.cnt.w) for k, v in cells(closure.block_closure(g.constant(one, A.GEODESIC), size)).items()}
        assert got == {(r.src, r.dst): (r.len, int(r.cnt)) for r in closure.geodesics(g).collect()}
    weights = g.map_with_keys(lambda s, d, v: A.finite(1 + (3 * s + d) % 5), A.TROPICAL)
    assert cells(closure.block_closure(weights, 4)) == cells(closure.closure(weights))


@pytest.mark.parametrize("size", [1, 16])
def test_counts_of_walks_that_a_shorter_one_beats_may_be_too_large(spark, size):
    """From 1 by 2 and 3 to 4 there are more walks than a bigint holds, and one arc from 1 to 4."""
    label = F.struct(A.finite(F.lit(1)).alias("len"), A.finite(F.col("val")).alias("cnt"))
    arcs = [(1, 2, 3_000_000_000), (2, 3, 3_000_000_000), (3, 4, 3_000_000_000), (1, 4, 5)]
    g = matrix(spark, 5, arcs)
    g = g.like(g.cells.select("src", "dst", label.alias("val")), A.GEODESIC)
    for close in (lambda m: closure.block_closure(m, size, drop_zeros=True), lambda m: closure.closure_by_kinds(m, drop_zeros=True)):
        read = close(g).cells.select("src", "dst", A.weight_of(F.col("val.len")).alias("len"), A.weight_of(F.col("val.cnt")).alias("cnt"))
        assert {tuple(r) for r in read.collect()} == {(a, b, 1, n) for a, b, n in arcs} | {(1, 3, 2, 9 * 10**18), (2, 4, 2, 9 * 10**18)}
    # without that arc those walks are the shortest: their number is asked for and cannot be given
    few = g.like(g.cells.where("src <> 1 or dst <> 4"), A.GEODESIC)
    beyond = closure.block_closure(few, size, drop_zeros=True).cells.where("src = 1 and dst = 4").select(A.weight_of(F.col("val.cnt")).alias("cnt"))
    with pytest.raises(Exception, match="not a finite value"):
        beyond.collect()


@pytest.mark.parametrize("size", [2, 16])
def test_regular_closure_by_blocks(spark, size):
    """Each expression matches the words of the walks between its vertices, and no others, up to four letters."""
    arcs = {(0, 1): "a", (1, 0): "b", (1, 2): "c", (2, 2): "d"}
    m = matrix(spark, 3, [(*k, v) for k, v in arcs.items()], A.Algebra("text", "string", None, None, None, None, None)).map(A.letter, A.REGULAR)
    told = {k: re.compile(v.text.replace("⊕", "|").replace("⊛", "").replace("ε", "")) for k, v in cells(closure.block_closure(m, size)).items()}
    for n in range(1, 5):
        for w in words_of("abcd", repeat=n):
            for s in range(3):
                ends = {s}
                for x in w:
                    ends = {b for (a, b), y in arcs.items() if a in ends and y == x}
                for t in range(3):
                    assert bool((s, t) in told and told[s, t].fullmatch("".join(w))) == (t in ends), (s, t, w)


def test_ordered_products(spark):
    rng = random.Random(8)
    entries = {rng.randrange(10**6): chr(97 + rng.randrange(26)) for _ in range(3000)}
    v = Vec(spark.createDataFrame(list(entries.items()), "key bigint, val string").repartition(5), A.Algebra("text", "string", None, lambda: F.lit(""), None, F.concat, None))
    assert v.reduced(F.concat, width=16).first().val == v.product().first().val == "".join(entries[k] for k in sorted(entries))
    assert v.filter(lambda x: x == "?").product().first().val == ""
    assert v.filter(lambda x: x == "?").reduced(F.concat).first().val is None


def test_heavy_vertices_are_split(spark):
    """A tenth of all arcs meet at one vertex: the same product, and no join key holds more than a fixed number of rows."""
    rng = random.Random(9)
    left = sorted({(k, rng.randrange(50)) for k in range(400)} | {(k, 7) for k in range(0, 400, 8)})
    right = sorted({(rng.randrange(50), k) for k in range(300)} | {(7, k) for k in range(0, 300, 6)})
    a, b = (matrix(spark, 400, [(x, y, x + y) for x, y in arcs]) for arcs in (left, right))
    assert cells(products.mat_mat(a, b, heavy=10)) == cells(products.mat_mat(a, b))
    v = Vec(spark.range(0, 50).select(F.col("id").alias("key"), F.col("id").alias("val")), A.NUMBER)
    one = lambda heavy: {r.key: r.val for r in products.vec_mat(v, b, heavy=heavy).df.collect()}
    assert one(10) == one(None)
    sides = a.cells.select("src", F.col("dst").alias("via")), b.cells.select(F.col("src").alias("via"), "dst")
    joined = products.spread(*sides, "via", 10)
    assert joined.count() == sides[0].join(sides[1], "via").count()


def test_degrees(spark):
    from arcweave.streaming import edges

    got = edges.degrees(spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 1)], "src bigint, dst bigint")).collect()
    assert {(r.key, r.arcs, r.successors) for r in got} == {(1, 3, 2), (2, 1, 1)}


def spokes(spark, n):
    """n vertices joined both ways to one of two hubs each, and to a third that all share."""
    arcs = [(10 + k, hub) for k in range(n) for hub in (k % 2, 2)]
    return joined_both_ways(spark, arcs)


def joined_both_ways(spark, arcs):
    return Matrix.of(spark.createDataFrame([*arcs, *[(b, a) for a, b in arcs]], "src bigint, dst bigint"), A.UNIT)


def test_twins_are_one(spark):
    """Rounds run over the kinds of vertices: hubs and two kinds of spokes, however many spokes there are."""
    from arcweave.plans import twins

    q = twins.quotient(spokes(spark, 60))
    assert {(r.id, r.times) for r in q.sizes.collect()} == {(0, 1), (1, 1), (2, 1), (10, 30), (11, 30)}
    assert {(r.src, r.dst) for r in q.matrix.cells.collect()} == {(a, b) for x, y in ((10, 0), (11, 1), (10, 2), (11, 2)) for a, b in ((x, y), (y, x))}


@pytest.mark.parametrize("closed", [True, False])
def test_betweenness_of_twins(spark, closed):
    arcs = {(10 + k, hub) for k in range(9) for hub in (k % 2, 2)} | {(20, 0), (20, 20)}
    g = joined_both_ways(spark, sorted(arcs)).cells.distinct()
    index = {v: k for k, v in enumerate(sorted({v for a in arcs for v in a}))}
    plain = {(index[r.src], index[r.dst]) for r in g.collect()}
    got = {index[r.id]: Fraction(int(r.num), int(r.den)) for r in social.betweenness(Matrix.of(g, A.UNIT), closed).collect()}
    assert got == plain_betweenness(len(index), plain, closed)


def test_geodesics_and_closure_of_twins(spark):
    one = F.struct(A.finite(F.lit(1)).alias("len"), A.finite(F.lit(1)).alias("cnt"))
    g = spokes(spark, 7)
    plain = {(r.src, r.dst): (r.l, r.c) for r in closure.closure(g.constant(one, A.GEODESIC)).cells.select("src", "dst", A.weight_of(F.col("val.len")).alias("l"), A.weight_of(F.col("val.cnt")).alias("c")).collect()}
    kinds = {(r.src, r.dst): (r.l, r.c) for r in closure.closure_by_kinds(g.constant(one, A.GEODESIC)).cells.select("src", "dst", A.weight_of(F.col("val.len")).alias("l"), A.weight_of(F.col("val.cnt")).alias("c")).collect()}
    assert len(plain) == 100 and kinds == plain and {(r.src, r.dst): (r.len, int(r.cnt)) for r in closure.geodesics(g).collect()} == plain


def rows_shuffled(spark, df):
    """Rows that the stages of one run of df write to shuffles, and the rows of df."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return [found.apply(k) for k in range(found.size())]

    seen = max((s.stageId() for s in stages()), default=-1)
    rows = df.collect()
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > seen), rows


def test_pairs_of_twins_are_made_after_the_shuffle(spark, monkeypatch):
    """What is dealt to tasks is a row for each pair of blocks of vertices, not for each vertex and kind."""
    from arcweave.plans import twins

    for sources, targets in ((twins.SOURCES, twins.TARGETS), (50, 7)):
        monkeypatch.setattr(twins, "SOURCES", sources)
        monkeypatch.setattr(twins, "TARGETS", targets)
        q = twins.quotient(spokes(spark, 400))
        vertices = {r.id: r.kind for r in q.of.collect()}
        pairs = q.sizes.select(F.col("id").alias("src")).crossJoin(q.sizes.select(F.col("id").alias("dst"))).withColumn("x", F.col("src") * 1000 + F.col("dst"))
        pairs = spark.createDataFrame(pairs.collect(), pairs.schema).coalesce(1)
        shuffled, rows = rows_shuffled(spark, q.expanded(pairs))
        assert sorted((r.src, r.dst, r.x) for r in rows) == sorted((v, w, 1000 * a + b) for v, a in vertices.items() for w, b in vertices.items())
        blocks = [sum(-(-n // size) for n in (200, 200, 1, 1, 1)) for size in (sources, targets)]
        assert shuffled <= blocks[0] * blocks[1] and (sources < 1024 or shuffled == 25)


def test_out_degrees_of_a_table_are_exact(spark):
    from arcweave.streaming import edges

    found = edges.degrees(spark.range(120_000).selectExpr("id % 40 AS src", "id AS dst")).collect()
    assert len(found) == 40 and all(r.arcs == r.successors == 3_000 for r in found)


def test_rounds_of_directed_components_broadcast_nothing(spark, monkeypatch):
    plans = {}

    def noted(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, label)

    kept = graphs.written
    for module in (graphs, levels):
        monkeypatch.setattr(module, "written", noted)
    arcs = random_arcs(5, 12, 14)
    cells = spark.createDataFrame(arcs, "src bigint, dst bigint")
    merged = {tuple(r) for r in graphs.per_root(Matrix.of(cells, A.UNIT), merge=True).collect()}
    assert all("BroadcastHashJoin" not in p for k in ("ancestors", "changed", "level") for p in plans[k])
    assert merged == {tuple(r) for r in graphs.per_root(Matrix.of(cells, A.UNIT)).collect()}


def most_pairs(arcs):
    out, mate = successors(arcs), {}

    def found(a, seen):
        for b in out[a]:
            if b not in seen:
                seen.add(b)
                if b not in mate or found(mate[b], seen):
                    mate[b] = a
                    return True
        return False

    return sum(found(a, set()) for a in sorted(out))


@pytest.mark.parametrize("arcs", [[(rng.randrange(n), rng.randrange(m)) for _ in range(k)] for rng, n, m, k in ((random.Random(11), 60, 60, 90), (random.Random(12), 70, 30, 110), (random.Random(13), 25, 60, 90))] + [[(k, k) for k in range(9)] + [(k + 1, k) for k in range(8)], []])
def test_matching_and_cover_from_pairs(spark, monkeypatch, arcs):
    """Proposals, then trees: as many pairs as a plain search finds and as many vertices of a cover. The arcs are written once."""
    labels = []
    monkeypatch.setattr(matchings, "written", lambda df, label, kept=matchings.written: labels.append(label) or kept(df, label))
    pairs, right = matchings.matched(spark.createDataFrame(arcs, "src bigint, dst bigint"))
    got, met = [tuple(r) for r in pairs.select("src", "dst").collect()], {r.dst for r in right.collect()}
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == most_pairs(sorted(set(arcs))) and set(got) <= set(arcs)
    cover = {(1, b) if b in met else (0, a) for a, b in got}
    assert len(cover) == len(got) and all((0, a) in cover or (1, b) in cover for a, b in arcs) and labels.count("arcs") == 1


def test_cover_query_knows_its_sides(spark, monkeypatch):
    """Arcs are written once, in one direction, without a search for sides; what trees and proposals pick is picked without sorts."""
    labels, plans = [], []

    def seen(df, label, kept=matchings.written):
        labels.append(label)
        if label in ("trees", "pairs"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, label)

    monkeypatch.setattr(matchings, "written", seen)
    monkeypatch.setattr(graphs, "bipartition", lambda g: pytest.fail("sides are known"))
    got = catalog.cover_size(spark, "/root/testdata/sf0.001").first()
    sides = derive.next_parts(spark, "/root/testdata/sf0.001").agg(F.countDistinct("src"), F.countDistinct("dst")).first()
    assert (got.size, got.uncovered) == (min(sides), 0) and labels.count("arcs") == 1
    assert plans and not any("SortAggregate" in p for p in plans)


def test_uncovered_arcs_are_told(spark):
    arcs = spark.createDataFrame([(0, 1), (0, 3), (2, 1), (2, 5), (2, 5)], "src bigint, dst bigint")
    cover = {r.key for r in matchings.least_cover(arcs).collect()}
    assert len(cover) == 2 and all(a in cover or b in cover for a, b in ((0, 1), (0, 3), (2, 1), (2, 5)))
    assert matchings.uncovered(arcs, spark.createDataFrame([(0,)], "key bigint")).distinct().count() == 2


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_sides_by_pieces(spark, block):
    """Sides are those of a search from the least vertex, whatever the blocks; rings of odd length and loops are told."""
    from arcweave.plans.components import sides_by_pieces

    rng = random.Random(14)
    arcs = [(2 * rng.randrange(30), 2 * rng.randrange(30) + 1) for _ in range(45)]
    near = successors(arcs + [(b, a) for a, b in arcs])
    want = {}
    for root in sorted(near):
        if root not in want:
            want |= {v: k % 2 for v, k in distances(near, root).items()}
    sides = lambda links: sides_by_pieces(spark.createDataFrame(links, "a bigint, b bigint"), block).collect()
    assert {r.node: (r.side, r.odd) for r in sides(arcs)} == {v: (s, False) for v, s in want.items()}
    odd = [(100 + k, 100 + (k + 1) % 9) for k in range(9)]
    assert any(r.odd for r in sides(arcs + odd)) and any(r.odd for r in sides([*arcs, (3, 3)])) and not any(r.odd for r in sides(odd[:-1]))


def test_arcs_of_hubs_are_not_one_tasks(spark, monkeypatch):
    """What hubs are joined to is broadcast: no shuffle brings all arcs of the source or the sink to one task."""
    rng = random.Random(15)
    arcs = [(0, k, 9) for k in range(2, 10)] + [(k, 10 + rng.randrange(8), rng.randrange(1, 9)) for k in range(2, 10) for _ in range(3)] + [(k, 1, 7) for k in range(10, 18)]
    arcs = [(a, b, c) for (a, b), c in {(a, b): c for a, b, c in arcs}.items()]
    plans = []

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, label)

    kept = flows.written
    monkeypatch.setattr(flows, "written", noted)
    flow, _ = flows.maximum_flow(matrix(spark, 18, arcs), 0, 1)
    value = sum(x for (a, _), x in cells(flow).items() if a == 0)
    assert value == best_flow(arcs, 0, 1) > 0
    assert all("BroadcastHashJoin" in p for label, p in plans if label == "open") and "proposals" in {label for label, _ in plans}
    split = flows.met(spark.createDataFrame([(0, 1), (0, 2), (3, 1)], "src bigint, dst bigint"), spark.range(4).toDF("src"), "src", [0], "left_anti")
    assert split.isEmpty()
