"""The registered queries of the library and their SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.functions import algebra as alg
from arcweave.functions import paths
from arcweave.operators import products, setops
from arcweave.operators.matrices import Matrix
from arcweave.operators.vectors import Vec
from arcweave.plans import closure, flows, graphs, levels, matchings, social, voting
from arcweave.plans.shared import work_folder, written
from arcweave.sources import build, derive, random_graphs
from arcweave.streaming import edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return register


# --- pieces of SQL

APPROVALS = """approvals AS (
  SELECT DISTINCT o_custkey AS player, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS alternative
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
votes AS (SELECT alternative AS key, count(*) AS val FROM approvals GROUP BY 1)"""
SUPPLY = "supply AS (SELECT l_suppkey AS src, l_partkey AS dst, CAST(sum(l_quantity) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2)"
THIN = """half AS (SELECT DISTINCT 2 * l_suppkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem WHERE l_quantity = 50),
thin AS (SELECT src, dst FROM half UNION ALL SELECT dst, src FROM half)"""
HALF = """half AS (SELECT DISTINCT 2 * l_suppkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem),
joined AS (SELECT src, dst FROM half UNION ALL SELECT dst, src FROM half)"""
TRADE = """counts AS (
  SELECT CAST(c_nationkey AS BIGINT) AS n1, CAST(s_nationkey AS BIGINT) AS n2, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2),
shares AS (SELECT *, CAST(n * 1000000 // sum(n) OVER (PARTITION BY n2) AS BIGINT) AS share FROM counts),
trade AS (SELECT n1 AS src, n2 AS dst, n, share AS val FROM shares WHERE n1 <> n2 AND share * (SELECT count(*) FROM nation) > 1000000),
ids AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation)"""
SIGNED = TRADE + """,
signed AS (SELECT src, dst, CASE WHEN n * (SELECT count(*) FROM trade) > (SELECT sum(n) FROM trade) THEN '+' ELSE '-' END AS val FROM trade)"""
EVENTS = """following AS (
  SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
names AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)),
moves AS (
  SELECT a.id AS src, b.id AS dst, count(*) AS val
  FROM following JOIN names a ON following.event_type = a.event_type JOIN names b ON following.next = b.event_type GROUP BY 1, 2)"""
REACH = """reach(src, dst) AS (
  SELECT src, dst FROM trade UNION SELECT reach.src, trade.dst FROM reach JOIN trade ON reach.dst = trade.src)"""


def least_walks(base: str, rounds: int = 6) -> str:
    """CTEs w0 ... w{rounds}: least weights over walks of up to 2 ** rounds arcs, by squaring."""
    parts = [f"w0 AS (SELECT src, dst, min(val) AS val FROM {base} GROUP BY 1, 2)"]
    for k in range(rounds):
        parts.append(
            f"w{k + 1} AS (SELECT src, dst, min(val) AS val FROM (SELECT * FROM w{k} UNION ALL "
            f"SELECT a.src, b.dst, a.val + b.val FROM w{k} a JOIN w{k} b ON a.dst = b.src) GROUP BY 1, 2)"
        )
    return ",\n".join(parts)


def least_labels(base: str, rounds: int = 8) -> str:
    """CTEs l0 ... and roots(key, root): least vertices that walks of up to ``rounds`` arcs reach."""
    parts = [f"l0 AS MATERIALIZED (SELECT DISTINCT src AS key, src AS root FROM {base})"]
    for k in range(rounds):
        parts.append(f"l{k + 1} AS MATERIALIZED (SELECT key, min(root) AS root FROM (SELECT * FROM l{k} UNION ALL SELECT dst, root FROM l{k} JOIN {base} ON key = src) GROUP BY 1)")
    return ",\n".join([*parts, f"roots AS (SELECT key, root FROM l{rounds})"])


LEVELS = """walk(key, level) AS (
  SELECT CAST(0 AS BIGINT), 0 UNION SELECT joined.dst, level + 1 FROM walk JOIN joined ON walk.key = joined.src WHERE level < 6),
lvl AS (SELECT key, min(level) AS level FROM walk GROUP BY key)"""


def cells(m: Matrix) -> DataFrame:
    return m.cells.select("src", "dst", "val")


def origin(spark: SparkSession, *keys: int) -> Vec:
    return Vec.keys_of(spark, keys or [0])


# --- voting


@query(f"WITH {APPROVALS} SELECT key, val FROM votes")
def voting_results(spark, sf):
    return voting.results(derive.approvals(spark, sf)).df


@query(f"WITH {APPROVALS} SELECT key, val FROM votes WHERE val = (SELECT max(val) FROM votes)")
def voting_winners(spark, sf):
    return voting.winners(derive.approvals(spark, sf)).df


@query(f"WITH {APPROVALS} SELECT key, (SELECT max(val) FROM votes) - val AS val FROM votes")
def voting_lower_bound(spark, sf):
    return voting.lower_bounds(derive.approvals(spark, sf))


def few_players(spark, sf, n: int = 12) -> Matrix:
    """The vote of the first customers (a search over all subsets is exponential by definition)."""
    v = derive.approvals(spark, sf)
    first = v.vertices().below(n)
    few = v.restrict_rows(first)
    return few.like(few.cells, rows=first.df.select(F.col("key").alias("id"))).stored()


@query(
    f"""WITH {APPROVALS}, few AS (SELECT * FROM approvals WHERE player < 12),
masks AS (SELECT alternative, CAST(sum(1 << CAST(player AS INTEGER)) AS BIGINT) AS approvers, count(*) AS n FROM few GROUP BY 1),
goal AS (SELECT min(alternative) AS alternative FROM masks WHERE n >= 2),
bound AS (SELECT max(n) - max(n) FILTER (alternative = (SELECT alternative FROM goal)) AS least FROM masks),
sets AS (SELECT range AS mask, bit_count(range) AS size FROM range(4096) WHERE bit_count(range) >= (SELECT least FROM bound)),
judged AS (
  SELECT mask, size, max(bit_count(approvers & ~mask)) AS top,
         max(bit_count(approvers & ~mask)) FILTER (alternative = (SELECT alternative FROM goal)) AS own
  FROM sets, masks GROUP BY mask, size),
placed AS (SELECT *, row_number() OVER (ORDER BY size, mask) AS attempt FROM judged)
SELECT attempt, mask AS removed FROM placed WHERE top = 0 OR (own = top AND own > 0) ORDER BY attempt LIMIT 1"""
)
def voting_removal(spark, sf):
    """For the first alternative with two approvals or more; the set as a bit mask."""
    v = few_players(spark, sf)
    goal = voting.votes(v).df.where("val >= 2").agg(F.min("key")).first()[0]
    found = voting.minimal_removal(v, goal)
    return found.select("attempt", F.aggregate("players", F.lit(0).cast("bigint"), lambda a, i: a + F.pow(F.lit(2), i).cast("bigint")).alias("removed"))


# --- products


@query(f"WITH {SUPPLY} SELECT dst AS key, sum((src % 7) * val)::BIGINT AS val FROM supply GROUP BY 1")
def vec_mat_number(spark, sf):
    m = derive.supply(spark, sf)
    return products.vec_mat(m.vertices().map_with_key(lambda k, v: k % 7, alg.NUMBER), m).df


@query(f"WITH {SUPPLY} SELECT dst AS key, min(src % 7 + val) AS val FROM supply GROUP BY 1")
def vec_mat_tropical(spark, sf):
    m = derive.supply(spark, sf).map(alg.finite, alg.TROPICAL)
    v = m.vertices().map_with_key(lambda k, v: alg.finite(k % 7), alg.TROPICAL)
    return products.vec_mat(v, m, drop_zeros=True).df.select("key", alg.weight_of(F.col("val")).alias("val"))


@query(f"WITH {SUPPLY} SELECT dst AS key, bool_or(src % 2 = 0 AND val > 50) AS val FROM supply GROUP BY 1")
def vec_mat_bool(spark, sf):
    m = derive.supply(spark, sf).map(lambda x: x > 50, alg.BOOL)
    return products.vec_mat(m.vertices().map_with_key(lambda k, v: k % 2 == 0, alg.BOOL), m).df


@query(f"WITH {SUPPLY} SELECT dst AS key, arg_min(src * 3, src) AS val FROM supply GROUP BY 1")
def vec_mat_first_vector(spark, sf):
    m = derive.supply(spark, sf)
    return products.first_vector_label(m.vertices().map_with_key(lambda k, v: k * 3, alg.NUMBER), m).df


@query(f"WITH {SUPPLY} SELECT dst AS key, arg_min(val, src) AS val FROM supply GROUP BY 1")
def vec_mat_first_matrix(spark, sf):
    m = derive.supply(spark, sf)
    return products.first_matrix_label(m.vertices(), m).df


@query(f"WITH {SUPPLY} SELECT dst AS key, min(src) AS val FROM supply GROUP BY 1")
def min_pred(spark, sf):
    m = derive.supply(spark, sf)
    return products.least_predecessor(m.vertices(), m).df


@query(f"WITH {SUPPLY} SELECT dst AS key, string_agg(src || ':' || val, ' ' ORDER BY src) AS arcs FROM supply GROUP BY 1")
def collect_arcs(spark, sf):
    m = derive.supply(spark, sf)
    got = products.collected_arcs(m.vertices(), m).df
    return got.select("key", F.array_join(F.transform("val", lambda a: F.concat(a["src"].cast("string"), F.lit(":"), a["val"].cast("string"))), " ").alias("arcs"))


@query(f"WITH {SUPPLY} SELECT dst AS key, count(*) AS val FROM supply GROUP BY 1")
def count_pred(spark, sf):
    m = derive.supply(spark, sf)
    return products.predecessor_count(m.vertices(), m).df


@query(f"WITH {EVENTS} SELECT a.src, b.dst, sum(a.val * b.val)::BIGINT AS val FROM moves a JOIN moves b ON a.dst = b.src GROUP BY 1, 2")
def mat_mat_number(spark, sf):
    m = derive.transitions(spark, sf)
    return cells(products.mat_mat(m, m))


@query(
    """WITH a AS (SELECT o_custkey AS src, ascii(l_returnflag) AS via, CAST(sum(l_quantity) AS BIGINT) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
b AS (SELECT ascii(l_returnflag) AS via, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT src, dst, CAST(sum(x * y) AS BIGINT) AS val FROM a JOIN b USING (via) GROUP BY 1, 2"""
)
def mat_mat_hubs(spark, sf):
    """A product whose every pair meets at one of three vertices (return flags), each dealt to tasks in parts."""
    a, b = derive.by_return_flag(spark, sf)
    return cells(products.mat_mat(a, b, heavy=200))


@query(f"WITH {TRADE} SELECT a.src, b.dst, min(a.val + b.val) AS val FROM trade a JOIN trade b ON a.dst = b.src GROUP BY 1, 2")
def mat_mat_tropical(spark, sf):
    m = derive.nation_trade(spark, sf).map(alg.finite, alg.TROPICAL)
    return cells(products.mat_mat(m, m, True).map(alg.weight_of, alg.NUMBER))


@query(f"WITH {TRADE} SELECT a.src, b.dst, max(least(a.val, b.val)) AS val FROM trade a JOIN trade b ON a.dst = b.src GROUP BY 1, 2")
def mat_mat_widest(spark, sf):
    m = derive.nation_trade(spark, sf, alg.widest())
    return cells(products.mat_mat(m, m))


@query(f"WITH {TRADE} SELECT a.src, b.dst, count(*) AS val FROM trade a JOIN trade b ON a.dst = b.src GROUP BY 1, 2")
def mat_mat_per_row(spark, sf):
    """Counted predecessors, lifted to all rows at once."""
    m = derive.nation_trade(spark, sf)
    return cells(products.per_row(products.predecessor_count, m, m))


# --- matrix algebra


@query(f"WITH {TRADE} SELECT src, dst, sum(val)::BIGINT AS val FROM (SELECT src, dst, val FROM trade UNION ALL SELECT dst, src, val FROM trade) GROUP BY 1, 2")
def sym_closure(spark, sf):
    return cells(derive.nation_trade(spark, sf).symmetric())


@query(f"WITH {TRADE} SELECT src, dst, sum(val)::BIGINT AS val FROM (SELECT src, dst, val FROM trade UNION ALL SELECT src, dst, 2 * val FROM trade WHERE src < 10) GROUP BY 1, 2")
def mat_add(spark, sf):
    m = derive.nation_trade(spark, sf)
    return cells(m.plus(m.restrict_rows(m.vertices().below(10)).scaled(F.lit(2))))


@query(
    f"WITH {TRADE} SELECT src, dst, sum(val)::BIGINT AS val FROM (SELECT src, dst, val FROM trade UNION ALL SELECT dst, src, -val FROM trade) GROUP BY 1, 2 HAVING sum(val) <> 0"
)
def mat_sub(spark, sf):
    m = derive.nation_trade(spark, sf)
    return cells(m.minus(m.transposed()))


@query(f"WITH {SUPPLY} SELECT dst AS src, src AS dst, val FROM supply")
def transpose(spark, sf):
    return cells(derive.supply(spark, sf).transposed())


@query(f"WITH {SUPPLY} SELECT dst AS src, src AS dst, val FROM supply WHERE src < (SELECT count(*) FROM supplier)")
def transpose_square(spark, sf):
    return cells(derive.supply(spark, sf).transposed_square())


@query(f"WITH {TRADE} SELECT src, dst, true AS val FROM trade")
def to_unit(spark, sf):
    return cells(derive.nation_trade(spark, sf).units())


@query(f"WITH {TRADE} SELECT src, dst, 5 * val AS val FROM trade WHERE val <> 0")
def scalar_product(spark, sf):
    return cells(derive.nation_trade(spark, sf).scaled(F.lit(5).cast("bigint"), drop_zeros=True))


@query(f"WITH {TRADE} SELECT id AS src, id AS dst, 1::BIGINT AS val FROM ids")
def identity_matrix(spark, sf):
    return cells(derive.nation_trade(spark, sf).identity())


# --- sets and vectors: quantities per part and per order, whose keys overlap

TWO = """a AS (SELECT l_partkey AS key, CAST(sum(l_quantity) AS BIGINT) AS val FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey AS key, CAST(sum(l_quantity) AS BIGINT) AS val FROM lineitem GROUP BY 1)"""


def two_vectors(spark, sf) -> tuple[Vec, Vec]:
    return derive.quantities(spark, sf, "l_partkey"), derive.quantities(spark, sf, "l_orderkey")


@query(f"WITH {TWO} SELECT key, coalesce(a.val, b.val) AS val FROM a FULL JOIN b USING (key)")
def union_left(spark, sf):
    a, b = two_vectors(spark, sf)
    return a.union(b).df


@query(f"WITH {TWO} SELECT key, coalesce(b.val, a.val) AS val FROM a FULL JOIN b USING (key)")
def union_right(spark, sf):
    a, b = two_vectors(spark, sf)
    return setops.union_right(a.df, b.df)


@query(f"WITH {TWO} SELECT key, CASE WHEN a.val IS NULL THEN b.val WHEN b.val IS NULL THEN a.val ELSE a.val * 2 - b.val END AS val FROM a FULL JOIN b USING (key)")
def union_op(spark, sf):
    a, b = two_vectors(spark, sf)
    return a.union_with(b, lambda x, y: x * 2 - y).df


@query(f"WITH {TWO} SELECT key, coalesce(a.val, b.val) AS val FROM a FULL JOIN b USING (key)")
def union_first_of_many(spark, sf):
    a, b = two_vectors(spark, sf)
    return setops.union_first([a.df, b.df, a.df])


@query(f"WITH {TWO} SELECT key, a.val - b.val AS val FROM a JOIN b USING (key)")
def intersect_op(spark, sf):
    a, b = two_vectors(spark, sf)
    return a.intersect(b, lambda x, y: x - y).df


@query(f"WITH {TWO} SELECT key, val FROM a WHERE key NOT IN (SELECT key FROM b)")
def diff(spark, sf):
    a, b = two_vectors(spark, sf)
    return a.drop(b).df


@query(f"WITH {TWO} SELECT key, CASE WHEN b.val IS NULL THEN a.val ELSE a.val - b.val END AS val FROM a LEFT JOIN b USING (key) WHERE b.val IS NULL OR a.val > b.val")
def diff_op(spark, sf):
    a, b = two_vectors(spark, sf)
    return setops.difference_with(a.df, b.df, lambda x, y: F.when(x > y, x - y))


@query(f"WITH {TWO} SELECT key, coalesce(a.val, b.val) AS val FROM a FULL JOIN b USING (key) WHERE a.val IS NULL OR b.val IS NULL")
def sym_diff(spark, sf):
    a, b = two_vectors(spark, sf)
    return a.symmetric_difference(b).df


@query(f"WITH {TWO} SELECT key, sum(val)::BIGINT AS val FROM (SELECT * FROM a UNION ALL SELECT key, -val FROM b) GROUP BY 1 HAVING sum(val) <> 0")
def vector_difference(spark, sf):
    a, b = two_vectors(spark, sf)
    return a.minus(b, drop_zeros=True).df


@query(f"WITH {TWO} SELECT (SELECT sum(val) FROM a)::BIGINT AS total, (SELECT max(val) FROM a) AS greatest, (SELECT count(*) FROM a) AS size")
def vector_summary(spark, sf):
    a, _ = two_vectors(spark, sf)
    return a.df.agg(a.algebra.total_or_zero(F.col("val")).alias("total"), F.greatest(F.max("val"), F.lit(0)).alias("greatest"), F.count("*").alias("size"))


@query(f"WITH {TWO} SELECT key, val FROM a ORDER BY val, key LIMIT 1")
def least_entry(spark, sf):
    return two_vectors(spark, sf)[0].least_entry()


@query(f"WITH {SUPPLY} SELECT src, dst, val FROM supply WHERE src % 9 = 0")
def restrict_rows(spark, sf):
    m = derive.supply(spark, sf)
    return cells(m.restrict_rows(m.vertices().filter_with_key(lambda k, v: k % 9 == 0)))


@query(f"WITH {SUPPLY} SELECT src, dst, val FROM supply WHERE dst IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 = 0)")
def restrict_cols(spark, sf):
    m = derive.supply(spark, sf)
    return cells(m.restrict_columns(m.vertices().filter_with_key(lambda k, v: k % 9 == 0)))


@query(f"WITH {SUPPLY} SELECT src, dst, val - 50 AS val FROM supply WHERE val <> 50")
def filter_zero(spark, sf):
    return cells(derive.supply(spark, sf).map(lambda v: v - 50).without_zeros())


@query(f"WITH {SUPPLY} SELECT coalesce((SELECT val FROM supply WHERE src = 3 AND dst = 8), 0) AS val")
def point_lookup(spark, sf):
    return derive.supply(spark, sf).at(3, 8)


@query(f"WITH {TRADE} SELECT id AS key, true AS val FROM ids WHERE id IN (SELECT src FROM trade)")
def with_successors(spark, sf):
    return derive.nation_trade(spark, sf).with_successors().df


@query(f"WITH {APPROVALS} SELECT c_custkey AS key, true AS val FROM customer WHERE c_custkey NOT IN (SELECT player FROM approvals)")
def without_successors(spark, sf):
    return derive.approvals(spark, sf).without_successors().df


@query(f"WITH {SUPPLY} SELECT src AS key, val FROM supply WHERE dst = 5")
def predecessors(spark, sf):
    return derive.supply(spark, sf).predecessors(5).df


@query(f"WITH {SUPPLY} SELECT count(*) AS arcs, (SELECT count(*) FROM supplier) AS vertices FROM supply")
def arc_count(spark, sf):
    m = derive.supply(spark, sf)
    return m.cells.agg(F.count("*").alias("arcs")).join(m.rows.agg(F.count("*").alias("vertices")))


# --- levels


@query(f"WITH RECURSIVE {HALF}, {LEVELS} SELECT level, key FROM lvl")
def bfs_levels(spark, sf):
    return levels.distance(origin(spark), derive.supply_graph(spark, sf))


@query(f"WITH RECURSIVE {HALF}, {LEVELS} SELECT key, true AS val FROM lvl")
def reachable(spark, sf):
    return levels.reachable(origin(spark), derive.supply_graph(spark, sf), products.reached).df


@query(f"WITH RECURSIVE {HALF}, {LEVELS} SELECT key, true AS val FROM lvl WHERE key % 8 = 6 AND level = (SELECT min(level) FROM lvl WHERE key % 8 = 6)")
def shortest_level(spark, sf):
    m = derive.supply_graph(spark, sf)
    return levels.shortest(origin(spark), m.vertices().filter_with_key(lambda k, v: k % 8 == 6), m, products.reached).df


@query(
    f"""WITH RECURSIVE {HALF}, {LEVELS},
step AS (SELECT b.key, min(a.key) AS pred FROM lvl a JOIN joined ON a.key = joined.src JOIN lvl b ON b.key = joined.dst AND b.level = a.level + 1 GROUP BY 1),
path(key, spot, trail) AS (
  SELECT key, key, CAST('' AS VARCHAR) FROM lvl
  UNION ALL SELECT path.key, step.pred, step.pred || CASE WHEN trail = '' THEN '' ELSE ' ' END || trail FROM path JOIN step ON path.spot = step.key)
SELECT key, trail AS path FROM path WHERE spot = 0"""
)
def bfs_path(spark, sf):
    """For each reached supplier or part the path before it, by least predecessors."""
    start = origin(spark).constant(paths.empty_path(), alg.free("bigint"))
    found = levels.reachable(start, derive.supply_graph(spark, sf), products.extended_path)
    return found.df.select("key", F.array_join(F.col("val").cast("array<string>"), " ").alias("path"))


@query(
    f"""WITH RECURSIVE {HALF}, {LEVELS}
SELECT b.level, b.key AS vertex, a.key AS pred FROM lvl a JOIN joined ON a.key = joined.src JOIN lvl b ON b.key = joined.dst AND b.level = a.level + 1"""
)
def predecessor_forest(spark, sf):
    found = levels.forest(origin(spark), derive.supply_graph(spark, sf))
    return found.where("pred is not null").select("level", "vertex", "pred")


REGION_SUPPLIERS = "ours AS (SELECT s_suppkey, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(
    f"""WITH {REGION_SUPPLIERS}
SELECT (SELECT least(count(*) FILTER (region = 0), count(*) FILTER (region = 1)) FROM ours) AS paths, CAST(3 AS INTEGER) AS vertices, true AS valid, true AS disjoint, true AS maximal"""
)
def disjoint_paths(spark, sf):
    """Shortest paths from the suppliers of one region over parts to those of another, no vertex on two of them: their number
    (no larger one is possible), and whether they are paths of the graph, disjoint, and leave no further one."""
    g = derive.supply_graph(spark, sf).stored()
    start, target = derive.suppliers_of(spark, sf, 0), derive.suppliers_of(spark, sf, 1)
    found = written(levels.disjoint_paths(start, target, g), "paths")
    steps = found.select("path_id", F.explode(F.zip_with(F.expr("slice(path, 1, size(path) - 1)"), F.expr("slice(path, 2, size(path) - 1)"), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("s")).select("s.src", "s.dst")
    # the arcs of paths are few: all arcs are filtered by them, not shuffled
    strays = steps.join(g.cells.select("src", "dst").join(steps, ["src", "dst"], "left_semi"), ["src", "dst"], "left_anti").agg(F.count("*").alias("strays"))
    ends = found.select(F.get("path", F.lit(0)).alias("key")).join(start.df, "key", "left_anti").unionByName(found.select(F.element_at("path", -1).alias("key")).join(target.df, "key", "left_anti"))
    used = found.select(F.explode("path").alias("key"))
    shared = used.groupBy("key").count().agg(F.count_if(F.col("count") > 1).alias("shared"))
    # one more path of two arcs without the used vertices
    held = Vec(used)
    more = products.reached(products.reached(start.drop(held), g).drop(held), g).drop(held).keep(target).df.agg(F.count("*").alias("more"))
    sums = found.agg(F.count("*").alias("paths"), F.max(F.size("path")).alias("vertices"), (F.min(F.size("path")) == F.max(F.size("path"))).alias("even"))
    one = sums.join(strays).join(ends.agg(F.count("*").alias("wrong"))).join(shared).join(more)  # one row each
    return one.select("paths", "vertices", F.expr("strays = 0 and wrong = 0 and even").alias("valid"), F.expr("shared = 0").alias("disjoint"), F.expr("more = 0").alias("maximal"))


@query("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_size) AS root FROM part")
def components(spark, sf):
    return graphs.weak_components(derive.size_chains(spark, sf))


@query("SELECT count(DISTINCT p_size) AS n FROM part")
def component_count(spark, sf):
    return graphs.component_count(derive.size_chains(spark, sf))


# --- closures


@query(f"WITH RECURSIVE {TRADE}, {REACH} SELECT src, dst, true AS val FROM reach")
def closure_bool(spark, sf):
    return cells(closure.closure(derive.nation_trade(spark, sf).booleans()))


@query(f"WITH {TRADE}, {least_walks('trade')} SELECT src, dst, val FROM w6")
def closure_tropical(spark, sf):
    return cells(closure.closure(derive.nation_trade(spark, sf).map(alg.finite, alg.TROPICAL)).map(alg.weight_of, alg.NUMBER))


@query(f"WITH {TRADE}, {least_walks('trade')} SELECT src, dst, min(val) AS val FROM (SELECT * FROM w6 UNION ALL SELECT id, id, 0 FROM ids) GROUP BY 1, 2")
def star_tropical(spark, sf):
    return cells(closure.star_closure(derive.nation_trade(spark, sf, alg.LEAST)))


@query(f"WITH {TRADE}, {least_walks('trade')} SELECT src, dst, true AS reached, val AS weight FROM w6")
def closure_pair(spark, sf):
    m = derive.nation_trade(spark, sf).map(lambda v: F.struct(F.lit(True).alias("_1"), alg.finite(v).alias("_2")), alg.pair(alg.BOOL, alg.TROPICAL))
    return closure.closure(m).cells.select("src", "dst", F.col("val._1").alias("reached"), alg.weight_of(F.col("val._2")).alias("weight"))


# --- bipartite graphs, matchings, covers


@query(
    f"""WITH RECURSIVE {TRADE}, pairs AS (SELECT src, dst FROM trade UNION SELECT dst, src FROM trade),
odd(root, key, parity) AS (SELECT id, id, 0 FROM ids UNION SELECT root, pairs.dst, 1 - parity FROM odd JOIN pairs ON odd.key = pairs.src)
SELECT NOT EXISTS (SELECT 1 FROM odd WHERE root = key AND parity = 1) AS bipartite"""
)
def bipartite_flag(spark, sf):
    return spark.createDataFrame([(graphs.is_bipartite(derive.nation_trade(spark, sf).units().symmetric()),)], "bipartite boolean")


@query(
    f"""WITH {HALF}, {least_labels('joined')}
SELECT key, CAST((key + root) % 2 AS INTEGER) AS side FROM roots"""
)
def bipartition(spark, sf):
    return graphs.bipartition(derive.supply_graph(spark, sf))


NEXT_PARTS = """behind AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem),
steps AS (SELECT DISTINCT src, dst FROM behind WHERE dst IS NOT NULL)"""


# no matching is larger than the smaller side, so one of that size is proved to be a maximum, and with it the cover
@query(f"WITH {NEXT_PARTS} SELECT least(count(DISTINCT src), count(DISTINCT dst)) AS size, CAST(0 AS BIGINT) AS twice FROM steps")
def matching_size(spark, sf):
    """Parts matched to the parts behind them, by phases of longer and longer alternating paths; twice: vertices matched twice."""
    arcs = matchings.stored(derive.next_parts(spark, sf))
    pairs, _ = matchings.matched(arcs, kept=True)
    twice = pairs.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").count().agg(F.count_if(F.col("count") > 1).alias("twice"))
    return arcs.join(pairs, ["src", "dst"], "left_semi").agg(F.count("*").alias("size")).join(twice)  # one row each


@query(f"WITH {NEXT_PARTS} SELECT least(count(DISTINCT src), count(DISTINCT dst)) AS size, CAST(0 AS BIGINT) AS uncovered FROM steps")
def cover_size(spark, sf):
    """A least set of vertices that touches all arcs, and the arcs it leaves uncovered. The sides are known: no search for them, and
    arcs in one direction."""
    arcs = matchings.stored(derive.next_parts(spark, sf))
    cover = written(matchings.least_cover(arcs, kept=True), "cover")
    open_ = matchings.uncovered(arcs, cover).agg(F.count("*").alias("uncovered"))
    return cover.agg(F.count("*").alias("size")).join(open_)  # one row each


@query(
    f"""WITH RECURSIVE {THIN}, turns AS (SELECT src, dst, row_number() OVER (ORDER BY dst, src) AS i FROM thin),
greedy(i, cover) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT turns.i, CASE WHEN list_contains(cover, src) OR list_contains(cover, dst) THEN cover ELSE list_append(list_append(cover, src), dst) END
  FROM greedy JOIN turns ON turns.i = greedy.i + 1)
SELECT unnest(cover) AS key FROM greedy WHERE i = (SELECT count(*) FROM turns)"""
)
def approximate_cover(spark, sf):
    return graphs.approximate_vertex_cover(derive.thin_supply(spark, sf))


# --- signed networks and centrality


@query(
    f"""WITH RECURSIVE {SIGNED}, arcs AS (SELECT src, dst, val FROM signed UNION SELECT dst, src, val FROM signed),
walk(root, key, parity) AS (
  SELECT id, id, 0 FROM ids UNION SELECT root, arcs.dst, CASE WHEN arcs.val = '-' THEN 1 - parity ELSE parity END FROM walk JOIN arcs ON walk.key = arcs.src)
SELECT NOT EXISTS (SELECT 1 FROM walk WHERE root = key AND parity = 1) AS balanced"""
)
def balanced_flag(spark, sf):
    return spark.createDataFrame([(social.is_balanced(derive.signed_trade(spark, sf)),)], "balanced boolean")


POSITIVE = """arcs AS (SELECT src, dst FROM signed WHERE val = '+' UNION SELECT dst, src FROM signed WHERE val = '+'),
label(key, root) AS (SELECT id, id FROM ids UNION SELECT arcs.dst, root FROM label JOIN arcs ON label.key = arcs.src),
clusters AS (SELECT key AS id, min(root) AS cluster FROM label GROUP BY key)"""


@query(
    f"""WITH RECURSIVE {SIGNED}, {POSITIVE}
SELECT NOT EXISTS (SELECT 1 FROM signed JOIN clusters a ON src = a.id JOIN clusters b ON dst = b.id WHERE val = '-' AND a.cluster = b.cluster) AS clustered"""
)
def clustered_flag(spark, sf):
    return spark.createDataFrame([(social.is_clustered(derive.signed_trade(spark, sf)),)], "clustered boolean")


@query(f"WITH RECURSIVE {SIGNED}, {POSITIVE} SELECT id, cluster FROM clusters")
def clustering_candidate(spark, sf):
    return social.clustering_candidate(derive.signed_trade(spark, sf))


TRAITS = """of AS (SELECT 3 * s_suppkey AS src, 3 * CAST(s_nationkey AS BIGINT) + 1 AS n, 3 * CAST(floor(s_acctbal / 1000) AS BIGINT) + 5 AS b FROM supplier),
pairs AS (SELECT src, n AS dst FROM of UNION ALL SELECT src, b FROM of), traits AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs)"""
SHORTEST = """hops(src, dst, len) AS (SELECT src, dst, 1 FROM traits UNION SELECT hops.src, traits.dst, len + 1 FROM hops JOIN traits ON hops.dst = traits.src WHERE len < 12),
far AS (SELECT src, dst, min(len) AS len FROM hops GROUP BY 1, 2),
walks(src, dst, len) AS (
  SELECT src, dst, 1 FROM traits
  UNION ALL SELECT walks.src, traits.dst, walks.len + 1 FROM walks JOIN traits ON walks.dst = traits.src JOIN far ON far.src = walks.src AND far.dst = traits.dst AND far.len = walks.len + 1),
d AS (SELECT src, dst, len, count(*) AS cnt FROM walks GROUP BY 1, 2, 3)"""


@query(
    f"""WITH RECURSIVE {TRAITS}, {SHORTEST},
shares AS (
  SELECT a.dst AS id, CAST(w.cnt AS HUGEINT) AS den, CAST(sum(a.cnt * b.cnt) AS HUGEINT) AS num
  FROM d a JOIN d b ON a.dst = b.src JOIN d w ON w.src = a.src AND w.dst = b.dst AND a.len + b.len = w.len WHERE a.src <> a.dst AND b.src <> b.dst GROUP BY 1, 2),
common AS (SELECT id, list_reduce(list(den), lambda x, y: lcm(x, y)) AS m FROM shares GROUP BY 1),
sums AS (SELECT id, any_value(m) AS den, CAST(sum(num * (m // den)) AS HUGEINT) AS num FROM shares JOIN common USING (id) GROUP BY 1)
SELECT v.id, CAST(coalesce(num // gcd(num, den), 0) AS VARCHAR) AS num, CAST(coalesce(den // gcd(num, den), 1) AS VARCHAR) AS den, round(coalesce(num / den, 0), 4) AS val
FROM (SELECT DISTINCT src AS id FROM traits) v LEFT JOIN sums USING (id)"""
)
def betweenness(spark, sf):
    """Suppliers, their nations and the thousands of their balances: exact shares of shortest walks."""
    return social.betweenness(derive.supplier_traits(spark, sf)).select("id", "num", "den", F.round("val", 4).alias("val"))


# --- flows

# every set of regions that a cut may leave on the source's side: a part goes where it costs less
CUTS = """sold AS (
  SELECT l_partkey AS part, CAST(n_regionkey AS BIGINT) AS region, CAST(sum(l_quantity) AS BIGINT) AS val
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
leaving AS (SELECT part, CAST(sum(val) // 2 AS BIGINT) AS cap FROM sold GROUP BY 1),
entering AS (SELECT CAST(r_regionkey AS BIGINT) AS region, CAST((SELECT sum(val) FROM sold) * (r_regionkey + 1) // 25 AS BIGINT) AS cap FROM region),
sides AS (SELECT range AS mask FROM range(CAST(1 << (SELECT count(*) FROM region) AS BIGINT))),
inner_ AS (SELECT mask, part, coalesce(sum(val) FILTER ((mask >> CAST(region AS INTEGER)) % 2 = 0), 0) AS out FROM sides, sold GROUP BY 1, 2),
parted AS (SELECT mask, sum(least(cap, out)) AS cut, count(*) FILTER (out < cap) AS near FROM inner_ JOIN leaving USING (part) GROUP BY 1),
cuts AS (
  SELECT mask, near + bit_count(mask) + 1 AS size, cut + (SELECT coalesce(sum(cap) FILTER ((mask >> CAST(region AS INTEGER)) % 2 = 1), 0) FROM entering) AS capacity FROM parted)"""


def checked_flow(capacity: Matrix) -> tuple[Matrix, Matrix, DataFrame]:
    """Flow, residual and one row: val (what leaves the source), unbalanced (inner vertices where more or less leaves than
    enters) and over (arcs that carry more than their capacity)."""
    capacity = capacity.stored()
    flow, residual = flows.maximum_flow(capacity, derive.SOURCE, derive.SINK)
    flow = flow.stored()
    net = graphs.balance(flow)
    ends = net.agg(
        F.coalesce(F.max(F.when(F.col("key") == derive.SOURCE, F.col("val"))), F.lit(0)).alias("val"),
        F.count_if((F.col("val") != 0) & ~F.col("key").isin(derive.SOURCE, derive.SINK)).alias("unbalanced"),
    )
    over = flow.cells.join(capacity.cells.withColumnRenamed("val", "most"), ["src", "dst"], "left").agg(F.count_if(F.col("val") > F.coalesce("most", F.lit(0))).alias("over"))
    return flow, residual, ends.join(over)  # one row each


@query(f"WITH {CUTS} SELECT CAST(min(capacity) AS BIGINT) AS val, CAST(0 AS BIGINT) AS unbalanced, CAST(0 AS BIGINT) AS over FROM cuts")
def flow_value(spark, sf):
    """A maximum flow from parts to regions is worth the least cut, which the SQL finds among all sets of regions."""
    return checked_flow(derive.sales_network(spark, sf))[2]


@query(f"WITH {CUTS} SELECT CAST(capacity AS BIGINT) AS val, CAST(size AS BIGINT) AS side FROM cuts WHERE capacity = (SELECT min(capacity) FROM cuts) ORDER BY size LIMIT 1")
def cut_capacity(spark, sf):
    capacity = derive.sales_network(spark, sf).stored()
    _, residual = flows.maximum_flow(capacity, derive.SOURCE, derive.SINK)
    side = graphs.minimum_cut(residual, derive.SOURCE)
    return graphs.cut_capacity(capacity, side).select("val", F.lit(side.count()).cast("bigint").alias("side"))


@query(
    f"""WITH {SUPPLY}, s AS (SELECT sum(val) // 2 AS cap FROM supply GROUP BY src), p AS (SELECT sum(val) * 3 // 5 AS cap FROM supply GROUP BY dst)
SELECT (SELECT count(*) FROM supply) + (SELECT count(*) FROM s) + (SELECT count(*) FROM p) AS arcs, true AS tight, CAST(0 AS BIGINT) AS unbalanced, CAST(0 AS BIGINT) AS over"""
)
def supply_flow(spark, sf):
    """Suppliers to parts: the flow is valid and worth the cut found beside it, so both are best (a proof, whatever the value)."""
    capacity = derive.supply_network(spark, sf).stored()
    _, residual, row = checked_flow(capacity)
    cut = graphs.cut_capacity(capacity, graphs.minimum_cut(residual, derive.SOURCE)).withColumnRenamed("val", "cut")
    arcs = capacity.cells.agg(F.count("*").alias("arcs"))
    return row.join(cut).join(arcs).select("arcs", (F.col("val") == F.col("cut")).alias("tight"), "unbalanced", "over")  # one row each


@query(f"WITH {TRADE} SELECT key, sum(val)::BIGINT AS val FROM (SELECT src AS key, val FROM trade UNION ALL SELECT dst, -val FROM trade) GROUP BY 1")
def balance(spark, sf):
    return graphs.balance(derive.nation_trade(spark, sf))


# --- random graphs


@query("SELECT CAST(floor(count(*) * count(*) * 0.25) AS BIGINT) AS n FROM nation")
def random_graph_count(spark, sf):
    n = derive.nations(spark, sf).count()
    return random_graphs.random_graph(spark, n, 0.25, seed=5).cells.agg(F.count("*").alias("n"))


# --- further operators


@query(f"WITH RECURSIVE {TRAITS}, {SHORTEST} SELECT src, dst, len, cnt FROM d")
def geodesics(spark, sf):
    return closure.geodesics(derive.supplier_traits(spark, sf), count="bigint")


@query(
    f"""WITH RECURSIVE {TRADE}, pairs AS (SELECT src, dst FROM trade UNION SELECT dst, src FROM trade),
reach(src, dst) AS (SELECT id, id FROM ids UNION SELECT reach.src, pairs.dst FROM reach JOIN pairs ON reach.dst = pairs.src)
SELECT src, dst, true AS val FROM reach"""
)
def symmetric_star_closure(spark, sf):
    return cells(closure.symmetric_star_closure(derive.nation_trade(spark, sf).booleans()))


@query(
    f"""WITH RECURSIVE {SIGNED}, walk(src, dst, sign) AS (
  SELECT src, dst, CASE WHEN val = '+' THEN 1 ELSE -1 END FROM signed
  UNION SELECT walk.src, signed.dst, sign * CASE WHEN signed.val = '+' THEN 1 ELSE -1 END FROM walk JOIN signed ON walk.dst = signed.src)
SELECT src, dst, CASE WHEN count(*) = 2 THEN '+-' WHEN min(sign) = 1 THEN '++' ELSE '--' END AS val FROM walk GROUP BY 1, 2"""
)
def closure_balanced(spark, sf):
    """Signs of all walks between two nations."""
    return cells(closure.closure(derive.signed_trade(spark, sf).map(alg.sign_to_balanced, alg.BALANCED)))


@query(
    f"""WITH RECURSIVE {SIGNED}, walk(src, dst, negatives) AS (
  SELECT src, dst, CASE WHEN val = '+' THEN 0 ELSE 1 END FROM signed
  UNION SELECT walk.src, signed.dst, least(2, negatives + CASE WHEN signed.val = '+' THEN 0 ELSE 1 END) FROM walk JOIN signed ON walk.dst = signed.src)
SELECT src, dst, CASE WHEN bool_or(negatives = 0) AND bool_or(negatives = 1) THEN 'a' WHEN bool_or(negatives = 0) THEN 'p' WHEN bool_or(negatives = 1) THEN 'n' ELSE 'q' END AS val
FROM walk GROUP BY 1, 2"""
)
def closure_clustered(spark, sf):
    """Whether walks between two nations have no, one or only more negative arcs."""
    return cells(closure.closure(derive.signed_trade(spark, sf).map(alg.sign_to_clustered, alg.CLUSTERED)))


@query(f"WITH {TRADE} SELECT a.src, b.dst, max(least(a.val, b.val)) AS val FROM trade a JOIN trade b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2 HAVING max(least(a.val, b.val)) > 40000")
def filter_matrix(spark, sf):
    m = derive.nation_trade(spark, sf, alg.widest())
    two = products.mat_mat(m, m)
    return cells(two.drop(two.identity()).filter(lambda v: v > 40000))


@query(f"WITH {TRADE} SELECT t.src, t.dst, true AS val FROM trade t JOIN trade u ON t.src = u.dst AND t.dst = u.src")
def common_arcs(spark, sf):
    m = derive.nation_trade(spark, sf)
    return cells(m.common_arcs(m.transposed()))


@query(f"WITH {TRADE} SELECT id, coalesce((SELECT sum(val)::BIGINT FROM trade WHERE src = id), 0) AS val FROM ids")
def per_vertex_sum(spark, sf):
    return derive.nation_trade(spark, sf).per_vertex(F.sum("val")).select("id", F.coalesce("val", F.lit(0)).alias("val"))


@query(f"WITH {SUPPLY} SELECT src, dst, val FROM supply WHERE src IN (SELECT src FROM supply GROUP BY src HAVING count(*) % 2 = 0)")
def filter_adjacencies(spark, sf):
    return cells(derive.supply(spark, sf).filter_rows(F.count("*") % 2 == 0))


@query(f"WITH {TRADE} SELECT src, dst, sum(val)::BIGINT AS val FROM (SELECT src, dst, val FROM trade UNION ALL SELECT id, id, 1 FROM ids) GROUP BY 1, 2")
def with_identity(spark, sf):
    return cells(closure.with_identity(derive.nation_trade(spark, sf)))


@query(f"WITH {TRADE} SELECT src, dst, CASE WHEN src = 3 AND dst = 4 THEN -1 ELSE val END AS val FROM trade UNION SELECT 3, 4, -1")
def put_cell(spark, sf):
    return cells(derive.nation_trade(spark, sf).put(3, 4, F.lit(-1).cast("bigint")).put(99, 1, F.lit(5).cast("bigint")))


@query(f"WITH {TWO} SELECT key, CASE WHEN b.val IS NULL THEN a.val * 100 + a.val WHEN a.val IS NULL THEN b.val ELSE a.val * 100 + (b.val * 100 + a.val) END AS val FROM a FULL JOIN b USING (key)")
def union_op_of_many(spark, sf):
    a, b = two_vectors(spark, sf)
    return setops.union_many([a.df, b.df, a.df], lambda x, y: x * 100 + y)


@query(f"WITH {TWO} SELECT key, concat_ws(' ', a.val, b.val) AS vals FROM a FULL JOIN b USING (key)")
def union_lists(spark, sf):
    a, b = two_vectors(spark, sf)
    both = setops.union_lists([v.map(lambda x: F.array(x)).df for v in (a, b)])
    return both.select("key", F.array_join(F.col("val").cast("array<string>"), " ").alias("vals"))


@query(f"WITH {TWO} SELECT key, CASE WHEN b.val IS NULL THEN a.val WHEN a.val IS NULL THEN b.val ELSE a.val - b.val END AS val FROM a FULL JOIN b USING (key) WHERE a.val IS NULL OR b.val IS NULL OR a.val > b.val")
def sym_diff_op(spark, sf):
    a, b = two_vectors(spark, sf)
    return setops.symmetric_difference_with(a.df, b.df, lambda x, y: F.when(x > y, x - y))


@query(f"WITH {TWO} SELECT list_reduce(list_prepend(0::BIGINT, list(key + val ORDER BY key DESC)), lambda rest, x: (rest * 31 + x) % 1000003) AS val FROM a")
def ordered_fold(spark, sf):
    """A right fold whose result depends on the order: the lowest key is merged last."""
    a, _ = two_vectors(spark, sf)
    return a.fold(lambda k, v, rest: (rest * 31 + k + v) % 1000003, F.lit(0).cast("bigint"))


@query(f"WITH {TWO} SELECT key, val FROM a WHERE key <> 3 AND key <> 7 UNION ALL SELECT 7, 0")
def insert_delete(spark, sf):
    return two_vectors(spark, sf)[0].delete(3).insert(7, F.lit(0)).df


@query(f"WITH {TWO} SELECT key, greatest(val, 0) AS val FROM a WHERE val = (SELECT max(val) FROM a)")
def restrict_to_greatest(spark, sf):
    return two_vectors(spark, sf)[0].restrict_to_greatest().df


CHAINS = "chains AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS path FROM lineitem GROUP BY 1)"


@query(
    f"""WITH {CHAINS}
SELECT id, len(path) AS n, array_to_string(list_reverse(path), '->') AS reversed, len(path) - 1 AS arcs, path[1] AS first_src, coalesce(path[2], -1) AS first_dst FROM chains"""
)
def path_functions(spark, sf):
    """Paths of the parts of each order: lengths count vertices."""
    parts = derive.order_paths(spark, sf)
    p, arcs = F.col("path"), paths.arcs_of(F.col("path"))
    first = F.get(arcs, F.lit(0))
    return parts.select(
        "id", paths.n_vertices(p).cast("bigint").alias("n"), paths.show_path(paths.reverse_path(p)).alias("reversed"), F.size(arcs).cast("bigint").alias("arcs"),
        F.coalesce(first["src"], F.get(p, F.lit(0))).alias("first_src"), F.coalesce(first["dst"], F.lit(-1)).alias("first_dst"),
    )


@query(f"WITH {CHAINS} SELECT id, array_to_string(list_slice(path, 1, 3), ' ') AS vertices, CASE WHEN len(path) >= 3 THEN 'x y' WHEN len(path) = 2 THEN 'x' ELSE '' END AS labels FROM chains")
def labelled_paths(spark, sf):
    parts = derive.order_paths(spark, sf)
    later = F.slice("path", F.lit(2), F.lit(2))
    steps = F.transform(later, lambda v, i: F.struct(F.when(i == 0, "x").otherwise("y").alias("label"), v.alias("vertex")))
    back = paths.reverse_labelled(paths.reverse_labelled(paths.labelled_from(F.get("path", F.lit(0)), steps)))
    there = parts.select("id", paths.from_interleaved(paths.interleaved(back)).alias("p"))
    return there.select("id", F.array_join(paths.vertices_of(F.col("p")).cast("array<string>"), " ").alias("vertices"), F.array_join(paths.labels_of(F.col("p")), " ").alias("labels"))


@query("SELECT CAST(bit_count(range) AS INTEGER) AS size, count(*) AS n FROM range(4096) WHERE bit_count(range) >= 3 GROUP BY 1")
def subset_sizes(spark, sf):
    return voting.subsets(few_players(spark, sf), 3).groupBy("size").agg(F.count("*").alias("n"))


@query(
    "SELECT p_partkey AS key, p_partkey * 5 AS fivefold, p_partkey * p_partkey * p_partkey AS cube, CASE p_size % 3 WHEN 0 THEN 'Min' WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE 'Max' END AS shown FROM part"
)
def scalar_functions(spark, sf):
    """Multiples and powers of part keys, and part sizes as tropical numbers shown as text."""
    k, size = F.col("p_partkey"), F.col("p_size")
    t = F.when(size % 3 == 0, alg.TROPICAL.one()).when(size % 3 == 1, alg.finite(size)).otherwise(alg.TROPICAL.zero())
    return derive.table(spark, sf, "part").select(k.alias("key"), alg.NUMBER.multiple(5, k).alias("fivefold"), alg.NUMBER.power(k, 3).alias("cube"), alg.show_tropical(t).alias("shown"))


@query(f"WITH {TRADE} SELECT id, coalesce((SELECT string_agg(dst || ':' || val, ' ' ORDER BY dst) FROM trade WHERE src = id), '') AS line FROM ids")
def show_rows(spark, sf):
    return derive.nation_trade(spark, sf).show_rows()


@query(
    f"""WITH {EVENTS}, w1 AS (SELECT src, dst FROM moves), w2 AS (SELECT a.src, b.dst FROM w1 a JOIN w1 b ON a.dst = b.src)
SELECT src, dst, count(*) AS walks, 0::BIGINT AS others FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY 1, 2"""
)
def regular_closure(spark, sf):
    """Regular expressions of all walks among the event types, held against all sequences of one and two arcs: how many
    walks between two types the expression matches, and how many sequences that are no such walk. A letter is an arc."""
    m = derive.transitions(spark, sf).stored()
    name = lambda s, d: F.char(F.lit(97) + 5 * s + d)
    closed = closure.closure(m.map_with_keys(lambda s, d, v: alg.letter(name(s, d)), alg.REGULAR)).cells
    closed = closed.select("src", "dst", F.concat(F.lit("^(?:"), F.regexp_replace(F.regexp_replace(alg.show_regular(F.col("val")), "⊕", "|"), "[⊛ε]", ""), F.lit(")$")).alias("e"))
    one = m.cells.select(F.col("src").alias("first"), F.col("dst").alias("last"), name(F.col("src"), F.col("dst")).alias("w"), F.lit(True).alias("walk"))
    next_ = one.select(F.col("first").alias("via"), F.col("last").alias("to"), F.col("w").alias("v"))
    # all pairs of arcs, walks or not: the graph has as many vertices as there are event types
    two = one.join(next_).select("first", F.col("to").alias("last"), F.concat("w", "v").alias("w"), (F.col("last") == F.col("via")).alias("walk"))
    found = closed.join(one.unionByName(two)).where(F.rlike("w", "e"))
    right = F.col("walk") & (F.col("first") == F.col("src")) & (F.col("last") == F.col("dst"))
    return found.groupBy("src", "dst").agg(F.count_if(right).alias("walks"), F.count_if(~right).alias("others"))


# --- sources


def nation_rows(spark, sf) -> list[list[tuple[int, int]]]:
    """The nations of each region with the length of their names, as Python values (regions are few and numbered from 0)."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for r in derive.table(spark, sf, "nation").collect():
        rows.setdefault(r.n_regionkey, []).append((r.n_nationkey, len(r.n_name)))
    return [sorted(rows.get(k, [])) for k in range(max(rows) + 1)]


@query("SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(n_nationkey AS BIGINT) AS dst, CAST(length(n_name) AS BIGINT) AS val FROM nation")
def from_rows(spark, sf):
    return cells(build.from_rows(spark, nation_rows(spark, sf), alg.NUMBER))


@query("SELECT CAST(n_regionkey AS BIGINT) AS id, string_agg(n_nationkey || ':' || length(n_name), ' ' ORDER BY n_nationkey) AS line FROM nation GROUP BY 1")
def from_mat(spark, sf):
    """A checked matrix and mappings give the same rows."""
    rows = nation_rows(spark, sf)
    a = build.from_mat(spark, list(enumerate(rows)), alg.NUMBER, validate=True).validated()
    b = build.from_mappings(spark, [dict(reversed(r)) for r in rows], alg.NUMBER)
    return a.union(b).show_rows()


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, true AS val FROM lineitem")
def adjacency_column(spark, sf):
    """A graph from an array of successors per row: the parts of each order."""
    orders = derive.order_paths(spark, sf).select("id", F.array_distinct("path").alias("parts"))
    return cells(build.from_adjacency_column(orders, "id", F.col("parts")))


@query("SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(n_nationkey AS BIGINT) AS dst, true AS val FROM nation")
def matrix_column(spark, sf):
    """One row with an array of arrays, and lists of Python, are the same graph: the nations of each region."""
    per = derive.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("bigint"))).alias("row"))
    one = per.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_regionkey", "row"))), lambda r: r["row"]).alias("m"))
    return cells(build.from_matrix_column(one, F.col("m")).keep(build.from_adjacencies(spark, [[n for n, _ in row] for row in nation_rows(spark, sf)])))


@query(f"WITH {SUPPLY} SELECT src, dst, val FROM supply")
def edges_round_trip(spark, sf):
    """Written as a table and read back."""
    folder = work_folder(spark, "edges")
    build.write_edges(derive.supply(spark, sf), folder)
    return cells(build.read_edges(spark, folder, algebra=alg.NUMBER, val="val"))


@query(
    """WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS key, CAST(n_nationkey AS BIGINT) AS nation FROM nation)
SELECT 'first' AS made, key, min(nation) AS val FROM n GROUP BY 2 UNION ALL SELECT 'last', key, max(nation) FROM n GROUP BY 2
UNION ALL SELECT 'one', max(key), 1 FROM n UNION ALL SELECT 'keys', p_partkey, 9 FROM part UNION ALL SELECT 'rows', c_custkey, CAST(c_nationkey AS BIGINT) FROM customer"""
)
def vector_sources(spark, sf):
    """Vectors from pairs that repeat keys, of one entry, of the first keys, and from a table."""
    pairs = [(k, n) for k, row in enumerate(nation_rows(spark, sf)) for n, _ in row]
    customers = derive.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("bigint").alias("val"))
    made = {
        "first": Vec.of(spark, pairs, alg.NUMBER), "last": Vec.of(spark, pairs, alg.NUMBER, "last"), "one": Vec.unit(spark, pairs[-1][0], alg.NUMBER),
        "keys": Vec.first_keys(spark, derive.table(spark, sf, "part").count(), F.lit(9), alg.NUMBER), "rows": Vec(customers, alg.NUMBER),
    }
    return reduce(DataFrame.unionByName, [v.df.select(F.lit(k).alias("made"), "key", "val") for k, v in made.items()])


@query("SELECT (SELECT CAST(floor(count(*) * count(*) * 0.3) AS BIGINT) FROM nation) AS relation, (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM customer) AS diagonal, (SELECT CAST(floor(count(*) * (count(*) - 1) // 2 * 0.4) AS BIGINT) FROM nation) AS triangle")
def random_shapes(spark, sf):
    """Exact numbers of cells of a random relation, diagonal and strict triangle, all where they belong."""
    n, c = derive.nations(spark, sf).count(), derive.table(spark, sf, "customer").count()
    size = lambda m, where: m.cells.where(where).distinct().agg(F.count("*").alias("n")).first().n
    found = (
        size(random_graphs.random_relation(spark, n, n, 0.3, seed=2), "val"),
        size(random_graphs.random_diagonal(spark, c, 0.5, seed=3), "src = dst"),
        size(random_graphs.random_triangle(spark, n, 0.4, seed=4, strict=True), "src > dst"),
    )
    return spark.createDataFrame([found], "relation bigint, diagonal bigint, triangle bigint")


@query(
    """WITH RECURSIVE behind AS (
  SELECT l_partkey AS src, p_size AS size, lead(l_partkey) OVER w AS dst, lead(p_size) OVER w AS next FROM lineitem JOIN part ON l_partkey = p_partkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)),
arcs AS (SELECT DISTINCT src, dst FROM behind WHERE size = next),
walk(root, key, level) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT root, dst, level + 1 FROM walk JOIN arcs ON key = src WHERE level < 40),
least AS (SELECT key, min(root) AS root FROM walk GROUP BY 1)
SELECT least.root, least.key, min(level) AS level FROM walk JOIN least ON walk.key = least.key AND walk.root = least.root GROUP BY 1, 2"""
)
def directed_components(spark, sf):
    """From the least part not yet reached along arcs, again and again: roots, and levels of what each is the first to reach."""
    return graphs.per_root(derive.size_successions(spark, sf), merge=True)


@query(f"WITH RECURSIVE {TRAITS}, {SHORTEST} SELECT src, dst, CAST(len AS BIGINT) AS len, cnt FROM d")
def geodesic_closure(spark, sf):
    """The same counts as ``geodesics``, as a closure under the algebra of lengths and numbers of shortest walks, by blocks of kinds."""
    one = F.struct(alg.finite(F.lit(1)).alias("len"), alg.finite(F.lit(1)).alias("cnt"))
    kinds, closed = closure.closure_of_kinds(derive.supplier_traits(spark, sf).constant(one, alg.GEODESIC), drop_zeros=True)
    # labels are read before rows are made for all vertices
    return kinds.expanded(closed.cells.select("src", "dst", alg.weight_of(F.col("val.len")).alias("len"), alg.weight_of(F.col("val.cnt")).alias("cnt")))


# --- vectors and matrices, further


@query(f"WITH {TWO} SELECT b.key, b.val FROM b JOIN a USING (key)")
def keep_right(spark, sf):
    a, b = two_vectors(spark, sf)
    return setops.keep_right(a.df, b.df)


@query(f"WITH {TRADE} SELECT t.src, t.dst, u.val FROM trade t JOIN trade u ON t.src = u.dst AND t.dst = u.src")
def keep_other(spark, sf):
    """The turned cells at the places that are filled both ways."""
    m = derive.nation_trade(spark, sf)
    return cells(m.keep_other(m.transposed()))


@query(f"WITH {TWO} SELECT key, key * 1000 + a.val - b.val AS val FROM a JOIN b USING (key)")
def intersect_with_key(spark, sf):
    a, b = two_vectors(spark, sf)
    return setops.intersect_with_key(a.df, b.df, lambda k, x, y: k * 1000 + x - y)


@query(f"WITH {TWO} SELECT key, val // 2 AS val, key % 7 AS rest FROM a WHERE val % 2 = 0 AND key % 7 > 0")
def map_maybe(spark, sf):
    """Labels of an even value and of keys that seven does not divide."""
    a, _ = two_vectors(spark, sf)
    half = a.map_maybe(lambda v: F.when(v % 2 == 0, F.expr("val div 2")))
    rest = a.map_maybe_with_key(lambda k, v: F.when(k % 7 > 0, k % 7))
    return setops.intersect(half.df, rest.df, lambda x, y: F.struct(x.alias("x"), y.alias("y"))).select("key", F.col("val.x").alias("val"), F.col("val.y").alias("rest"))


@query(f"WITH {TWO} SELECT (SELECT min(key) FROM a) AS low, (SELECT max(key) FROM a) AS high, (SELECT min(key) FROM a) AS some, (SELECT count(*) FROM b WHERE val = (SELECT max(val) FROM b)) AS top, (SELECT count(*) FROM range(5000) WHERE range NOT IN (SELECT key FROM b)) AS gaps, CAST(0 AS BIGINT) AS absent, (SELECT count(*) FROM a) AS pairs")
def vector_reading(spark, sf):
    a, b = two_vectors(spark, sf)
    one = a.bounds()
    for df in (
        a.some().select(F.col("key").alias("some")), b.greatest_keys().agg(F.count("*").alias("top")), b.full_rows(5000).agg(F.count_if(F.col("val").isNull()).alias("gaps")),
        a.at_or_zero(-1).select(F.col("val").alias("absent")), a.with_keys().df.where("val.key = key").agg(F.count("*").alias("pairs")),
    ):
        one = one.join(df)  # one row each
    return one


@query(f"WITH {TWO} SELECT list_reduce(list_prepend(1::BIGINT, list((val % 10 + 1) ORDER BY key)), lambda x, y: (x * y) % 1009) AS val FROM b")
def vector_product(spark, sf):
    """A product of all labels under numbers modulo a prime."""
    _, b = two_vectors(spark, sf)
    modular = replace(alg.NUMBER, times=lambda x, y: (x * y) % 1009)
    return Vec(b.map(lambda v: v % 10 + 1).df, modular).product()


@query(f"WITH {TWO} SELECT list_reduce(list_prepend(0::BIGINT, list(key + val ORDER BY key DESC)), lambda rest, x: (rest * 31 + x) % 1000003) AS val FROM b")
def ordered_product(spark, sf):
    """The fold of ``ordered_fold`` over all orders, as a product of maps x -> scale * x + shift, which does not commute."""
    _, b = two_vectors(spark, sf)
    one = lambda a, c: F.struct(a.cast("bigint").alias("scale"), c.cast("bigint").alias("shift"))
    after = lambda f, g: one(f["scale"] * g["scale"] % 1000003, (f["scale"] * g["shift"] + f["shift"]) % 1000003)
    maps = alg.Algebra("maps", "struct<scale:bigint,shift:bigint>", None, lambda: one(F.lit(1), F.lit(0)), None, after, None)
    found = Vec(b.map_with_key(lambda k, v: one(F.lit(31), k + v)).df, maps).product()
    return found.select(F.col("val.shift").alias("val"))


@query(f"WITH {TRADE}, turned AS (SELECT dst AS src, src AS dst, val FROM trade) SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN a.val IS NULL THEN b.val WHEN b.val IS NULL THEN a.val ELSE a.val - b.val END AS val FROM trade a FULL JOIN turned b ON a.src = b.src AND a.dst = b.dst")
def symmetric_with(spark, sf):
    return cells(derive.nation_trade(spark, sf).symmetric_with(lambda x, y: x - y))


@query(f"WITH {SUPPLY} SELECT (SELECT count(*) FROM part) AS rows, (SELECT count(*) FROM supply) AS arcs, (SELECT count(DISTINCT dst) FROM supply) AS filled")
def transposed_of_width(spark, sf):
    m = derive.supply(spark, sf).transposed_of_width(derive.table(spark, sf, "part").count())
    return m.rows.agg(F.count("*").alias("rows")).join(m.cells.agg(F.count("*").alias("arcs"), F.countDistinct("src").alias("filled")))  # one row each


@query(f"WITH {TRADE}, put AS (SELECT 3 AS src, 4 AS dst, -1 AS val UNION ALL SELECT 5, 6, -2 UNION ALL SELECT 6, 5, -2), one AS (SELECT id AS src, id AS dst, 1 AS val FROM ids WHERE id % 5 = 0) SELECT src, dst, sum(val)::BIGINT AS val FROM (SELECT * FROM put UNION ALL SELECT src, dst, val FROM trade WHERE (src, dst) NOT IN (SELECT (src, dst) FROM put) UNION ALL SELECT * FROM one) GROUP BY 1, 2")
def put_edges(spark, sf):
    """An arc and an edge put in, and a partial identity added."""
    m = derive.nation_trade(spark, sf)
    edited = m.add_arc(3, 4, F.lit(-1)).add_edge(5, 6, F.lit(-2))
    return cells(edited.plus(m.partial_identity(m.vertices().filter_with_key(lambda k, v: k % 5 == 0))))


@query(f"WITH {SUPPLY} SELECT dst AS key, 2 * val AS val FROM supply WHERE src = 7")
def successors(spark, sf):
    return derive.supply(spark, sf).successors(7, lambda v: 2 * v).df


@query(f"WITH {SUPPLY} SELECT src, dst, val - min(val) OVER (PARTITION BY src) AS val FROM supply")
def map_rows(spark, sf):
    """Each row as a whole: labels less the row's least."""
    least = F.min("val").over(Window.partitionBy("src"))
    return cells(derive.supply(spark, sf).map_rows(lambda c: c.select("src", "dst", (F.col("val") - least).alias("val"))))


@query("SELECT true AS below, false AS above, true AS same, true AS empty, false AS other, true AS held, false AS lacking")
def matrix_tests(spark, sf):
    """Natural order, equality, emptiness and membership."""
    m = derive.nation_trade(spark, sf).booleans().stored()
    part = m.restrict_rows(m.vertices().filter_with_key(lambda k, v: k % 3 == 0))
    answers = (part.at_most(m), m.at_most(part), m.equals(m.union(part)), m.emptied().is_empty(), m.is_empty(), m.vertices().contains(3), m.vertices().contains(-3))
    return spark.createDataFrame([answers], "below boolean, above boolean, same boolean, empty boolean, other boolean, held boolean, lacking boolean")


# --- algebras as labels of products


@query(f"WITH {SUPPLY} SELECT dst AS key, sum((src % 7) * val)::BIGINT AS total, count(*) AS n FROM supply GROUP BY 1")
def zipped_labels(spark, sf):
    two = alg.zip_list(alg.NUMBER, 2)
    m = derive.supply(spark, sf).map(lambda v: F.array(v, F.lit(1).cast("bigint")), two)
    found = products.vec_mat(m.vertices().map_with_key(lambda k, v: F.array(k % 7, F.lit(1).cast("bigint")), two), m)
    return found.df.select("key", F.get("val", F.lit(0)).alias("total"), F.get("val", F.lit(1)).alias("n"))


@query(f"WITH {SUPPLY} SELECT dst AS key, sum((src % 7) * val)::BIGINT AS plain, sum((src % 3) * val)::BIGINT AS other FROM supply GROUP BY 1")
def function_labels(spark, sf):
    """Functions on a domain of two points."""
    both = alg.over_domain(alg.NUMBER, ["plain", "other"])
    point = lambda x, y: F.create_map(F.lit("plain"), x, F.lit("other"), y)
    m = derive.supply(spark, sf).map(lambda v: point(v, v), both)
    found = products.vec_mat(m.vertices().map_with_key(lambda k, v: point(k % 7, k % 3), both), m)
    return found.df.select("key", F.col("val")["plain"].alias("plain"), F.col("val")["other"].alias("other"))


@query(f"WITH {SUPPLY} SELECT dst AS key, arg_min(val, src) FILTER (val % 2 = 0) AS val FROM supply GROUP BY 1")
def first_labels(spark, sf):
    """The even label of the lowest source that has one, else null."""
    g = alg.first("bigint")
    m = derive.supply(spark, sf).map(lambda v: F.when(v % 2 == 0, v), g)
    return products.vec_mat(m.vertices().constant(F.lit(1).cast("bigint"), g), m).df


@query(f"WITH {SUPPLY}, d AS (SELECT dst, min(src % 3) AS len FROM supply GROUP BY 1) SELECT supply.dst AS key, len + 1 AS len, count(*) AS cnt FROM supply JOIN d ON supply.dst = d.dst AND src % 3 = len GROUP BY 1, 2")
def geodesic_labels(spark, sf):
    """Least lengths and their counts, over one arc from suppliers at different distances."""
    at = lambda n: F.struct(alg.finite(n).alias("len"), alg.finite(F.lit(1)).alias("cnt"))
    m = derive.supply(spark, sf).map(lambda v: at(F.lit(1)), alg.GEODESIC)
    found = products.vec_mat(m.vertices().map_with_key(lambda k, v: at(k % 3), alg.GEODESIC), m)
    return found.df.select("key", alg.weight_of(F.col("val.len")).alias("len"), alg.weight_of(F.col("val.cnt")).alias("cnt"))


@query(f"WITH {SUPPLY} SELECT dst AS key, CAST(min(src) AS VARCHAR) AS path, arg_min(val, src) AS width FROM supply GROUP BY 1")
def bottleneck_step(spark, sf):
    """Paths with their least capacity, one step on."""
    m = derive.supply(spark, sf)
    start = m.vertices().constant(F.struct(paths.empty_path().alias("path"), F.lit(None).cast("bigint").alias("width")), alg.widest())
    return products.extended_bottleneck(start, m).df.select("key", F.array_join(F.col("val.path").cast("array<string>"), " ").alias("path"), F.col("val.width").alias("width"))


@query(f"WITH {TRADE} SELECT b.dst AS key, string_agg(a.src || '-' || b.src, ' ' ORDER BY b.src, a.src) AS paths FROM trade a JOIN trade b ON a.dst = b.src GROUP BY 1")
def all_paths(spark, sf):
    """All walks of two arcs, by their last and then their first source."""
    m = derive.nation_trade(spark, sf)
    start = m.vertices().constant(F.array(paths.empty_path()), alg.free("array<bigint>"))
    found = products.extended_paths(products.extended_paths(start, m), m)
    return found.df.select("key", F.array_join(F.transform("val", lambda p: F.array_join(p.cast("array<string>"), "-")), " ").alias("paths"))


@query("WITH q AS (SELECT p_partkey AS key, CAST(p_size % 20 AS BIGINT) AS range FROM part) SELECT key, CASE WHEN range = 0 THEN 'Min' ELSE CAST(range - 1 AS VARCHAR) END AS low, greatest(range - 1, 0) AS weight, CASE WHEN range = 0 THEN '3' ELSE CAST(range + 2 AS VARCHAR) END AS plus, CASE WHEN range = 0 THEN 'Min' ELSE CAST(3 * (range - 1) AS VARCHAR) END AS times, range * 6 AS product, range + 6 AS total, range % 2 = 1 AS one FROM q")
def scalar_conversions(spark, sf):
    """Part sizes as tropical numbers and back, their sums and products as numbers, and folds of labels."""
    k = (F.col("p_size") % 20).cast("bigint")
    low, three = alg.finite_or_low(k - 1), alg.finite(F.lit(3))
    return derive.table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), alg.show_tropical(low).alias("low"), alg.weight_or_zero(low).alias("weight"), alg.show_tropical(alg.add_tropical(low, three)).alias("plus"),
        alg.show_tropical(alg.multiply_tropical(low, three)).alias("times"), alg.NUMBER.product_of([k, F.lit(2).cast("bigint"), F.lit(3).cast("bigint")]).alias("product"),
        alg.NUMBER.sum_of([k, F.lit(2).cast("bigint"), F.lit(4).cast("bigint")]).alias("total"), (~alg.NUMBER.is_not_one(k % 2)).alias("one"),
    )


@query(f"WITH {TWO} SELECT key, CAST(sum(val) AS BIGINT) AS val FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def sum_labels(spark, sf):
    """Numbers under addition alone."""
    a, b = two_vectors(spark, sf)
    return Vec(a.df, alg.sums()).plus(Vec(b.df, alg.sums())).df


@query(f"WITH {SUPPLY} SELECT src AS key, count(*) AS arcs, true AS near FROM supply GROUP BY 1")
def out_degrees(spark, sf):
    """Arcs of each supplier as a stream would count them, and whether the estimate of different parts is within a tenth."""
    found = edges.degrees(derive.supply(spark, sf).cells)
    return found.select("key", "arcs", (F.abs(F.col("successors") - F.col("arcs")) <= F.greatest(F.col("arcs") * 0.1, F.lit(2))).alias("near"))


@query(f"WITH {CHAINS} SELECT id, '-1->' || array_to_string(path, '->') AS stepped, len(path) + 1 AS n, array_to_string(list_filter(path, lambda x, i: i % 2 = 1), ' ') AS evens, array_to_string(list_filter(path, lambda x, i: i % 2 = 0), ' ') AS odds, path[1] AS start, CAST(len(path) AS INTEGER) AS steps, len(path) AS third FROM chains")
def path_steps(spark, sf):
    """Steps to either side, labelled paths taken apart and put together, and every second vertex."""
    p = F.col("path")
    grown = paths.labelled_step_left(F.lit(-1).cast("bigint"), F.lit("l"), paths.labelled_step_right(paths.initial(F.get(p, F.lit(0))), F.lit("r"), F.lit(-2).cast("bigint")))
    steps = F.transform(F.slice(p, F.lit(2), F.size(p)), lambda v: F.struct(F.lit("x").alias("label"), v.alias("vertex")))
    apart = paths.start_and_steps(paths.labelled_from(F.get(p, F.lit(0)), steps))
    pairs = F.transform(p, lambda v, i: F.struct(i.alias("key"), F.size(p).cast("bigint").alias("val")))
    return derive.order_paths(spark, sf).select(
        "id", paths.show_path(paths.step_left(F.lit(-1).cast("bigint"), p)).alias("stepped"), F.size(paths.step_right(p, F.lit(-2).cast("bigint"))).cast("bigint").alias("n"),
        F.array_join(paths.evens(p).cast("array<string>"), " ").alias("evens"), F.array_join(paths.odds(p).cast("array<string>"), " ").alias("odds"),
        apart["start"].alias("start"), (F.size(apart["steps"]) + paths.n_labelled(grown) - 2).alias("steps"), paths.lookup(pairs, F.lit(0)).alias("third"),
    )


# --- loops, further


@query(
    f"""WITH RECURSIVE {SUPPLY}, pairs AS (SELECT DISTINCT a.src, b.src AS dst FROM supply a JOIN supply b ON a.dst = b.dst),
walk(key, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT pairs.dst, level + 1 FROM walk JOIN pairs ON walk.key = pairs.src WHERE level < 6)
SELECT min(level) AS level, key FROM walk GROUP BY key"""
)
def two_graph_levels(spark, sf):
    """A step passes from a supplier to its parts and back to their suppliers: a list of graphs."""
    m = derive.supply(spark, sf)
    return levels.distance(origin(spark), [m, m.transposed()], m.rows.select(F.col("id").alias("key")))


@query(
    f"""WITH RECURSIVE {HALF}, {REGION_SUPPLIERS}, walk(key, level) AS (
  SELECT 2 * s_suppkey, 0 FROM ours WHERE region = 0 UNION SELECT joined.dst, level + 1 FROM walk JOIN joined ON walk.key = joined.src WHERE level < 4),
lvl AS (SELECT key, min(level) AS level FROM walk GROUP BY key),
goal AS (SELECT key, level FROM lvl WHERE key IN (SELECT 2 * s_suppkey FROM ours WHERE region = 1)),
step AS (SELECT b.key, min(a.key) AS pred FROM lvl a JOIN joined ON a.key = joined.src JOIN lvl b ON b.key = joined.dst AND b.level = a.level + 1 GROUP BY 1),
path(key, spot, level, trail) AS (
  SELECT key, key, level, CAST(key AS VARCHAR) FROM goal WHERE level = (SELECT min(level) FROM goal)
  UNION ALL SELECT path.key, step.pred, level - 1, step.pred || ' ' || trail FROM path JOIN step ON path.spot = step.key WHERE level > 0)
SELECT key AS path_id, trail AS path FROM path WHERE level = 0"""
)
def paths_by_strategy(spark, sf):
    """Shortest paths between the suppliers of two regions, picked by a strategy of the caller's choice, here least predecessors."""
    start, target = derive.suppliers_of(spark, sf, 0), derive.suppliers_of(spark, sf, 1)
    found = levels.paths_by(levels.least_paths, start, target, derive.supply_graph(spark, sf))
    return found.select("path_id", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


@query(
    f"""WITH {HALF}, {least_labels('joined')}
SELECT root, count(*) FILTER ((key + root) % 2 = 0) AS near, count(*) FILTER ((key + root) % 2 = 1) AS far FROM roots GROUP BY 1"""
)
def componentwise(spark, sf):
    """A function applied to each component: how many vertices lie on even and on odd levels of its search."""
    found = graphs.componentwise(derive.supply_graph(spark, sf), lambda start, g, within: levels.distance(start, g, within))
    return found.groupBy("root").agg(F.count_if(F.col("level") % 2 == 0).alias("near"), F.count_if(F.col("level") % 2 == 1).alias("far"))


@query(f"WITH {EVENTS}, {least_walks('moves')} SELECT src, dst, val FROM w6")
def closure_by_pivots(spark, sf):
    """The same closure with a step of the caller's: one row is passed through at a time."""
    def through(m: Matrix, k: int) -> Matrix:
        into, out = m.cells.where(F.col("dst") == k), m.cells.where(F.col("src") == k)
        return m.plus(products.mat_mat(m.like(into), m.like(out)))

    m = derive.transitions(spark, sf)
    return cells(closure.pivot_closure(m.like(m.cells, alg.LEAST), through))


@query(
    f"""WITH RECURSIVE {TRADE}, pairs AS (SELECT src, dst FROM trade UNION SELECT dst, src FROM trade),
odd(root, key, parity) AS (SELECT id, id, 0 FROM ids UNION SELECT root, pairs.dst, 1 - parity FROM odd JOIN pairs ON odd.key = pairs.src)
SELECT NOT EXISTS (SELECT 1 FROM odd WHERE root = key AND parity = 1) AS by_closure, NOT EXISTS (SELECT 1 FROM odd WHERE root = key AND parity = 1) AS by_even_walks"""
)
def bipartite_by_walks(spark, sf):
    g = derive.nation_trade(spark, sf).units().symmetric()
    return spark.createDataFrame([(graphs.is_bipartite_by_closure(g), graphs.is_bipartite_by_even_walks(g))], "by_closure boolean, by_even_walks boolean")
