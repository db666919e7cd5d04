"""Graphs derived from the driver's tables. Each is one plan over the tables it needs; nothing is collected."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.functions.algebra import NUMBER, UNIT, Algebra
from arcweave.operators.matrices import Matrix
from arcweave.operators.vectors import Vec
from arcweave.plans.shared import fit_session

#: The scale of shares.
SHARE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the largest one sets how many partitions shuffles have."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "lineitem":
        fit_session(spark, found.count())
    return found


def approvals(spark: SparkSession, sf_dir: str) -> Matrix:
    """Customers approve the brands they bought. Every customer is a row.

    Orders lead to few brands each, so (customer, brand) pairs are made distinct right after the joins.
    """
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    brands = table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", r"\d+", 0).cast("bigint").alias("dst"))
    pairs = lines.join(brands, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    cells = pairs.select(F.col("o_custkey").alias("src"), "dst").distinct()
    return Matrix.of(cells, UNIT, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


def supply(spark: SparkSession, sf_dir: str) -> Matrix:
    """Supplier to part, with the quantity supplied."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return Matrix.of(lines.agg(F.sum("l_quantity").cast("bigint").alias("val")), NUMBER, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


def quantities(spark: SparkSession, sf_dir: str, column: str) -> Vec:
    """Keys of a column of all lines, with the quantity of each."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col(column).cast("bigint").alias("key"))
    return Vec(lines.agg(F.sum("l_quantity").cast("bigint").alias("val")), NUMBER)


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path: the parts of each order by line, a path of vertices."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    found = lines.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    return found.select("id", F.transform("lines", lambda x: x["l_partkey"].cast("bigint")).alias("path"))


def both_ways(cells: DataFrame) -> Matrix:
    """Arcs (src, dst) and their turned ones. Rows: ends of arcs."""
    turned = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return replace(Matrix.of(cells.select(F.inline(F.array(F.struct("src", "dst"), turned))), UNIT), both_ways=True)


def supply_graph(spark: SparkSession, sf_dir: str) -> Matrix:
    """Suppliers (2k) and parts (2k + 1), joined both ways where the one supplies the other."""
    lines = table(spark, sf_dir, "lineitem").select((2 * F.col("l_suppkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst"))
    return both_ways(lines.distinct())


def thin_supply(spark: SparkSession, sf_dir: str) -> Matrix:
    """The part of ``supply_graph`` with a line of quantity 50: sparse, for work that goes pick by pick."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") == 50).select((2 * F.col("l_suppkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst"))
    return both_ways(lines.distinct())


def suppliers_of(spark: SparkSession, sf_dir: str, region: int) -> Vec:
    """The suppliers of a region, as vertices of ``supply_graph``."""
    at = table(spark, sf_dir, "nation").where(F.col("n_regionkey") == region)
    found = table(spark, sf_dir, "supplier").join(at, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return Vec(found.select((2 * F.col("s_suppkey")).alias("key"), F.lit(True).alias("val")))


def supplier_traits(spark: SparkSession, sf_dir: str) -> Matrix:
    """Suppliers (3k) joined both ways to their nation (3k + 1) and to the thousands of their balance (3k + 5, from -1 up)."""
    of = table(spark, sf_dir, "supplier").select((3 * F.col("s_suppkey")).alias("src"), F.col("s_nationkey").cast("bigint").alias("n"), F.floor(F.col("s_acctbal") / 1000).cast("bigint").alias("b"))
    return both_ways(of.select("src", F.explode(F.array(3 * F.col("n") + 1, 3 * F.col("b") + 5)).alias("dst")))


def next_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), repeats included: parts as they come (2k) and as they follow (2k + 1), where an order has the one on the line behind
    the other."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    behind = lines.withColumn("next", F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))).where("next is not null")
    return behind.select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("next") + 1).alias("dst"))


def successions(spark: SparkSession, sf_dir: str) -> Matrix:
    """``next_parts`` joined both ways. A matching covers the parts by chains and rings."""
    return both_ways(next_parts(spark, sf_dir).distinct())


def by_return_flag(spark: SparkSession, sf_dir: str) -> tuple[Matrix, Matrix]:
    """Customer to return flag (its code point) with the quantity bought, and return flag to supplier's nation with the number
    of lines: few vertices in the middle, with a large share of all arcs each."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", F.ascii("l_returnflag").cast("bigint").alias("flag"))
    orders, supp = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("nation"))
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("src"), F.col("flag").alias("dst")).agg(F.sum("l_quantity").cast("bigint").alias("val"))
    sent = lines.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("flag").alias("src"), F.col("nation").alias("dst")).agg(F.count("*").alias("val"))
    return Matrix.of(bought, NUMBER), Matrix.of(sent, NUMBER)


def size_successions(spark: SparkSession, sf_dir: str) -> Matrix:
    """Part to part, where an order has a part of the same size on the next line. All parts are rows."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    behind = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("p_size"), F.lead("p_size").over(order).alias("size")).where("size = p_size")
    return Matrix.of(behind.select("src", "dst").distinct(), UNIT, part.select(F.col("p_partkey").alias("id")))


def trade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n1, n2, n, share: lines that customers of nation n1 bought from suppliers of nation n2, n1 <> n2, and their share of
    all lines of n2. Arcs are the pairs above an even share."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("n1"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("n2"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n1")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(supp, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "n2")
    counts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n1", "n2").agg(F.count("*").alias("n"))
    share = counts.withColumn("share", F.expr(f"n * {SHARE} div sum(n) over (partition by n2)")).where("n1 <> n2")
    even = table(spark, sf_dir, "nation").agg(F.count("*").alias("nations"))
    return share.join(even).where(F.col("share") * F.col("nations") > SHARE).select("n1", "n2", "n", "share")  # one row


def nation_trade(spark: SparkSession, sf_dir: str, algebra: Algebra = NUMBER) -> Matrix:
    """Nations with the shares of ``trade_counts`` as labels. Every nation is a row."""
    cells = trade_counts(spark, sf_dir).select(F.col("n1").alias("src"), F.col("n2").alias("dst"), F.col("share").cast("bigint").alias("val"))
    return Matrix.of(cells, algebra, nations(spark, sf_dir))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))


def signed_trade(spark: SparkSession, sf_dir: str) -> Matrix:
    """Nation arcs, '+' where the count is above the mean of all arcs, else '-'."""
    arcs = trade_counts(spark, sf_dir)
    whole = arcs.agg(F.sum("n").alias("all"), F.count("*").alias("arcs"))
    cells = arcs.join(F.broadcast(whole)).select(F.col("n1").alias("src"), F.col("n2").alias("dst"), F.when(F.col("n") * F.col("arcs") > F.col("all"), "+").otherwise("-").alias("val"))  # one row
    return Matrix.of(cells, Algebra("sign", "string", None, None, None, None, None), nations(spark, sf_dir))


def transitions(spark: SparkSession, sf_dir: str) -> Matrix:
    """Event types, numbered in alphabetical order, with how often a user's next event is of the other type."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    following = events.withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    counts = following.where("next is not null").groupBy("event_type", "next").agg(F.count("*").alias("val"))
    names = events.select("event_type").distinct()
    names = names.select("event_type", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("bigint").alias("id"))  # event types are few
    cells = counts.join(names.withColumnRenamed("id", "src"), "event_type").join(names.select(F.col("event_type").alias("next"), F.col("id").alias("dst")), "next")
    return Matrix.of(cells.select("src", "dst", "val"), NUMBER, names.select("id"))


def size_chains(spark: SparkSession, sf_dir: str) -> Matrix:
    """Parts of equal size in a chain by key."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lead("p_partkey").over(Window.partitionBy("p_size").orderBy("p_partkey")).alias("next"))
    cells = parts.where("next is not null").select(F.col("p_partkey").alias("src"), F.col("next").alias("dst"))
    return Matrix.of(cells, UNIT, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


#: Vertices of the networks: source, sink, and what the other kinds of vertices begin with.
SOURCE, SINK, REGIONS, PARTS = 0, 1, 2, 100


def sales_network(spark: SparkSession, sf_dir: str) -> Matrix:
    """From a source through all parts and the customers' regions to a sink: half of what is sold of a part may leave the
    source, to a region goes no more than was sold to it, and region r lets through r + 1 parts in 25 of all that was sold."""
    nations_, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cust = table(spark, sf_dir, "customer").join(nations_, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("bigint").alias("region"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "region")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sold = lines.groupBy("l_partkey", "region").agg(F.sum("l_quantity").cast("bigint").alias("val"))
    part, region = F.col("l_partkey") + PARTS, F.col("region") + REGIONS
    leaving = sold.groupBy("l_partkey").agg(F.expr("sum(val) div 2").alias("val")).select(F.lit(SOURCE).alias("src"), part.alias("dst"), "val")
    through = sold.agg(F.sum("val").alias("all")).join(regions.select(F.col("r_regionkey").cast("bigint").alias("region")))  # a row for each region
    entering = through.select(region.alias("src"), F.lit(SINK).alias("dst"), F.expr("`all` * (region + 1) div 25").alias("val"))
    return Matrix.of(leaving.unionByName(sold.select(part.alias("src"), region.alias("dst"), "val")).unionByName(entering).where("val > 0"), NUMBER)


def supply_network(spark: SparkSession, sf_dir: str) -> Matrix:
    """From a source through all suppliers (2k + 2) and parts (2k + 3) to a sink: half of what a supplier delivers may leave
    the source, on to parts as delivered, and three fifths of what is delivered of a part reach the sink."""
    cells = supply(spark, sf_dir).cells
    src, dst = 2 * F.col("src") + 2, 2 * F.col("dst") + 3
    leaving = cells.groupBy("src").agg(F.expr("sum(val) div 2").alias("val")).select(F.lit(SOURCE).alias("src"), src.alias("dst"), "val")
    entering = cells.groupBy("dst").agg(F.expr("sum(val) * 3 div 5").alias("val")).select(dst.alias("src"), F.lit(SINK).alias("dst"), "val")
    return Matrix.of(leaving.unionByName(cells.select(src.alias("src"), dst.alias("dst"), "val")).unionByName(entering).where("val > 0"), NUMBER)
