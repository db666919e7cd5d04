"""Mixing sources to target weights by entropy balancing.

Sources share the words of all documents by weight, none above ``limit`` times its own (the excess is shared again by
weight). The rates r at which documents are taken stay as close to 1 as these token constraints allow: they minimise
sum(r log r - r) with sum(size r) = target in each source and r <= limit. So rates are exponentially tilted by size,
r = min(limit, exp(lambda * size / mean size)), and the one lambda of a source solves a convex dual, whose slope is the
words taken less the target. Newton steps find it, kept between bounds that have been seen to lie on either side.

Rates depend on source and size alone, so all sums run over the table of (source, size, count), aggregated once before
any shuffle of single documents; a hot source is as many rows there as it has sizes. A round is one aggregation of that
table; the driver holds the dual of each source. Terms are rounded to a fixed scale and added as decimals, so that neither
rates nor results depend on the order of tasks.

Rates become copies by systematic rounding. Groups of one source, size and part (a hash of the document; a part holds
some ``PART`` documents) are laid end to end by falling size; a group gets as many extra copies as whole numbers lie in
its stretch of the fractions' running sum, so the running sums of what is owed and what is given never differ by more
than a half and a source's words by more than half its longest document. Within a group the documents of least hash get
them. What is still missing or too much is then settled by documents that can take or lose one copy, the largest that fit
first.

Size: runs of characters other than ASCII white space (null: 0). A null source is a source, last in order. Documents of
size 0 have rate 1 and take 0. Repeated rows are documents of their own; where rows that repeat an id and a text share a
source they may swap their copies, so that the result as a whole is the same in each run. An empty table gives no rows.
Other columns, whatever their names, play no part. The driver holds a few numbers for each source.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.llm.common import written

#: Characters of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and size that are ordered in one task, about.
PART = 20_000
#: Sizes of a source that are summed before their sums are put in order.
SPAN = 512
#: Newton steps at most, and the scale of rates.
ROUNDS, UNIT = 200, 1 << 24

EXACT = "decimal(38,6)"
ABOVE = (Window.unboundedPreceding, -1)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, key (of the source, never null), source, size and h (hash of id and text) of every row, written: the texts are
    read once."""
    text, source = F.coalesce(F.col(text_col), F.lit("")), F.col(source_col)
    key = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return written(docs.select(F.col(id_col).alias("id"), key.alias("key"), source.alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), text).alias("h")), "sized")


def targets(words: list[int], weights: list[float], limit: int) -> list[float]:
    """The share of all words of each source by weight (repeating, in the order given), none above limit times its words:
    whoever is above stays there, and the rest is shared anew by the others until none is."""
    rest, goals = float(sum(words)), [float(limit * w) for w in words]
    open_ = {k: float(weights[k % len(weights)]) for k in range(len(words))}
    while open_:
        level = rest / sum(open_.values())
        full = [k for k, w in open_.items() if level * w >= goals[k]]
        if not full:
            return [level * open_[k] if k in open_ else g for k, g in enumerate(goals)]
        rest -= sum(goals[k] for k in full)
        open_ = {k: w for k, w in open_.items() if k not in set(full)}
    return goals


def rate(tilt: Column, size: Column, limit: int) -> Column:
    """min(limit, exp(tilt * size)); without a tilt (null) the limit. Documents of size 0 have rate 1."""
    at_limit = tilt.isNull() | (tilt * size >= log(limit))
    return F.when(size == 0, 1.0).when(at_limit, float(limit)).otherwise(F.exp(tilt * size))


@dataclass
class Dual:
    """One source's dual variable: the tilt by size / mean size, and the bounds between which the solution was seen to lie."""

    target: float
    scale: float
    tilt: float = 0.0
    low: float = -inf
    high: float = inf
    done: bool = False

    def step(self, taken: float, bend: float, tolerance: float) -> None:
        """A Newton step; one that leaves the bracket or runs far halves it instead, or doubles outwards on an open side."""
        over = taken - self.target
        if over < 0:
            self.low = self.tilt
        elif over > 0:
            self.high = self.tilt
        new = self.tilt - over / bend if bend > 0 else inf
        if not (self.low < new < self.high and abs(new - self.tilt) <= 1 + 4 * abs(self.tilt)):
            new = self.high - 1 - abs(self.high) if self.low == -inf else self.low + 1 + abs(self.low) if self.high == inf else (self.low + self.high) / 2
        self.done = abs(over) <= tolerance or new in (self.low, self.high)
        if not self.done:
            self.tilt = new


def tilts(sizes: DataFrame, duals: dict[str, Dual], limit: int, tolerance: float = 0.25) -> None:
    """Solves the duals; sizes: (key, size, n). Each round sums words taken and their slope for all sources that are not
    within ``tolerance`` words yet, and the driver holds two numbers a source."""
    for _ in range(ROUNDS):
        left = {k: d for k, d in duals.items() if not d.done}
        if not left:
            return
        at = sizes.join(_column(sizes.sparkSession, "scaled", {k: d.tilt * d.scale for k, d in left.items()}, pa.float64()), "key")
        at = at.join(_column(sizes.sparkSession, "scale", {k: d.scale for k, d in left.items()}, pa.float64()), "key")
        r = rate(F.col("scaled"), F.col("size"), limit)
        words = F.col("n") * F.col("size") * r
        bend = F.when(r < limit, words * F.col("size") * F.col("scale")).otherwise(0.0)
        for row in at.groupBy("key").agg(F.sum(words.cast(EXACT)).alias("taken"), F.sum(bend.cast(EXACT)).alias("bend")).collect():
            left[row.key].step(float(row.taken), float(row.bend), tolerance)


def _column(spark: SparkSession, name: str, values: dict, kind: pa.DataType) -> DataFrame:
    """key and a value of each source."""
    return spark.createDataFrame(pa.table({"key": pa.array(list(values), pa.string()), name: pa.array(list(values.values()), kind)}))


def extra_copies(groups: DataFrame) -> DataFrame:
    """groups (key, size, part, n, frac) to (key, size, part, extra): the copies that each gets beyond the whole part of its
    rate. Running sums of n * frac by falling size, in two steps: spans of sizes first, then within a span."""
    span = groups.withColumns({"span": F.floor(F.col("size") / SPAN), "owed": F.col("n").cast("decimal(20,0)") * F.col("frac")})
    heads = span.groupBy("key", "span").agg(F.sum("owed").alias("sum"))
    heads = heads.select("key", "span", F.coalesce(F.sum("sum").over(Window.partitionBy("key").orderBy(F.desc("span")).rowsBetween(*ABOVE)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("key", "span").orderBy(F.desc("size"), "part").rowsBetween(*ABOVE)
    at = span.join(heads, ["key", "span"]).withColumn("from", F.col("ahead") + F.coalesce(F.sum("owed").over(within), F.lit(0)))
    return at.select("key", "size", "part", F.expr(f"(`from` + owed + {UNIT // 2}) div {UNIT} - (`from` + {UNIT // 2}) div {UNIT}").alias("extra"))


def copies(rows: DataFrame, rates: DataFrame, limit: int) -> DataFrame:
    """rows (id, key, source, size, h) with rate, base (whole copies), frac (of UNIT), part, rank (within key, size and part;
    null for size 0) and copies; rates: (key, size, n, rate)."""
    scaled = F.least(F.round(F.col("rate") * UNIT).cast("long"), F.lit(limit * UNIT))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / PART)).cast("long")
    plan = rates.select("key", "size", "rate", F.floor(scaled / UNIT).alias("base"), (scaled % UNIT).alias("frac"), parts.alias("parts"))
    at = rows.join(plan, ["key", "size"]).withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts"))).drop("parts")
    filled = at.where("size > 0")
    extra = extra_copies(filled.groupBy("key", "size", "part", "frac").agg(F.count("*").alias("n")))
    ranked = filled.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("h", "id")))
    ranked = ranked.join(extra, ["key", "size", "part"]).withColumn("copies", F.col("base") + (F.col("rank") <= F.col("extra")).cast("long")).drop("extra")
    return ranked.unionByName(at.where("size = 0").withColumns({"rank": F.lit(None).cast("int"), "copies": F.col("base")}))


def settled(given: DataFrame, goals: dict[str, float], limit: int) -> DataFrame:
    """The copies, changed by one for documents that settle what a source's words still differ from its target.

    What is off is about half the longest document at most, so few documents are needed whatever the corpus: as many as fit
    take (or lose) a copy, first those that stay next to their rate, then others between 0 and the limit, both by falling
    size. That choice runs on counts by size, two rows for each size up to what is off.
    """
    taken = given.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    off = _column(given.sparkSession, "off", {r.key: round(goals[r.key] - r.taken) for r in taken}, pa.int64()).where("off <> 0")
    more = F.col("off") > 0
    can = F.when(more, F.col("copies") < limit).otherwise(F.col("copies") > 0) & F.col("rank").isNotNull() & (F.col("size") <= F.abs("off"))
    near = F.when(more, (F.col("copies") == F.col("base")) & (F.col("frac") > 0)).otherwise(F.col("copies") > F.col("base"))
    open_ = given.join(off, "key").where(can).withColumn("near", near)
    alike = written(open_.groupBy("key", "near", "size", "part", "off").agg(F.count("*").alias("n")), "alike")

    def fit(pdf):
        pdf = pdf.sort_values(["near", "size"], ascending=False)
        rest, takes = abs(int(pdf.off.iloc[0])), []
        for size, n in zip(pdf["size"], pdf["n"]):
            takes.append(min(int(n), rest // int(size)))
            rest -= takes[-1] * int(size)
        return pdf[["key", "near", "size"]].assign(take=takes)

    group = ["key", "near", "size"]
    take = alike.groupBy(*group, "off").agg(F.sum("n").alias("n")).groupBy("key").applyInPandas(fit, "key string, near boolean, size long, take long").where("take > 0")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(*ABOVE)), F.lit(0))
    got = alike.join(take, group).withColumn("got", F.least("n", F.col("take") - earlier)).where("got > 0").select(*group, "part", "got")
    turn = F.row_number().over(Window.partitionBy(*group, "part").orderBy("rank"))
    chosen = open_.join(written(got, "got"), [*group, "part"]).withColumn("turn", turn).where("turn <= got")
    change = chosen.select("key", "size", "part", "rank", F.signum("off").cast("long").alias("change"))
    out = given.join(change, ["key", "size", "part", "rank"], "left")
    return out.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")


def mix(docs: DataFrame, weights: list[float], limit: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, rate, copies and taken (size * copies) of every row."""
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col, source_col)
    sizes = written(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "sizes")
    totals = sizes.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs")).orderBy(F.col("source").asc_nulls_last()).collect()
    goals = dict(zip([r.key for r in totals], targets([r.words for r in totals], weights, limit)))
    duals = {r.key: Dual(goals[r.key], r.docs / r.words) for r in totals if goals[r.key] < limit * r.words}
    tilts(sizes, duals, limit)
    found = sizes.join(_column(spark, "tilt", {k: d.tilt * d.scale for k, d in duals.items()}, pa.float64()), "key", "left")
    rates = found.select("key", "size", "n", rate(F.col("tilt"), F.col("size"), limit).alias("rate"))
    given = settled(written(copies(rows, rates, limit), "copies"), goals, limit)
    out = given.join(_column(spark, "source_size", {r.key: r.words for r in totals}, pa.int64()), "key").join(_column(spark, "target", goals, pa.float64()), "key")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))
