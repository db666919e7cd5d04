"""Laws of the algebras, on all values of the finite ones and on samples of the others: one job per algebra."""

import itertools

import pytest
from pyspark.sql import functions as F

from arcweave.functions import algebra as A

LOW, HIGH = {"tag": 0, "w": None}, {"tag": 2, "w": None}
FIN = [{"tag": 1, "w": w} for w in (0, 1, 3, 7)]
GEO = [{"len": n, "cnt": c} for n in (HIGH, *FIN[:2]) for c in (LOW, FIN[1], FIN[2])]
SAMPLES = {
    "bool": (A.BOOL, [False, True]),
    "number": (A.NUMBER, [-2, 0, 1, 5]),
    "tropical": (A.TROPICAL, [LOW, HIGH, *FIN]),
    "balanced": (A.BALANCED, list(A.BALANCED_CODES)),
    "clustered": (A.CLUSTERED, list(A.CLUSTERED_CODES)),
    "pair": (A.pair(A.BOOL, A.TROPICAL), [{"_1": b, "_2": t} for b in (False, True) for t in (LOW, HIGH, FIN[1])]),
    "zip": (A.zip_list(A.BOOL, 2), [[a, b] for a in (False, True) for b in (False, True)]),
    "widest": (A.widest(), [0, 1, 5]),
}


def triples(spark, g, values):
    rows = list(itertools.product(values, repeat=3))
    return spark.createDataFrame(rows, f"a {g.kind}, b {g.kind}, c {g.kind}")


@pytest.mark.parametrize("name", SAMPLES)
def test_semiring_laws(spark, name):
    g, values = SAMPLES[name]
    df = triples(spark, g, values)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    zero, one = g.zero(), g.one()
    if name == "widest":
        zero, one = F.lit(0).cast("bigint"), None
    laws = {
        "plus associative": (g.plus(g.plus(a, b), c), g.plus(a, g.plus(b, c))),
        "plus commutative": (g.plus(a, b), g.plus(b, a)),
        "zero neutral": (g.plus(a, zero), a),
        "times associative": (g.times(g.times(a, b), c), g.times(a, g.times(b, c))),
        "left distributive": (g.times(a, g.plus(b, c)), g.plus(g.times(a, b), g.times(a, c))),
        "right distributive": (g.times(g.plus(a, b), c), g.plus(g.times(a, c), g.times(b, c))),
        "zero absorbs": (g.times(a, zero), zero),
    }
    if one is not None:
        laws |= {"one neutral left": (g.times(one, a), a), "one neutral right": (g.times(a, one), a)}
    if g.idempotent:
        laws["idempotent"] = (g.plus(a, a), a)
    if g.star and one is not None:
        s = g.star(a)
        laws |= {
            "star unfolds left": (g.plus(one, g.times(a, s)), s),
            "star unfolds right": (g.plus(one, g.times(s, a)), s),
        }
    if g.negative:
        laws["inverse"] = (g.plus(a, g.negative(a)), zero)
    bad = df.agg(*[F.sum((~x.cast(g.kind).eqNullSafe(y.cast(g.kind))).cast("int")).alias(k) for k, (x, y) in laws.items()]).first().asDict()
    assert {k for k, v in bad.items() if v} == set()


@pytest.mark.parametrize("name", ["bool", "number", "tropical", "balanced", "clustered", "pair", "zip"])
def test_aggregate_is_repeated_plus(spark, name):
    g, values = SAMPLES[name]
    df = triples(spark, g, values).withColumn("id", F.monotonically_increasing_id())
    long = df.select("id", F.posexplode(F.array("a", "b", "c")).alias("at", "x")).groupBy("id").agg(g.total(F.col("x"), F.col("at")).alias("t"))
    both = df.join(long, "id").where(~g.plus(g.plus(F.col("a"), F.col("b")), F.col("c")).cast(g.kind).eqNullSafe(F.col("t").cast(g.kind)))
    assert both.isEmpty()


def test_geodesic(spark):
    g = A.GEODESIC
    df = triples(spark, g, GEO[3:])
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    laws = [(g.plus(g.plus(a, b), c), g.plus(a, g.plus(b, c))), (g.times(g.times(a, b), c), g.times(a, g.times(b, c))), (g.times(a, g.one()), a)]
    for x, y in laws:
        assert df.where(~x.cast(g.kind).eqNullSafe(y.cast(g.kind))).isEmpty()
    assert not g.idempotent


def test_powers_and_multiples(spark):
    row = spark.range(1).select(
        A.NUMBER.power(F.lit(3).cast("bigint"), 5).alias("p"), A.NUMBER.multiple(6, F.lit(7).cast("bigint")).alias("m"),
        A.weight_of(A.TROPICAL.power(A.finite(F.lit(4)), 3)).alias("t"), A.BOOL.multiple(0, F.lit(True)).alias("z"),
    ).first()
    assert tuple(row) == (243, 42, 12, False)


def test_regular_expressions(spark):
    a, b = A.letter(F.lit("a")), A.letter(F.lit("b"))
    row = spark.range(1).select(
        A.then(A.either(a, b), A.repeated(b))["text"].alias("x"), A.either(A.then(a, b), a)["text"].alias("y"), A.repeated(A.either(a, b))["text"].alias("z"),
        A.then(a, A.REGULAR.zero())["text"].alias("w"), A.repeated(A.REGULAR.zero())["text"].alias("e"),
    ).first()
    assert tuple(row) == ("(a⊕b)⊛b*", "a⊛b⊕a", "(a⊕b)*", "∅", "ε")


def test_first_and_lists(spark):
    df = spark.createDataFrame([(3, "z"), (1, None), (2, "y")], "o int, x string")
    assert df.agg(A.first("string").total(F.col("x"), F.col("o"))).first()[0] == "y"
    assert spark.range(1).select(A.free().times(F.array(F.lit("a")), F.array(F.lit("b")))).first()[0] == ["a", "b"]
