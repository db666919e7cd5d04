"""Algebras: how edge labels add along alternatives and multiply along paths, as Column expressions.

An ``Algebra`` is a value: every part of it maps Columns to Columns, so Catalyst sees plain expressions and plans partial
aggregation where the addition is a built-in aggregate. A null label means "no label" and only occurs where said.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Unary, Binary = Callable[[Column], Column], Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Algebra:
    """kind: SQL type of a label. total(col, order) is the aggregate of ⊕; order is only used if ``ordered``."""

    name: str
    kind: str
    zero: Callable[[], Column] | None
    one: Callable[[], Column] | None
    plus: Binary | None
    times: Binary | None
    total: Callable[[Column, Column | None], Column] | None
    star: Unary | None = None
    negative: Unary | None = None
    idempotent: bool = False
    ordered: bool = False
    has_zero_test: bool = True

    def is_zero(self, c: Column) -> Column:
        return c.eqNullSafe(self.zero())

    def is_not_zero(self, c: Column) -> Column:
        return ~self.is_zero(c)

    def is_one(self, c: Column) -> Column:
        return c.eqNullSafe(self.one())

    def is_not_one(self, c: Column) -> Column:
        return ~self.is_one(c)

    def at_most(self, a: Column, b: Column) -> Column:
        """The natural order: a ⊕ b = b."""
        return self.plus(a, b).eqNullSafe(b)

    def proper_star(self, c: Column) -> Column:
        """a ⊗ star(a): at least one pass."""
        return self.times(c, self.star(c))

    def minus(self, a: Column, b: Column) -> Column:
        return self.plus(a, self.negative(b))

    def multiple(self, n: int, c: Column) -> Column:
        """n-fold ⊕; zero for n = 0."""
        if n == 0:
            return self.zero()
        return c if self.idempotent else _doubled(n, c, self.plus)

    def power(self, c: Column, n: int) -> Column:
        """n-fold ⊗; one for n = 0."""
        return self.one() if n == 0 else _doubled(n, c, self.times)

    def sum_of(self, parts: list[Column]) -> Column:
        return reduce(self.plus, parts, self.zero())

    def product_of(self, parts: list[Column]) -> Column:
        return reduce(self.times, parts, self.one())

    def total_or_zero(self, c: Column, order: Column | None = None) -> Column:
        return F.coalesce(self.total(c, order), self.zero())


def _doubled(n: int, c: Column, op: Binary) -> Column:
    """n-fold op by doubling: an expression of logarithmic depth."""
    if n == 1:
        return c
    half = _doubled(n // 2, c, op)
    both = op(half, half)
    return op(both, c) if n % 2 else both


def in_order(c: Column, order: Column, merge: Binary, zero: Column) -> Column:
    """Aggregate for additions that are not commutative: folds the labels of a group by ascending order."""
    sorted_ = F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("x"))))
    return F.aggregate(F.transform(sorted_, lambda s: s["x"]), zero, merge)


# --- numbers and truth values


def number(kind: str = "bigint") -> Algebra:
    """Sums and products. Whole numbers overflow with an error (ANSI mode), decimals have 38 digits."""
    lit = lambda v: F.lit(v).cast(kind)
    return Algebra("number", kind, lambda: lit(0), lambda: lit(1), lambda a, b: a + b, lambda a, b: (a * b).cast(kind), lambda c, o: F.sum(c).cast(kind), negative=lambda a: -a)


NUMBER = number()
REAL = number("double")

UNIT = Algebra(
    "unit", "boolean", lambda: F.lit(True), lambda: F.lit(True), lambda a, b: a, lambda a, b: a, lambda c, o: F.bool_or(c), star=lambda a: a, idempotent=True, has_zero_test=False
)
BOOL = Algebra(
    "bool", "boolean", lambda: F.lit(False), lambda: F.lit(True), lambda a, b: a | b, lambda a, b: a & b, lambda c, o: F.bool_or(c), star=lambda a: F.lit(True), idempotent=True
)

# --- tropical numbers: (0) below all, (1, w) finite, (2) above all; struct order is their order


def tropical(weight: str = "bigint") -> Algebra:
    """Least weight; weights add along paths. Weights must not be negative where a star or closure is taken."""
    kind = f"struct<tag:int,w:{weight}>"
    low, high = (lambda: F.struct(F.lit(0).alias("tag"), F.lit(None).cast(weight).alias("w"))), (lambda: F.struct(F.lit(2).alias("tag"), F.lit(None).cast(weight).alias("w")))
    sum_ = lambda a, b: F.struct(F.lit(1).alias("tag"), (a["w"] + b["w"]).cast(weight).alias("w"))

    def times(a: Column, b: Column) -> Column:
        return F.when((a["tag"] == 2) | (b["tag"] == 2), high()).when(a["tag"] == 0, b).when(b["tag"] == 0, a).otherwise(sum_(a, b))

    return Algebra("tropical", kind, high, low, F.least, times, lambda c, o: F.min(c), star=lambda a: low(), idempotent=True)


TROPICAL = tropical()


def finite(w: Column, weight: str = "bigint") -> Column:
    return F.struct(F.lit(1).alias("tag"), w.cast(weight).alias("w"))


def finite_or_low(w: Column, weight: str = "bigint") -> Column:
    """A negative number becomes the lowest value."""
    return F.when(w < 0, F.struct(F.lit(0).alias("tag"), F.lit(None).cast(weight).alias("w"))).otherwise(finite(w, weight))


def weight_of(t: Column) -> Column:
    """The number of a finite value; an error for the lowest and highest."""
    return F.when(t["tag"] == 1, t["w"]).otherwise(F.raise_error(F.lit("not a finite value")).cast("bigint"))


def weight_or_zero(t: Column) -> Column:
    """As weight_of, with 0 for the lowest value."""
    return F.when(t["tag"] == 0, F.lit(0)).when(t["tag"] == 1, t["w"]).otherwise(F.raise_error(F.lit("the highest value is no number")).cast("bigint"))


def add_tropical(a: Column, b: Column) -> Column:
    """Numbers add with the lowest value as 0; the highest absorbs."""
    high = (a["tag"] == 2) | (b["tag"] == 2)
    tag = F.when(high, 2).when((a["tag"] == 0) & (b["tag"] == 0), 0).otherwise(1)
    return F.struct(tag.alias("tag"), F.when(tag == 1, F.coalesce(a["w"], F.lit(0)) + F.coalesce(b["w"], F.lit(0))).alias("w"))


def multiply_tropical(a: Column, b: Column) -> Column:
    """Numbers multiply; the lowest value absorbs before the highest does."""
    tag = F.when((a["tag"] == 0) | (b["tag"] == 0), 0).when((a["tag"] == 2) | (b["tag"] == 2), 2).otherwise(1)
    return F.struct(tag.alias("tag"), F.when(tag == 1, a["w"] * b["w"]).alias("w"))


def least_weight(kind: str = "bigint") -> Algebra:
    """Tropical numbers without the extremes, as plain numbers: an absent row is the highest value, 0 is the lowest."""
    return Algebra("least weight", kind, lambda: F.lit(None).cast(kind), lambda: F.lit(0).cast(kind), F.least, lambda a, b: a + b, lambda c, o: F.min(c), star=lambda a: F.lit(0).cast(kind), idempotent=True)


LEAST = least_weight()


def widest(kind: str = "bigint") -> Algebra:
    """Greatest bottleneck: the least capacity along a path, the greatest over paths. Null stands for unlimited in one."""
    return Algebra("widest", kind, lambda: F.lit(0).cast(kind), lambda: F.lit(None).cast(kind), F.greatest, F.least, lambda c, o: F.max(c), star=lambda a: F.lit(None).cast(kind), idempotent=True)


# --- finite algebras of signed walks: fixed values, their sums are bitwise or of these codes

BALANCED_CODES = {"__": 0, "--": 1, "++": 2, "+-": 3}
CLUSTERED_CODES = {"_": 0, "q": 4, "n": 5, "p": 6, "a": 7}
#: Products of the clustered algebra, row by column in the order of CLUSTERED_ORDER.
CLUSTERED_ORDER = "_npaq"
CLUSTERED_TIMES = {"_": "_____", "n": "_qnnq", "p": "_npaq", "a": "_naaq", "q": "_qqqq"}



def _case(c: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(c == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _coded(name: str, codes: dict[str, int], one: str, times: Binary, star: Unary) -> Algebra:
    back = {v: k for k, v in codes.items()}
    code, label = (lambda c: _case(c, codes)), (lambda c: _case(c, back))
    zero = next(k for k, v in codes.items() if v == 0)
    return Algebra(
        name, "string", lambda: F.lit(zero), lambda: F.lit(one), lambda a, b: label(code(a).bitwiseOR(code(b))), times, lambda c, o: label(F.bit_or(code(c))), star=star, idempotent=True
    )


def _balanced_times(a: Column, b: Column) -> Column:
    return F.when((a == "__") | (b == "__"), "__").when((a == "+-") | (b == "+-"), "+-").when(a == b, "++").otherwise("--")


BALANCED = _coded("balanced", BALANCED_CODES, "++", _balanced_times, lambda a: F.when(a.isin("__", "++"), "++").otherwise("+-"))
CLUSTERED = _coded(
    "clustered",
    CLUSTERED_CODES,
    "p",
    lambda a, b: _case(a, {k: _case(b, dict(zip(CLUSTERED_ORDER, row))) for k, row in CLUSTERED_TIMES.items()}),
    lambda a: F.when(a.isin("n", "a"), "a").otherwise("p"),
)


def sign_to_balanced(sign: Column) -> Column:
    return F.when(sign == "+", "++").when(sign == "-", "--")


def sign_to_clustered(sign: Column) -> Column:
    return F.when(sign == "+", "p").when(sign == "-", "n")


# --- geodesics: (length, number of shortest paths)


#: The tag of a count too large for its kind. It is no finite value, so ``weight_of`` raises.
BEYOND = 3


def geodesic(length: str = "bigint", count: str = "bigint") -> Algebra:
    """Shorter length wins, counts of equal lengths add. The sum is not idempotent: closures count levels instead.

    Length and count are tropical structs, as both may be lowest or highest. Closures also multiply counts of walks that a shorter
    one then beats; a count too large for its kind therefore gets the tag BEYOND and is an error only where it is read.
    """
    t, n = tropical(length), tropical(count)
    make = lambda a, b: F.struct(a.alias("len"), b.alias("cnt"))
    kind = f"struct<len:{t.kind},cnt:{n.kind}>"

    def counted(tag: Column, a: Column, b: Column, op: Binary) -> Column:
        w = F.when(tag == 1, op(a, b).try_cast(count))
        return F.struct(F.when((tag == 1) & w.isNull(), BEYOND).otherwise(tag).alias("tag"), w.alias("w"))

    def add(a: Column, b: Column) -> Column:
        tag = F.when((a["tag"] == 2) | (b["tag"] == 2), 2).otherwise(F.greatest(a["tag"], b["tag"]))
        return counted(tag, F.coalesce(a["w"], F.lit(0)), F.coalesce(b["w"], F.lit(0)), F.try_add)

    def multiply(a: Column, b: Column) -> Column:
        tag = F.when((a["tag"] == 0) | (b["tag"] == 0), 0).when((a["tag"] == 2) | (b["tag"] == 2), 2).otherwise(F.greatest(a["tag"], b["tag"]))
        return counted(tag, a["w"], b["w"], F.try_multiply)

    def plus(a: Column, b: Column) -> Column:
        return F.when(a["len"] < b["len"], a).when(b["len"] < a["len"], b).otherwise(make(a["len"], add(a["cnt"], b["cnt"])))

    def total(c: Column, o: Column | None) -> Column:
        return F.aggregate(F.collect_list(c), make(t.zero(), n.one()).cast(kind), lambda a, b: plus(a, b).cast(kind))

    def star(c: Column) -> Column:
        many = (c["len"]["tag"] == 0) & (c["cnt"]["tag"] != 0)
        return make(t.one(), F.when(many, n.zero()).otherwise(finite(F.lit(1), count)))

    return Algebra("geodesic", kind, lambda: make(t.zero(), n.one()), lambda: make(t.one(), finite(F.lit(1), count)), plus, lambda a, b: make(t.times(a["len"], b["len"]), multiply(a["cnt"], b["cnt"])), total, star=star)


GEODESIC = geodesic()


# --- algebras made of others


def pair(x: Algebra, y: Algebra) -> Algebra:
    """Both at once, part by part."""
    make = lambda a, b: F.struct(a.alias("_1"), b.alias("_2"))
    two = lambda f, g: None if f is None or g is None else lambda a, b: make(f(a["_1"], b["_1"]), g(a["_2"], b["_2"]))
    each = lambda f, g: None if f is None or g is None else lambda a: make(f(a["_1"]), g(a["_2"]))
    const = lambda f, g: None if f is None or g is None else lambda: make(f(), g())
    return Algebra(
        f"({x.name}, {y.name})", f"struct<_1:{x.kind},_2:{y.kind}>", const(x.zero, y.zero), const(x.one, y.one), two(x.plus, y.plus), two(x.times, y.times),
        lambda c, o: make(x.total(c["_1"], o), y.total(c["_2"], o)), star=each(x.star, y.star), negative=each(x.negative, y.negative),
        idempotent=x.idempotent and y.idempotent, ordered=x.ordered or y.ordered,
    )


def zip_list(x: Algebra, n: int) -> Algebra:
    """Arrays of n labels, position by position."""
    const = lambda f: None if f is None else lambda: F.array_repeat(f(), n)
    merge = lambda a, b: F.zip_with(a, b, x.plus)
    return Algebra(
        f"zip of {x.name}", f"array<{x.kind}>", const(x.zero), const(x.one), merge, lambda a, b: F.zip_with(a, b, x.times),
        lambda c, o: F.array(*[x.total(F.get(c, F.lit(k)), o) for k in range(n)]), star=None if x.star is None else lambda a: F.transform(a, x.star),
        negative=None if x.negative is None else lambda a: F.transform(a, x.negative), idempotent=x.idempotent, ordered=x.ordered,
    )


def over_domain(x: Algebra, domain: list) -> Algebra:
    """Functions on a finite domain, as maps with a value for each of its elements, point by point."""
    points = [F.lit(d) for d in domain]
    build = lambda f: F.map_from_arrays(F.array(*points), F.array(*[f(p) for p in points]))
    const = lambda f: None if f is None else lambda: build(lambda p: f())
    two = lambda f: None if f is None else lambda a, b: build(lambda p: f(a[p], b[p]))
    return Algebra(
        f"functions to {x.name}", f"map<string,{x.kind}>", const(x.zero), const(x.one), two(x.plus), two(x.times), lambda c, o: build(lambda p: x.total(c[p], o)),
        star=None if x.star is None else lambda a: build(lambda p: x.star(a[p])), idempotent=x.idempotent, ordered=x.ordered,
    )


def first(kind: str, times: Binary | None = None, one: Callable[[], Column] | None = None) -> Algebra:
    """The label of the lowest source that has any (null: none). A product is null if a factor is."""
    both = times or (lambda a, b: b)
    return Algebra(
        "first", kind, lambda: F.lit(None).cast(kind), one, lambda a, b: F.coalesce(a, b), lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(both(a, b)),
        lambda c, o: F.min_by(c, F.when(c.isNotNull(), o)), idempotent=True, ordered=True,
    )


def free(kind: str = "string") -> Algebra:
    """Lists under concatenation: a product only."""
    return Algebra("list", f"array<{kind}>", None, lambda: F.array().cast(f"array<{kind}>"), None, lambda a, b: F.concat(a, b), None)


def sums(kind: str = "bigint") -> Algebra:
    """Numbers under addition alone."""
    return replace(number(kind), name="sum", times=None, one=None)


# --- regular expressions, as text with a precedence mark: struct<text, level>; they are built, never matched

NO_WORD, EMPTY_WORD = "∅", "ε"
#: Precedence of an alternative and of a composition; letters, constants and repetitions bind tightest.
ALTERNATIVE, COMPOSITION, ATOM = 5, 6, 10


def regular_of(text: Column, level: int = ATOM) -> Column:
    return F.struct(text.alias("text"), F.lit(level).alias("level"))


def letter(c: Column) -> Column:
    return regular_of(c.cast("string"))


def is_composite(r: Column) -> Column:
    return r["level"] < ATOM


def _within(r: Column, level: int) -> Column:
    return F.when(r["level"] < level, F.concat(F.lit("("), r["text"], F.lit(")"))).otherwise(r["text"])


def either(a: Column, b: Column) -> Column:
    """Alternative; the empty set is neutral."""
    both = regular_of(F.concat(_within(a, ALTERNATIVE), F.lit("⊕"), _within(b, ALTERNATIVE)), ALTERNATIVE)
    return F.when(a["text"] == NO_WORD, b).when(b["text"] == NO_WORD, a).otherwise(both)


def then(a: Column, b: Column) -> Column:
    """Composition; the empty word is neutral, the empty set absorbs."""
    both = regular_of(F.concat(_within(a, COMPOSITION), F.lit("⊛"), _within(b, COMPOSITION)), COMPOSITION)
    nothing = regular_of(F.lit(NO_WORD))
    return F.when((a["text"] == NO_WORD) | (b["text"] == NO_WORD), nothing).when(a["text"] == EMPTY_WORD, b).when(b["text"] == EMPTY_WORD, a).otherwise(both)


def repeated(a: Column) -> Column:
    """Any number of passes; of the empty set and the empty word it is the empty word."""
    return F.when(a["text"].isin(NO_WORD, EMPTY_WORD), regular_of(F.lit(EMPTY_WORD))).otherwise(regular_of(F.concat(_within(a, ATOM), F.lit("*"))))


REGULAR = Algebra(
    "regular", "struct<text:string,level:int>", lambda: regular_of(F.lit(NO_WORD)), lambda: regular_of(F.lit(EMPTY_WORD)), either, then,
    lambda c, o: in_order(c, o, either, regular_of(F.lit(NO_WORD))), star=repeated, ordered=True,
)


# --- display


def show_tropical(t: Column) -> Column:
    return F.when(t["tag"] == 0, "Min").when(t["tag"] == 2, "Max").when(t["tag"] == BEYOND, "Beyond").otherwise(t["w"].cast("string"))


def show_regular(r: Column) -> Column:
    return r["text"]


def compose(*steps: Callable) -> Callable:
    """The function that applies the steps one after the other."""
    return lambda x: reduce(lambda v, f: f(v), steps, x)
