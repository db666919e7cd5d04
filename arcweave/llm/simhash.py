"""SimHash near-dedup by multi-index hashing.

Fingerprints: 64 bits, a bit is set if it is set in over half of the hashes of a text's word shingles. Two fingerprints
link if they differ in at most ``MAX_BITS`` bits; documents linked directly or through others form a component.

Multi-index hashing: a fingerprint has two segments of 32 bits. Of two fingerprints within 3 bits one segment differs in
at most one bit, so every pair meets in a bucket (segment, value) that the one probes with its own value or with one set
bit cleared and that holds the other. Candidates are verified over all bits. Equal fingerprints are one entry throughout,
so copies cost nothing here. Buckets of more than ``DENSE`` entries are not paired as they are: within them a second index
over the 16-bit halves of the other segment splits the entries again; what meets there shares 48 bits up to the probed
ones, which leaves at most 65,536 different entries however many documents there are. No candidate is dropped.

Null text counts as empty; texts without words have the fingerprint zero and link like any other. Rows that repeat an id
are one document to the components, each row gets its result. Null ids never name a component; a component of null ids
only has a null name. An empty table gives no rows. Other columns, whatever their names, pass through the stage form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import components, keyed, one_per_root, written

MAX_BITS = 3
SEED = 42
DENSE = 256
_LANES, _LOW = np.arange(8, dtype=np.uint64), np.uint64(0x0101010101010101)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words (all words if there are fewer), A-Z in lower case, joined by one space."""
    import xxhash

    h, words = xxhash.xxh64_intdigest, text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if n <= size:
        return np.array([h(b" ".join(words), SEED)] if n else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, n - size + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned integer; zero of none.

    The eight bits of each byte are spread to lanes, so that sums of up to 255 hashes fit into bytes.
    """
    n = len(hashes)
    if not n:
        return 0
    sums = np.add.reduceat((hashes[:, None] >> _LANES) & _LOW, np.arange(0, n, 255), axis=0)
    counts = sums.view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64)  # [bit in byte, byte]
    return int(np.packbits((2 * counts > n).T.reshape(-1), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int) -> Column:
    """The fingerprint of every whole text as a signed 64-bit integer."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([majority(shingle_hashes(t.as_py() or "", shingle)) for t in texts], np.uint64).view(np.int64))

    return prints(text)


def segments(fp: Column) -> Column:
    low = F.lit(0xFFFFFFFF)
    return F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned(fp, 32).alias("key")), F.struct(F.lit(1).alias("seg"), fp.bitwiseAND(low).alias("key")))


def ball(key: Column, bits: int) -> Column:
    """key and key with each one of its set bits cleared: of two keys one bit apart, one is in the other's ball."""
    cleared = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: key.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    return F.array_distinct(F.concat(F.array(key), cleared))


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of different fingerprints (column fp, distinct) at most MAX_BITS apart; each may occur more than once."""
    held = prints.select("fp", F.explode(segments(F.col("fp"))).alias("s")).select("fp", "s.seg", "s.key")
    asked = held.select("fp", "seg", F.explode(ball(F.col("key"), 32)).alias("key"))
    sizes = held.groupBy("seg", "key").agg(F.count("*").alias("n"))
    crowded = written(sizes.where(F.col("n") > dense).select("seg", "key"), "crowded")

    def near(pairs: DataFrame) -> DataFrame:
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        return pairs.where((F.col("a") != F.col("b")) & (apart <= MAX_BITS)).select("a", "b")

    left, right = asked.withColumnRenamed("fp", "a"), held.withColumnRenamed("fp", "b")
    if crowded.isEmpty():
        return near(left.join(right, ["seg", "key"]))
    calm = near(left.join(crowded, ["seg", "key"], "left_anti").join(right, ["seg", "key"]))

    def split(rows: DataFrame, name: str, probe: bool) -> DataFrame:
        """rows of crowded buckets with a second key: half and value of the other segment's 16-bit halves."""
        other = F.when(F.col("seg") == 0, F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(F.col(name), 32))
        halves = F.array(*[F.struct(F.lit(k).alias("half"), F.shiftrightunsigned(other, 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("v")) for k in (0, 1)])
        out = rows.join(crowded, ["seg", "key"]).select(name, "seg", "key", F.explode(halves).alias("h")).select(name, "seg", "key", "h.half", "h.v")
        if not probe:
            return out
        # both directions: the outer probe already fixed which of the two asks
        both = F.array_union(ball(F.col("v"), 16), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("v").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
        return out.select(name, "seg", "key", "half", F.explode(both).alias("v"))

    tight = near(split(left, "a", True).join(split(right, "b", False), ["seg", "key", "half", "v"]))
    return calm.unionByName(tight)


def fingerprint_roots(prints: DataFrame) -> DataFrame:
    """(node, root) of the fingerprints (column fp, distinct) that link to others, directly or through others."""
    return components(links(prints))


def clusters(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (content hash), fp, root and component_id of every row.

    root, a fingerprint, tells components apart; component_id, the smallest id, only names them: null ids give no name, and
    an id that several texts bear may name several components. Texts are read once, where they lie; from there on only ids and fingerprints move.
    """
    texts = keyed(docs, id_col, text_col)
    rows = written(texts.select("id", "th", fingerprint_column(F.col("text"), shingle).alias("fp")), "simhash")
    firsts = rows.groupBy("fp").agg(F.min("id").alias("least"))
    groups = fingerprint_roots(rows.select("fp").distinct())
    named = firsts.join(groups, firsts.fp == groups.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "fp").select("id", "th", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, whole rows, with one document of each component: see ``one_per_root``."""
    return one_per_root(docs, written(clusters(docs, shingle, id_col, text_col), "clusters"), id_col, text_col)
