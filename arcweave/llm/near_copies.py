"""Near copies: documents whose sets of word shingles have a Jaccard similarity of ``SIMILAR`` or more.

Documents linked directly or through others form a group. Shingles are those of ``simhash``; equal sets are one entry
throughout, so copies cost nothing here.

1. MinHash: ``BANDS`` times the least values of ``BAND_ROWS`` hash functions over a set name a bucket. Two sets of
   similarity s share no bucket with probability (1 - s^BAND_ROWS)^BANDS, 0.000003 at 0.8 and less above.
2. Each bucket's sets are compared with its head, the one that meets most sets over all of its buckets.
3. In buckets that are then still in several groups, sets are described by what they lack of their head and what they
   have beyond it. Pairs that can still be similar (see ``open_pairs``) are compared, all others are proved not to be.

So every pair that shares a bucket is compared, already in one group, or under the limit by exact bounds: no candidate is
dropped, and a large group of near copies costs a comparison per member and head, not per pair.

The stage of the pipeline (``fingerprints``) links by SimHash as ``simhash`` does, all documents whose fingerprints differ in
``simhash.MAX_BITS`` bits or fewer, and joins these components with the groups above, which its bits do not reach.

A comparison is exact: the similarity of the whole sets. Texts without words have the empty set and are equal to each
other. Null text counts as empty. Null ids and repeated ids are documents like any other. An empty table gives no rows.
Other columns, whatever their names, pass through the stage form.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.common import components, keyed, one_per_root, same, written
from arcweave.llm.simhash import fingerprint_roots, majority, shingle_hashes

SIMILAR = 0.8
BANDS, BAND_ROWS, SEED = 32, 5, 17
#: Shingles that are hashed together.
SEGMENT = 512

_RNG = np.random.default_rng(SEED)
_FLIPS = _RNG.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_MIXERS = _RNG.integers(0, 2**64, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text or "", shingle))


def set_name(hashes: np.ndarray) -> bytes:
    """A digest of 128 bits that stands for the whole set: equal names are equal sets at any number of documents."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each band, signed; none of the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SEGMENT):
        some = hashes[at : at + SEGMENT]
        np.minimum(least, ((some[None, :] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    h = ((least ^ (least >> np.uint64(29))).reshape(BANDS, BAND_ROWS) * _MIXERS).sum(axis=1, dtype=np.uint64)
    return ((h ^ (h >> np.uint64(32))) * _MIXERS[:, 0]).view(np.int64)


def entries(text: Column, shingle: int) -> Column:
    """(node, buckets, fp) of every text; fp: the fingerprint of ``simhash``."""
    kind = pa.struct([("node", pa.binary()), ("buckets", pa.list_(pa.int64())), ("fp", pa.int64())])

    def entry(hashes: np.ndarray) -> dict:
        own = np.unique(hashes)
        return {"node": set_name(own), "buckets": buckets(own), "fp": int(np.uint64(majority(hashes)).view(np.int64))}

    @F.arrow_udf("struct<node:binary,buckets:array<long>,fp:long>")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([entry(shingle_hashes(t.as_py() or "", shingle)) for t in texts], kind)

    return made(text)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets in ascending order; 1 of two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def set_table(firsts: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the given nodes, written. firsts: node, id and th of one document each. Only their texts are shuffled."""

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in column], pa.binary())

    wanted = firsts.join(nodes, "node").select("node", "id", "th")
    found = same(texts, wanted).groupBy("node").agg(F.first("text").alias("text"))  # rows that repeat an id and text
    return written(found.select("node", packed(F.col("text")).alias("hashes")), "sets")


def with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with set_a and set_b, the sets of their columns a and b."""
    left, right = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"set_{n}")) for k, n in ((a, "a"), (b, "b")))
    return pairs.join(left, a).join(right, b)


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is ``SIMILAR`` or more."""

    @F.arrow_udf("boolean")
    def close(a: pa.Array, b: pa.Array) -> pa.Array:
        read = lambda x: np.frombuffer(x.as_py(), np.uint64)
        return pa.array([similarity(read(x), read(y)) >= SIMILAR for x, y in zip(a, b)], pa.bool_())

    return with_sets(pairs, sets, "a", "b").where(close(F.col("set_a"), F.col("set_b"))).select("a", "b")


def pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def profiles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (head, node, root) with n, the head's size, r, what the node lacks of it, and ``added``, what it has beyond
    it, written."""
    kind = pa.struct([("n", pa.int64()), ("r", pa.int64()), ("added", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n:long,r:long,added:array<long>>")
    def profile(own: pa.Array, head: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(own, head):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            added = np.setdiff1d(x, y, assume_unique=True)
            out.append({"n": len(y), "r": len(y) - len(x) + len(added), "added": added.view(np.int64)})
        return pa.array(out, kind)

    rows = with_sets(members, sets, "node", "head").select("head", "node", "root", profile("set_a", "set_b").alias("p"))
    return written(rows.select("head", "node", "root", "p.n", "p.r", F.size("p.added").cast("long").alias("a"), "p.added"), "profiles")


def open_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of one head and different roots that may be similar; members: see ``profiles``.

    For sets p and q with r_p >= r_q that share s added shingles, the intersection has n - |lacking of p or q| + s, so
    n - r_p + s at most, shingles. A similarity of 0.8 takes 4/9 of the sum of both sizes, which comes to
    9 s >= u_p - n - w_q with u = 5 r + 4 a and w = 4 (r - a); n >= u_p says that p itself is similar to its head.

    - If they share any, look at the rarest one: the others are more common, so s is at most its place, from the most
      common on, among the added shingles of p, and of q: an equal join with 9 * place >= u_p - n - w_q for both places.
    - With no shared one u_p - n <= w_q: an equal join on w in steps. As p and q are not both similar to the head,
      w_q <= 0 is then only possible if p lacks more than it adds.
    """
    u, w = 5 * F.col("r") + 4 * F.col("a"), 4 * (F.col("r") - F.col("a"))
    rows = members.withColumns({"over": u - F.col("n"), "w": w})
    tokens = rows.select("head", "node", "root", "r", "over", "w", F.explode("added").alias("s"))
    common = tokens.groupBy("head", "s").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("c > 1").select("head", "s", "c", (F.col("lo") != F.col("hi")).alias("mixed"))
    place = F.row_number().over(Window.partitionBy("head", "node").orderBy(F.desc("c"), "s"))
    held = written(tokens.join(common, ["head", "s"]).withColumn("place", place).where("mixed"), "added")
    as_p = held.select("head", "s", F.col("node").alias("p"), F.col("root").alias("p_root"), F.col("r").alias("p_r"), "over", F.col("place").alias("p_place"))
    as_q = held.select("head", "s", F.col("node").alias("q"), F.col("root").alias("q_root"), F.col("r").alias("q_r"), "w", F.col("place").alias("q_place"))
    # a p that no q in w could save at its place is left out before the join
    best = rows.groupBy("head").agg(F.max("w").alias("best"))
    as_p = as_p.join(best, "head").where("9 * p_place >= over - best").drop("best")
    sharing = as_p.join(as_q, ["head", "s"]).where("p_root <> q_root and p_r >= q_r and 9 * least(p_place, q_place) >= over - w")

    step = lambda c: F.floor(16 * F.col(c) / F.greatest("n", F.lit(1)))
    rows = rows.select("head", "node", "root", "r", "a", "over", "w", step("w").alias("at"), step("over").alias("low"))
    most = rows.groupBy("head").agg(F.max("at").alias("most"))
    asked = rows.join(most, "head").where("low <= most and (most >= 0 or r > a)")
    asked = asked.withColumn("low", F.when((F.col("over") <= 0) & (F.col("r") > F.col("a")), F.col("low")).otherwise(F.greatest("low", F.lit(0))))
    asked = asked.where("low <= most").select("head", F.col("node").alias("p"), F.col("root").alias("p_root"), F.col("r").alias("p_r"), "over", F.explode(F.sequence("low", "most")).alias("at"))
    told = rows.select("head", "at", F.col("node").alias("q"), F.col("root").alias("q_root"), F.col("r").alias("q_r"), "w")
    shorter = asked.join(told, ["head", "at"]).where("p_root <> q_root and p_r >= q_r and over <= w")
    return sharing.select(*pair("p", "q")).unionByName(shorter.select(*pair("p", "q"))).distinct()


def joined_by_fingerprint(found: DataFrame, rows: DataFrame) -> DataFrame:
    """found (id, th, node, root) with the roots of groups that hold linked fingerprints made one; rows: node, fp."""
    prints = rows.select("node", "fp").distinct()
    linked = fingerprint_roots(prints.select("fp").distinct()).withColumnsRenamed({"node": "fp", "root": "fp_root"})
    of = found.select("node", "root").distinct().join(prints, "node").join(linked, "fp", "left").select("root", F.coalesce("fp_root", "fp").alias("fp_root")).distinct()
    of = written(of, "fingerprint_groups")
    least = of.groupBy("fp_root").agg(F.min("root").alias("b"), F.count("*").alias("n")).where("n > 1").select("fp_root", "b")
    merged = of.join(least, "fp_root").where("root <> b").select(F.col("root").alias("a"), "b")
    last = components(merged).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return found.join(last, "root", "left").select("id", "th", "node", F.coalesce("last", "root").alias("root"))


def groups(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", fingerprints: bool = False) -> DataFrame:
    """id, th (content hash) and root of every row: equal roots are near copies, directly or through others. With
    ``fingerprints`` SimHash links count as well."""
    texts = keyed(docs, id_col, text_col)
    read = texts.select("id", "th", entries(F.col("text"), shingle).alias("e")).select("id", "th", "e.node", "e.buckets", "e.fp")
    rows = written(read, "minhash")
    found = written(_similar(rows, texts, shingle), "similar") if fingerprints else _similar(rows, texts, shingle)
    return (joined_by_fingerprint(found, rows) if fingerprints else found).select("id", "th", "root")


def _similar(rows: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """id, th, node and root of every row (id, th, node, buckets): equal roots are similar sets, directly or through others."""
    # a node's copies become one row, then its buckets are dealt out
    nodes = rows.groupBy("node").agg(F.min(F.struct("id", "th")).alias("k"), F.first("buckets").alias("buckets"))
    firsts = nodes.select("node", "k.id", "k.th")
    members = nodes.select("node", F.explode(F.array_distinct("buckets")).alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(sizes, "bucket"), "buckets")
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    heads = shared.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("head")).select("bucket", "head.node")
    heads = written(heads.withColumnRenamed("node", "head"), "heads")
    starred = written(shared.join(heads, "bucket").where("node <> head").select(*pair("node", "head")).distinct(), "pairs")
    sets = set_table(firsts, shared.select("node").distinct(), texts, shingle)
    roots = components(alike(starred, sets))

    # the buckets of more than two that are not yet one group
    named = shared.where("n > 2").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    open_rows = named.join(mixed.join(heads, "bucket"), "bucket").where("node <> head").select("head", "node", "root").distinct()
    left = written(open_pairs(profiles(open_rows, sets)).join(starred, ["a", "b"], "left_anti"), "pairs")
    found = rows.select("id", "th", "node").join(roots, "node", "left").select("id", "th", "node", F.coalesce("root", "node").alias("root"))
    if left.isEmpty():
        return found
    # links that came to light now join whole groups: only these groups' roots are linked further
    a, b = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b"))
    merged = alike(left, sets).join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    last = components(merged).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return found.join(last, "root", "left").select("id", "th", "node", F.coalesce("last", "root").alias("root"))


def one_of_each(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", fingerprints: bool = False) -> DataFrame:
    """docs, whole rows, with one document of each group: see ``one_per_root``."""
    return one_per_root(docs, written(groups(docs, shingle, id_col, text_col, fingerprints), "groups"), id_col, text_col)
