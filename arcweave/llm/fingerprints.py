"""Document fingerprints: a digest of the canonical text, equal for equal documents up to form, case and blanks.

Built of DataFrame functions alone. Canonical: Unicode compatibility composition (NFKC), full case folding, NFKC again,
runs of white space as one space, none at the ends. The digest is two chained 64-bit xxhashes, 32 hex digits. Within
equal digests the canonical bytes are compared; should they differ, each gets their SHA-256 behind the digest, so that equal fingerprints always mean equal canonical texts.

Null text counts as empty; empty texts are equal to each other. Rows that repeat an id and its text count as one document
wherever documents are ordered. A null id sorts first. An empty table gives no rows. Other columns, whatever their
names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.common import keyed, same, written

#: Documents to a range of the order by id, unless the session asks for more shuffle partitions.
RANGE_ROWS = 1 << 20


def canonical(text: Column) -> Column:
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.trim(F.regexp_replace(compose(fold), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    lanes = F.xxhash64(canon), F.xxhash64(F.lit("second lane"), canon)
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in lanes]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, n_chars and digest of every document (repeated rows once), written to the shared folder: small rows."""
    rows = keyed(docs, id_col, text_col).select("id", "th", F.length("text").cast("long").alias("n_chars"), digest(canonical(F.col("text"))).alias("digest"))
    return written(rows.distinct(), "digests")


def collisions(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The digests that stand for more than one canonical text: none, unless the hash fails.

    Canonical bytes of the documents that share a digest are compared through their least and greatest, combined before
    the shuffle, so that a bucket with very many copies sends one row per task.
    """
    shared = found.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1").select("digest")
    members = same(texts, found.join(shared, "digest").select("id", "th", "digest")).select("digest", canonical(F.col("text")).alias("canon"))
    return members.groupBy("digest").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("digest")


def told_apart(rows: DataFrame, canon: Column, digest_col: str, odd: DataFrame, name: str) -> DataFrame:
    """rows with a fingerprint ``name``: the digest, and behind one of the odd digests a SHA-256 of the canonical bytes."""
    marked = rows.join(odd.select(F.col("digest").alias(digest_col), F.lit(True).alias("odd")), digest_col, "left")
    return marked.withColumn(name, F.when(F.col("odd"), F.concat(digest_col, F.lit(":"), F.sha2(canon, 256))).otherwise(F.col(digest_col))).drop("odd")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, n_chars, digest and fingerprint of each document, written to the shared folder: small rows."""
    found, texts = digests(docs, id_col, text_col), keyed(docs, id_col, text_col)
    odd = written(collisions(texts, found), "odd")
    if odd.isEmpty():
        return found.withColumn("fingerprint", F.col("digest"))
    few = found.join(odd, "digest", "left_semi").select("id", "th")
    named = told_apart(same(texts, few).withColumn("canon", canonical(F.col("text"))).withColumn("digest", digest(F.col("canon"))), F.col("canon"), "digest", odd, "fingerprint")
    named = named.select("id", "th", F.col("fingerprint").alias("own")).distinct()
    return written(same(found, named, "left").withColumn("fingerprint", F.coalesce("own", "digest")).drop("own"), "fingerprints")


def groups(prints: DataFrame) -> DataFrame:
    """fingerprint, group_id (the smallest id) and copies, a row for each class of equal documents."""
    return prints.groupBy("fingerprint").agg(F.min("id").alias("group_id"), F.count("*").alias("copies"))


def successors(prints: DataFrame) -> DataFrame:
    """prints with nid, nth and next_print: the next document by ascending id (after the last: the first).

    Documents are dealt by ranges of (id, hash), whatever the span of the ids, and written once, so that a range keeps
    its number; ranges are ordered one by one, and the step over all ranges sees the first document of each.
    """
    order = [F.col("id").asc_nulls_first(), F.col("th")]
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() // RANGE_ROWS))
    rows = written(prints.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    me = F.struct(F.col("id").alias("nid"), F.col("th").alias("nth"), F.col("fingerprint").alias("next_print"))
    inside = F.lead(me).over(Window.partitionBy("range").orderBy(*order))
    firsts = rows.groupBy("range").agg(F.min(me).alias("first"))
    by = Window.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(by), F.first("first").over(by)).alias("after"))
    out = rows.withColumn("inside", inside).join(firsts, "range").withColumn("n", F.coalesce("inside", "after"))
    return out.select(*prints.columns, "n.nid", "n.nth", "n.next_print")


def edited(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """prints with next_print, ``edited`` and ``text``: the last quarter replaced by the start of the next document.

    The texts are shuffled once, by document, and read from there twice: as the next document, which sends on a quarter
    of its length at most, and as the document itself.
    """
    texts = keyed(docs, id_col, text_col)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    after = successors(prints)
    heads = same(after, texts, id="nid", th="nth").select("id", "th", "n_chars", "digest", "fingerprint", "next_print", F.substring("text", F.lit(1), quarter).alias("head"))
    both = same(texts, heads)
    return both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.col("head")))
