"""Line dedup: windows of three consecutive lines that occur again are removed, the first occurrence stays.

Built of DataFrame functions alone. Lines are what lies between line breaks (``\\n``), compared byte for byte. Occurrences
are ordered by document id (null first), content hash and position; every occurrence of a window but the first is covered,
and the union of covered lines is removed. A text with fewer than three lines has no window and stays whole. Null text
counts as empty. Rows that repeat an id and its text count as one document and get the same result. A text whose lines
are all covered becomes empty; its row stays. An empty table gives no rows. All other columns pass through, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import packed

WINDOW = 3


def window_keys(lines: Column, width: int = WINDOW) -> Column:
    """Array of (pos, k): the SHA-256 of each window's lines, joined by the line break that none of them holds, so that
    different windows are told apart whatever their lines are made of."""

    def keys(x: Column) -> Column:
        at = F.when(F.size(x) >= width, F.sequence(F.lit(0), F.size(x) - width)).otherwise(F.array().cast("array<int>"))
        digest = lambda i: F.unhex(F.sha2(F.array_join(F.slice(x, i + 1, width), "\n").cast("binary"), 256))
        return F.transform(at, lambda i: F.struct(i.alias("pos"), digest(i).alias("k")))

    # the lines are made once: a one-element array is transformed, so that they are bound to a name
    return F.get(F.transform(F.array(lines), keys), F.lit(0))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """id, th (content hash) and ``starts``, the positions of repeated windows, of the documents that have any.

    One shuffle of (window digest, id, position) for the first occurrences, counted and combined before it; a second, of the
    same small rows, brings them back to their windows. A window that very many documents hold is one row per task in the
    first and may be split in the second.
    """
    src = packed(docs, id_col, text_col).select("id", F.xxhash64("text").alias("th"), window_keys(F.split("text", "\n", -1), width).alias("w"))
    spots = src.select("id", "th", F.explode("w").alias("w")).select("id", "th", "w.pos", "w.k")
    spot = F.struct("id", "th", "pos")
    firsts = spots.groupBy("k").agg(F.min(spot).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = spots.join(firsts, "k").where(~spot.eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``row`` (the input row), ``kept`` (the text without covered lines), ``n_lines`` and ``n_removed``.

    The texts are shuffled once, by id, to meet their covered lines.
    """
    src = packed(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    cover = covered_lines(docs, id_col, text_col, width).select(F.col("id").alias("cid"), F.col("th").alias("cth"), "starts")
    out = src.join(cover, F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")), "left")
    out = out.withColumn("lines", F.split("text", "\n", -1))
    covered = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (width - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    out = out.withColumn("left", F.when(F.col("starts").isNotNull(), left))
    lines = F.col("lines")
    kept = F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.get(lines, i)), "\n"))
    return out.select("row", kept.alias("kept"), F.size("lines").alias("n_lines"), F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).alias("n_removed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", width: int = WINDOW) -> DataFrame:
    """docs, with the same columns, text without covered lines and the count of characters (if there is one) of that."""
    done = dedup_lines(docs, id_col, text_col, width)
    new = {text_col: F.col("kept"), chars_col: F.length("kept").cast(docs.schema[chars_col].dataType) if chars_col in docs.columns else None}
    return done.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
