"""A corpus pipeline of five stages, each applying one operator to all documents that the one before kept.

Each stage takes (spark, docs, sf_dir), docs with the columns of ``documents``, and returns a DataFrame; all but the last
return these columns. Between stages the documents are written as Parquet and read again.

Null texts count as empty all the way. Repeated rows are near copies of each other, so that one of them stays; so do empty
texts, and texts of fewer than five words only with their like. Documents with a null id are kept by the same rules. Texts
of any length are read whole. An empty table gives an empty result with the last stage's columns; other columns pass
through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import byte_bpe, decontaminate, line_dedup, near_copies, quality
from arcweave.llm.common import table, written
from arcweave.llm.queries import BYTE_RANKS, training_labels

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
#: Rows that a Python worker is handed at once: an executor holds a batch several times over, in the JVM, outside its heap and in
#: each worker.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; fitted on the labels of documents outside the held-out quarter."""
    small_batches(spark)
    return quality.good(docs, training_labels(table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three-line windows; n_chars counts what is left."""
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies over shingles of five words: SimHash fingerprints three bits apart or less, and,
    beyond what these reach, a Jaccard similarity of 0.8 or more."""
    small_batches(spark)
    return near_copies.one_of_each(docs, SHINGLE, fingerprints=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers) and the SHA-256 of the bytes they decode to."""
    small_batches(spark)
    done = byte_bpe.encode_decode(docs, BYTE_RANKS, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level bpe", to_tokens),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
