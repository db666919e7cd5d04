"""Token ids as ORC files in document order.

Layout: one ORC file per range of document ids, rows (doc_id, part, seq, n_tokens, ids) sorted by doc_id; ``part`` numbers
the ranges, ``seq`` the rows of a range. ORC stores the ids in run-length encoded integer streams, keeps row indexes for
every ``ROW_INDEX_STRIDE`` rows and Bloom filters on doc_id, so that stripes are read in parallel and a look-up skips
stripes and row groups by their metadata.

Null text counts as empty (only the end id). Null ids sort first. Repeated ids stay together in one range, ordered by
text. An empty table gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRIPE_BYTES = 8 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
#: The complement of characters for which lower case is one character each, composed letters stay as they are, and the
#: classes of letters, digits and spaces are the same in every Unicode version. A text without these can be encoded chunk
#: by chunk; any other goes through the library whole.
ODD = "[^\\t\\n\\r -~¡-¨«-±´¶-¸»¿-ÿĀ-įĲ-ńŊ-ž]"
#: A full stop or comma between a letter or digit and a blank is a piece of its own, so it can stand apart: then most chunks
#: are words, of which there are fewer than of words with their endings.
ENDINGS = r"([\p{L}\p{N}])([.,])([ \t\r\n]|\z)", r"\1 \2\3"
#: Entries of a worker's cache of blank-delimited chunks.
CACHE_ENTRIES = 300_000
#: Bytes of text that are encoded together.
GROUP_BYTES = 4 << 20
#: Bytes of text to a range, and so to a file, unless the session asks for more shuffle partitions.
RANGE_BYTES = 256 << 20


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts as the tokenizers library does with one of its files, each distinct chunk between blanks once.

    The library's own call takes made-up words at some 1,500 CPU seconds a GB, and most of a text repeats a few words. So
    a group of texts is split at blanks, the library encodes the distinct chunks that are not yet known, and the ids are
    gathered by chunk. That is only done where the file's normaliser and pre-splitting cannot look across a blank
    (no ``ODD`` character, no added token's string, the known settings); any other text goes through the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        # one thread: the tasks of an executor already share its cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_chunk = steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed"
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.model, self.letters = self.whole.model, byte_letters()
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, chunks: list[str]) -> list[bytes]:
        """The ids of new chunks. One of letters alone is one piece, for the library's model as it is; others are split."""
        out, split = [], [c for c in chunks if not c.isalpha()]
        whole = iter(self._whole(split))
        for c in chunks:
            if c.isalpha():
                ids = [t.id for t in self.model.tokenize(c if c.isascii() else c.encode().decode("latin-1").translate(self.letters))]
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append(next(whole))
        return out

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks. The cache has two halves: as the newer one fills, the older one is let go."""
        out = list(map(self.newer.get, chunks))
        gaps = [i for i, x in enumerate(out) if x is None]
        if gaps:
            for i in gaps:
                out[i] = self.older.get(chunks[i])
            new = [i for i in gaps if out[i] is None]
            for i, x in zip(new, self._learned([chunks[i] for i in new])):
                out[i] = x
            if len(self.newer) + len(gaps) > CACHE_ENTRIES // 2:
                self.newer, self.older = {}, self.newer
            self.newer.update((chunks[i], out[i]) for i in gaps)
        return out

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, and ``end`` behind them, as little-endian unsigned 32-bit integers; texts: no nulls."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here forms cycles, and the cache is long to walk through
        try:
            odd = pc.match_substring_regex(texts, ODD) if self.by_chunk else pa.array([True] * len(texts), pa.bool_())
            for t in self.added:
                odd = pc.or_(odd, pc.match_substring(texts, t))
            plain = pc.utf8_lower(pc.replace_substring_regex(pc.if_else(odd, "", texts), *ENDINGS))
            split = pc.ascii_split_whitespace(plain)
            flat = split.flatten().dictionary_encode()
            known = [*self._ids_of(flat.dictionary.to_numpy(zero_copy_only=False).tolist()), end]
            # behind the last chunk of each text comes the end; the chunks' ids are copied into one buffer, in order
            bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
            chunks = pa.array(np.insert(flat.indices.to_numpy(), bounds[1:], len(known) - 1))
            ids = pa.array(known, pa.binary()).take(chunks)
            ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(chunks) + 1][bounds + np.arange(len(texts) + 1)]
            out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), ids.buffers()[2]])
            apart = odd.to_numpy(zero_copy_only=False)
            if not apart.any():
                return out
            whole = pa.array([x + end for x in self._whole(texts.filter(odd).to_pylist())], pa.binary())
            return pc.replace_with_mask(out, odd, whole)
        finally:
            if collecting:
                gc.enable()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_column(pa.array([text]))[0].as_py(), "<u4").tolist()


def groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """(start, count) of neighbouring texts of some ``size`` bytes, one at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < len(texts):
        upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right")))
        yield k, upto - k
        k = upto


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_ids(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends ``end_id`` and writes the ids as ORC into ``folder`` in ascending order of the id.

    Texts are dealt by ranges of the id (one shuffle) and sorted within; a range is encoded and written as it streams by.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = src.schema["doc_id"].dataType
    size = src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    dealt = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for start, count in groups(batch.column(1)):
                held = enc.encode_column(batch.column(1).slice(start, count), end)
                bounds = np.frombuffer(held.buffers()[1], np.int32)[: count + 1] // 4
                ids = pa.Array.from_buffers(pa.int32(), int(bounds[-1]), [None, held.buffers()[2]])
                rows = np.arange(seq, seq + count)
                seq += count
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, count), pa.array(np.full(count, part, np.int32)), pa.array(rows), pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), ids)],
                    names=["doc_id", "part", "seq", "n_tokens", "ids"],
                )

    rows = dealt.mapInArrow(run, f"doc_id {id_type.simpleString()}, part int, seq long, n_tokens long, ids array<int>")
    (
        rows.write.format("orc")
        .option("compression", "snappy")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .save(folder)
    )


def read_ids(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """The rows of the files. Filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(f"doc_id {id_type}, part int, seq long, n_tokens long, ids array<int>").orc(folder)


def offsets(rows: DataFrame) -> DataFrame:
    """rows (part, seq, n_tokens and any more columns) with ``start``, the number of ids in all rows before, in file order.

    Sums of each range first, then a running sum over the ranges (one row each, and a range is RANGE_BYTES of text or
    so), then one within each range.
    """
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "part").select(*rows.columns, (F.col("before") + F.col("inside")).alias("start"))


def checksums(ids: DataFrame) -> DataFrame:
    """doc_id, part, seq, n_tokens (counted) and ``ids_crc32``, the unsigned CRC-32 of the ids as little-endian unsigned
    32-bit integers: one pass over the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            raw, ends = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()), np.cumsum(lens) * 4
            sums = np.fromiter((zlib.crc32(raw[e - 4 * n : e]) for n, e in zip(lens.tolist(), ends.tolist())), np.int64, len(lens))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lens), pa.array(sums)], names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"])

    id_type = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "part", "seq", "ids").mapInArrow(run, f"doc_id {id_type}, part int, seq long, n_tokens long, ids_crc32 long")
