"""Byte-level BPE with the tiktoken library and a local rank file.

Rows with null text count as empty text: no ids, empty bytes. Repeated rows give repeated results, a null id stays
null, an empty table gives an empty result, other columns (whatever their names) play no part. Texts of any length and
content are encoded, long runs of blanks included.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import arrow_rows

#: Texts longer than this many characters are split before they are encoded.
CHUNK_CHARS = 16_384
#: What \s of the library's regular expressions matches.
BLANK = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A safe boundary: no match of the pre-splitting pattern holds a blank after another character, so a match ends here and
#: the next one starts here, whatever surrounds them.
SAFE = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])")
#: Runs of blanks that do not go through the library's regular expression, whose stack overflows on long ones.
LONG_RUN = re.compile(f"[{BLANK}]{{1000,}}")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file (lines of base64 token and rank), loaded once in each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Pieces of text of at least ``size`` characters, cut only at safe boundaries; joined they are the text."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(text: str, rank_file: str, pattern: str) -> list[int]:
    r"""The ids of a text. ``pattern`` ends in ``\s+(?!\S)|\s+`` and matches no blank after another character elsewhere.

    So a run of blanks in front of another character is one match up to its last blank, which stays with what follows, and
    at the end of the text one match as a whole. Long runs are taken out by this rule and encoded as the pieces they are.
    """
    enc = encoding(rank_file, pattern)
    if len(text) <= CHUNK_CHARS:
        return enc.encode_ordinary(text)
    ids, start = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += [i for piece in safe_chunks(text[start : run.start()]) for i in enc.encode_ordinary(piece)]
        ids += enc._encode_single_piece(text[run.start() : end])
        start = end
    return ids + [i for piece in safe_chunks(text[start:]) for i in enc.encode_ordinary(piece)]


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` bytes.

    The bytes are what the ids decode to, not a copy of the text. No shuffle; a worker holds one input batch and a few
    MB of results.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            # ids travel through as they are, of whatever type, by the position of their row
            def rows(texts=batch.column(1)):
                for k, text in enumerate(texts):
                    ids = encode_text(text.as_py() or "", rank_file, pattern)
                    yield k, len(ids), np.asarray(ids, "<u4").tobytes(), enc.decode_bytes(ids)

            for out in arrow_rows(rows(), schema):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(out.column(0)), *out.columns[1:]], names=["id", *schema.names[1:]])

    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {id_type}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)
