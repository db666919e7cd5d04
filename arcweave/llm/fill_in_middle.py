"""Fill-in-middle: a text is cut at two unit borders and its parts change places, marked by sentinels.

A unit begins at the text's first byte and wherever the byte before and the byte at a place say so (``LINES``: behind a
line break). The bytes of a group of texts lie in one buffer that is decomposed into chunks; each chunk is read with the
one byte before it, so that chunks overlap in the pair at their border and no border is missed or counted twice. One
vectorised pass counts the borders of all chunks, prefix sums of these counts say which chunk owns the border of each
cut rank, and only those chunks (two a text) are scanned again for the place itself. So a text of any length costs one
counting pass and two chunks, and nothing is held for each unit.

Everything happens where the text is: no shuffle, whatever the sizes, and a task holds one Arrow batch. A text is one value
that one task reads, writes and hashes, so its chunks are not dealt to other tasks.

Null text counts as empty. A text that is empty, or that holds a sentinel, stays plain. Rows that repeat an id are cut
alike if their texts are equal; a null id counts as the empty string in the hash. An empty table gives no rows. Other
columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.token_output import groups

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and of texts that are cut together.
CHUNK, GROUP = 4096, 8 << 20

Border = Callable[[np.ndarray, np.ndarray], np.ndarray]


def LINES(before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A line ends with its line break."""
    return before == 10


def CHARACTERS(before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points: any byte that does not continue one."""
    return (at & 0xC0) != 0x80


def WORDS(before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A word reaches up to the next one: a border lies where blank ASCII ends."""
    blank = lambda b: (b == 32) | ((b >= 9) & (b <= 13))
    return blank(before) & ~blank(at)


class Borders:
    """The unit borders of some texts, counted by chunk; texts lie in ``data`` from ``starts[k]`` to ``starts[k + 1]``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, border: Border, chunk: int = CHUNK):
        self.data, self.starts, self.border = data, starts, border
        sizes = np.diff(starts)
        self.of_text = np.concatenate([[0], np.cumsum(-(-sizes // chunk))])  # first chunk of each text
        owner = np.repeat(np.arange(len(sizes)), np.diff(self.of_text))
        self.begins = starts[owner] + (np.arange(len(owner)) - self.of_text[owner]) * chunk
        self.ends = np.minimum(self.begins + chunk, starts[owner + 1])
        self.first = starts[owner]
        # borders in front of each chunk, over all texts: a chunk's count is the difference of two
        self.before = np.concatenate([[0], np.cumsum(self._counts())])

    def _flags(self, low: int, high: int, first: int) -> np.ndarray:
        """Which places of [low, high) begin a unit of the text that begins at ``first``. A text's first place does."""
        out = np.ones(high - low, bool)
        skip = int(low == first)
        out[skip:] = self.border(self.data[low + skip - 1 : high - 1], self.data[low + skip : high])
        return out

    def _counts(self) -> np.ndarray:
        """Borders of each chunk. The chunks follow each other without gaps, so one pass over the buffer does for all."""
        if not len(self.begins):
            return np.zeros(0, np.int64)
        low, high = int(self.begins[0]), int(self.ends[-1])
        flags = np.ones(high - low, bool)
        flags[1:] = self.border(self.data[low : high - 1], self.data[low + 1 : high])
        flags[np.unique(self.first) - low] = True
        return np.add.reduceat(flags, self.begins - low, dtype=np.int64)

    def units(self) -> np.ndarray:
        """Number of units of each text."""
        return self.before[self.of_text[1:]] - self.before[self.of_text[:-1]]

    def place(self, text: int, rank: int) -> int:
        """Where in its text unit number ``rank`` (from 0) begins; the text's end for one past the last."""
        low, high = self.of_text[text], self.of_text[text + 1]
        want = self.before[low] + rank
        if want >= self.before[high]:
            return int(self.starts[text + 1] - self.starts[text])
        chunk = int(np.searchsorted(self.before, want, "right")) - 1
        flags = self._flags(int(self.begins[chunk]), int(self.ends[chunk]), int(self.first[chunk]))
        return int(self.begins[chunk] + np.flatnonzero(flags)[want - self.before[chunk]] - self.starts[text])


def draws(id_: Column, salt: str) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of salt and id."""
    h = F.sha2(F.concat(F.lit(salt), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, salt: str = "7:", rate: int = 100, suffix_first: int = 50, border: Border = LINES, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of each row.

    Of n + 1 borders two are drawn by the id. ``rate`` percent of the texts are cut, ``suffix_first`` percent of these
    have their suffix in front (spm), the others their prefix (psm).
    """
    h1, h2, h3, h4 = draws(F.col(id_col), salt)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), h1.alias("a"), h2.alias("b"), (h3 % 100 < rate).alias("cut"), (h4 % 100 < suffix_first).alias("spm"), text.alias("text"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def cut(group: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.concat_arrays([group.column(5)]).cast(pa.large_binary())
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        found = Borders(data, starts, border, chunk)
        held = np.zeros(len(texts), bool)
        for m in marks:
            held |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        n = found.units()
        a, b = (group.column(k).to_numpy() % (n + 1) for k in (1, 2))
        keep = group.column(3).to_numpy(zero_copy_only=False) & ~held & (n > 0)
        spm = group.column(4).to_numpy(zero_copy_only=False)
        forms, heads, middles, out = [], [], [], []
        for k in range(len(texts)):
            t = data[starts[k] : starts[k + 1]]
            if not keep[k]:
                forms.append("plain")
                heads.append(None)
                middles.append(None)
                out.append(t.tobytes())
                continue
            x, y = (found.place(k, int(r)) for r in sorted((a[k], b[k])))
            parts = t[:x], t[y:], t[x:y]
            forms.append("spm" if spm[k] else "psm")
            heads.append(int(CHARACTERS(parts[0], parts[0]).sum()))
            middles.append(int(CHARACTERS(parts[2], parts[2]).sum()))
            order = (1, 0, 2) if spm[k] else (0, 1, 2)
            out.append(b"".join(p for i in order for p in (marks[i], parts[i].tobytes())))
        columns = [group.column(0), pa.array(n), pa.array(forms), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, count in groups(batch.column(5), GROUP):
                yield cut(batch.slice(k, count))

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text before the cut, from output and form alone. No sentinel overlaps itself or another, and a cut text holds
    none, so each is found where it was put."""
    between = lambda x, y: F.substring_index(F.substring_index(output, x, -1), y, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
