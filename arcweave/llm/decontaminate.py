"""Benchmark decontamination: documents that hold a benchmark item up to a tenth of its characters edited.

Texts and items are compared in lower case with runs of white space as one space. An item of L characters is found in a
document if some stretch of the text is within floor(L * EDIT_SHARE) insertions, deletions and replacements of it.

1. Windows. An item is cut into two pieces more than it may have edits, so two pieces at least are intact wherever it
   occurs, and their places agree on where the item would start up to the number of edits. All pieces are sought at once;
   two that agree give windows of the item's size. This leaves out no occurrence.
2. Embedding. A CGK random walk maps a window to a longer string: step j copies the current character and moves on if a
   random bit of (j, character) says so. Strings at a small edit distance end up at a small Hamming distance.
3. Bit sampling. A table hashes some sampled positions of the string that one of several walks makes; so many tables are
   drawn that the target recall is reached, measured on items edited at random up to the limit. Windows that meet an item
   in any table are candidates. Of a class of lengths whose recall stays below the target with ``MAX_TABLES`` tables (long
   items), all windows are candidates.
4. Candidates are verified by their exact edit distance.

Items of under ``MIN_CHARS`` characters are sought as whole words (in scripts without blanks anywhere), by the same rule: up
to a tenth of their characters edited, so one from 10 characters on, none below. Their windows are all verified. Null
and empty texts hold nothing, and null and empty items are held by nothing. Repeated
rows and repeated items give repeated findings. Ids, of items of any type, are carried through unchanged, null ones too. Without items, or documents, nothing is
found. Other columns, whatever their names, pass through the stage form.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.llm.common import written

EDIT_SHARE = 0.1
MIN_CHARS = 20
TARGET_RECALL = 0.98
#: Positions in a table's sample, tables that share a walk, and the most tables; they are added up to the target recall.
SAMPLE, SHARING, MAX_TABLES, SEED = 8, 12, 960, 11
#: Items are looked for together up to so many characters (they travel with the tasks); beyond, in several passes.
ITEM_CHARS = 4 << 20
#: Windows that are embedded together, and characters of text that are searched together.
WINDOWS, TEXT_CHARS = 16_384, 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def allowed(length: int, share: float = EDIT_SHARE) -> int:
    return int(length * share)


def pieces(item: str, share: float = EDIT_SHARE) -> list[tuple[int, str]]:
    """(offset, piece): disjoint pieces, two more than the item may have edits."""
    n, k = len(item), allowed(len(item), share) + 2
    return [(n * j // k, item[n * j // k : n * (j + 1) // k]) for j in range(k)]


class Walks:
    """CGK embeddings of one class of lengths, read at the sampled positions of their tables only."""

    def __init__(self, shortest: int, tables: int, seed: int):
        self.steps = 2 * shortest  # half of the steps move on: by then a string of this length is walked through
        self.tables, self.each = tables, []
        for w in range(-(-tables // SHARING)):
            rng = np.random.default_rng([seed, shortest, w])
            moves = rng.integers(0, 2, (self.steps, 256), dtype=np.int32)
            at = rng.integers(0, self.steps, (SHARING, SAMPLE))
            weights = rng.integers(0, 2**63, (SHARING, SAMPLE), dtype=np.uint64) | np.uint64(1)
            by_step: dict[int, list[tuple[int, np.uint64]]] = defaultdict(list)
            for t, sample in enumerate(at.tolist()):
                for k, j in enumerate(sample):
                    by_step[j].append((w * SHARING + t, weights[t, k]))
            self.each.append((moves, by_step, max(by_step) + 1))

    def keys(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hash of each table's sample: one row per table, one column per window. Past its end a window reads zeros."""
        out = np.zeros((len(self.each) * SHARING, len(starts)), np.uint64)
        last = len(codes) - 1
        for moves, by_step, steps in self.each:
            i = np.zeros(len(starts), np.int64)
            for j in range(steps):
                c = np.where(i < lengths, codes[np.minimum(starts + i, last)], 0)
                for t, weight in by_step.get(j, ()):
                    out[t] += (c.astype(np.uint64) + np.uint64(1)) * weight
                i += moves[j, c & 255]
        return out[: self.tables]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def embed(walk: Walks, strings: list[str]) -> np.ndarray:
    lengths = np.array([len(s) for s in strings], np.int64)
    return walk.keys(codes_of("".join(strings)), np.cumsum(lengths) - lengths, lengths)


def edited(item: str, edits: int, rng: np.random.Generator) -> str:
    """item after random insertions, deletions and replacements by its own characters, of the item's length."""
    x = list(item)
    for _ in range(edits):
        at, c = int(rng.integers(len(x))), item[int(rng.integers(len(item)))]
        kind = rng.integers(3)
        if kind == 0:
            x[at] = c
        elif kind == 1:
            x.insert(at, c)
        elif len(x) > 1:
            del x[at]
    return "".join(x)


class Tables:
    """Walk and hash tables of the items of one class of lengths."""

    def __init__(self, items: list[tuple[int, str]], share: float, target: float):
        self.items = items
        shortest = min(len(s) for _, s in items)
        rng = np.random.default_rng([SEED, shortest, len(items)])
        some = [items[i][1] for i in rng.choice(len(items), min(40, len(items)), replace=False)] * 5
        walk = Walks(shortest, MAX_TABLES, SEED)
        hit = embed(walk, some) == embed(walk, [edited(s, allowed(len(s), share), rng) for s in some])
        found = np.maximum.accumulate(hit, axis=0).mean(axis=1)  # recall of the first 1, 2, ... tables
        enough = np.flatnonzero(found >= target)
        self.recall = float(found[enough[0]] if len(enough) else found[-1])
        self.exact = not len(enough)
        if self.exact:
            return
        self.tables = int(enough[0]) + 1
        self.walk = Walks(shortest, self.tables, SEED)
        keys = embed(self.walk, [s for _, s in items])
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def candidates(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) that agree in a table."""
        out: set[tuple[int, int]] = set()
        for t, row in enumerate(self.walk.keys(codes, starts, lengths)):
            lo, hi = np.searchsorted(self.keys[t], row, "left"), np.searchsorted(self.keys[t], row, "right")
            for w in np.flatnonzero(hi > lo).tolist():
                out.update((w, int(i)) for i in self.order[t, lo[w] : hi[w]])
        return out


def closest(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the stretch of text with the least edit distance to item; the first end of equals.

    One column of the edit matrix is two big integers of bits (its differences), advanced for each character of text.
    """
    n, masks = len(item), defaultdict(int)
    for k, c in enumerate(item):
        masks[c] |= 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diag | up)), up & diag
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diag | plus)), plus & diag
        if score < best:
            best, end = score, j + 1
    return best, end


def whole_word(text: str, start: int, end: int) -> bool:
    """Whether a stretch does not begin or end inside a word; letters from U+3000 on are words of their own."""
    inside = lambda a, b: a.isalnum() and b.isalnum() and max(a, b) < "\u3000"
    return not (start and inside(text[start - 1], text[start])) and not (end < len(text) and inside(text[end - 1], text[end]))


def distance_of(a: str, b: str) -> int:
    """The edit distance of two short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def nearest_words(item: str, text: str, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """(distance, start, length) of the nearest stretch of whole words that starts at first to last; None beyond ``most``."""
    best = None
    for start in range(max(0, first), min(last, len(text) - 1) + 1):
        for end in range(start + max(1, len(item) - most), min(start + len(item) + most, len(text)) + 1):
            if whole_word(text, start, end):
                distance = distance_of(item, text[start:end])
                if distance <= most and (best is None or distance < best[0]):
                    best = (distance, start, end - start)
    return best


@dataclass(frozen=True)
class Verified:
    """A class of items without tables: all its windows are verified."""

    items: list[tuple[int, str]]
    exact: bool = True


class Finder:
    """Items, the automaton of their pieces and the tables of each class of lengths."""

    def __init__(self, items: tuple[tuple[int, str], ...], share: float, target: float):
        import ahocorasick

        self.share = share
        items = [(i, s) for i, s in ((i, normal(t)) for i, t in items) if s]
        self.short: ahocorasick.Automaton | None = None
        brief: dict[str, list[int]] = defaultdict(list)
        for i, s in items:
            if not allowed(len(s), share) and len(s) < MIN_CHARS:
                brief[s].append(i)
        if brief:
            self.short = ahocorasick.Automaton()
            for s, ids in brief.items():
                self.short.add_word(s, (s, tuple(ids)))
            self.short.make_automaton()
        words = [(i, s) for i, s in items if allowed(len(s), share) and len(s) < MIN_CHARS]
        items = [(i, s) for i, s in items if len(s) >= MIN_CHARS]
        classes: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for i, s in items:
            classes[int(np.log(len(s)) / np.log(1.3))].append((i, s))
        self.tables: list[Tables | Verified] = [Tables(c, share, target) for _, c in sorted(classes.items())]
        if words:
            self.tables.append(Verified(words))
        places: dict[str, set[tuple[int, int, int]]] = defaultdict(set)
        for k, t in enumerate(self.tables):
            for item, (_, s) in enumerate(t.items):
                for offset, piece in pieces(s, share):
                    places[piece].add((k, item, offset))
        self.automaton = ahocorasick.Automaton() if places else None
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), tuple(sorted(where))))
        if places:
            self.automaton.make_automaton()

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each normalised text its findings (item id, start, length, distance), one per item: the nearest."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        if self.short is not None:
            for d, text in enumerate(texts):
                for end, (s, ids) in self.short.iter(text):
                    start = end + 1 - len(s)
                    if whole_word(text, start, end + 1):
                        for i in ids:
                            found[d].setdefault(i, (start, len(s), 0))
        if self.automaton is None:
            return [[(i, *f) for i, f in sorted(x.items())] for x in found]
        windows: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
        stretches: list[tuple[int, int, int, int, int]] = []
        for d, text in enumerate(texts):
            hits: dict[tuple[int, int], list[int]] = defaultdict(list)
            for end, (size, where) in self.automaton.iter(text):
                for k, item, offset in where:
                    hits[k, item].append(end + 1 - size - offset)
            for (k, item), begin in hits.items():
                if len(begin) > 1:
                    n = len(self.tables[k].items[item][1])
                    begin.sort()
                    for a, b in zip(begin, begin[1:]):
                        if b - a > allowed(n, self.share):
                            continue
                        if not self.tables[k].exact:
                            windows[k] |= {(d, max(0, a), n), (d, max(0, b), n)}
                        elif stretches and stretches[-1][:3] == (d, k, item) and stretches[-1][4] == a:
                            stretches[-1] = (*stretches[-1][:4], b)  # starts that follow each other closely are one stretch
                        else:
                            stretches.append((d, k, item, a, b))
        held = sorted({d for ws in windows.values() for d, _, _ in ws})
        begins = dict(zip(held, np.cumsum([0] + [len(texts[d]) for d in held]).tolist()))
        codes = codes_of("".join(texts[d] for d in held)) if held else None
        for k, ws in windows.items():
            ordered = sorted(ws)
            for at in range(0, len(ordered), WINDOWS):
                some = ordered[at : at + WINDOWS]
                starts = np.array([begins[d] + s for d, s, _ in some], np.int64)
                lengths = np.array([min(n, len(texts[d]) - s) for d, s, n in some], np.int64)
                for w, item in sorted(self.tables[k].candidates(codes, starts, lengths)):
                    d, s, _ = some[w]
                    self._verify(self.tables[k].items[item], texts[d], s, s, found[d])
        for d, k, item, a, b in stretches:
            self._verify(self.tables[k].items[item], texts[d], max(0, a), max(0, b), found[d])
        return [[(i, *f) for i, f in sorted(x.items())] for x in found]

    def _verify(self, item: tuple[int, str], text: str, start: int, last: int, found: dict) -> None:
        """Keeps the nearest stretch of text that starts about ``start`` to ``last``."""
        i, s = item
        if found.get(i, (0, 0, 1))[2] == 0:
            return
        most = allowed(len(s), self.share)
        if len(s) < MIN_CHARS:
            near = nearest_words(s, text, start - most, last + most, most)
            if near and (i not in found or near[0] < found[i][2]):
                found[i] = (near[1], near[2], near[0])
            return
        lo = max(0, start - 2 * most)
        part = text[lo : last + len(s) + 2 * most]
        at = part.find(s)
        if at >= 0:
            found[i] = (lo + at, len(s), 0)
            return
        distance, end = closest(s, part)
        if distance <= most and (i not in found or distance < found[i][2]):
            _, size = closest(s[::-1], part[:end][::-1])
            found[i] = (lo + end - size, size, distance)


@lru_cache(maxsize=1)  # a worker outlives the tables it was made for
def finder(items: tuple[tuple[int, str], ...], share: float, target: float) -> Finder:
    return Finder(items, share, target)


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = ITEM_CHARS) -> Iterator[tuple[tuple[tuple[int, str], ...], list, bool]]:
    """(items, ids, whether there are more blocks): blocks of about ``most`` characters at most, each fetched by itself.

    Inside a block items are numbered; ids has the item's own id, of any type or null, at its number.
    """
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if chars <= most else 1 + 2 * (chars // most)
    order = [F.col("id").asc_nulls_first(), "text"]
    for b in range(n):
        block = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).orderBy(*order).collect()
        yield tuple((k, r.text) for k, r in enumerate(block)), [r.id for r in block], n > 1


def findings_column(text: Column, items: tuple[tuple[int, str], ...], share: float, target: float) -> Column:
    """Array of (item_id, start, length, distance) for each text; positions count characters of the normalised text."""

    @F.arrow_udf("array<struct<item_id:long,start:int,length:int,distance:int>>")
    def found(texts: pa.Array) -> pa.Array:
        f, out, group, size = finder(items, share, target), [], [], 0
        for t in texts:
            group.append(normal(t.as_py()))
            size += len(group[-1])
            if size >= TEXT_CHARS:
                out += f.find(group)
                group, size = [], 0
        out += f.find(group)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("distance", pa.int32())]))
        return pa.array([[dict(zip(("item_id", "start", "length", "distance"), x)) for x in xs] for xs in out], kind)

    return found(text)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, target: float = TARGET_RECALL) -> DataFrame:
    """One row (id, item_id, start, length, distance) per document and item found in it. No shuffle of the texts.

    Items of more than one block are sought block by block, each pass written to the shared folder.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = T.StructType([T.StructField("k", T.LongType()), T.StructField("item_id", benchmark.schema[item_id].dataType)])
    out = None
    for block, ids, more in item_blocks(benchmark, item_id, item_text):
        names = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(ids)), kind))
        rows = src.select("id", F.explode(findings_column(F.col("text"), block, share, target)).alias("f"))
        rows = rows.join(names, F.col("f.item_id") == F.col("k")).select(F.col("id").alias(id_col), "item_id", "f.start", "f.length", "f.distance")
        rows = written(rows, "leaks") if more else rows
        out = rows if out is None else out.unionByName(rows)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, target: float = TARGET_RECALL) -> DataFrame:
    """The documents, unchanged, that hold no item. Items of more than one block are sought block by block."""
    for block, _, more in item_blocks(benchmark, item_id, item_text):
        docs = docs.where(F.size(findings_column(F.coalesce(F.col(text_col), F.lit("")), block, share, target)) == 0)
        docs = written(docs, "clean") if more else docs
    return docs
