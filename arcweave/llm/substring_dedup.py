"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Words are maximal runs of anything but ASCII white space. A window is ``WINDOW`` consecutive words of one document. The
reference of a document is every document with a smaller id: a window that one of them holds too is removed, with all of
its words.

Documents are dealt into tiles by their hash; each tile is also a block of the reference, with an index of its windows. A
block parses what it is asked greedily, from left to right: the first window that a smaller document of the block holds,
compared word by word, is extended as far as the two texts agree. That is a factor; factors have ``WINDOW`` words at least,
what lies between them are single words. At a factor's end the windows that cross it are looked up in turn, so the next
factor may begin up to ``WINDOW`` - 1 words before that end. Removed words are those of factors, nothing else. The
reference of a factor is the least document of the block that holds its first window, which need not be the one with the
longest match; the words covered are the same.

Asking all blocks for all texts would grow with the square of the input, so hashes say which blocks to ask for what. A
window's anchor is the least hash among its 5-word grams: equal windows have equal anchors, and a text has about one anchor
per five words:

1. each tile sends its distinct anchors to index parts dealt by hash, which answer with those that other tiles hold too;
2. each tile sends the distinct windows around such anchors (96-bit hash, least id) to index parts, which answer with the
   tile that holds the least document of each window found earlier elsewhere;
3. each tile sends the stretches of such windows, words and all, to that reference block; a window goes out once per tile;
4. the blocks parse the stretches and answer with the factors;
5. each tile cuts its documents by the factors; a window that repeats one inside a factor, word by word, is cut with it.

Hashes of windows are built from two hashes of their words with keys drawn for each plan, and only choose what is compared:
no word goes without a comparison of words. A window could be missed only if another one with the same 96
bits stood in a smaller document.

What is sent is distinct per tile, so a passage that very many documents share goes out once per tile. A block that holds
the first document of a very large group of copies gets one such passage of each tile in one task. The texts are shuffled
once. All steps are one plan of shuffles and are recomputed from their inputs if an executor is lost; the order of a tile's
documents is that of id and text, whatever the order of arrival.

Null text counts as empty (no words). A null id counts as smaller than all others. Rows that repeat an id do not repeat
each other (their ids are equal) and each gets its result; equal rows lie in one tile. Ids are integers. An empty table
gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from secrets import randbits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from arcweave.llm.common import keyed

WINDOW, GRAM = 13, 5
#: Characters of text in a tile, and of the texts whose windows one part of the index covers.
TILE_CHARS, BLOCK_CHARS = 4 << 20, 16 << 20
NULL_ID, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: A window as it is asked: hash, second hash, least id; and as it is answered: the tile to ask.
ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("d", "<i8")])
ANSWER = np.dtype([("h", "<u8"), ("g", "<u4"), ("tile", "<u4")])
ODD = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space by byte, and the 32-bit pieces of a word that have keys.
BLANK, PIECES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), 16


def _mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of MurmurHash3 for 64 bits: spreads every bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of texts joined into one text that ends in white space. ``norm`` has one blank after each word."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        blank = BLANK[raw]
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        self.ends_before = np.flatnonzero(keep & blank)  # where words end in ``data``
        self.norm = np.append(raw[keep], np.zeros(8, np.uint8))  # what reads past the last word finds nothing
        self.ends = np.flatnonzero(BLANK[self.norm])
        self.norm[self.ends] = 32
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.sizes = self.ends - self.starts

    def codes(self) -> np.ndarray:
        """A number for each word, equal for equal words only."""
        cuts = np.concatenate([[0], self.ends + 1]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(self.ends), [None, pa.py_buffer(cuts), pa.py_buffer(self.norm)])
        return column.dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def phrase(self, a: int, b: int) -> bytes:
        """Words a to b - 1, with a blank between them."""
        return self.norm[self.starts[a] : self.ends[b - 1]].tobytes()

    def hashes(self, seed: int, count: int) -> list[np.ndarray]:
        """``count`` 64-bit hashes of each word, the same in all tiles.

        Multilinear hashing: the sum of a word's 32-bit pieces and its length, each times a key of 64 bits drawn from the
        seed. Any two words meet with a chance of 2**-32 at most per hash, whatever they are. Longer words than ``PIECES``
        have room for are hashed by xxhash.
        """
        keys = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, (2, PIECES + 1), np.uint64)[:count]
        out = [self.sizes.astype(np.uint64) * k[PIECES] for k in keys]
        at8 = np.ndarray((max(0, len(self.norm) - 7),), "<u8", self.norm, strides=(1,))
        some, sizes, starts = slice(None), self.sizes, self.starts
        for piece in range(0, PIECES, 2):
            v = at8[starts + 4 * piece]
            rest = sizes - 4 * piece
            v &= np.where(rest < 8, (np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
            low, high = v & np.uint64(0xFFFFFFFF), v >> np.uint64(32)
            for h, k in zip(out, keys):
                h[some] += low * k[piece] + high * k[piece + 1]
            on = np.flatnonzero(rest > 8)
            some = on if piece == 0 else some[on]
            sizes, starts = sizes[on], starts[on]
            if not len(on):
                break
        out = [_mix(h) for h in out]
        for w in some[sizes > 4 * PIECES] if len(sizes) else ():
            digest = np.frombuffer(xxh3_128_digest(self.phrase(w, w + 1), seed), "<u8")
            for h, d in zip(out, digest):
                h[w] = d
        return out


def local(codes: np.ndarray) -> np.ndarray:
    """Hashes of windows that hold within one numbering of words, where equal ones are compared by words anyway."""
    return grams(_mix((codes.astype(np.uint64) + np.uint64(1)) * ODD), WINDOW)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by their first word, from the hashes of the words.

    Runs of 1, 2, 4, ... words are hashed in pairs; a run of any size is put together from these.
    """
    n, out, at, have = len(h) - size + 1, None, 0, 1
    if n <= 0:
        return h[:0]
    while True:
        if size & have:
            part = h[at : at + n]
            out = part if out is None else _mix(out * ODD + part)
            at += have
        if 2 * have > size:
            return out
        h = _mix(h[:-have] * ODD + h[have:])
        have *= 2


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


class Tile(Words):
    """Documents of one tile in the order of their ids (then texts), as one list of words."""

    def __init__(self, docs: pa.Table):
        keys = docs["id"].combine_chunks().cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        texts = [x or b"" for x in docs["text"].cast(pa.large_binary()).to_pylist()]
        self.order = np.array(sorted(range(len(texts)), key=lambda k: (keys[k], texts[k])), np.int64)
        self.ids = keys[self.order]
        texts = [texts[k] for k in self.order]
        super().__init__(b" ".join([*texts, b""]))
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        self.begins = np.concatenate([[0], np.searchsorted(self.ends_before, ends, "right")]).astype(np.int64)
        self.counts = np.diff(self.begins)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        n = max(0, len(self.ends) - WINDOW + 1)
        self.valid = self.owner[:n] == self.owner[len(self.owner) - n :]

    def windows(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of all windows, the second one of 32 bits."""
        h, g = self.hashes(seed, 2)
        return grams(h, WINDOW), grams(g, WINDOW).astype(np.uint32)

    def anchors(self, seed: int) -> np.ndarray:
        return least_of(grams(self.hashes(seed, 1)[0], GRAM), WINDOW - GRAM + 1)

    def without(self, gone: np.ndarray) -> pa.Array:
        """The documents' words that are not gone, joined by one blank."""
        left = self.norm[: len(self.norm) - 8][np.repeat(~gone, self.sizes + 1)]
        cuts = np.concatenate([[0], np.cumsum(np.where(gone, 0, self.sizes + 1))])[self.begins]
        filled = np.diff(cuts) > 0
        inner = np.ones(len(left), bool)
        inner[cuts[1:][filled] - 1] = False  # the blank after a document's last word
        cuts = (cuts - np.concatenate([[0], np.cumsum(filled)])).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(filled), [None, pa.py_buffer(cuts), pa.py_buffer(left[inner])])


def heads_of(n: int, *new: np.ndarray) -> np.ndarray:
    """Starts of the stretches of n entries in which none of the conditions (of n - 1 each) holds between neighbours."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce(new)])) if n else np.empty(0, np.int64)


def runs(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal (h, g) in sorted arrays."""
    return np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.empty(0, np.int64)


def by_hash(h: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
    """A stable order by h and, where h is equal, g: a plain sort of h whose ties are then put in order."""
    order = np.argsort(h)
    hs = h[order]
    again = hs[1:] == hs[:-1]
    tie = np.concatenate([[False], again]) | np.concatenate([again, [False]]) if len(h) else np.empty(0, bool)
    some = order[tie]
    order[tie] = some[np.lexsort((some, h[some]) if g is None else (some, g[some], h[some]))]
    return order


def places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value is, or would be, in the sorted known ones. Looking them up in their own order spares the
    jumps through memory."""
    out = np.empty(len(wanted), np.int64)
    order = np.argsort(wanted)
    out[order] = np.searchsorted(known, wanted[order])
    return out


def dealt(values: np.ndarray, hashes: np.ndarray, blocks: int, tile: int) -> pa.Table:
    """One row (block, tile, bytes of its values) for each block that has any."""
    to = ((hashes >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    values, to = values[order], to[order]
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
    cuts = [*at.tolist(), len(to)]
    blobs = [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.table({"block": pa.array(to[at], pa.int64()), "tile": pa.array([tile] * len(at), pa.int64()), "data": pa.array(blobs, pa.binary())})


def gathered(rows: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of the rows' data, and the tile of each."""
    parts = [np.frombuffer(x.as_py(), kind) for x in rows["data"]]
    tiles = np.repeat(rows["tile"].to_numpy(), [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.empty(0, kind)), tiles


def answers(values: np.ndarray, tiles: np.ndarray) -> pa.Table:
    """One row (tile, bytes of its values) per tile."""
    order = np.argsort(tiles, kind="stable")
    values, tiles = values[order], tiles[order]
    at = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]])) if len(tiles) else np.empty(0, np.int64)
    cuts = [*at.tolist(), len(tiles)]
    return pa.table({"tile": pa.array(tiles[at], pa.int64()), "data": pa.array([values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries agree."""
    n, step, at = min(len(a), len(b)), 64, 0
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return n


def factors_in(block: Tile, phrases: list[bytes], before: list[int]) -> list[list[tuple[int, int, int]]]:
    """Greedy parse of each phrase against the block's documents with ids less than ``before``: its factors of ``WINDOW``
    words or more as (first word, words, id of the reference)."""
    codes = Words(b" ".join([block.norm[: len(block.norm) - 8].tobytes(), *phrases, b""])).codes()
    own, asked = codes[: len(block.ends)], codes[len(block.ends) :]
    inside = np.flatnonzero(block.valid)
    h = local(own)[inside]
    order = by_hash(h)  # equal hashes stay in the order of ids
    h, spots = h[order], inside[order]
    wanted = local(asked)
    low = places(h, wanted)
    out, begin = [], 0
    for phrase, limit in zip(phrases, before):
        found, at, end = [], begin, begin + phrase.count(b" ") + 1
        while at + WINDOW <= end:
            k, n = int(low[at]), 0
            while k < len(h) and h[k] == wanted[at]:
                spot = int(spots[k])
                doc = block.owner[spot]
                if block.ids[doc] >= limit:
                    break
                n = agreeing(asked[at:end], own[spot : block.begins[doc + 1]])
                if n >= WINDOW:
                    found.append((at - begin, n, int(block.ids[doc])))
                    break
                k += 1
            # after a factor come the windows that cross its end
            at += n - WINDOW + 1 if n >= WINDOW else 1
        out.append(found)
        begin = end
    return out


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by one space) and factors (start, length, ref) of every row.

    start and length count words; ref is the id of the document that the factor was compared with. Factors that meet in a
    document and have one reference are shown as one; with different references they may overlap.
    """
    texts = keyed(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("id", "th").alias("at"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n_tiles, blocks = 1 + chars // TILE_CHARS, 1 + chars // BLOCK_CHARS
    seed = randbits(64)
    tiles = texts.select("id", "text", F.pmod("at", F.lit(n_tiles)).alias("tile"))

    def ask_anchors(key: tuple, rows: pa.Table) -> pa.Table:
        t = Tile(rows)
        mine = np.sort(t.anchors(seed)[t.valid])
        mine = mine[heads_of(len(mine), mine[1:] != mine[:-1])]
        return dealt(mine, mine, blocks, key[0].as_py())

    def shared_anchors(rows: pa.Table) -> pa.Table:
        a, tile = gathered(rows, "<u8")
        order = np.argsort(a, kind="stable")
        a, tile = a[order], tile[order]
        again = a[1:] == a[:-1]
        shared = np.concatenate([[False], again]) | np.concatenate([again, [False]]) if len(a) else np.empty(0, bool)
        return answers(a[shared], tile[shared])

    def ask_windows(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        known = np.sort(gathered(told, "<u8")[0])
        if not len(known) or not rows.num_rows:
            return dealt(np.empty(0, ENTRY), np.empty(0, np.uint64), blocks, 0)
        t = Tile(rows)
        m = t.anchors(seed)
        near = np.flatnonzero(t.valid & (known[np.minimum(places(known, m), len(known) - 1)] == m))
        h, g = (x[near] for x in t.windows(seed))
        d = t.ids[t.owner[near]]
        order = by_hash(h, g)
        h, g, d = h[order], g[order], d[order]
        first = runs(h, g)  # stable, and the tile is in the order of ids: the first is the least id
        out = np.empty(len(first), ENTRY)
        out["h"], out["g"], out["d"] = h[first], g[first], d[first]
        return dealt(out, out["h"], blocks, key[0].as_py())

    def earlier_windows(rows: pa.Table) -> pa.Table:
        e, tile = gathered(rows, ENTRY)
        order = np.lexsort((tile, e["d"], e["g"], e["h"]))
        e, tile = e[order], tile[order]
        at = runs(e["h"], e["g"])
        first = np.repeat(at, np.diff([*at, len(e)])) if len(e) else np.empty(0, np.int64)
        late = e["d"][first] < e["d"]
        out = np.empty(int(late.sum()), ANSWER)
        out["h"], out["g"], out["tile"] = e["h"][late], e["g"][late], tile[first[late]]
        return answers(out, tile[late])

    def ask_blocks(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        t, here = Tile(rows), key[0].as_py()
        inside = np.flatnonzero(t.valid)
        h, g = (x[inside] for x in t.windows(seed))
        own = t.ids[t.owner[inside]]
        # the tile's own windows and the answers, sorted together: who holds each window before, and the first that repeats it
        e, _ = gathered(told, ANSWER)
        all_h, all_g = np.concatenate([h, e["h"]]), np.concatenate([g, e["g"]])
        order = by_hash(all_h, all_g)
        at = runs(all_h[order], all_g[order])
        size = np.diff([*at, len(order)])
        least = np.concatenate([own, np.full(len(e), NO_ID)])[order]
        holder = np.concatenate([np.full(len(own), -1), e["tile"].astype(np.int64)])[order]
        if len(order):
            least, holder = np.repeat(np.minimum.reduceat(least, at), size), np.repeat(np.maximum.reduceat(holder, at), size)
        mine = np.flatnonzero(order < len(own))
        spot = order[mine]
        late = (holder[mine] >= 0) | (least[mine] < own[spot])
        mine, spot = mine[late], spot[late]
        once = runs(all_h[spot], all_g[spot])
        mine, spot = mine[once], spot[once]
        place = np.argsort(spot)
        to, spots = np.where(holder[mine] < 0, here, holder[mine])[place], inside[spot[place]]
        docs_of = t.owner[spots]
        heads = heads_of(len(spots), np.diff(spots) != 1, np.diff(docs_of) != 0, np.diff(to) != 0)
        ends = np.append(heads[1:], len(spots))[: len(heads)] - 1
        phrases = [t.phrase(a, b + WINDOW) for a, b in zip(spots[heads].tolist(), spots[ends].tolist())]
        return pa.table(
            {
                "to": pa.array(to[heads], pa.int64()),
                "tile": pa.array(np.full(len(heads), here), pa.int64()),
                "start": pa.array(spots[heads], pa.int64()),
                "d": pa.array(t.ids[docs_of[heads]], pa.int64()),
                "words": pa.array(phrases, pa.binary()),
            }
        )

    def factor(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows:
            lists = factors_in(Tile(rows), asked["words"].to_pylist(), asked["d"].to_pylist())
            for tile, start, some in zip(asked["tile"].to_pylist(), asked["start"].to_pylist(), lists):
                found += [(tile, start + at, n, ref) for at, n, ref in some]
        columns = list(zip(*found)) or [[]] * 4
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("tile", "start", "n", "ref"), columns)})

    def cut(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        t = Tile(rows)
        start, n, ref = (told[k].to_numpy() for k in ("start", "n", "ref"))
        spots, refs = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(start):
            codes = t.codes()
            inside = np.flatnonzero(t.valid)
            h = local(codes)
            # windows inside factors, by hash, then those that repeat one of them word by word
            many = n - WINDOW + 1
            first = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            order = np.argsort(first)
            first, by = first[order], np.repeat(ref, many)[order]
            order = by_hash(h[first])
            first, by = first[order], by[order]
            known = h[first]
            left = inside
            at = places(known, h[left])
            hit_spots, hit_refs = [], []
            while len(left):
                on = at < len(known)
                on[on] = known[at[on]] == h[left[on]]
                left, at = left[on], at[on]
                hit = first[at] <= left
                for k in range(WINDOW):
                    hit &= codes[first[at] + k] == codes[left + k]
                hit_spots.append(left[hit])
                hit_refs.append(by[at[hit]])
                left, at = left[~hit], at[~hit] + 1
            spots, refs = np.concatenate(hit_spots), np.concatenate(hit_refs)
            order = np.argsort(spots)
            spots, refs = spots[order], refs[order]
        edge = np.zeros(len(t.ends) + 1, np.int64)
        edge[spots] += 1
        edge[spots + WINDOW] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        # neighbouring windows with one reference are one stretch
        heads = heads_of(len(spots), np.diff(spots) != 1, np.diff(refs) != 0, np.diff(t.owner[spots]) != 0)
        owners = t.owner[spots[heads]]
        stretch = pa.StructArray.from_arrays(
            [
                pa.array(spots[heads] - t.begins[owners], pa.int32()),
                pa.array(np.diff([*heads, len(spots)])[: len(heads)] + WINDOW - 1, pa.int32()),
                pa.array(refs[heads], pa.int64(), mask=refs[heads] == NULL_ID),
            ],
            names=["start", "length", "ref"],
        )
        per_doc = np.bincount(owners, minlength=len(t.counts))[: len(t.counts)]
        factors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), stretch)
        removed = np.bincount(t.owner[gone], minlength=len(t.counts))[: len(t.counts)]
        text = t.without(gone).cast(pa.string())
        ids = rows["id"].combine_chunks().take(pa.array(t.order))
        return pa.table({"id": ids, "n_words": pa.array(t.counts), "n_removed": pa.array(removed.astype(np.int64)), "kept": text, "factors": factors})

    asked, answer = "block long, tile long, data binary", "tile long, data binary"
    shared = tiles.groupBy("tile").applyInArrow(ask_anchors, asked).groupBy("block").applyInArrow(shared_anchors, answer)
    windows = tiles.groupBy("tile").cogroup(shared.groupBy("tile")).applyInArrow(ask_windows, asked)
    earlier = windows.groupBy("block").applyInArrow(earlier_windows, answer)
    phrases = tiles.groupBy("tile").cogroup(earlier.groupBy("tile")).applyInArrow(ask_blocks, "to long, tile long, start long, d long, words binary")
    factors = phrases.groupBy("to").cogroup(tiles.groupBy("tile")).applyInArrow(factor, "tile long, start long, n long, ref long")
    return tiles.groupBy("tile").cogroup(factors.groupBy("tile")).applyInArrow(
        cut, "id long, n_words long, n_removed long, kept string, factors array<struct<start:int,length:int,ref:long>>"
    )
