"""Clustering around centroids (Lloyd's rounds) in exact integer arithmetic.

Vectors of the asked length without null or non-finite components become whole numbers, floor(scale * component), and are
packed into blocks, one row of a table in the shared folder for some thousand vectors. A round multiplies each block by
the centroids in one float64 matrix product, |x|^2 - 2 x.c + |c|^2. All its terms are whole numbers, so the result is
exact as long as dim * (max|x| + max|c|)^2 stays below 2**53; a block beyond that bound falls back to 64-bit differences,
and beyond 2**63 to Python integers. ``treeAggregate`` adds up counts and component sums as Python integers, so that no
order of tasks changes a centroid. The driver holds the centroids and their sums, k rows of dim numbers, and nothing that
grows with the vectors; each round reads the blocks again, so a lost executor costs the tasks it had.

Equal distances go to the smaller centroid number. An empty centroid stays where it is. Fewer vectors than centroids give
fewer centroids; none gives an empty result. Repeated rows and ids are vectors of their own; a null id is kept, and stands
as the empty string where ids are hashed. Distances or sums that no 64-bit number holds are null in the result. Other
columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import written

#: Vectors in a block.
BLOCK = 4096
#: Whole numbers below this are exact in float64; below the second in 64 bits.
EXACT, LONG = 2**53, 2**63


def usable(vec: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none null, NaN or infinite."""
    inf = F.lit(float("inf"))
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))), F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a float64 matrix, in the narrowest of 16, 32 and 64 bits or as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x)
    top = float(np.abs(scaled).max(initial=0.0))
    if top < 2.0**62:
        return scaled.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8")
    big = [int(v) * scale if abs(v) >= EXACT else floor(scale * v) for v in x.ravel().tolist()]
    return np.array(big, object).reshape(x.shape)


def packed_blocks(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """ids, kind, x: blocks of usable vectors, written into the shared folder.

    x holds the rows one after the other, as whole numbers of the given kind; where 64 bits do not do, kind is ``<f8`` and x
    holds the components as they came.
    """
    src = vectors.where(usable(F.col(vec_col), dim)).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for k in range(0, len(raw), BLOCK):
                part = raw[k : k + BLOCK]
                x = whole(part, scale)
                kept = part.astype("<f8") if x.dtype == object else x
                ids = batch.column(0).slice(k, len(part))
                offsets = pa.array([0, len(part)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.concat_arrays([ids])), pa.array([kept.dtype.str]), pa.array([kept.tobytes()], pa.binary())], names=["ids", "kind", "x"])

    return written(src.mapInArrow(run, f"ids array<{id_type}>, kind string, x binary"), "blocks")


def block_matrix(kind: str, x: bytes, dim: int, scale: int) -> np.ndarray:
    rows = np.frombuffer(x, kind).reshape(-1, dim)
    return whole(rows, scale) if kind == "<f8" else rows


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances, a row per vector and a column per centroid, exact: 64-bit numbers or Python integers."""
    reach = int(np.abs(x).max(initial=0)) if x.dtype == object else int(np.abs(x.astype(np.int64)).max(initial=0))
    reach += max((abs(v) for c in centroids for v in c), default=0)
    bound = x.shape[1] * reach * reach
    if bound < EXACT:
        a, b = x.astype(np.float64), np.array(centroids, np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    kind = np.int64 if bound < LONG else object
    a = x.astype(kind)
    return np.stack([((a - np.array(c, kind)) ** 2).sum(1) for c in centroids], 1)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, the smaller number of equals."""
    d = distances(x, centroids)
    k = np.argmin(d, 1)
    return k, d[np.arange(len(d)), k]


def block_sums(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """For each centroid: count, summed distance and component sums of its vectors, as Python integers."""
    k, d = nearest(x, centroids)
    out = np.zeros((len(centroids), x.shape[1] + 2), object)
    out[:, 0] = np.bincount(k, minlength=len(centroids)).tolist()
    top = int(np.abs(x).max(initial=0)) if x.dtype == object else int(np.abs(x.astype(np.int64)).max(initial=0))
    if len(x) * top < EXACT:
        chosen = np.zeros((len(centroids), len(x)))
        chosen[k, np.arange(len(x))] = 1.0
        out[:, 2:] = (chosen @ x.astype(np.float64)).astype(np.int64).tolist()
    else:
        for c in range(len(centroids)):
            out[c, 2:] = x[k == c].astype(object).sum(0)
    for c in range(len(centroids)):
        mine = d[k == c]
        out[c, 1] = int(mine.sum()) if len(mine) * int(mine.max(initial=0)) < LONG else sum(map(int, mine))
    return out


@dataclass(frozen=True)
class Clustering:
    """Final centroids and, for each, the count and the summed squared distance of its vectors."""

    blocks: DataFrame
    dim: int
    scale: int
    centroids: list[list[int]]
    counts: list[int]
    inertia: list[int]

    def assigned(self, id_col: str) -> DataFrame:
        """id, cluster (int) and distance (long, squared) of every vector."""
        dim, scale, centroids = self.dim, self.scale, self.centroids
        kind = self.blocks.schema["ids"].dataType.elementType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, k, x in zip(*batch.columns):
                    c, d = nearest(block_matrix(k.as_py(), x.as_py(), dim, scale), centroids)
                    far = pa.array([v if v < LONG else None for v in d.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.values, pa.array(c.astype(np.int32)), far], names=["id", "cluster", "distance"])

        return self.blocks.mapInArrow(run, f"id {kind}, cluster int, distance long").withColumnRenamed("id", id_col)


def first_by_hash(vectors: DataFrame, id_col: str, vec_col: str, dim: int, k: int, salt: str) -> list[list[float]]:
    """The k usable vectors of least SHA-256 of ``salt`` and id, in that order (repeated ids: by their components)."""
    seed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.where(usable(F.col(vec_col), dim)).select(seed.alias("h"), vec.alias("x")).orderBy("h", "x").limit(k).collect()
    return [r.x for r in rows]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> Clustering:
    """Centroids start as the k usable vectors of least hash; each round moves every centroid to the componentwise
    floor(sum / count) of the vectors nearest to it. One more pass sums the distances to the last centroids."""
    blocks = packed_blocks(vectors, id_col, vec_col, dim, scale)
    start = first_by_hash(vectors, id_col, vec_col, dim, k, salt)
    centroids = [list(map(int, row)) for row in whole(np.array(start, np.float64).reshape(-1, dim), scale).tolist()]
    if not centroids:
        return Clustering(blocks, dim, scale, [], [], [])
    rows = blocks.select("kind", "x").rdd

    def sums(at: list[list[int]]) -> np.ndarray:
        def add(total, block):
            part = block_sums(block_matrix(block.kind, bytes(block.x), dim, scale), at)
            return part if total is None else total + part

        return rows.treeAggregate(None, add, lambda a, b: b if a is None else a if b is None else a + b)

    for _ in range(rounds):
        centroids = [[int(s) // int(row[0]) for s in row[2:]] if row[0] else c for row, c in zip(sums(centroids), centroids)]
    last = sums(centroids)
    return Clustering(blocks, dim, scale, centroids, [int(n) for n in last[:, 0]], [int(d) for d in last[:, 1]])
