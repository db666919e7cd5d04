"""Paths as arrays of vertices, and labelled paths as struct<vertices, labels> with one label less than vertices.

Lengths count vertices, not edges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_path() -> Column:
    return F.array().cast("array<bigint>")


def path_of(vertices: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in vertices]).cast("array<bigint>")


def step_right(path: Column, v: Column) -> Column:
    return F.concat(path, F.array(v))


def step_left(v: Column, path: Column) -> Column:
    return F.concat(F.array(v), path)


def n_vertices(path: Column) -> Column:
    return F.size(path)


def reverse_path(path: Column) -> Column:
    return F.reverse(path)


def arcs_of(path: Column) -> Column:
    """Array of (src, dst) of neighbouring vertices; empty for fewer than two."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    heads, tails = F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n)
    return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("src"), b.alias("dst")))


def show_path(path: Column) -> Column:
    return F.array_join(path.cast("array<string>"), "->")


# --- labelled paths


def initial(v: Column, label: str = "string") -> Column:
    return F.struct(F.array(v).alias("vertices"), F.array().cast(f"array<{label}>").alias("labels"))


def labelled_step_right(p: Column, label: Column, v: Column) -> Column:
    return F.struct(F.concat(p["vertices"], F.array(v)).alias("vertices"), F.concat(p["labels"], F.array(label)).alias("labels"))


def labelled_step_left(v: Column, label: Column, p: Column) -> Column:
    return F.struct(F.concat(F.array(v), p["vertices"]).alias("vertices"), F.concat(F.array(label), p["labels"]).alias("labels"))


def labelled_from(start: Column, steps: Column) -> Column:
    """From a first vertex and an array of (label, vertex)."""
    return F.struct(F.concat(F.array(start), F.transform(steps, lambda s: s["vertex"])).alias("vertices"), F.transform(steps, lambda s: s["label"]).alias("labels"))


def start_and_steps(p: Column) -> Column:
    """struct<start, steps>: the inverse of labelled_from."""
    later = F.slice(p["vertices"], F.lit(2), F.size(p["vertices"]))
    return F.struct(F.get(p["vertices"], F.lit(0)).alias("start"), F.zip_with(p["labels"], later, lambda x, v: F.struct(x.alias("label"), v.alias("vertex"))).alias("steps"))


def vertices_of(p: Column) -> Column:
    return p["vertices"]


def labels_of(p: Column) -> Column:
    return p["labels"]


def n_labelled(p: Column) -> Column:
    return F.size(p["vertices"])


def reverse_labelled(p: Column) -> Column:
    return F.struct(F.reverse(p["vertices"]).alias("vertices"), F.reverse(p["labels"]).alias("labels"))


def interleaved(p: Column) -> Column:
    """Array of struct<vertex, label>, one of them null: vertex, label, vertex, ... in order."""
    both = F.zip_with(p["vertices"], p["labels"], lambda v, x: F.array(F.struct(v.alias("vertex"), F.lit(None).alias("label")), F.struct(F.lit(None).alias("vertex"), x.alias("label"))))
    return F.filter(F.flatten(both), lambda s: s["vertex"].isNotNull() | s["label"].isNotNull())


def from_interleaved(xs: Column) -> Column:
    """The inverse: vertices at even places, labels at odd ones."""
    return F.struct(
        F.transform(F.filter(xs, lambda x, i: i % 2 == 0), lambda s: s["vertex"]).alias("vertices"),
        F.transform(F.filter(xs, lambda x, i: i % 2 == 1), lambda s: s["label"]).alias("labels"),
    )


# --- arrays in general


def evens(xs: Column) -> Column:
    """Elements at positions 0, 2, 4, ..."""
    return F.filter(xs, lambda x, i: i % 2 == 0)


def odds(xs: Column) -> Column:
    return F.filter(xs, lambda x, i: i % 2 == 1)


def empty_or_contains(xs: Column, x: Column) -> Column:
    return (F.size(xs) == 0) | F.array_contains(xs, x)


def lookup(pairs: Column, k: Column) -> Column:
    """The value of the first (key, val) with this key, else null."""
    return F.get(F.filter(pairs, lambda p: p["key"] == k), F.lit(0))["val"]
