"""What several operators of this subpackage share: tables, the shared work folder, row packing, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.plans.components import components
from arcweave.plans.shared import work_folder, written

__all__ = ["arrow_rows", "components", "keyed", "one_per_root", "packed", "same", "table", "work_folder", "written"]

#: Bytes that a Python worker gathers before it hands a batch back to the JVM.
OUT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id``, ``text`` (null: empty) and ``row``, the whole input row: no name of the input can clash."""
    return df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """id, th (content hash) and text (null: empty) of every row, and more columns by name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), *[c.alias(k) for k, c in more.items()])


def same(left: DataFrame, right: DataFrame, how: str = "inner", **names: str) -> DataFrame:
    """left joined to right on the document (id and content hash); a null id equals a null id."""
    r = right.withColumnsRenamed({"id": "r_id", "th": "r_th"})
    i, t = names.get("id", "id"), names.get("th", "th")
    return left.join(r, F.col(i).eqNullSafe(F.col("r_id")) & (F.col(t) == F.col("r_th")), how).drop("r_id", "r_th")


def one_per_root(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, whole rows, with one document for each root in found (id, th, root): the one with the smallest id (null before
    all), then content hash.

    Of rows that repeat that document's id and text one stays. The kept keys are joined to the texts by document, one
    shuffle of the texts unless adaptive execution can broadcast the keys.
    """
    kept = found.groupBy("root").agg(F.min(F.struct("id", "th")).alias("k")).select("k.id", "k.th")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = keyed(docs, id_col, text_col, row=row).drop("text")
    out = same(rows, kept, "left_semi")
    if not found.groupBy(F.struct("id", "th")).count().where("count > 1").isEmpty():
        out = out.groupBy(F.struct("id", "th")).agg(F.first("row").alias("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def arrow_rows(rows: Iterable[tuple], schema: pa.Schema, limit: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of some ``limit`` bytes from tuples, sized by their strings and bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 16 + sum(len(x) for x in r if isinstance(x, (bytes, str)))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
