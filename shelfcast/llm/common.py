"""Helpers shared by the training-data operators: text passes over Arrow batches and written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from shelfcast.session import materialize

__all__ = ["bucket_of", "chunks", "identified", "map_rows", "map_text", "materialize", "packed", "table", "unused"]

#: Rows and bytes of text handled at once inside a task; bounds the memory of a Python worker.
CHUNK_ROWS = 512
CHUNK_BYTES = 4 << 20

#: One word of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts of the rows, as UTF-8 bytes (null becomes empty), to one Arrow array per new column.
Kernel = Callable[[list[bytes]], Sequence[pa.Array]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, taken: Sequence[str]) -> str:
    """``name``, or a longer one that no column has (column names are compared without case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts as bytes, bounded in rows and in bytes (one long text may exceed it)."""
    texts = batch.column(column)
    if not pa.types.is_binary(texts.type):
        texts = texts.cast(pa.binary())
    start = 0
    while start < batch.num_rows:
        size, stop, own = 0, start, []
        while stop < batch.num_rows and stop - start < CHUNK_ROWS and size < CHUNK_BYTES:
            own.append(texts[stop].as_py() or b"")
            size += len(own[-1])
            stop += 1
        yield batch.slice(start, stop - start), own
        start = stop


def map_rows(
    df: DataFrame, make: Callable[[], Callable], fields: Sequence[StructField], sized: str, keep: Sequence[str]
) -> DataFrame:
    """The columns ``keep`` plus ``fields``; the kernel gets slices of the batches and the values of ``sized``.

    ``make`` runs once per task and returns the kernel, so that look-up tables are built once. ``sized`` is a string
    or binary column by whose bytes the slices are cut.
    """
    schema = StructType([*df.select(*keep).schema.fields, *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part, values in chunks(batch, sized):
                arrays = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, *kernel(values, part)], names=names)

    return df.mapInArrow(run, schema)


def map_text(
    docs: DataFrame, make: Callable[[], Kernel], fields: Sequence[StructField], text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """One pass over the texts that adds ``fields`` to the columns ``keep``.

    The text column is read under a private name, so it may be kept or not.
    """
    private = unused("_text", [*keep, *[f.name for f in fields]])
    source = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(private))

    def only_texts():
        kernel = make()
        return lambda texts, _: kernel(texts)

    return map_rows(source, only_texts, fields, private, keep)


def identified(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``_id``, ``_body``, ``_r1``, ``_r2`` (96 bits that identify id and text) and ``_held``, all other columns.

    Columns that an operator passes through stay in one struct, so that their names can't clash with its own.
    """
    body = F.col(text).cast("string")
    return docs.select(
        F.col(doc_id).alias("_id"),
        body.alias("_body"),
        F.xxhash64(F.col(doc_id), body).alias("_r1"),
        F.hash(body, F.lit(7), F.col(doc_id)).alias("_r2"),
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("_held"),
    )


def packed(docs: DataFrame, text: str, doc_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """Identity, the columns ``keep`` of ``identified``, and ``_z``: the text, compressed for a shuffle (null if null)."""

    def make():
        pack = zstandard.ZstdCompressor(level=1).compress

        def kernel(texts, part):
            null = part.column("_body").is_null().to_pylist()
            return [pa.array([None if n else pack(raw) for raw, n in zip(texts, null)], pa.binary())]

        return kernel

    keys = ["_r1", "_r2", *keep]
    return map_rows(identified(docs, text, doc_id).select(*keys, "_body"), make, [StructField("_z", BinaryType())], "_body", keys)


def bucket_of(column: str, modulus: int):
    """crc32 of the value as text, modulo; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
