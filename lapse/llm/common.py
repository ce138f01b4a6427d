"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, a null text as the empty one: extra columns of `docs` can't clash with an operator's."""
    return docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """(whole, doc_id, th): each row whole as one column beside its id and its text's hash, so that no column of `docs`
    can clash with those that an operator joins to it. `whole.*` unpacks it."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), docs["doc_id"].cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("th"))


def words(text: Column) -> Column:
    """Words of a non-null text: maximal runs without white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs inside the block hand texts to Python workers in batches of so many rows: texts can be long, and a batch is held
    on both sides. The session's own setting is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, converted a few hundred at a time, so that long texts don't pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, n: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `n` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)
