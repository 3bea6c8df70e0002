"""Helpers of the operators: columns appended batch by batch, folds, prefix sums over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from maskmix.functions.runtime import map_arrow

#: Bytes of text a task works on at once; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000
#: Rows of a batch at most, however short their texts are.
BATCH_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def id_crc(column: str | Column) -> Column:
    """Unsigned crc32 of an id written as text; a missing id counts as empty text."""
    id_text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.crc32(F.coalesce(id_text, F.lit("")).cast("binary"))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def regroup(batches: Iterable[pa.RecordBatch], name: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of about ``most`` bytes of column ``name`` and at most
    ``BATCH_ROWS`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in _bounded(batches):
        if sum(h.num_rows for h in held) + batch.num_rows > BATCH_ROWS:
            yield _joined(held)
            held, size = [], 0
        column = batch.column(batch.schema.get_field_index(name))
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())).to_pylist()
        start, before = 0, 0
        for row, end in enumerate(ends):
            if size + end - before >= most:
                held.append(batch.slice(start, row + 1 - start))
                yield _joined(held)
                held, size, start, before = [], 0, row + 1, end
        if start < batch.num_rows:
            held.append(batch.slice(start))
            size += ends[-1] - before
    if held:
        yield _joined(held)


def _bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _appended(batches, text: str, most: int, step, names: list[str]):
    run = step()
    for batch in regroup(batches, text, most):
        made = run(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])


def append(
    df: DataFrame, text: str, added: list[tuple[str, str]], step: Callable[[], Callable], most: int = BATCH_BYTES
) -> DataFrame:
    """``df`` with more columns.  ``step()`` is called once per task and returns a function from a
    record batch to the arrays of ``added`` (name and Spark type).  Rows neither move nor change."""
    kinds = [StructField(n, _kind(t)) for n, t in added]
    schema = StructType([*[StructField(f.name, f.dataType) for f in df.schema], *kinds])
    names = [n for n, _ in added]
    return map_arrow(df, partial(_appended, text=text, most=most, step=step, names=names), schema)


def _kind(text: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(f"struct<c:{text}>")["c"].dataType


def partition_bases(stored: DataFrame, part: str, amount: str, base: str) -> DataFrame:
    """One row per written partition with the sum of ``amount`` over the partitions before it.

    The rows are as many as the partitions of the writing job, so they fit the driver."""
    totals = stored.groupBy(part).agg(F.sum(amount).alias("__total")).collect()
    before, rows = 0, []
    for r in sorted(totals, key=lambda r: r[part]):
        rows.append((r[part], before))
        before += r["__total"] or 0
    return stored.sparkSession.createDataFrame(rows, f"{part} int, {base} long")
