"""Columns computed from whole texts, a batch at a time, beside whatever columns a table already has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.llm.common import as_bytes, chunks, small_batches, tidy


def with_computed(df: DataFrame, schema: str, compute: Callable[[list[bytes], dict], dict[str, list]], chunk: int, text: str = "text", state: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns of ``schema`` (columns of these names in ``df`` go), computed by ``compute(texts, state columns)``.

    Null texts come as empty ones. ``compute`` sees runs of whole texts of about ``chunk`` bytes.
    """
    small_batches(df.sparkSession)
    added = StructType.fromDDL(schema)
    kept = df.drop(*(x for x in added.names if x not in state))
    out = StructType([f for f in kept.schema if f.name not in added.names] + added.fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
            for begin, end in chunks(texts, chunk):
                part = batch.slice(begin, end - begin)
                new = compute(texts[begin:end], {k: part.column(part.schema.get_field_index(k)) for k in state})
                columns = []
                for field in arrow:
                    if field.name in new:
                        values = new[field.name]
                        columns.append(values if isinstance(values, pa.Array) else pa.array(values, type=field.type))
                    else:
                        columns.append(part.column(part.schema.get_field_index(field.name)).cast(field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return kept.mapInArrow(tidy(run), out)


def kept_rows(df: DataFrame, keep: Callable[[list[bytes]], list[bool]], chunk: int, text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, for whose texts ``keep`` says so; null texts come as empty ones."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
            for begin, end in chunks(texts, chunk):
                yield batch.slice(begin, end - begin).filter(pa.array(keep(texts[begin:end]), type=pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)
