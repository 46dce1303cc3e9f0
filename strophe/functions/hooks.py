"""Injected Python mappers: the one place where rows may leave the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strophe.operators.linking import map_distinct

Mapper = Callable[[list[str]], tuple[list[list[str]], list[list[str]]]]


#: Code points of texts that a mapper gets in one call, unless a single text is longer.
CALL = 1 << 18


def slices(texts: pa.Array, size: int = CALL) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of texts of at most ``size`` code points, or of a single text."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if i > start and held + n > size:
            yield start, i - start
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts) - start


def map_texts(df: DataFrame, text: str, mapper: Mapper) -> DataFrame:
    """Add ``symbols`` and ``unknown`` from ``mapper(texts) -> (symbols, unknown)``.

    Only distinct texts go to Python, in Arrow batches; results join back to all rows. A call sees a bounded
    number of characters, so a worker's memory does not follow the length of a batch.
    """
    found = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(0)):
                part = batch.slice(start, n)
                symbols, unknown = mapper([t if t is not None else "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(symbols, found), pa.array(unknown, found)], ["text", "symbols", "unknown"])

    def apply(distinct: DataFrame) -> DataFrame:
        return distinct.select(text).mapInArrow(run, "text string, symbols array<string>, unknown array<string>").withColumnRenamed("text", text)

    return map_distinct(df, text, apply)
