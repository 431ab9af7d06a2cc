"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def arrow_map(df: DataFrame, per_batch: Callable[[pa.RecordBatch], "pa.RecordBatch | Iterator[pa.RecordBatch]"], schema: str | T.StructType) -> DataFrame:
    """Apply a function to each Arrow batch; empty batches are skipped."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = per_batch(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, text_col: str, fields: list[T.StructField], compute: Callable[[list], list[pa.Array]]) -> DataFrame:
    """``df`` with columns computed from the texts of one; columns of the same names, in any case, are replaced."""
    taken = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in taken]
    rows = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias("\x01text"))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *compute(batch.columns[-1].to_pylist())], names=[*kept, *(f.name for f in fields)])

    return arrow_map(rows, per_batch, T.StructType([*rows.schema.fields[:-1], *fields]))


def code_points(text: str) -> np.ndarray:
    """A text as an array of Unicode code points (lone surrogates are kept)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def slices(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``most`` characters, so that vectorised work stays in the cache."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
