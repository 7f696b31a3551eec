"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinweave.session import Scratch, configure

__all__ = ["Scratch", "configure", "fresh", "lower_ascii", "map_texts", "read", "release", "sliced"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: lower-cases A-Z only.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that clash with none of those taken (Spark compares without case)."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Give what a finished task held back to the system: Spark reuses its Python workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about `limit` bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame, text: str, fields: list[T.StructField], kernel: Callable[[], Callable[[list], list]], keep: list[str]
) -> DataFrame:
    """Append columns computed from the texts, part by part, inside one Arrow map.

    `kernel` is built once per task and maps a list of texts (None allowed) to one list per
    field. Kept columns pass through untouched; no row is moved between partitions."""
    df = df.select(*keep, *([] if text in keep else [text]))
    at = df.columns.index(text)
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + fields)
    names = [f.name for f in schema.fields]
    types = [to_arrow_type(f.dataType) for f in fields]
    kept = [df.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for part in sliced(batch, at):
                made = work(part.column(at).to_pylist())
                arrays = [part.column(i) for i in kept] + [pa.array(v, t) for v, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        del work
        release()

    return df.mapInArrow(run, schema)
