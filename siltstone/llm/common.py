"""Shared helpers: scratch tables, word splitting, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scratch import clean_scratch, stored  # noqa: F401
from siltstone.functions.shipping import ship

#: Bytes that `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` takes after lower-casing A-Z; all others become spaces.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alnum_words(raw: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and any non-ASCII characters."""
    return raw.translate(ALNUM_TABLE).split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about max_bytes of the column (a longer row stands alone)."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column))
        if batch.num_rows and (pc.sum(lengths).as_py() or 0) <= max_bytes:
            yield batch
            continue
        sizes = [x or 0 for x in lengths.to_pylist()]
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each length in turn."""
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(len(out), dtype=np.int64)
    return out


def release() -> None:
    """Give memory that a task no longer uses back to the system; workers live on between tasks beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map, whose worker releases memory when the task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def per_row(df: DataFrame, keep: list[str], text: str, out: str, row: Callable[[bytes], tuple]) -> DataFrame:
    """Map each row's text (null: empty) to the columns of `out`, in Arrow batches; `keep` columns stay in front."""
    ship(df.sparkSession)
    spark_schema = df.select(*keep).schema
    names = [x.split()[0] for x in out.split(",")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in spark_schema] + [out])
    types = _arrow_types(df.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [row(x or b"") for x in utf8(batch, text)]
            cols = list(zip(*got, strict=True)) if got else [[] for _ in names]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + arrays, names=[*keep, *names])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)


def _arrow_types(spark: SparkSession, ddl: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return [to_arrow_type(f.dataType) for f in _parse_datatype_string(ddl).fields]


def doc_crc(doc_id: str = "doc_id"):
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
