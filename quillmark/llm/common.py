"""Helpers shared by the corpus operators: shared scratch tables, text bytes, hashes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scratch import discard  # noqa: F401  used by the operators

#: Paths of stashes made while a stage of a pipeline runs, by application.
_SCRATCH: dict[str, list[str]] = {}


def stash(df: DataFrame) -> DataFrame:
    """scratch.stash, noted for the stage of a pipeline that runs."""
    out = scratch.stash(df)
    if (made := _SCRATCH.get(df.sparkSession.sparkContext.applicationId)) is not None:
        made.append(out._stash_path)
    return out


#: What stages that have returned left for the lazy readers of their results.
_LEFT: dict[str, list[str]] = {}


def sweep(spark: SparkSession) -> None:
    """Delete what earlier stages left: their results have been written by now."""
    for path in _LEFT.pop(spark.sparkContext.applicationId, []):
        scratch.delete(spark, path)


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A pipeline stage that first deletes the scratch tables of the stage before, whose result has to be written."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        sweep(spark)
        _SCRATCH[app] = []
        try:
            return f(spark, docs, sf_dir)
        finally:
            _LEFT.setdefault(app, []).extend(_SCRATCH.pop(app))

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows: rows here are whole texts, of which Python should not hold a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # workers live on; the next stage's need not find this one's memory taken


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fold_of(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


#: Delimiters become spaces and A-Z lower case; digits, a-z and every byte of non-ASCII characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return text.translate(WORD_BYTES).split()


def space_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8."""
    return text.lower().split()
