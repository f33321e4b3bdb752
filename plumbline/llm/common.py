"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import checkpoint

# Words are runs of anything but these bytes: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORDS_SQL = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """URI of a new folder that driver and executors share, below the checkpoint folder of the session."""
    checkpoint.prepare(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{re.sub('^file:/+', 'file:///', base if ':' in base else f'file://{base}')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: computed once, kept when executors are lost."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; bytes.split() cuts at exactly the six bytes of SPACES."""
    return text.encode().split() if text else []


def lower_ascii(c):
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c):
    """Number of words, null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORDS_SQL)), F.lit(0)).cast("bigint")


def open_folder(uri: str):
    """File system and path behind a URI, in any task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def pieces_of(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches cut to at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_caches: list[dict] = []


def worker_cache(cache: dict) -> dict:
    """A dictionary that lives as long as its worker; tasks of other operators may empty it."""
    _caches.append(cache)
    return cache


def release_memory(kept: dict | None = None) -> None:
    """Empties the caches of a reused worker, all but ``kept``, and gives what earlier tasks have freed back to the system, where the C library can."""
    import pyarrow as pa

    for cache in _caches:
        if cache is not kept:
            cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
