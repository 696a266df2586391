"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


_held: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def take_turns(owner: str, forget: Callable[[], None]) -> None:
    """What a worker remembers for one operator goes when another one's task begins: stages of a pipeline share workers."""
    for name, other in _held.items():
        if name != owner:
            other()
    if _held and owner not in _held:
        give_back()
    _held.clear()
    _held[owner] = forget


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's names; all others go, so that no name can clash."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
