"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, ASCII capitals and small letters.
WHITE_SPACE = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = "abcdefghijklmnopqrstuvwxyz"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_memo(name: str, make):
    """An object that a Python worker keeps from task to task; made by ``make`` on first use."""
    kept = sys.modules.setdefault("_worker_memo", types.ModuleType("_worker_memo")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def let_go() -> None:
    """Drop what operators keep in this Python worker, and give the memory it has freed back to the system."""
    sys.modules.pop("_worker_memo", None)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` over the batches of a task, before and after which the worker lets go of memory it does not use.

    Workers live on from stage to stage, several beside one executor, and what each still holds adds up.
    """

    @functools.wraps(run)
    def over(batches):
        let_go()
        try:
            yield from run(batches)
        finally:
            let_go()

    return over


def lean_group(run):
    """``run`` over one group, after which the worker lets go of memory it does not use."""

    @functools.wraps(run)
    def over(rows):
        try:
            return run(rows)
        finally:
            let_go()

    return over


def hash128(*cols: "Column | str") -> list[Column]:
    """Two independent 64-bit hashes of the same columns."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)]


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
