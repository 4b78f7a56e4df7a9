"""Small helpers shared by the training-data operators."""
from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stargraph.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"  # the class [\x20\x09-\x0D]


def by_value(module: str) -> None:
    """Ship the functions of a module with the tasks that use them, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.  ``lower`` has a fast path for pure ASCII, where both agree."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus`` (null for a null id: such a row is neither
    held out nor learned from, and its ``held_out`` is null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores after it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


__all__ = [
    "UPPER", "LOWER", "BLANKS", "by_value", "text_or_empty", "ascii_lower", "remainder", "unused", "documents", "table",
    "materialize",
]
