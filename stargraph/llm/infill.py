"""Fill-in-the-middle transformation by repeated-capture matching.

A text is matched once as ``(unit)*`` by the ``regex`` library, which keeps every repetition of a group:
``match.ends(1)`` holds the end of each unit, so its length is the number of units and the two cuts are read from it,
without a loop over the text.  A unit is a code point by default; any pattern whose repetition covers every text may
be given (words with the blanks after them, lines).

The draws come from the SHA-256 of ``salt:doc_id``: two cuts, whether the text is transformed, and in which order
(prefix, suffix, middle or suffix, prefix, middle).  A text that is empty or holds a marker stays plain, because the
output could not be taken apart again; ``restore`` rebuilds the text from output and form alone.

Cases: a null text is an empty one, plain; a null doc_id draws from ``salt:``; equal rows give equal outputs; texts of
any length are matched whole, and batches are cut by characters so that the captures of a batch stay few; of other
columns none is used; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stargraph.llm.common import by_value, text_or_empty

by_value(__name__)

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
PLAIN_OF_100 = 10  # texts left plain
SPM_OF_100 = 20    # transformed texts in suffix, prefix, middle order
SALT = "1"
EMIT = 4 << 20     # characters of output in a batch


class Infill(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def draws(doc_id, salt: str) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, doc_id, units: regex.Pattern, salt: str = SALT) -> Infill:
    """``units`` is the compiled ``(unit)*``."""
    ends = units.fullmatch(text).ends(1)
    n = len(ends)
    first, second, kind, order = draws(doc_id, salt)
    if not text or kind % 100 >= 100 - PLAIN_OF_100 or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Infill(n, "plain", None, None, text)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < SPM_OF_100:
        return Infill(n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Infill(n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restore(output: str, form: str) -> str:
    """The text of an output.  A marker cannot appear across the end of a part: it would have to start inside one."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, salt: str = SALT) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, restored`` of every text."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
        T.StructField("restored", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*")
        for batch in batches:
            rows: list[tuple] = []
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            size = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                made = transform(text.as_py(), doc_id.as_py(), units, salt)
                rows.append((doc_id.as_py(), *made, restore(made.output, made.form)))
                size += len(made.output)
                if size >= EMIT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.fieldNames())
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.fieldNames())

    return docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests in place of the texts."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
