"""File sources and sinks for review exports (S1–S8) and the projection of wanted columns.

Three meanings of a "bad" CSV line exist in the reference, and each reader keeps its own:

* ``read_csv_tolerant`` (S1): short rows are kept (missing fields null), long rows are dropped;
* ``read_csv_strict_arity`` (S2): only rows with exactly the header's field count, all fields text;
* blank lines vanish in both.

Spark's CSV reader flags short *and* long rows as corrupt in PERMISSIVE mode, so S1 counts the fields of a
flagged record itself (commas outside quoted sections + 1).  Quoted fields may hold line breaks, which Spark reads
with ``multiLine``, one task per file.  With ``split=True`` the readers cut a file into blocks instead
(``csv_blocks``) and give the same rows, stray and unclosed quotes included; lines end in LF or CRLF there, and a record
of more than ``csv_blocks.RECORD_BYTES`` bytes is a bad record.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import csv_blocks

CORRUPT = "_corrupt_record"
OVERLONG = "\u0000overlong"  # no CSV record holds it as its whole text

#: The well-formed byte sequences of UTF-8 (Unicode standard, table 3-7), as ISO-8859-1 characters.
_UTF8 = (
    r"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|"
    r"\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)


def select_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def _schema(columns: T.StructType | Sequence[str]) -> T.StructType:
    if isinstance(columns, T.StructType):
        return columns
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def header_columns(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The column names in the first line of the export (read without a pass over the data)."""
    return spark.read.options(header=True, escape='"', inferSchema=False).csv(path).columns


def _file_schema(spark: SparkSession, path, wanted: T.StructType, header: bool) -> T.StructType:
    """The wanted fields in the file's own order, other columns as text; without a header as given."""
    if not header:
        return wanted
    types = {f.name: f.dataType for f in wanted.fields}
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header_columns(spark, path)])


def _named(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """The wanted columns by name; one that the file lacks is null."""
    return df.select(*[
        F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields
    ])


def field_count(record: Column) -> Column:
    """Fields of a raw CSV record: commas outside quoted sections, plus one.

    The quoted-section pattern is written as an unrolled loop with possessive quantifiers: an alternation
    inside a repetition makes Java's regex engine recurse once per character and overflow on long texts.
    """
    unquoted = F.regexp_replace(record, '"[^"]*+(?:""[^"]*+)*+"', "")
    return F.length(F.regexp_replace(unquoted, "[^,]", "")) + F.lit(1)


def csv_records(spark: SparkSession, path: str | list[str], header: bool = True, latin: bool = False) -> DataFrame:
    """``record, size``: the records of CSV files as text (``csv_blocks``), without each file's header.

    With ``latin`` the bytes that are no UTF-8 are dropped from the lines first.
    """
    prepare = drop_undecodable if latin else lambda line: line
    found = csv_blocks.records(spark, path, prepare)
    return (found.filter(~F.col("first")) if header else found).select("record", "size")


def _well_formed(latin: Column) -> Column:
    """UTF-8 text from its bytes as ISO-8859-1 characters, without the bytes that belong to no well-formed sequence.

    ASCII text is what it was: it is recognised by its size, far cheaper than the pattern."""
    return F.when(F.octet_length(latin) == F.char_length(latin), latin).otherwise(_by_pattern(latin))


def _by_pattern(latin: Column) -> Column:
    return F.decode(F.encode(F.regexp_replace(latin, f"((?:{_UTF8})++)|[\\x80-\\xff]", "$1"), "ISO-8859-1"), "UTF-8")


def drop_undecodable(text: Column) -> Column:
    """A line as read, without bytes that are no UTF-8.  A replacement character that the file holds stays."""
    return F.when(F.is_valid_utf8(text), text).otherwise(_well_formed(F.decode(text.cast("binary"), "ISO-8859-1")))


def _flagged(spark: SparkSession, path, schema: T.StructType, header: bool, split: bool, latin: bool = False) -> DataFrame:
    """All records under ``schema``, those that do not fit it marked in ``_corrupt_record``; of a record too long to be
    read (split only) the mark is ``OVERLONG`` and nothing else is known.

    ``latin``: the file's bytes that are no UTF-8 are dropped (the fields are all text then)."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = dict(escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    if not split:
        if latin:
            options["encoding"] = "ISO-8859-1"
        df = spark.read.options(header=header, multiLine=True, **options).schema(with_corrupt).csv(path)
        return df.select(*[_well_formed(F.col(f"`{f.name}`")).alias(f.name) for f in schema.fields], CORRUPT) if latin else df
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_corrupt.fields)
    parsed = csv_records(spark, path, header, latin).select(F.from_csv("record", ddl, options).alias("r"), "record")
    mark = F.when(F.col("record").isNull(), F.lit(OVERLONG)).otherwise(F.col(f"r.{CORRUPT}")).alias(CORRUPT)
    return parsed.select(*[F.col(f"r.`{f.name}`") for f in schema.fields], mark)


def read_csv_tolerant(
    spark: SparkSession, path: str | list[str], columns: T.StructType | Sequence[str], header: bool = True,
    na_values: Sequence[str] = ("",), split: bool = False,
) -> DataFrame:
    """Tolerant CSV read – keep short rows (padded with null), skip rows with too many fields.

    ``na_values`` lists texts read as missing (the empty field always is).  With a header the columns are matched
    by name.
    """
    wanted = _schema(columns)
    schema = _file_schema(spark, path, wanted, header)
    n = len(schema.fields)
    df = _flagged(spark, path, schema, header, split)
    fits = F.col(CORRUPT).isNull() | ((F.col(CORRUPT) != OVERLONG) & (field_count(F.col(CORRUPT)) <= F.lit(n)))
    kept = df.filter(fits & _with_first(df)).drop(CORRUPT)
    kept = _named(kept, wanted)
    extra = [v for v in na_values if v != ""]
    if extra:
        kept = kept.select(*[
            F.when(F.col(f.name).cast("string").isin(extra), F.lit(None).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in wanted.fields
        ])
    return kept


def read_csv_all_records(spark: SparkSession, path, columns, header: bool = True, split: bool = False) -> DataFrame:
    """Every record of a CSV file, malformed ones included and marked (the input of a cleaning report)."""
    return _flagged(spark, path, _file_schema(spark, path, _schema(columns), header), header, split)


def read_csv_strict_arity(
    spark: SparkSession, path: str | list[str], columns: Sequence[str], header: bool = True, split: bool = False
) -> DataFrame:
    """Only records whose field count equals the header's; every field as text, columns matched by name;
    bytes that are no UTF-8 are dropped from the values."""
    return read_csv_strict_counted(spark, path, columns, header, split)[0]


def read_csv_strict_counted(
    spark: SparkSession, path: str | list[str], columns: Sequence[str], header: bool = True, split: bool = False
) -> tuple[DataFrame, Observation]:
    """S2 and the counts of S8 (``input``, ``kept``) in one scan: they are observed while the first action on the
    frame runs, and known after it (``observed_report``)."""
    wanted = _schema(list(columns))
    df = _flagged(spark, path, _file_schema(spark, path, wanted, header), header, split, latin=True)
    fits = F.col(CORRUPT).isNull() & _with_first(df)
    counts = Observation()
    df = df.observe(counts, F.count(F.lit(1)).alias("input"), F.count(F.when(fits, F.lit(1))).alias("kept"))
    return _named(df.filter(fits).drop(CORRUPT), wanted), counts


def observed_report(spark: SparkSession, counts: Observation) -> DataFrame:
    """``input, kept, dropped`` of a finished run."""
    found = counts.get
    n, kept = found["input"], found["kept"]
    return spark.createDataFrame([(n, kept, n - kept)], "input long, kept long, dropped long")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """S3: JSON-lines records with an explicit schema (no inference pass), keeping only ``columns``.

    Lines that are not JSON are dropped (``count_jsonl`` counts them).
    """
    df = _all_json(spark, path, schema)
    df = df.filter(F.col(CORRUPT).isNull() & _with_first(df)).drop(CORRUPT)
    return df.select(*columns) if columns else df


def _all_json(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).schema(with_corrupt).json(path)


def count_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """``input, kept, dropped`` of ``read_jsonl``."""
    return _report(_all_json(spark, path, schema), F.col(CORRUPT).isNull())


def _decoded(c: Column) -> Column:
    """``%xx`` escapes undone; a text without any is left alone, as decoding is far dearer than looking for one."""
    return F.when(F.contains(c, F.lit("%")), F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)


def folder_name(file_path: Column) -> Column:
    """The name of a file's folder, its escapes undone; of a ``column=value`` folder the value (null for Hive's null).

    It is worked out for every row, so it cuts at fixed marks: a regular expression would try each place of the path.
    """
    name = _decoded(F.substring_index(F.substring_index(file_path, "/", -2), "/", 1))  # of the path as a URI
    at = F.locate("=", name)
    plain = F.when(at > 1, _decoded(F.substring(name, at + 1, F.length(name)))).otherwise(name)
    return F.when(plain != "__HIVE_DEFAULT_PARTITION__", plain)


def read_datasets(
    spark: SparkSession, root: str, schema: T.StructType, category_col: str = "category", fmt: str = "parquet", **options,
) -> DataFrame:
    """The datasets in the folders below ``root`` as one table, in one scan however many there are.

    The category of a row is the name of its file's folder.  ``schema`` has the columns of all datasets (without the
    category); a column that a dataset lacks is null, one that ``schema`` lacks is not read.
    """
    reader = spark.read.schema(schema).options(recursiveFileLookup=True, **options).format(fmt)
    return reader.load(root).withColumn(category_col, folder_name(F.col("_metadata.file_path")))


def read_tsv(spark: SparkSession, path: str | list[str], columns: Sequence[str], header: bool = True) -> DataFrame:
    """The unquoted, backslash-escaped TSV written by ``write_tsv_noquote`` (values cleaned by X1, so
    without tabs or line breaks).  Fields are read raw and unescaped afterwards (``\\x`` → ``x``)."""
    df = (
        spark.read.options(header=header, sep="\t", quote="", escape="\u0000", multiLine=False)
        .schema(_schema(list(columns))).csv(path)
    )
    unescaped = lambda c: F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"\\(.)", "$1")).otherwise(c)
    return df.select(*[unescaped(F.col(c)).alias(c) for c in columns])


def write_csv_quote_all(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and every field quoted (quotes inside doubled; null and '' both as ``""``)."""
    df.write.mode(mode).options(quoteAll=True, escape='"', header=True, emptyValue="", nullValue="").csv(path)


def tsv_escape(c: Column) -> Column:
    """Backslash before backslash, tab, CR, LF and double quote (unquoted TSV with ``\\`` as escape)."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    for mark in '\\\t\r\n"':  # the backslash first
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def write_lines_with_header(lines: DataFrame, header: str, path: str, mode: str = "errorifexists") -> None:
    """Text files whose first line is ``header``: one file per task (``maxRecordsPerFile`` is switched off for this
    write, whatever the session says), the header in front of the task's first line.  An empty frame writes one
    file with the header alone."""
    line = F.coalesce(F.col(lines.columns[0]), F.lit(""))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the row number inside the task
    headed = lines.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value"))
    headed.write.mode(mode).option("maxRecordsPerFile", 0).text(path)
    spark = lines.sparkSession
    if spark.read.text(path).isEmpty():
        spark.range(1).coalesce(1).select(F.lit(header).alias("value")).write.mode("append").text(path)


def write_tsv_noquote(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """TSV with a header, no quoting and ``\\`` escapes (Spark's CSV writer cannot escape without
    quoting, so lines are built with ``concat_ws`` and written as text)."""
    line = F.concat_ws("\t", *[tsv_escape(F.col(c)) for c in df.columns])
    write_lines_with_header(df.select(line), "\t".join(df.columns), path, mode)


def _with_first(df: DataFrame) -> Column:
    """Always true, but it reads the first column: Spark refuses to read the corrupt-record column alone, which is
    what is left when a caller only counts rows."""
    first = F.col(f"`{df.columns[0]}`")
    return first.isNull() | (F.length(F.to_json(F.struct(first))) >= 0)


def _report(records: DataFrame, keep: Column) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("input"), F.count(F.when(keep & _with_first(records), F.lit(1))).alias("kept")
    ).withColumn("dropped", F.col("input") - F.col("kept"))


def cleaning_report(all_records: DataFrame) -> DataFrame:
    """``input, kept, dropped`` of a strict cleaning run without the run, in one pass over ``read_csv_all_records``."""
    return _report(all_records, F.col(CORRUPT).isNull())


def write_report(report: DataFrame, path: str, mode: str = "append") -> None:
    """S8's sink: the report's rows as JSON lines (one file a run, so that runs add up)."""
    report.coalesce(1).write.mode(mode).json(path)
