"""From a raw review export to the canonical reviews: the cleaning steps and the load, each in one call.

``clean_reviews``     raw CSV → strict arity (S2) → wanted columns that exist (P1) → text cleaning (X1) → TSV (S6), and
                      the run's report (S8).
``reviews_from_tsv``  that TSV (S4) → canonical reviews (review_id, reviewer_id, product_id, title, category, stars,
                      ts), ready for ``keep_first`` / ``build_graph``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clean_text, stars_to_int
from . import files

# The column names of the raw export, and the canonical name of each.
RAW_COLUMNS = (
    "review_id", "stars", "review_title", "product_id", "product_category", "review_body", "reviewer_id", "language",
)
EXTRA_COLUMNS = ("product_title", "review_date")


def clean_reviews(
    spark: SparkSession, raw_path: str | list[str], tsv_path: str, report_path: str | None = None,
    wanted: Sequence[str] = (*RAW_COLUMNS, *EXTRA_COLUMNS), split: bool = False,
) -> str:
    """Clean a raw CSV export into a TSV; returns the TSV's path.  Columns are found by the file's header, in any
    order; records of another arity are dropped and counted in the report, which is observed while the TSV is written."""
    present = files.header_columns(spark, raw_path)
    columns = [c for c in wanted if c in present]
    kept, counts = files.read_csv_strict_counted(spark, raw_path, columns, split=split)
    cleaned = kept.select(*[clean_text(F.col(c)).alias(c) for c in columns])
    files.write_tsv_noquote(cleaned, tsv_path)
    if report_path:
        files.write_report(files.observed_report(spark, counts), report_path)
    return tsv_path


def reviews_from_tsv(spark: SparkSession, tsv_path: str | list[str], id_type: str = "string") -> DataFrame:
    """The cleaned TSV as canonical reviews.  Rows without a review, reviewer or product id are no reviews.

    Ids are text unless ``id_type`` says otherwise; columns that the export lacks are null.
    """
    present = spark.read.options(header=True, sep="\t", quote="", escape="\u0000").csv(tsv_path).columns
    rows = files.read_tsv(spark, tsv_path, present)

    def column(name: str) -> Column:
        return blank_to_null(F.col(name)) if name in present else F.lit(None).cast("string")

    out = rows.select(
        column("review_id").try_cast(id_type).alias("review_id"),
        column("reviewer_id").try_cast(id_type).alias("reviewer_id"),
        column("product_id").try_cast(id_type).alias("product_id"),
        (column("product_title") if "product_title" in present else column("review_title")).alias("title"),
        column("product_category").alias("category"),
        stars_to_int(column("stars")).cast("int").alias("stars"),
        column("review_date").try_cast("timestamp_ntz").alias("ts"),
    )
    return out.filter(F.col("review_id").isNotNull() & F.col("reviewer_id").isNotNull() & F.col("product_id").isNotNull())
