"""Column expressions for cleaning and display (X1–X11).  All built-in functions, no UDFs."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference (display labels and limits) ─────────────────────────────────────────────
CATEGORY_LABELS = {
    "Toys_and_Games": "🧸 Toys",
    "Sports_and_Outdoors": "🏃 Sports",
    "Video_Games": "🎮 Video Games",
}
SHORT_TITLE_CHARS = 35
TABLE_TITLE_CHARS = 40
MAX_EDGE_WIDTH = 10
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CATEGORY_NODE_PREFIX = "cat_"
# Tooltip layout: title, category, stars (2 places), score (4 places), review count.
TOOLTIP_FORMAT = "📦 %s\n🏷️ %s\n⭐ %s | 📊 Score: %s\n💬 %s reseñas"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(c, null_text: str | None = None) -> Column:
    """X1 (+X2): CRLF, LF, CR and TAB become one space each (CRLF first) and double quotes are deleted.

    ``null_text='nan'`` reproduces the reference's ``astype(str)`` on missing values; default keeps null.
    """
    col = _c(c).cast("string")
    if null_text is not None:
        col = F.coalesce(col, F.lit(null_text))
    return F.translate(F.replace(col, F.lit("\r\n"), F.lit(" ")), '\n\r\t"', "   ")


def double_quotes(c) -> Column:
    """Every ``"`` becomes ``""``."""
    return F.replace(_c(c), F.lit('"'), F.lit('""'))


def stars_to_int(c) -> Column:
    """Numeric coercion with invalid → 0, then truncation toward zero (``4.7→4``, ``-1.9→-1``), as bigint.

    ``try_cast`` keeps ANSI mode from failing on junk; NaN and values beyond bigint become 0.  Spark's cast
    takes Java's type suffixes (``3d``, ``5f``); a text that ends in a letter is not a number here.
    """
    text = _c(c).cast("string")
    as_double = F.when(~text.rlike(r"\p{L}\s*$"), text).try_cast("double")
    cleaned = F.coalesce(F.nanvl(as_double, F.lit(0.0)), F.lit(0.0))
    return F.coalesce(cleaned.try_cast("bigint"), F.lit(0).cast("bigint"))


def short_title(title, fallback) -> Column:
    """The first 35 characters plus ``...`` only when longer; null or empty → the fallback (the id)."""
    t = _c(title)
    fb = _c(fallback).cast("string")
    return (
        F.when(t.isNull() | (t == ""), fb)
        .when(F.length(t) > SHORT_TITLE_CHARS, F.concat(F.substring(t, 1, SHORT_TITLE_CHARS), F.lit("...")))
        .otherwise(t)
    )


def table_title(title) -> Column:
    """The first 40 characters plus ``...`` always."""
    return F.concat(F.substring(_c(title), 1, TABLE_TITLE_CHARS), F.lit("..."))


def num_text(x, places: int) -> Column:
    """A rounded number as text (``round`` then the engine's shortest form: 4.87, 5.0)."""
    return F.round(_c(x).cast("double"), places).cast("string")


def tooltip(title, fallback, category, stars, score, reviews) -> Column:
    """Node tooltip; null numbers display as 0."""
    t = _c(title)
    name = F.when(t.isNull() | (t == ""), _c(fallback).cast("string")).otherwise(t)
    return F.format_string(
        TOOLTIP_FORMAT,
        name,
        F.coalesce(_c(category), F.lit("None")),
        num_text(F.coalesce(_c(stars), F.lit(0.0)), 2),
        num_text(F.coalesce(_c(score), F.lit(0.0)), 4),
        F.coalesce(_c(reviews), F.lit(0)).cast("string"),
    )


def label_lookup(c, labels: Mapping[str, str] = CATEGORY_LABELS) -> Column:
    """Display label from a fixed map; values not in the map display as themselves."""
    if not labels:
        return _c(c)
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(c)), _c(c))


def category_node_id(c) -> Column:
    """``cat_`` + category name."""
    return F.concat(F.lit(CATEGORY_NODE_PREFIX), _c(c))


def edge_width(weight) -> Column:
    """``min(int(weight or 1), 10)`` – 0 and null count as 1."""
    w = _c(weight)
    return F.least(
        F.when(F.coalesce(w, F.lit(0)) == 0, F.lit(1)).otherwise(w).cast("bigint"), F.lit(MAX_EDGE_WIDTH).cast("bigint")
    )


def review_year(ts, epoch_millis: bool = False) -> Column:
    """X11: year of the review time (epoch milliseconds are converted first)."""
    t = F.timestamp_millis(_c(ts)) if epoch_millis else _c(ts)
    return F.year(t)


def strip(c) -> Column:
    """Text without white space (Unicode's, line separators included) at both ends."""
    return F.trim(_c(c), F.lit(WHITE_SPACE))


def blank_to_null(c) -> Column:
    """Text without white space at both ends, with a blank value treated as absent."""
    return F.nullif(strip(_c(c)), F.lit(""))
