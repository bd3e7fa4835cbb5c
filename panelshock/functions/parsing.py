"""Text to typed values: the tolerant and the strict forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\x0b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_key(c: Column | str) -> Column:
    """Key as trimmed text; blank becomes NULL."""
    return F.nullif(F.btrim(_col(c).cast("string"), F.lit(BLANKS)), F.lit(""))


def clean_text(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def tolerant_decimal(c: Column | str, precision: int = 38, scale: int = 10) -> Column:
    """Exact number, or NULL for blank, non-numeric, NaN and infinite text, and for a number
    that the type cannot hold as it is (``does_not_fit``)."""
    value = clean_text(c).try_cast(f"decimal({precision},{scale})")
    return F.when(~does_not_fit(c, precision, scale), value)


def does_not_fit(c: Column | str, precision: int = 38, scale: int = 10) -> Column:
    """Whether the text is a number with more digits than the type, before or after the point."""
    value = clean_text(c).try_cast(f"decimal({precision},{scale})")
    number = tolerant_double(c)
    return F.coalesce(number.isNotNull() & ~value.cast("double").eqNullSafe(number), F.lit(False))


def tolerant_double(c: Column | str) -> Column:
    """Number, or NULL when the text is not a finite one."""
    value = clean_text(_col(c).cast("string")).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def strict_double(c: Column | str) -> Column:
    """Number; text that is not one fails the job (ANSI cast)."""
    return _col(c).cast("double")


def tolerant_date(c: Column | str, fmt: str = "yyyyMMdd") -> Column:
    return F.try_to_date(_col(c).cast("string"), fmt)


def strict_date(c: Column | str, fmt: str = "yyyyMMdd") -> Column:
    """Date; any other text fails the job (ANSI parse)."""
    return F.to_date(_col(c).cast("string"), fmt)


def lookup(c: Column | str, mapping: dict) -> Column:
    """Value of a small fixed mapping, NULL when the key is not in it."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def plain_decimal_text(c: Column | str) -> Column:
    """Fixed notation without trailing zeros, ``0`` for zero."""
    text = _col(c).cast("string")
    cut = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(cut.isin("", "-0", "-"), F.lit("0")).otherwise(cut)
