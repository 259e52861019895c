"""Dates as Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order they are tried: (shape, pattern). Shapes keep Spark's parser from reading past what strptime would.
_STRICT = [
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{2}$", "M-d-yy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^[A-Za-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
]
_COMMON = [_STRICT[4], _STRICT[0], _STRICT[1], _STRICT[7], _STRICT[8]]
_FREE = [(r"^\d{4}$", "yyyy"), _STRICT[9], (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2} [A-Za-z]{3,} \d{4}$", "d MMMM yyyy"), (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?$", None)]


def _tried(text: Column, formats: list) -> Column:
    """First format that fits; two-digit years are 20yy here."""
    titled = F.initcap(text)
    return F.coalesce(*(F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(titled, F.lit(fmt))) if fmt else F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))) for shape, fmt in formats))


def standardize_birthdate(c: Column) -> Column:
    """ISO date. Digits alone are a spreadsheet serial (days since 1899-12-30); two-digit years from 69 are 19yy."""
    text = F.trim(c)
    digits = F.when(text.rlike(r"^\d{1,7}$"), F.try_to_number(text, F.lit("9999999")).cast("int"))
    serial = F.when(digits <= 2_958_465, F.date_add(F.lit("1899-12-30").cast("date"), digits))
    parsed = _tried(text, _STRICT)
    two = text.rlike(r"^\d{1,2}[/-]\d{1,2}[/-](69|[7-9]\d)$")
    parsed = F.when(two, F.add_months(parsed, -1200)).otherwise(parsed)
    return F.date_format(F.coalesce(serial, parsed), "yyyy-MM-dd")


def valid_birthdate(c: Column) -> Column:
    return F.coalesce(F.year(F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))).between(1900, 2010), F.lit(False))


def parse_date(c: Column, latest_year: int = 2025) -> Column:
    """DATE from common formats, then some free ones; years after latest_year go back a century."""
    text = F.trim(c)
    text = F.when(~text.isin("", "nan", "None"), text)
    out = F.coalesce(_tried(text, _COMMON), _tried(text, _FREE))
    return F.when(F.year(out) > latest_year, F.add_months(out, -1200)).otherwise(out)
