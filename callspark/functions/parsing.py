"""Parsing of timestamps, durations and phone numbers from text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import FLEXIBLE_FORMATS, IMPORT_FORMATS, OTHER_PHONE_FORM, US_PHONE_FORM


def try_format(text: Column, fmt: str) -> Column:
    """Timestamp of a text in a format, else null.

    A failed parse costs an exception inside Spark, so the digits are tested first.
    """
    digits_of = {"yyyy": r"\d{4}", "SSSSSS": r"\d{6}"}
    shape = ""
    for match in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", fmt):
        token = match.group(0)
        if token.startswith("'"):
            shape += re.escape(token.strip("'"))
        elif match.group(1):
            shape += digits_of.get(token, r"\d{1,2}" if len(token) == 1 else rf"\d{{{len(token)}}}")
        else:
            shape += re.escape(token)
    return F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(fmt)))


def import_timestamp(text: Column, formats: list[str] = IMPORT_FORMATS) -> Column:
    """First import format that fits the row, else Spark's own timestamp syntax."""
    tries = [try_format(text, f) for f in formats]
    return F.coalesce(*tries, F.try_to_timestamp(text))


def flexible_timestamp(text: Column, fmt: str | None = None, zone: str | None = None) -> Column:
    """First flexible format that fits; ``zone`` says where the clock reading was taken."""
    formats = [fmt] if fmt else FLEXIBLE_FORMATS
    value = F.coalesce(*[try_format(text, f) for f in formats])
    return F.to_utc_timestamp(value, zone) if zone else value


def duration_seconds(value: Column) -> Column:
    """Seconds from ``MM:SS``, ``HH:MM:SS`` or a number; null counts as 0."""
    text = value.cast("string")
    part = F.split(text, ":")

    def number(i: int) -> Column:
        return F.trim(F.get(part, F.lit(i))).try_cast("bigint")

    clock = (
        F.when(F.size(part) == 2, number(0) * 60 + number(1))
        .when(F.size(part) == 3, number(0) * 3600 + number(1) * 60 + number(2))
        .cast("double")
    )
    return F.when(text.isNull(), F.lit(0.0)).when(F.contains(text, F.lit(":")), clock).otherwise(
        text.try_cast("double")
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "\\D", "")


def phone_e164(text: Column) -> Column:
    """Ten digits get +1, any other number a plain +."""
    d = digits(text)
    return F.when(F.length(d) == 10, F.concat(F.lit("+1"), d)).otherwise(F.concat(F.lit("+"), d))


def phone_display(text: Column) -> Column:
    """``+1 (AAA) BBB-CCCC`` for a ten-digit or 1 + ten-digit number, else unchanged."""
    d = digits(text)
    ten = F.when(F.length(d) == 10, d).when(
        (F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)
    )
    shown = F.format_string(
        "+1 (%s) %s-%s", F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4)
    )
    return F.when(ten.isNotNull(), shown).otherwise(text)


def phone_ok(text: Column, region: str = "US") -> Column:
    """Form check after removing separators; null is not a phone."""
    bare = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\s\\-\\.\\(\\)]", "")
    return bare.rlike(US_PHONE_FORM if region == "US" else OTHER_PHONE_FORM)
