"""Column expressions for categories, mixed-type fields and time text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweft.constants import TARGET_REQUEST_TYPES

# All Unicode white space plus the four ASCII separators.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"

# Epoch milliseconds a 64-bit nanosecond clock can hold.
_MAX_EPOCH_MS = 9_223_372_036_854


def normalize_text(value: Column) -> Column:
    """Trim, upper-case and squeeze blanks; a missing value becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.upper(value), _BLANKS, " ")), F.lit(""))


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def is_target_request(*aliases: Column, types: Iterable[str] = TARGET_REQUEST_TYPES) -> Column:
    """True when the first filled alias is exactly one of the listed types."""
    return normalize_text(first_filled(*aliases)).isin(*types)


def parse_variant_time(value: Column) -> Column:
    """UTC time from a variant: numbers are epoch milliseconds, text is ISO."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    in_range = F.abs(number) <= F.lit(_MAX_EPOCH_MS)
    whole = F.when(in_range, F.timestamp_millis(F.try_variant_get(value, "$", "bigint")))
    fractional = F.when(in_range, F.timestamp_micros((number * 1000).try_cast("bigint")))
    return (
        F.when(kind == "BIGINT", whole)
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), fractional)
        .when(kind == "STRING", F.try_to_timestamp(text))
    )


def to_number(value: Column) -> Column:
    """Number from text; bad text, NaN and numbers with a type suffix (``12d``) become null."""
    number = value.try_cast("double")
    suffixed = F.coalesce(F.regexp_like(value.cast("string"), F.lit(r"(?i)[0-9.]\s*[df]\s*$")), F.lit(False))
    return F.when(~F.isnan(number) & ~suffixed, number)


def parse_local_time(value: Column) -> Column:
    """Zone-less time from text; bad text becomes null."""
    return value.try_cast("timestamp_ntz")
