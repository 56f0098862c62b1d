"""Column expressions on hourly weather."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweft.constants import DRY_HOUR_MM, HEAT_INDEX_MIN_F, HEAT_INDEX_TERMS


def _power(value: Column, exponent: int) -> Column | None:
    return reduce(lambda a, b: a * b, [value] * exponent) if exponent else None


def heat_index_c(temperature_c: Column, humidity: Column) -> Column:
    """Heat index in Celsius; air temperature below 80 F, null when an input is null or humidity is no percentage."""
    fahrenheit = temperature_c * 9 / 5 + 32
    total = None
    for coefficient, t_power, h_power in HEAT_INDEX_TERMS:
        term = F.lit(coefficient)
        for factor in (_power(fahrenheit, t_power), _power(humidity, h_power)):
            if factor is not None:
                term = term * factor
        total = term if total is None else total + term
    return F.when(temperature_c.isNull() | ~F.coalesce(humidity.between(0, 100), F.lit(False)), F.lit(None).cast("double")).otherwise(
        F.when(fahrenheit < HEAT_INDEX_MIN_F, temperature_c).otherwise((total - 32) * 5 / 9)
    )


def is_dry(precip_mm: Column) -> Column:
    """True for a known amount below the dry-hour threshold."""
    return F.coalesce(precip_mm < DRY_HOUR_MM, F.lit(False))
