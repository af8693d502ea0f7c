"""Column functions of the trade-network domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to denominators of relative changes. Fixed value.
SMALL = 1e-8


def country(node: Column) -> Column:
    """Text before the first underscore, the whole id if there is none."""
    return F.substring_index(node, "_", 1)


def sector(node: Column) -> Column:
    """Text after the first underscore, the whole id if there is none: `USA_A01_02` gives `A01_02`."""
    return F.coalesce(F.get(F.split(node, "_", 2), F.lit(1)), node)


def sector_token(node: Column) -> Column:
    """The second token only, UNK if there is none: `USA_A01_02` gives `A01`."""
    return F.coalesce(F.get(F.split(node, "_"), F.lit(1)), F.lit("UNK"))


def number(text: Column) -> Column:
    """Text as a number; NULL where it is none, also for the text NaN."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def known(value: Column) -> Column:
    """NULL instead of NaN."""
    return F.when(~F.isnan(value), value)


def growth(now: Column, before: Column) -> Column:
    """(now - before) / before; 0 where either is missing or before is 0."""
    return F.coalesce(F.try_divide(now - before, before), F.lit(0.0))


def relative_change(before: Column, after: Column) -> Column:
    """(after - before) / (before + 1e-8)."""
    return F.try_divide(after - before, before + SMALL)


def log_change(before: Column, after: Column) -> Column:
    return F.log1p(after) - F.log1p(before)


def dead_sign(x: Column, eps: float) -> Column:
    """Sign of x; 0 where it is nearer to 0 than eps."""
    return F.when(F.abs(x) < eps, 0.0).otherwise(F.signum(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def year_code(year: Column, start: int) -> Column:
    """A year's place in the span of 20 years from start on."""
    return (year - start) / 20.0


def month_name(code: Column) -> Column:
    """Three letters for a month's two digits."""
    names = [x for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (F.lit(f"{i:02d}"), F.lit(m))]
    return F.try_element_at(F.create_map(*names), code)


def percent_text(x: Column, digits: int = 2) -> Column:
    """A share as `12.34%`; N/A where missing."""
    return number_text(x * 100, digits, "%")


def number_text(x: Column, digits: int = 4, unit: str = "") -> Column:
    shown = F.concat(F.format_string(f"%.{digits}f", x), F.lit(unit))
    return F.when(x.isNotNull() & ~F.isnan(x), shown).otherwise("N/A")


def unwrapped(values: Column) -> Column:
    """The only element of a list of one, else the list as text."""
    return F.when(F.size(values) == 1, F.try_element_at(values, F.lit(1))).otherwise(F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")))
