"""Names, percentages and signal values as shown to readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def model_title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def percent(value: Column, digits: int = 1) -> Column:
    """A share as percent; a missing one counts as 0."""
    return F.format_string(f"%.{digits}f%%", F.round(F.coalesce(value, F.lit(0.0)) * 100.0, digits))


def signal(value: Column, pct: bool = False) -> Column:
    shown = percent(value, 2) if pct else F.format_string("%.2f", F.round(value, 2))
    return F.when(value.isNull(), "n/a").otherwise(shown)


def yes_no(flag: Column) -> Column:
    return F.when(flag.isNull(), "n/a").when(flag, "Yes").otherwise("No")
