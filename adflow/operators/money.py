"""Money sums on integer micro-dollars, so totals do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def to_micros(usd) -> Column:
    c = F.col(usd) if isinstance(usd, str) else usd
    return F.round(c * MICROS).cast("bigint")


def sum_usd(usd) -> Column:
    """Exact sum of a USD column: sum integer micro-dollars, divide once."""
    return F.coalesce(F.sum(to_micros(usd)), F.lit(0)) / float(MICROS)


def sum_cpm_as_usd(cpm) -> Column:
    """sum(cpm) / 1000 (cost of the impressions) on micro-dollars."""
    c = F.col(cpm) if isinstance(cpm, str) else cpm
    return F.coalesce(F.sum(F.round(c * (MICROS / 1000)).cast("bigint")), F.lit(0)) / float(MICROS)
