"""Shared fixture loaders and parameters for catalogue queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ...sources import fixtures as fx
from ..oracle import register, with_views

# Fixed query parameters (UTC). Deterministic: no now().
STATS_AS_OF = "2024-01-31"
TRAIN_AS_OF = "2024-01-31 00:00:00"
REPORT_AS_OF = "2024-01-31 00:00:00"
INVENTORY_AS_OF = fx.INVENTORY_AS_OF
RECONCILE_DAY = "2024-01-15"

r6 = partial(F.round, scale=6)


def round6(col):
    return F.round(col, 6)


__all__ = ["fx", "register", "with_views", "round6", "STATS_AS_OF", "TRAIN_AS_OF",
           "REPORT_AS_OF", "INVENTORY_AS_OF", "RECONCILE_DAY"]
