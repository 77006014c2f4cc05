"""Click-log audit (R4): a signature verdict per click, counted by a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import signing as G


def audit_clicks(clicks: DataFrame, key: str, ttl_seconds: int = K.CLICK_URL_TTL_SECONDS,
                 now_col: str = "now_unix") -> DataFrame:
    """``clicks`` carries impression_id, exp, sig and the verification time."""
    return clicks.withColumn(
        "verdict", G.click_verdict("impression_id", "exp", "sig", F.col(now_col), key, ttl_seconds))


def audit_summary(audited: DataFrame, by: str = "publisher_id") -> DataFrame:
    return audited.groupBy(by, "verdict").agg(F.count(F.lit(1)).alias("n"))
