"""Lineage cuts that survive executor loss.

``checkpoint`` writes to the shared folder named by ``spark.checkpoint.dir``
(set by the cluster; only local sessions fall back to a scratch folder), never
to executor-local storage. ``release`` and ``intermediates`` remove what was written.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources import files

_WRITTEN: list[str] = []


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` once as parquet under the checkpoint folder and read it
    back: one job, lineage cut, and the planner sees real file sizes (so its
    size-checked auto-broadcast applies). ``eager`` is kept for API symmetry."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/adflow-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what one ``checkpoint`` call wrote; ``df`` is what it returned. For loops
    that write a state anew: the state before it can go."""
    path = getattr(df, "_written_to", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        files.delete(df.sparkSession, [path])


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the intermediates that ``checkpoint`` wrote in this process (from the
    ``since``-th on) and return how many folders went. Call it once the results that
    read them have been written out; DataFrames still built on them cannot run."""
    paths = _WRITTEN[since:]
    del _WRITTEN[since:]
    return files.delete(spark, paths)


@contextmanager
def intermediates(spark: SparkSession):
    """Whatever ``checkpoint`` writes inside the block is deleted when it ends."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        release(spark, since)


def snapshot(df: DataFrame) -> DataFrame:
    """Materialise a dimension or snapshot once. Its files say how large it is, so joins
    broadcast it by its size in bytes or shuffle it."""
    return checkpoint(df)
