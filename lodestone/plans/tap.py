"""Figures of what passes through a plan, taken while it runs and without another pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def tap(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``df`` and its figures: ``rows``, and for each condition how many rows hold it.

    ``observation.get`` gives them once an action has read all of ``df``; a limit above may stop it early.
    """
    seen = Observation()
    counts = [F.count_if(c).alias(n) for n, c in conditions.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen
