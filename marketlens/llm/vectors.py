"""Vectors shared by the two embedding operators: which take part, and blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that one task holds of one block.
BLOCK = 2048


def usable(embedding: str = "embedding") -> Column:
    """Not null, no null or non-finite component, not zero."""
    c = F.col(embedding)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def blocks(n: Column, size: int = BLOCK) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def prepared(table: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the usable rows."""
    return table.where(usable()).withColumn("embedding", F.col("embedding").cast("array<double>"))
