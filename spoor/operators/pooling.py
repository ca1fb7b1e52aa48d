"""Mean vectors per group."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.vectors import l2_normalise


def mean_vectors(bank: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """``(*keys, vector)``: the mean per group, scaled to unit length.

    The mean is combined per task before the shuffle, so a group of any size ships
    one vector per task.
    """
    as_vector = array_to_vector(F.col(vector))
    pooled = bank.groupBy(*keys).agg(Summarizer.mean(as_vector).alias("mean"))
    return pooled.select(*keys, l2_normalise(vector_to_array("mean")).alias(vector))
