"""Truncated PCA whitening, fitted on a reference bank and applied to any bank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions.vectors import l2_normalise, matrix_of
from spoor.session import ship_package
from spoor.sources.guards import require_rows

DEFAULT_K = 256
# Fixed value: spacing of single-precision floats at 1, the unit of the rank threshold.
FLOAT_EPS = float(np.finfo(np.float32).eps)


@dataclass(frozen=True)
class WhiteningModel:
    """Mean, principal directions (rows) and singular values of a reference bank.

    Its size depends on the dimension of the vectors only, never on their number.
    """

    reference_rows: int
    mean: np.ndarray
    components: np.ndarray
    singular_values: np.ndarray
    rcond: float = 0.0

    @property
    def rank(self) -> int:
        return len(self.singular_values)

    def transform(self, bank: DataFrame, k: int = DEFAULT_K, vector: str = "embedding"):
        """Whitened unit vectors; all other columns pass through."""
        white = self.project(bank, k, vector)
        return white.withColumn(vector, l2_normalise(F.col(vector)).cast("array<float>"))

    def project(self, bank: DataFrame, k: int = DEFAULT_K, vector: str = "embedding"):
        """The same before the last scaling to unit length: covariance one on the fit set."""
        k = min(k, self.rank)
        scale = np.sqrt(self.reference_rows - 1) / self.singular_values[:k]
        ship_package(bank.sparkSession)
        # d x k doubles: 8 MB for 4,096 dimensions and k = 256.
        model = bank.sparkSession.sparkContext.broadcast(
            (self.mean, self.components[:k].T * scale)
        )
        unit = bank.withColumn(vector, l2_normalise(F.col(vector)))
        return unit.mapInArrow(_projector(model, vector), unit.schema)

    def metadata(self, input_rows: int, k: int = DEFAULT_K) -> dict[str, int | float]:
        return {
            "reference_rows": self.reference_rows,
            "input_rows": input_rows,
            "input_dim": len(self.mean),
            "rank": self.rank,
            "k": min(k, self.rank),
            "rcond": self.rcond,
            "dropped": len(self.mean) - self.rank,
        }

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per direction, the mean as row -1, the threshold as row -2."""
        rows = [(-2, self.rcond, []), (-1, float(self.reference_rows), self.mean.tolist())]
        rows += [
            (i, float(s), c.tolist())
            for i, (s, c) in enumerate(zip(self.singular_values, self.components))
        ]
        schema = "component int, singular_value double, direction array<double>"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> WhiteningModel:
        rows = spark.read.parquet(path).orderBy("component").collect()
        limits = [r["singular_value"] for r in rows if r["component"] == -2]
        first, *rest = [r for r in rows if r["component"] >= -1]
        return WhiteningModel(
            int(first["singular_value"]),
            np.array(first["direction"]),
            np.array([r["direction"] for r in rest]).reshape(len(rest), -1),
            np.array([r["singular_value"] for r in rest]),
            *limits,
        )


def _projector(model, vector: str):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(vector)
            out = (matrix_of(batch.column(at), len(mean)) - mean) @ projection
            ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
            yield batch.set_column(at, pa.field(vector, column.type), column)

    return project


def _unit_rows(reference: DataFrame, vector: str) -> tuple[DataFrame, int, np.ndarray]:
    """The unit rows as ``unit``, their number and their mean."""
    unit = l2_normalise(F.col(vector))
    vectors = require_rows(reference, "the reference bank is empty").select(unit.alias("unit"))
    n, mean = vectors.agg(
        F.count(F.lit(1)), Summarizer.mean(array_to_vector("unit"))
    ).first()
    return vectors, n, mean.toArray()


def fit_whitening(
    reference: DataFrame, vector: str = "embedding", rcond: float | str | None = None
) -> WhiteningModel:
    """Mean and singular vectors of the unit rows of ``reference``.

    Each task sums its rows into one d x d product, the products are added up in a
    tree, and only that matrix reaches the driver. Directions with a singular value
    up to ``rcond`` times the largest are dropped; by default dim * FLOAT_EPS, and with
    ``"rows"`` max(rows, dim) * FLOAT_EPS, which needs fewer than about 8 million rows.
    """
    vectors, n, mean = _unit_rows(reference, vector)
    if rcond is None or rcond == "rows":
        threshold = (len(mean) if rcond is None else max(n, len(mean))) * FLOAT_EPS
    else:
        threshold = float(rcond)
    if threshold >= 1:
        raise ValueError(f"no direction passes the threshold {threshold}")
    centre = F.array(*[F.lit(float(x)) for x in mean])
    centred = vectors.select(
        array_to_vector(F.zip_with("unit", centre, lambda x, m: x - m)).alias("centred")
    )
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "centred"), n, len(mean))
    svd = matrix.computeSVD(len(mean), computeU=False, rCond=threshold)
    values = svd.s.toArray()
    directions = svd.V.toArray().T
    return WhiteningModel(n, mean, directions, values, threshold)


# Columns beyond k, and products with the covariance, of ``fit_leading``.
OVERSAMPLE = 16
PASSES = 2
# Partial sums are added up in so many groups before the last sum.
SUM_GROUPS = 64


def _scatter(vectors: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scatter matrix of the centred rows times ``block``, in one pass over the rows.

    Each task adds up one dim x columns matrix; these are added in two steps.
    """
    context = vectors.sparkSession.sparkContext
    model = context.broadcast((mean, block))  # dim x columns
    ship_package(vectors.sparkSession)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, block = model.value
        total = np.zeros_like(block)
        for batch in batches:
            if batch.num_rows:
                rows = matrix_of(batch.column(0), len(mean)) - mean
                total += rows.T @ (rows @ block)
        ends = pa.array([0, total.size], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], names=["sum"]
        )

    parts = vectors.select("unit").mapInArrow(products, "sum array<double>")
    parts = parts.select(
        array_to_vector("sum").alias("sum"), (F.spark_partition_id() % SUM_GROUPS).alias("part")
    )
    some = parts.groupBy("part").agg(Summarizer.sum(F.col("sum")).alias("sum"))
    return some.agg(Summarizer.sum(F.col("sum"))).first()[0].toArray().reshape(block.shape)


def fit_leading(
    reference: DataFrame, k: int = DEFAULT_K, vector: str = "embedding",
    oversample: int = OVERSAMPLE, passes: int = PASSES, rcond: float | None = None, seed: int = 7,
) -> WhiteningModel:
    """The ``k`` leading directions only, by a block Krylov space.

    A random block of k + ``oversample`` columns is multiplied by the scatter matrix ``passes``
    times, and the directions are the best within the space of all these blocks, which takes one
    pass more. Tasks and driver hold dim x columns blocks, never a dim x dim matrix. Within the
    space the covariance is diagonal, so whitened rows have covariance one however well the
    directions have settled.
    """
    vectors, n, mean = _unit_rows(reference, vector)
    dim = len(mean)
    columns = min(dim, k + oversample)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, columns)))[0]
    space = block
    for _ in range(passes):
        if space.shape[1] >= dim:
            break
        block = _scatter(vectors, mean, block)
        # Only what is new in the block, so that the space stays well conditioned.
        for _ in range(2):
            block = block - space @ (space.T @ block)
        new, sizes = np.linalg.qr(block)
        held = np.abs(np.diag(sizes)) > 1e-10 * max(1.0, np.abs(sizes).max(initial=0.0))
        block = new[:, held][:, : dim - space.shape[1]]
        if not block.shape[1]:
            break
        space = np.column_stack([space, block])
    inner = space.T @ _scatter(vectors, mean, space)
    energy, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-energy)[:k]
    values = np.sqrt(np.maximum(energy[order], 0.0))
    threshold = dim * FLOAT_EPS if rcond is None else float(rcond)
    kept = values > threshold * values.max(initial=0.0)
    directions = (space @ turn[:, order]).T[kept]
    return WhiteningModel(n, mean, directions, values[kept], threshold)
