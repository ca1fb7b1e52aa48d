"""Whitening as a stage of a ``pyspark.ml`` pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

from spoor.operators.whiten import DEFAULT_K, WhiteningModel, fit_leading, fit_whitening


class _WhiteningParams(Params):
    vectorCol = Param(Params._dummy(), "vectorCol", "column of vectors", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "directions to keep", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(vectorCol="embedding", k=DEFAULT_K)


class Whitening(Estimator, _WhiteningParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on a bank of vectors; ``leadingOnly`` computes no more than k directions."""

    leadingOnly = Param(
        Params._dummy(), "leadingOnly", "whether to fit k directions only", TypeConverters.toBoolean
    )

    @keyword_only
    def __init__(self, *, vectorCol="embedding", k=DEFAULT_K, leadingOnly=False):
        super().__init__()
        self._setDefault(leadingOnly=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> WhiteningStage:
        vector, k = self.getOrDefault("vectorCol"), self.getOrDefault("k")
        if self.getOrDefault("leadingOnly"):
            fitted = fit_leading(dataset, k, vector)
        else:
            fitted = fit_whitening(dataset, vector)
        return self._copyValues(WhiteningStage(fitted))


class WhiteningStage(Model, _WhiteningParams, MLReadable, MLWritable):
    """Whitens any bank by the directions of the one it was fitted on."""

    def __init__(self, model: WhiteningModel | None = None):
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset, self.getOrDefault("k"), self.getOrDefault("vectorCol"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: WhiteningStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.model.save(self.sparkSession, f"{path}/model")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> WhiteningStage:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls(WhiteningModel.load(self.sparkSession, f"{path}/model"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage
