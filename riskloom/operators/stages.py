"""Base classes of the fit/transform operators, usable and savable inside `pyspark.ml.Pipeline`."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params
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


class Configured(Params):
    """Settings kept as one JSON-ready dict; subclasses list their names in `defaults`."""

    defaults: dict[str, Any] = {}

    config = Param(Params._dummy(), "config", "settings of the stage")

    def __init__(self, **settings: Any):
        super().__init__()
        unknown = set(settings) - set(self.defaults)
        if unknown:
            raise TypeError(f"{type(self).__name__} has no setting {sorted(unknown)}")
        self._set(config={**self.defaults, **settings})

    def setting(self, name: str) -> Any:
        return self.getOrDefault(self.config)[name]


class Stage(Configured, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stateless column transformation."""


class FitStage(Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator; `_fit` returns a `FittedStage`."""


class _FittedWriter(MLWriter):
    def __init__(self, instance: FittedStage):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        tables = sorted(self.instance.tables)
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {"tables": tables})
        for name in tables:
            self.instance.tables[name].write.parquet(f"{path}/{name}")


class _FittedReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FittedStage:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.tables = {name: spark.read.parquet(f"{path}/{name}") for name in metadata["tables"]}
        return stage


class FittedStage(Model, MLReadable, MLWritable):
    """Fitted model: small values in `state` (JSON), tables that may grow in `tables` (Parquet)."""

    config = Param(Params._dummy(), "config", "settings of the stage")
    state = Param(Params._dummy(), "state", "fitted values")

    def __init__(self, config: dict | None = None, state: dict | None = None, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self._set(config=config or {}, state=state or {})
        self.tables: dict[str, DataFrame] = tables or {}

    def setting(self, name: str) -> Any:
        return self.getOrDefault(self.config)[name]

    def fitted(self, name: str) -> Any:
        return self.getOrDefault(self.state)[name]

    def write(self) -> MLWriter:
        return _FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FittedReader(cls)
