"""The isolation forest as a Spark ML estimator and model: parameters, pipelines, saving and loading."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, HasPredictionCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.operators.anomaly import TREE_SCHEMA, ForestModel, IsolationForest


class ForestParams(HasInputCols, HasPredictionCol, HasSeed):
    """Parameters shared by the estimator and its model."""

    idCols = Param(Params._dummy(), "idCols", "columns that tell rows apart; they decide which rows a tree sees", TypeConverters.toListString)
    scoreCol = Param(Params._dummy(), "scoreCol", "column of scores; below 0 is an anomaly", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    samplesPerTree = Param(Params._dummy(), "samplesPerTree", "rows per tree", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of the training rows below the cut", TypeConverters.toFloat)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(
            predictionCol="is_anomaly_ml", scoreCol="anomaly_score_ml", numTrees=100, samplesPerTree=256, contamination=0.01, seed=42
        )

    def getIdCols(self) -> list[str]:
        return self.getOrDefault(self.idCols)

    def getScoreCol(self) -> str:
        return self.getOrDefault(self.scoreCol)


class IsolationForestEstimator(Estimator, ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits :class:`IsolationForestModel`. Null features count as 0, as they do in scoring."""

    @keyword_only
    def __init__(
        self, *, inputCols=None, idCols=None, predictionCol="is_anomaly_ml", scoreCol="anomaly_score_ml", numTrees=100, samplesPerTree=256, contamination=0.01, seed=42
    ):
        super().__init__()
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(
        self, *, inputCols=None, idCols=None, predictionCol="is_anomaly_ml", scoreCol="anomaly_score_ml", numTrees=100, samplesPerTree=256, contamination=0.01, seed=42
    ):
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> IsolationForestModel:
        learner = IsolationForest(
            self.getInputCols(), self.getIdCols(), self.getOrDefault(self.numTrees), self.getOrDefault(self.samplesPerTree),
            self.getOrDefault(self.contamination), self.getSeed(),
        )
        return self._copyValues(IsolationForestModel(learner.fit(dataset)))


class IsolationForestModel(Model, ForestParams, MLReadable, MLWritable):
    """Adds ``scoreCol`` and the 0/1 label ``predictionCol``. Saved as parameters and one table of tree nodes."""

    def __init__(self, forest: ForestModel | None = None):
        super().__init__()
        self.forest = forest

    @property
    def cut(self) -> float | None:
        """Score, before it is taken off, that parts anomalies from the rest."""
        return self.forest.cut

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self.forest.scores(dataset, self.getScoreCol())
        return scored.withColumn(self.getPredictionCol(), (F.col(self.getScoreCol()) < 0).cast("int"))

    def write(self) -> MLWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ForestReader()


class ForestWriter(MLWriter):
    def __init__(self, instance: IsolationForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        forest = self.instance.forest
        extra = {"cols": list(forest.cols), "sampleRows": forest.sample_rows, "cut": forest.cut}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=extra)
        rows = [tuple(r) for tree in forest.trees for r in tree.itertuples(index=False)]  # trees x samples at most
        self.sparkSession.createDataFrame([[int(x) if i != 3 else float(x) for i, x in enumerate(r)] for r in rows], TREE_SCHEMA).coalesce(1).write.parquet(f"{path}/data")


class ForestReader(MLReader):
    def load(self, path: str) -> IsolationForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.schema(TREE_SCHEMA).parquet(f"{path}/data").toPandas()
        trees = [t.sort_values("node").reset_index(drop=True) for _, t in table.groupby("tree")]
        model = IsolationForestModel(ForestModel(metadata["cols"], trees, metadata["sampleRows"], metadata["cut"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
