"""Models trained on match data with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.threat import shot_angle, shot_distance
from touchline.operators.rasters import CHANNELS, coarse_zones


def shot_features(shots: DataFrame, x: str = "coordinates_x", y: str = "coordinates_y") -> DataFrame:
    """Add distance and angle of shots in corner-origin metres; shots without a place go."""
    placed = shots.dropna(subset=[x, y])
    return placed.withColumn("distance", shot_distance(F.col(x), F.col(y))).withColumn("angle", shot_angle(F.col("distance")))


def fit_xg(shots: DataFrame, goal: str = "is_goal") -> PipelineModel:
    """Logistic shot model on distance and angle.

    The penalty 1/n on the mean loss equals a unit penalty on the summed loss.
    """
    data = shot_features(shots).select("distance", "angle", F.col(goal).cast("double").alias("label"))
    n = data.count()
    features = VectorAssembler(inputCols=["distance", "angle"], outputCol="features")
    model = LogisticRegression(regParam=1.0 / max(n, 1), standardization=False, maxIter=500, tol=1e-13)
    return Pipeline(stages=[features, model]).fit(data)


def xg_coefficients(model: PipelineModel) -> tuple[float, float, float]:
    """(intercept, distance, angle) weights for ``goal_probability``."""
    fitted = model.stages[-1]
    return float(fitted.intercept), float(fitted.coefficients[0]), float(fitted.coefficients[1])


def score_xg(model: PipelineModel, shots: DataFrame) -> DataFrame:
    scored = model.transform(shot_features(shots))
    return scored.withColumn("xg", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_phase_classifier(rasters: DataFrame, label: str, cells: str = "cells", columns: int = 7, rows: int = 4) -> PipelineModel:
    """Multinomial phase model on occupied cells per coarse pitch zone of each raster."""
    data = zone_features(rasters, cells, columns, rows)
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")
    model = LogisticRegression(featuresCol="zones", labelCol="_label", predictionCol="_pred", probabilityCol="probability", rawPredictionCol="_margin", regParam=0.01, maxIter=50)
    return Pipeline(stages=[index, model]).fit(data)


def zone_features(rasters: DataFrame, cells: str = "cells", columns: int = 7, rows: int = 4) -> DataFrame:
    """Add ``zones``: occupied cells per channel and coarse pitch zone as a vector."""
    names = [str(z) for z in range(len(CHANNELS) * columns * rows)]
    counter = CountVectorizerModel.from_vocabulary(names, inputCol="_tokens", outputCol="zones")
    return counter.transform(rasters.withColumn("_tokens", coarse_zones(F.col(cells), columns, rows))).drop("_tokens")


def classify_phases(model: PipelineModel, rasters: DataFrame, label: str, cells: str = "cells", columns: int = 7, rows: int = 4) -> DataFrame:
    """Add ``phase`` and ``confidence`` to each raster."""
    names = F.array(*[F.lit(l) for l in model.stages[0].labels])
    data = zone_features(rasters, cells, columns, rows)
    scored = model.stages[-1].transform(data)
    return scored.withColumns(
        {"phase": F.get(names, F.col("_pred").cast("int")), "confidence": F.array_max(vector_to_array("probability"))}
    ).drop("zones", "_pred", "_margin", "probability")


def accuracy(scored: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Share of rows whose predicted phase is the label."""
    hit = F.avg((F.col("phase") == F.col(label)).cast("double")).alias("accuracy")
    return scored.groupBy(*(by or [])).agg(hit, F.count(F.lit(1)).alias("n"))
