"""Boosted trees with isotonic calibration, trained by Spark on a bounded sample."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import snapshot


def bounded(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most `most` rows, those with the smallest seeded hash of `keys`; written down."""
    return snapshot(rows.withColumn("_h", F.xxhash64(F.lit(11), *keys))
                    .orderBy("_h", *keys).limit(most), "sample")


def calibration_fold(*keys: str) -> Column:
    """A fifth of the rows, kept from the trees; equal keys fall on the same side."""
    return F.pmod(F.xxhash64(F.lit(29), *keys), F.lit(5)) == 0


@dataclass
class Boosted:
    trees: GBTClassificationModel
    scale: IsotonicRegressionModel

    def score(self, rows: DataFrame) -> DataFrame:
        """`rows` (with `features`, an array) and `score`, the calibrated probability of 1."""
        out = self.scale.transform(_margin(self.trees, rows))
        return out.select(*rows.columns, F.greatest(F.lit(0.0), F.least(
            F.lit(1.0), F.col("_score"))).alias("score"))


def _margin(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    made = trees.transform(rows.withColumn("_vector", array_to_vector("features")))
    return made.select(*rows.columns, vector_to_array("_raw")[1].alias("_margin"))


def fit_boosted(sample: DataFrame, keys: tuple[str, ...], trees: int = 20, depth: int = 4,
                seed: int = 5) -> Boosted | None:
    """Fit on a written sample with `features` and `label` (0 or 1).

    Trees see four fifths of the sample, calibration the rest; if one of the two lacks a
    class, both use the whole sample. None if the sample itself lacks one.
    """
    rows = sample.select("features", F.col("label").cast("double").alias("label"),
                         calibration_fold(*keys).alias("_fold"))
    classes = {(r["_fold"], r["label"]) for r in rows.select("_fold", "label").distinct().collect()}
    if len({label for _, label in classes}) < 2:
        return None
    parted = len(classes) == 4
    fit, scale = (rows.filter(~F.col("_fold")), rows.filter("_fold")) if parted else (rows, rows)
    learner = GBTClassifier(featuresCol="_vector", predictionCol="_y", maxIter=trees, maxDepth=depth,
                            stepSize=0.3, minInstancesPerNode=5, seed=seed)
    model = learner.setRawPredictionCol("_raw").setProbabilityCol("_p").fit(
        fit.withColumn("_vector", array_to_vector("features")))
    isotonic = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_score")
    return Boosted(model, isotonic.fit(_margin(model, scale)))
