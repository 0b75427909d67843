"""Fitted linear model: coefficients as a DataFrame, batch prediction, error
measures and persistence.

Prediction stays JVM-side: one array fold over the non-zero positions and
weights (two array constants), the same at every number of non-zeros.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = "1.0"


def linear_form(weights: np.ndarray, features: str | Column = "features",
                intercept: float = 0.0) -> Column:
    """``features · w + intercept`` as a Spark expression.

    Only positions with a non-zero weight are read, so a NaN or null elsewhere
    does not matter and one there makes the result NaN or null. A row of
    another width than the weights raises; a null vector gives null.
    """
    x = F.col(features) if isinstance(features, str) else features
    w = np.asarray(weights, dtype=np.float64)
    nz = np.flatnonzero(w)
    # array constants from text: one expression node each, whatever the count
    at = F.from_json(F.lit(json.dumps((nz + 1).tolist())), "array<int>")
    by = F.from_json(F.lit(json.dumps(w[nz].tolist())), "array<double>")
    terms = F.zip_with(at, by, lambda i, v: F.element_at(x, i) * v)
    value = F.aggregate(terms, F.lit(float(intercept)), lambda acc, v: acc + v)
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(F.size(x) == len(w), value)
            .otherwise(F.raise_error(F.concat(
                F.lit(f"expected {len(w)} features, got "), F.size(x).cast("string")))))


@dataclass
class LassoModel:
    weights: np.ndarray
    names: list[str] | None = None
    intercept: float = 0.0
    lam: float | None = None
    rho: float | None = None
    iterations: int | None = None
    converged: bool | None = None
    training_seconds: float | None = None
    mse: float | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_fit(cls, fit, names: list[str] | None = None) -> "LassoModel":
        return cls(np.array(fit.coef, dtype=np.float64), names, 0.0, fit.lam, fit.rho,
                   fit.iterations, fit.converged, fit.seconds)

    # -- views ---------------------------------------------------------
    def coefficients(self, spark: SparkSession, nonzero_only: bool = False) -> DataFrame:
        names = self.names or [f"x{i}" for i in range(len(self.weights))]
        rows = [(i, names[i], float(v) + 0.0) for i, v in enumerate(self.weights)
                if v != 0 or not nonzero_only]
        return spark.createDataFrame(rows, "idx int, name string, coef double")

    def nnz(self) -> int:
        return int(np.count_nonzero(self.weights))

    # -- scoring -------------------------------------------------------
    def predict(self, df: DataFrame, features: str = "features",
                out: str = "prediction") -> DataFrame:
        return df.withColumn(out, linear_form(self.weights, features, self.intercept))

    def mean_squared_error(self, df: DataFrame, features: str = "features",
                           label: str = "label") -> DataFrame:
        """One-row ``(n, mse)``: mean of squared residuals."""
        return mean_squared_error(self.predict(df, features), label, "prediction")

    # -- persistence ---------------------------------------------------
    def save(self, spark: SparkSession, path: str, mode: str = "overwrite") -> None:
        """``path/metadata`` (json), ``path/coef`` (parquet, all
        coefficients), ``path/coef.txt`` (non-zero ``coef,name`` text) and
        ``path/eval`` (json: mse and training time)."""
        meta = {"class": "sparselm.LassoModel", "version": FORMAT_VERSION,
                "numFeatures": int(len(self.weights)), "intercept": float(self.intercept),
                "lambda": self.lam, "rho": self.rho, "iterations": self.iterations,
                "converged": self.converged, "timestamp": int(time.time())}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
            .write.mode(mode).text(os.path.join(path, "metadata"))
        coef = self.coefficients(spark)
        coef.write.mode(mode).parquet(os.path.join(path, "coef"))
        (coef.where(F.col("coef") != 0).orderBy("idx")
         .select(F.concat_ws(",", F.col("coef").cast("string"), "name").alias("value"))
         .write.mode(mode).text(os.path.join(path, "coef.txt")))
        spark.createDataFrame([(self.mse, self.training_seconds, self.nnz())],
                              "mse double, training_seconds double, nnz int") \
            .write.mode(mode).option("ignoreNullFields", "false").json(os.path.join(path, "eval"))

    @staticmethod
    def read_coefficient_text(spark: SparkSession, path: str) -> DataFrame:
        """``coef.txt`` of a saved model: ``coef, name`` of the non-zeros."""
        line = spark.read.text(os.path.join(path, "coef.txt"))
        return line.select(F.substring_index("value", ",", 1).cast("double").alias("coef"),
                           F.expr("substr(value, instr(value, ',') + 1)").alias("name"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LassoModel":
        meta = json.loads(spark.read.text(os.path.join(path, "metadata")).first()["value"])
        if meta.get("class") != "sparselm.LassoModel":
            raise ValueError(f"not a saved LassoModel: {meta.get('class')}")
        rows = spark.read.parquet(os.path.join(path, "coef")).orderBy("idx").collect()
        w = np.array([r["coef"] for r in rows], dtype=np.float64)
        if len(w) != meta["numFeatures"]:
            raise ValueError("coefficient count does not match the metadata")
        ev = spark.read.schema("mse double, training_seconds double, nnz int") \
            .json(os.path.join(path, "eval")).first()
        ev = ev.asDict() if ev is not None else {}
        return cls(w, [r["name"] for r in rows], meta["intercept"], meta.get("lambda"),
                   meta.get("rho"), meta.get("iterations"), meta.get("converged"),
                   ev.get("training_seconds"), ev.get("mse"))


def mean_squared_error(df: DataFrame, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """``(n, mse)`` with ``mse = avg((prediction − label)²)``."""
    err = F.col(prediction) - F.col(label)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"))


def nonzero_coefficients(coef: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Keep ``coef != 0`` and attach names from the dictionary by ``idx``."""
    out = coef.where(F.col("coef") != 0)
    if names is not None:
        # the dictionary's size is not known here: the planner decides
        out = out.drop("name").join(names.select("idx", "name"), "idx", "left")
    return out
