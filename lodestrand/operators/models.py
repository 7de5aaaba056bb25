"""Model pipelines of the ML library, per-group models, and batch inference from a stored payload."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preprocessing(numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True) -> list:
    """Median imputation and scaling of numbers, one-hot columns of categories with unknown ones kept apart."""
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    steps: list = [Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}__filled" for c in numeric])]
    for c in categorical:
        steps += [StringIndexer(inputCol=c, outputCol=f"{c}__index", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__index", outputCol=f"{c}__hot")]
    steps.append(VectorAssembler(inputCols=[f"{c}__filled" for c in numeric] + [f"{c}__hot" for c in categorical], outputCol="__raw" if scale else "features"))
    if scale:
        steps.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True))
    return steps


def regressors(seed: int = 2025) -> dict:
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    return {"ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0), "forest": RandomForestRegressor(numTrees=50, seed=seed), "boosted": GBTRegressor(maxIter=50, seed=seed)}


def classifiers(seed: int = 2025) -> dict:
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier

    return {"logistic": LogisticRegression(), "forest": RandomForestClassifier(numTrees=50, seed=seed), "boosted": GBTClassifier(maxIter=50, seed=seed), "svm": LinearSVC()}


def fit_model(train: DataFrame, steps: list, estimator, label: str, grid: dict[str, Sequence] | None = None, folds: int = 3):
    """A fitted pipeline; with a grid and enough rows the best of a cross-validation over it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    model = Pipeline(stages=[*steps, estimator.copy({estimator.labelCol: label})])
    if not grid or train.limit(max(2 * folds, 10)).count() < max(2 * folds, 10):
        return model.fit(train)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getStages()[-1].getParam(name), list(values))
    return CrossValidator(estimator=model, estimatorParamMaps=builder.build(), evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=2025).fit(train).bestModel


def ridge_per_group(rows: DataFrame, group: str, features: Sequence[str], label: str, least: int = 10, penalty: float = 1.0) -> DataFrame:
    """(group, n, weights, intercept): one ridge model per group, from sums.

    Each task adds up the moment matrix of each group it sees, so a group of any size moves a few numbers per task."""
    names = list(features)
    k = len(names) + 2

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            pdf = pdf.dropna()
            for g, part in pdf.groupby(group):
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(float), part[label].to_numpy(float)])
                sums[g] = sums.get(g, 0) + x.T @ x
        yield pd.DataFrame({"g": list(sums), "m": [s.ravel().tolist() for s in sums.values()]})

    kind = dict(rows.dtypes)[group]
    parts = rows.select(group, *names, label).mapInPandas(moments, f"g {kind}, m array<double>")
    total = parts.groupBy("g").agg(F.array(*[F.sum(F.get("m", F.lit(i))) for i in range(k * k)]).alias("m"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, m in zip(pdf["g"], pdf["m"], strict=True):
                s = np.array(m, float).reshape(k, k)
                if s[0, 0] >= least:
                    a = s[:-1, :-1] + penalty * np.diag([0.0, *[1.0] * len(names)])
                    w = np.linalg.lstsq(a, s[:-1, -1], rcond=None)[0]
                    out.append((g, int(s[0, 0]), w[1:].tolist(), float(w[0])))
            yield pd.DataFrame(out, columns=["g", "n", "weights", "intercept"])

    return total.mapInPandas(solve, f"g {kind}, n long, weights array<double>, intercept double").withColumnRenamed("g", group)


def predict_batches(rows: DataFrame, payload: bytes, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Predictions of a pickled model (from a trusted store) with a `predict` method; rows with a missing feature get a
    reason instead."""
    shared = rows.sparkSession.sparkContext.broadcast(payload)
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pickle.loads(shared.value)
        for pdf in batches:
            whole = pdf[names].notna().all(axis=1)
            score = pd.Series(np.nan, index=pdf.index)
            if whole.any():
                score[whole] = model.predict(pdf.loc[whole, names].to_numpy(float))
            out = pdf[list(keys)].copy()
            out["score"] = score.astype(object).where(whole, None).astype("float64")
            out["reason"] = np.where(whole, None, "missing_feature")
            yield out

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", score double, reason string"
    return rows.select(*dict.fromkeys([*keys, *names])).mapInPandas(run, schema)


def principal_coordinates(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, coordinates): the centred vectors in their k principal directions. The covariance is summed up in partitions and
    only its matrix, dimension by dimension, comes to the driver."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    x = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(x).transform(x)
    return PCA(k=k, inputCol="c", outputCol="p").fit(x).transform(x).select(key, vector_to_array("p").alias("coordinates"))


def load_models(payloads: dict[str, bytes]) -> tuple[dict[str, bytes], dict[str, str]]:
    """The stored models (from a trusted store) that can be loaded and have a `predict` method, and the reasons of the others:
    one broken model does not keep the rest from being used."""
    good, failed = {}, {}
    for name, payload in sorted(payloads.items()):
        try:
            if not callable(getattr(pickle.loads(payload), "predict", None)):
                raise TypeError("no predict method")
            good[name] = payload
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {e}"
    return good, failed


def predict_with_all(rows: DataFrame, payloads: dict[str, bytes], features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Predictions of every model, in long form with the model's name."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [predict_batches(rows, p, features, keys).withColumn("model_name", F.lit(n)) for n, p in payloads.items()])
