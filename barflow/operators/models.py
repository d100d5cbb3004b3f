"""Fitting and scoring with Spark ML, and batch scoring with user models."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.functions.text import label_tone, lexicon_tone
from barflow.operators.stats import classifier_metrics
from barflow.session import reliable_checkpoint

REGIME_COLUMNS = ["rv", "trend_str", "atr_n", "vol_z", "ret_ac1"]
# fixed values: regime names by code
REGIMES = {0: "RANGING", 1: "TRENDING", 2: "VOLATILE"}


def fit_regimes(features: DataFrame, components: int = 5, min_weight: float = 0.02, seed: int = 42):
    """Gaussian mixture over standardised regime features; returns ``predict(df) -> df`` adding ``regime``.

    Components with negligible weight map to ranging; the rest are ordered by mean volatility into
    ranging, trending, volatile.  Spark has no Dirichlet-process mixture: the weight cut stands in.
    """
    columns = REGIME_COLUMNS
    assembled = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip")
    data = assembled.transform(features.dropna(subset=columns))
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(data)
    model = GaussianMixture(featuresCol="_z", predictionCol="_c", probabilityCol="_p", k=components, seed=seed, maxIter=50).fit(scaler.transform(data))
    means = [float(g.mean[0]) for g in model.gaussians]
    active = sorted((i for i, w in enumerate(model.weights) if w > min_weight), key=lambda i: means[i]) or list(range(components))
    label = {c: min(i, 2) for i, c in enumerate(active)}
    mapping = F.create_map(*[F.lit(x) for i in range(components) for x in (i, label.get(i, 0))])

    def predict(df: DataFrame) -> DataFrame:
        z = scaler.transform(assembled.transform(df.dropna(subset=columns)))
        return model.transform(z).withColumn("regime", mapping[F.col("_c")]).drop("_x", "_z", "_c", "_p")

    return predict


def score_batches(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], features: Sequence[str], expected: int | None = None,
                  out: str = "p") -> DataFrame:
    """Probability of a fitted model for every row, in Arrow batches.

    Missing feature columns and nulls count as 0.  If the model expects another number of features, or fails on a row of zeros (tried once
    on the driver), every row gets null, so that downstream filters block (fail closed).  A failure on later input fails the job, so the
    result does not depend on the batches.
    """
    features = list(features)
    for c in features:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    mismatch = expected is not None and expected != len(features)
    if not mismatch:
        try:
            predict(np.zeros((1, len(features))))
        except Exception:  # a broken model must block, not pass
            mismatch = True
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.full(len(pdf), np.nan)
            if not mismatch:
                p = np.asarray(predict(pdf[features].fillna(0).to_numpy(float)), dtype=float)
            yield pdf.assign(**{out: pd.Series(p, index=pdf.index).astype(object).where(~np.isnan(p), None)})

    return df.mapInPandas(run, schema)


def model_signal(p: str, long_at: float = 0.52, short_at: float = 0.48):
    """+1 / -1 / 0 from a probability; null gives 0."""
    return F.when(F.col(p) > long_at, 1.0).when(F.col(p) < short_at, -1.0).otherwise(0.0)


def score_texts(df: DataFrame, text: str, classify: Callable[[list[str]], list[tuple[str, float]]] | None, out: str = "tone") -> DataFrame:
    """Tone per text from a batch classifier, each distinct text scored once; the lexicon without a classifier."""
    if classify is None:
        return df.withColumn(out, lexicon_tone(text))
    schema = T.StructType([T.StructField("_t", T.StringType()), T.StructField("_label", T.StringType()), T.StructField("_conf", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = classify(pdf["_t"].tolist())
            yield pd.DataFrame({"_t": pdf["_t"], "_label": [g[0] for g in got], "_conf": [float(g[1]) for g in got]})

    scored = df.select(F.col(text).alias("_t")).where(F.col(text).isNotNull()).distinct().mapInPandas(run, schema)
    d = df.join(scored, df[text] == scored["_t"], "left")
    return d.withColumn(out, F.coalesce(label_tone("_label", "_conf"), F.lit(0.0))).drop("_t", "_label", "_conf")


def walk_forward_classifier(
    matrix: DataFrame, folds: DataFrame, features: Sequence[str], keys: Sequence[str], row: str = "row", iterations: int = 20, depth: int = 3, seed: int = 42,
) -> DataFrame:
    """Gradient-boosted trees fitted per fold on its train rows; classifier metrics on its test rows.

    ``folds(keys, fold, role, row)`` come from the purged splits; ``matrix`` carries the row number.
    The number of folds is fixed, so the loop over them is a handful of distributed fits.  A fold without a train row whose features are all known is
    skipped; without any fold there is no row.  Trees only use the order of a feature's values, so infinite ones, which Spark's trees refuse, stand at
    the ends of the doubles.
    """
    most = sys.float_info.max
    x = {c: F.col(c).cast("double") for c in features}
    matrix = matrix.withColumns({c: F.when(v == float("inf"), most).when(v == float("-inf"), -most).otherwise(v) for c, v in x.items()})
    data = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(matrix)
    joined = reliable_checkpoint(folds.join(data.select(*keys, row, "_x", F.col("target").cast("double").alias("target")), [*keys, row]))
    y = F.col("target").cast("int").alias("y")
    out = joined.where("false").select("fold", y, F.lit(None).cast("double").alias("p"))
    for fold in sorted(r["fold"] for r in joined.where("role = 'train'").select("fold").distinct().collect()):
        part = joined.where(F.col("fold") == fold)
        model = GBTClassifier(featuresCol="_x", labelCol="target", maxIter=iterations, maxDepth=depth, seed=seed).fit(part.where("role = 'train'"))
        out = out.unionByName(model.transform(part.where("role = 'test'")).select("fold", y, vector_to_array("probability")[1].alias("p")))
    return classifier_metrics(out, ["fold"])
