"""A baseline model of a window: regression on the one-hot sequence, exported as a scorer."""

from __future__ import annotations

import itertools
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.dna import one_hot
from lociframe.operators.evaluation import roc_auc, scored
from lociframe.operators.scorers import WeightScorer


PARALLEL_FITS = 4


class LogisticScorer:
    """Probability of a weight scorer's sum."""

    def __init__(self, inner: WeightScorer):
        self.inner = inner

    def __call__(self, col):
        return 1.0 / (1.0 + F.exp(-self.inner(col)))

    def over(self, col):
        return F.transform(self.inner.over(col), lambda x: 1.0 / (1.0 + F.exp(-x)))


def features(df: DataFrame, seq: str = "seq", label: str = "label") -> DataFrame:
    return df.select(array_to_vector(one_hot(seq)).alias("features"), F.col(label).cast("double").alias("label"))


def train_baseline(df: DataFrame, task: str = "classification", seq: str = "seq", label: str = "label",
                   reg: float = 0.01, elastic: float = 0.0, max_iter: int = 50):
    """Fit on the train rows (split = train, or all) and return a scorer.

    MLlib aggregates gradients over the partitions; only the weights, four per position, reach
    the driver.
    """
    train = df.where("split = 'train'") if "split" in df.columns else df
    data = features(train, seq, label)
    kind = {"classification": LogisticRegression, "regression": LinearRegression}[task]
    model = kind(regParam=reg, elasticNetParam=elastic, maxIter=max_iter).fit(data)
    inner = WeightScorer(np.asarray(model.coefficients.toArray()).reshape(-1, 4), model.intercept)
    return LogisticScorer(inner) if task == "classification" else inner


def evaluate(df: DataFrame, scorer, task: str = "classification", seq: str = "seq", label: str = "label") -> DataFrame:
    """One row of test metrics: test_loss (BCE or MSE), and test_acc and test_auc for a classifier."""
    y = F.col(label).cast("double")
    rows = scored(df.select(y.alias("label"), scorer(F.col(seq)).alias("score")))
    if task == "regression":
        return rows.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("test_loss"))
    p = F.col("score")
    # Logarithms are kept above -100, so a certain and wrong score costs a finite loss.
    loss = -(F.col("label") * F.greatest(F.log(p), F.lit(-100.0))
             + (1 - F.col("label")) * F.greatest(F.log1p(-p), F.lit(-100.0)))
    right = ((p > 0.5).cast("double") == F.col("label")).cast("double")
    flat = rows.agg(F.avg(loss).alias("test_loss"), F.avg(right).alias("test_acc"))
    return flat.withColumn("test_auc", roc_auc(rows).select("roc_auc").scalar())


def sweep(df: DataFrame, grid: dict[str, list], task: str = "classification", draws: int | None = None, seed: int = 42,
          seq: str = "seq", label: str = "label") -> DataFrame:
    """Validation loss per parameter set (grid, or seeded random draws from it), best first.

    grid names arguments of train_baseline. Each set is one Spark fit on the train split and one
    aggregate over the val split; a few run at a time, as one fit alone leaves executors idle.
    """
    sets = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if draws is not None and draws < len(sets):
        sets = random.Random(seed).sample(sets, draws)
    train = df.where("split = 'train'").select(seq, label).cache()
    val = df.where("split = 'val'").select(seq, label).cache()

    def fit(params):
        model = train_baseline(train, task, seq, label, **params)
        loss = evaluate(val, model, task, seq, label).first()["test_loss"]   # one number per set
        return (*[float(v) for v in params.values()], float(loss))
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        rows = list(pool.map(fit, sets))
    train.unpersist()
    val.unpersist()
    fields = ", ".join(f"{n} double" for n in grid) + ", val_loss double"
    return df.sparkSession.createDataFrame(rows, fields).orderBy("val_loss")
