"""Training sets: labels, splits, label scaling, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators.sampling import hash_cuts, hash_order, take_by_hash


def make_classification(pos: DataFrame, neg: DataFrame, key: str = "id", seq: str = "seq", balance: bool = True,
                        seed=42, check: bool = True) -> DataFrame:
    """(key, seq, label, order_key): positives 1 and negatives 0, the larger class drawn down to the
    smaller one when balance. order_key is the shuffled order. Sequences of different lengths are an error."""
    rows = pos.select(key, seq, F.lit(1).alias("label")).unionByName(neg.select(key, seq, F.lit(0).alias("label")))
    if check:
        low, high = rows.agg(F.min(F.length(seq)), F.max(F.length(seq))).first()
        if low != high:
            raise ValueError(f"sequence lengths differ: {low} to {high}")
    label_key = F.concat(F.col("label").cast("string"), F.lit(":"), F.col(key).cast("string"))
    if balance:
        sizes = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
        quotas = sizes.select(F.least("p", "n").alias("quota"), F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
        rows = take_by_hash(rows, label_key, seed, quotas, by=["label"])
    return rows.withColumn("order_key", hash_order(f"{seed}-order", label_key))


def label_stats(df: DataFrame, label: str = "label") -> DataFrame:
    """min, max, mean and population standard deviation."""
    return df.agg(F.min(label).alias("min"), F.max(label).alias("max"), F.avg(label).alias("mean"),
                  F.stddev_pop(label).alias("std"))


def make_regression(df: DataFrame, transform: str = "none", min_score: float | None = None, score: str = "score"
                    ) -> tuple[DataFrame, DataFrame]:
    """Rows with label, the transformed score, and the statistics before the filter and after.

    log2 and log10 take score + 1; zscore is (score - mean) / (sample std + 1e-8) of the kept rows.
    """
    if transform not in ("log2", "log10", "zscore", "none"):
        raise ValueError(f"unknown transform {transform!r}: log2, log10, none, zscore")
    value = F.col(score).cast("double")
    kept = df if min_score is None else df.where(value >= min_score)
    if transform == "log2":
        out = kept.withColumn("label", F.log2(value + 1))
    elif transform == "log10":
        out = kept.withColumn("label", F.log10(value + 1))
    elif transform == "zscore":
        m = kept.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))).scalar()
        out = (kept.withColumn("_m", m)
               .withColumn("label", (value - F.col("_m.mean")) / (F.col("_m.std") + 1e-8)).drop("_m"))
    else:
        out = kept.withColumn("label", value)
    before = label_stats(df.select(value.alias("label"))).withColumn("stage", F.lit("before"))
    after = label_stats(out).withColumn("stage", F.lit("after"))
    return out, before.unionByName(after)


def split_dataset(df: DataFrame, key: str = "id", test: float = 0.2, val: float = 0.2, seed=42) -> DataFrame:
    """Adds split with exact sizes: test max(1, int(n*test)), val max(1, int((n - n_test)*val)), train the
    rest. Fewer than three rows are an error. The sizes and the two borders come from counts; the
    rows themselves are labelled where they are."""
    n = F.count(F.lit(1))
    sizes = df.agg(F.when(n < 3, F.raise_error(F.lit("a split needs at least 3 rows")).cast("long")).otherwise(n).alias("n"))
    n_test = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(test)))).cast("long")
    quotas = (sizes.withColumn("test", n_test)
              .withColumn("both", F.col("test") + F.greatest(F.lit(1), F.floor((F.col("n") - F.col("test")) * F.lit(float(val)))).cast("long"))
              .select("test", "both"))
    cuts = hash_cuts(df, key, seed, quotas, ["test", "both"]).select(F.struct("test", "both")).scalar()
    h = hash_order(seed, key)
    return (df.withColumn("_c", cuts)
            .withColumn("split", F.when(h <= F.col("_c.test"), "test").when(h <= F.col("_c.both"), "val").otherwise("train"))
            .drop("_c"))


def fit_scaling(df: DataFrame, method: str = "standardize", label: str = "label", split: str | None = "split") -> DataFrame:
    """One row of scaling parameters, fitted on the train split only: scaling_method and mean, std (sample)
    or min, max."""
    train = df.where(F.col(split) == "train") if split else df
    name = F.lit(method).alias("scaling_method")
    if method == "standardize":
        return train.agg(F.avg(label).alias("mean"), F.stddev_samp(label).alias("std")).select(name, "mean", "std")
    if method == "normalize":
        return train.agg(F.min(label).alias("min"), F.max(label).alias("max")).select(name, "min", "max")
    if method == "none":
        return df.sparkSession.range(1).select(name)
    raise ValueError(f"unknown scaling method {method!r}: standardize, normalize, none")


def _shift_and_size(params: DataFrame) -> tuple[str, str] | None:
    if "mean" in params.columns:
        return "mean", "std"
    return ("min", "range") if "min" in params.columns else None


def _scaled(df: DataFrame, params: DataFrame, col: str, fn) -> DataFrame:
    names = _shift_and_size(params)
    if names is None:
        return df
    size = F.col("std") if names[0] == "mean" else F.col("max") - F.col("min")
    row = params.select(F.struct(F.col(names[0]).alias("shift"), size.alias("size"))).scalar()
    return df.withColumn("_p", row).withColumn(col, fn(F.col(col), F.col("_p.shift"), F.col("_p.size"))).drop("_p")


def apply_scaling(df: DataFrame, params: DataFrame, label: str = "label") -> DataFrame:
    return _scaled(df, params, label, lambda x, shift, size: (x - shift) / size)


def inverse_scale(df: DataFrame, params: DataFrame | None, col: str = "score", classifier: bool = False) -> DataFrame:
    """Scores back in label units; a classifier's are never changed."""
    if classifier or params is None:
        return df
    return _scaled(df, params, col, lambda x, shift, size: x * size + shift)


def inverse_delta(df: DataFrame, params: DataFrame | None, col: str, classifier: bool = False) -> DataFrame:
    """Differences of scores in label units: the size without the shift."""
    if classifier or params is None:
        return df
    return _scaled(df, params, col, lambda x, _, size: x * size)


def units(method: str | None, inverted: bool, classifier: bool = False, known: bool = True) -> str:
    """label, training_scale or unknown."""
    if inverted or classifier:
        return "label"
    if not known:
        return "unknown"
    return "label" if method in (None, "none") else "training_scale"


def infer_task(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: task (classification when all labels are 0 or 1), n, n_classes, single_class."""
    x = F.col(label).cast("double")
    return df.agg(
        F.when(F.bool_and(x.isin(0.0, 1.0)), "classification").otherwise("regression").alias("task"),
        F.count(F.lit(1)).alias("n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")).select(
        "task", "n", (F.col("_lo") == F.col("_hi")).alias("single_class"))


