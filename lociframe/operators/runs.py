"""Training logs: best epoch per run and runs that did not learn."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A classifier with a constant output of 0.5 has a loss of ln 2.
LN2 = math.log(2.0)
LOSS_TOLERANCE = 0.005
AUC_TOLERANCE = 0.05


def finite(col) -> Column:
    """The value as a double, NULL when blank, not a number or infinite."""
    value = F.col(col) if isinstance(col, str) else col
    value = value.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def rows_of_this_run(rows: DataFrame, before: DataFrame, by: str = "run", row_no: str = "row_no") -> DataFrame:
    """rows without the leading rows a run's file already held.

    before holds the earlier content under the same columns. A run's first rows are dropped only if
    they repeat that content, more rows follow, and the first new row does not lie after the last
    old one in (epoch, step). Only counts and two positions per run are aggregated.
    """
    values = [c for c in before.columns if c not in (by, row_no)]
    old = before.select(by, row_no, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_old_{c}") for c in values])
    differs = F.lit(False)
    for c in values:
        differs = differs | (F.coalesce(F.col(c).cast("string"), F.lit("")) != F.col(f"_old_{c}"))
    sizes = before.groupBy(by).agg(F.count(F.lit(1)).alias("_m"))
    place = F.struct(F.coalesce(finite("epoch"), F.lit(0.0)), F.coalesce(finite("step"), F.lit(0.0)))
    facts = (rows.join(sizes, by).join(old, [by, row_no], "left")
             .groupBy(by, "_m").agg(
                 F.count(F.lit(1)).alias("_rows"),
                 F.count_if((F.col(row_no) < F.col("_m")) & differs).alias("_changed"),
                 F.max(F.when(F.col(row_no) == F.col("_m"), place)).alias("_first_new"),
                 F.max(F.when(F.col(row_no) == F.col("_m") - 1, place)).alias("_last_old")))
    drop = facts.where((F.col("_rows") > F.col("_m")) & (F.col("_changed") == 0)
                       & (F.col("_first_new") <= F.col("_last_old"))).select(by, "_m")
    return (rows.join(drop, by, "left")
            .where(F.col("_m").isNull() | (F.col(row_no) >= F.col("_m"))).drop("_m"))


def best_epoch(rows: DataFrame, by: str = "run", epoch: str = "epoch", loss: str = "val_loss",
               also: tuple[str, ...] = ("val_acc", "val_auc")) -> DataFrame:
    """Per run the row of the least finite val_loss (the first logged on ties) and epochs_run.

    Rows with a blank epoch or loss are no candidates; a run without any gives no row.
    """
    order = F.col("row_no") if "row_no" in rows.columns else F.col(epoch)
    present = [c for c in also if c in rows.columns]
    row = F.struct(finite(loss).alias("val_loss"), *[finite(c).alias(c) for c in present],
                   finite(epoch).cast("long").alias("best_epoch"))
    candidate = finite(loss).isNotNull() & finite(epoch).isNotNull()
    return (rows.groupBy(by).agg(
        F.min_by(row, F.when(candidate, F.struct(finite(loss), order))).alias("b"),
        (F.max(finite(epoch)).cast("long") + 1).alias("epochs_run"),
        F.count_if(candidate).alias("_n"))
        .where(F.col("_n") > 0).select(by, "b.*", "epochs_run"))


def dead_run(rows: DataFrame, by: str = "run", epoch: str = "epoch", loss: str = "val_loss",
             auc: str | None = "val_auc") -> DataFrame:
    """Per run whether a classifier stayed at the loss of a constant output.

    Dead: every logged loss lies within 0.005 of ln 2, or the best epoch is the first, later ones
    did not improve on it, and its loss lies within 0.005 of ln 2; and the best epoch's AUC, if
    logged, lies within 0.05 of 0.5.
    """
    best = best_epoch(rows, by, epoch, loss, (auc,) if auc else ())
    logged = rows.where(finite(loss).isNotNull() & finite(epoch).isNotNull())
    span = logged.groupBy(by).agg(
        F.bool_and(F.abs(finite(loss) - LN2) <= LOSS_TOLERANCE).alias("_flat"),
        F.min(finite(epoch).cast("long")).alias("_first"), F.max(finite(epoch).cast("long")).alias("_last"))
    stuck = ((F.col("best_epoch") == F.col("_first")) & (F.col("_last") > F.col("_first"))
             & (F.abs(F.col("val_loss") - LN2) <= LOSS_TOLERANCE))
    near = (F.coalesce(F.abs(F.col(auc) - 0.5) < AUC_TOLERANCE, F.lit(True)) if auc else F.lit(True))
    return best.join(span, by).withColumn("dead", (F.col("_flat") | stuck) & near).drop("_flat", "_first", "_last")
