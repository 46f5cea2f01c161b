"""Features and a boosted-tree model of daily boardings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

FEATURES = ("stop", "dow", "month", "lag_7", "lag_30", "mean_7", "mean_14", "stop_mean")


def features(daily: DataFrame) -> DataFrame:
    """Lags by rows, rolling means of the days before, and the stop's mean. ``daily`` has stop, day, boardings."""
    w = Window.partitionBy("stop").orderBy("day")
    return daily.withColumns({
        "dow": F.weekday("day"), "month": F.month("day"),
        "lag_7": F.coalesce(F.lag("boardings", 7).over(w), F.lit(0.0)), "lag_30": F.coalesce(F.lag("boardings", 30).over(w), F.lit(0.0)),
        "mean_7": F.coalesce(F.avg("boardings").over(w.rowsBetween(-7, -1)), F.lit(0.0)), "mean_14": F.coalesce(F.avg("boardings").over(w.rowsBetween(-14, -1)), F.lit(0.0)),
        "stop_mean": F.avg("boardings").over(Window.partitionBy("stop")),
    })


def clipped(rows: DataFrame, column: str, quantile: float = 0.995) -> DataFrame:
    """Values above an exact quantile become that quantile."""
    top = ranks.quantile(rows, column, quantile)
    return rows if top is None else rows.withColumn(column, F.least(column, F.lit(top)))


def dense_codes(rows: DataFrame, column: str, code: str) -> DataFrame:
    """Adds the rank of each distinct value among all, from 0; whether the values are broadcast is left to their size."""
    values = ranks.placed(rows.select(column).distinct(), [F.col(column).asc_nulls_first()], code)
    return rows.join(values.withColumn(code, F.col(code).cast("int")), column)


def train(rows: DataFrame, rounds: int = 20, depth: int = 5, seed: int = 7):
    """Boosted trees on log1p of the boardings; returns the model and the scores on the held-out fifth of rows: ``mae``, ``rmse``
    and ``r2`` in boardings, and ``log_mae``, ``log_rmse`` and ``log_r2`` of their logarithms."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("label", F.log1p("boardings")))
    held = F.pmod(F.xxhash64("stop", "day"), F.lit(5)) == 0
    model = GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed).fit(data.where(~held).select("features", "label"))
    return model, scores(predict(model, data.where(held)))


def scores(scored: DataFrame) -> dict[str, float]:
    """Errors of ``prediction`` against ``boardings``, as they are and as logarithms."""
    def of(actual, predicted, prefix):
        error = predicted - actual
        sse, n = F.sum(error * error), F.count(F.lit(1))
        sst = F.sum(actual * actual) - F.sum(actual) * F.sum(actual) / n
        return [F.avg(F.abs(error)).alias(f"{prefix}mae"), F.sqrt(sse / n).alias(f"{prefix}rmse"), (1 - F.try_divide(sse, sst)).alias(f"{prefix}r2")]

    logs = of(F.log1p("boardings"), F.log1p("prediction"), "log_")
    return scored.agg(*of(F.col("boardings"), F.col("prediction"), ""), *logs).first().asDict()


def predict(model, rows: DataFrame) -> DataFrame:
    """Adds ``prediction``, in boardings and never below 0."""
    return model.transform(rows).withColumn("prediction", F.greatest(F.lit(0.0), F.expm1("prediction")))
