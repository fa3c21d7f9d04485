"""Evaluation metrics as aggregates: set precision and recall, class metrics, paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def f1(precision: Column, recall: Column) -> Column:
    return F.round(F.try_divide(2 * precision * recall, precision + recall), 6)


def set_counts(gold: DataFrame, predicted: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key: sizes of both sets of items and of their intersection; keys of either side."""
    marked = gold.select(*keys, item, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*keys, item, F.lit(0).alias("g"), F.lit(1).alias("p")))
    items = marked.groupBy(*keys, item).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return items.groupBy(*keys).agg(F.sum("g").alias("gold"), F.sum("p").alias("predicted"), F.sum(F.col("g") * F.col("p")).alias("correct"))


def micro_prf(counts: DataFrame, by: list[str]) -> DataFrame:
    """Micro-averaged precision, recall and F1 of set_counts() within ``by``."""
    total = counts.groupBy(*by).agg(F.sum("gold").alias("gold"), F.sum("predicted").alias("predicted"), F.sum("correct").alias("correct"))
    p, r = F.try_divide(F.col("correct"), F.col("predicted")), F.try_divide(F.col("correct"), F.col("gold"))
    return total.select(*by, "gold", "predicted", "correct", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), f1(p, r).alias("f1"))


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """(gold, predicted, n) over the whole grid of ``labels``, zero cells included."""
    grid = pairs.sparkSession.createDataFrame([(g, p) for g in labels for p in labels], "gold string, predicted string")
    return grid.join(pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n")), ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(grid: DataFrame) -> DataFrame:
    """(label, support, tp, fp, fn, precision, recall, f1) one against the rest; a zero denominator gives null."""
    sides = grid.select(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("gold") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn"))
    other = grid.where("gold <> predicted").select(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    total = sides.unionByName(other).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return total.select("label", (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), f1(p, r).alias("f1"))
