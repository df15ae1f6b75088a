"""Classification metrics and ensembles, from (label, pred, prob) rows.

Ranks and running sums go over distinct scores, after aggregation; ranges of scores are summed apart, so that no task
needs all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finsift.operators.stats import exact_quantiles, in_ranges


#: Models whose weights are looked up in the plan itself, at most.
MODELS = 1000


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(label, pred).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row; undefined ratios are 0."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    one = df.agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return one.select("n", ratio(tp + tn, F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def curve(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """(prob, pos, neg, tp, fp): counts at each score, and from the highest score down to it.

    Scores are summed within ranges that hold about as many scores each; only the ranges' totals, one row a range, are
    put in order by one task.
    """
    by_score = df.groupBy(F.col(prob).alias("prob")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    ranged = in_ranges(by_score, [], "prob")
    totals = ranged.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = W.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"))
    inside = W.partitionBy("range").orderBy(F.desc("prob")).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "range").select("prob", "pos", "neg", (F.sum("pos").over(inside) + F.col("p0")).alias("tp"), (F.sum("neg").over(inside) + F.col("n0")).alias("fp"))


def roc_auc(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Ties count half."""
    c = curve(df, label, prob)
    return c.agg((F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def average_precision(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """The step-wise sum over scores of recall gained times precision."""
    c = curve(df, label, prob)
    return c.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("ap"))


def exact_mean(x: Column) -> Column:
    """The mean by a sum that is rounded once, so that it doesn't hang on the order of rows: a mean of 0.5 is often one within an ulp.

    Multiples of 2**-24 and what is left of each value are summed apart, without rounding for values from 2**-10 to 1.
    """
    high = F.rint(x * F.lit(2.0**24)) / F.lit(2.0**24)
    low = F.when(F.abs(x) < 2.0**28, x - high).otherwise(0.0)
    return (F.sum(high) + F.sum(low)) / F.count(x)


def ensemble(predictions: DataFrame, weights: DataFrame | None = None, id_col: str = "record_id") -> DataFrame:
    """(id, probability, pred): mean of the models' probabilities, weighted by (model, auc) where given; no weight at all counts as 1."""
    if weights is None:
        out = predictions.groupBy(id_col).agg(exact_mean(F.col("prob").cast("double")).alias("probability"))
    else:
        few = weights.select("model", "auc").limit(MODELS + 1).collect()
        if len(few) <= MODELS:  # a look-up in place of a shuffle of all predictions
            known = F.create_map(*(F.lit(x) for r in few if r["model"] is not None and r["auc"] is not None for x in (r["model"], float(r["auc"])))) if few else F.create_map()
            out = predictions.withColumn("w", F.coalesce(F.try_element_at(known.cast("map<string,double>"), F.col("model")), F.lit(0.5)))
        else:
            out = predictions.join(weights, "model", "left").withColumn("w", F.coalesce("auc", F.lit(0.5)))
        total = F.sum("w")
        out = out.groupBy(id_col).agg((F.sum(F.col("prob") * F.col("w")) / F.when(total == 0, 1.0).otherwise(total)).alias("probability"))
    return out.withColumn("pred", (F.col("probability") > 0.5).cast("int"))


def percentile_flag(df: DataFrame, column: str, share: float = 0.95, above: bool = True) -> DataFrame:
    """df with threshold and flag, from the exact percentile, one row."""
    cut = exact_quantiles(df, [column], [share]).agg(F.max("value").alias("threshold"))
    flag: Column = F.col(column) > F.col("threshold") if above else F.col(column) < F.col("threshold")
    return df.crossJoin(F.broadcast(cut)).withColumn("flag", flag.cast("int"))


def probability_flag(df: DataFrame, column: str = "prob", least: float = 0.5) -> DataFrame:
    return df.withColumn("flag", (F.col(column) > least).cast("int"))


def scaled_score(df: DataFrame, column: str, negate: bool = False) -> DataFrame:
    """df with `prob`: the score (or its negative) on the range from 0 to 1 of all rows."""
    s = -F.col(column) if negate else F.col(column)
    ends = df.agg(F.min(s).alias("low"), F.max(s).alias("high"))
    return df.crossJoin(F.broadcast(ends)).withColumn("prob", (s - F.col("low")) / (F.col("high") - F.col("low") + F.lit(1e-8))).drop("low", "high")


def compared(results: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """A row of metrics for each named result (label, pred, prob), stacked, the best AUC first."""
    out = None
    for name, df in results.items():
        one = classification_metrics(df, label).crossJoin(F.broadcast(roc_auc(df, label))).crossJoin(F.broadcast(average_precision(df, label))).select(F.lit(name).alias("ensemble"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("auc"), "ensemble")


def appended(df: DataFrame, predictions: DataFrame, id_col: str, label: str | None = None) -> DataFrame:
    """df with fraud_predicted and fraud_probability, and with a label whether they agree."""
    out = df.join(predictions.select(id_col, F.col("pred").alias("fraud_predicted"), F.col("probability").alias("fraud_probability")), id_col, "left")
    return out if label is None else out.withColumn("correct_prediction", (F.col("fraud_predicted") == F.col(label)).cast("int"))
