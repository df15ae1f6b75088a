"""Descriptive statistics. Each takes one pass over the table; global thresholds are one-row aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finsift.functions.text import first_digit


def _unpivoted(one_row: DataFrame, columns: list[str], stats: list[str]) -> DataFrame:
    """(column, stats...) from one row of `column__stat` values."""
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}__{s}`").alias(s) for s in stats)) for c in columns))
    return one_row.select(F.explode(rows).alias("r")).select("r.*")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [c for c, t in df.dtypes if c not in exclude and (t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"))]


def dtype_histogram(df: DataFrame) -> dict[str, int]:
    kinds = [t for _, t in df.dtypes]
    return {t: kinds.count(t) for t in sorted(set(kinds))}


def missing_rates(df: DataFrame, top: int | None = 10) -> DataFrame:
    one = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"{c}__rate") for c in df.columns))
    out = _unpivoted(one, df.columns, ["rate"]).orderBy(F.desc("rate"), "column")
    return out.limit(top) if top else out


def ranges_of(spark) -> int:
    """Ranges to sort apart: four for each shuffle partition, whose number goes with the data, from 64 to 4096."""
    return max(64, min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def in_ranges(counted: DataFrame, keys: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """counted with `range`, 0 and up in the order of value: about as many rows in each range of a key.

    The ends come from a sketch of bounded size, so that no range depends on how values are spread.
    """
    ranges = ranges or ranges_of(counted.sparkSession)
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    ends = counted.groupBy(*keys).agg(F.percentile_approx(value, shares, 10_000).alias("ends"))
    placed = counted.join(F.broadcast(ends), keys) if keys else counted.crossJoin(F.broadcast(ends))
    placed = placed.withColumn("range", F.lit(0))
    for step in (1 << i for i in reversed(range(ranges.bit_length()))):  # bisection, in compiled code; ends[i] is null beyond the last
        placed = placed.withColumn("range", F.col("range") + F.when(F.get("ends", F.col("range") + (step - 1)) < F.col(value), step).otherwise(0))
    return placed.drop("ends")


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(column, share, value): interpolated between the two nearest values, as an exact percentile is; nulls left out.

    Equal values are counted first. Counts are added up by ranges of values, and only the ranges that hold a wanted
    place are put in order. So no task sees all values of a column.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns))).alias("x")).select("x.*").where("value IS NOT NULL")
    ranged = in_ranges(long.groupBy("column", "value").agg(F.count("*").alias("n")), ["column"], "value")
    totals = ranged.groupBy("column", "range").agg(F.sum("n").alias("n"))  # a few rows a column
    upto = totals.withColumn("to", F.sum("n").over(W.partitionBy("column").orderBy("range"))).withColumn("all", F.sum("n").over(W.partitionBy("column")))
    asked = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share")) for q in shares)))
    wanted = upto.select("column", "range", (F.col("to") - F.col("n")).alias("before"), "to", asked.alias("q"), "all").select("column", "range", "before", "to", "q.share", ((F.col("all") - 1) * F.col("q.share")).alias("place"))
    wanted = wanted.where("(floor(place) >= before AND floor(place) < to) OR (ceil(place) >= before AND ceil(place) < to)")
    needed = wanted.select("column", "range", "before").distinct()
    inside = ranged.join(F.broadcast(needed), ["column", "range"]).withColumn("to", F.col("before") + F.sum("n").over(W.partitionBy("column", "range").orderBy("value")))
    inside = inside.select("column", "range", "value", (F.col("to") - F.col("n")).alias("from"), "to")
    held = lambda x: F.max(F.when((x >= F.col("from")) & (x < F.col("to")), F.col("value")))
    place = F.col("place")
    found = inside.join(F.broadcast(wanted.select("column", "range", "share", "place")), ["column", "range"]).groupBy("column", "share").agg(held(F.floor(place)).alias("low"), held(F.ceil(place)).alias("high"), F.max("place").alias("place"))
    part = F.col("place") - F.floor("place")
    return found.select("column", "share", F.when(part == 0, F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high")).alias("value"))


def _quantile_columns(df: DataFrame, columns: list[str], named: dict[str, float]) -> DataFrame:
    """(column, one value for each name)."""
    found = exact_quantiles(df, columns, list(named.values()))
    return found.groupBy("column").agg(*(F.max(F.when(F.col("share") == q, F.col("value"))).alias(name) for name, q in named.items()))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, variance, min, quartiles and max of each column, nulls left out."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "variance": F.var_samp, "min": F.min, "max": F.max}
    one = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{s}") for c in columns for s, f in stats.items()))
    quarters = _quantile_columns(df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    out = _unpivoted(one, columns, list(stats)).join(F.broadcast(quarters), "column", "left")
    return out.select("column", "count", "mean", "std", "variance", "min", "p25", "p50", "p75", "max")


def moments(df: DataFrame, columns: list[str], corrected: bool = True) -> DataFrame:
    """Skewness and excess kurtosis of each column: corrected for bias, or not."""
    out = []
    for c in columns:
        n, g1, g2 = F.count(c), F.skewness(c), F.kurtosis(c)
        if corrected:
            out += [(g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))).alias(f"{c}__skewness"), (((n + 1) * g2 + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))).alias(f"{c}__kurtosis")]
        else:
            out += [g1.alias(f"{c}__skewness"), g2.alias(f"{c}__kurtosis")]
    return _unpivoted(df.agg(*out), columns, ["skewness", "kurtosis"])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for each pair of columns, pairwise complete."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def label_correlations(df: DataFrame, columns: list[str], label: str, top: int = 15) -> DataFrame:
    one = df.agg(*(F.corr(c, label).alias(f"{c}__r") for c in columns))
    return _unpivoted(one, columns, ["r"]).orderBy(F.desc_nulls_last("r"), "column").limit(top)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """(bin, n) over equal widths from the least to the largest value; the last bin holds its upper end."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    at = F.least(F.floor((F.col(column) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.when(F.col("high") > F.col("low"), at).otherwise(0).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def kde(df: DataFrame, column: str, points: int = 200, nodes: int = 2048) -> DataFrame:
    """(point, x, density): a Gaussian kernel density from the least to the largest value, with Scott's bandwidth.

    Values are shared linearly between the two nearest of `nodes` places, and their sums are convolved with the kernel: one
    pass over the rows, then work of a fixed size. Nulls are left out; a constant column has no density.
    """
    v = F.col(f"`{column}`").cast("double")
    values = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("s"), F.count("*").alias("n")).where("high > low")
    at = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * (nodes - 1)
    placed = values.crossJoin(F.broadcast(ends)).select(F.floor(at).cast("int").alias("i"), (at - F.floor(at)).alias("w"))  # one row of ends
    sums = placed.groupBy("i").agg(F.sum(1 - F.col("w")).alias("a"), F.sum("w").alias("b"))
    both = sums.select("i", F.col("a").alias("w")).unionByName(sums.select((F.col("i") + 1).alias("i"), F.col("b").alias("w")))
    held = both.groupBy("i").agg(F.sum("w").alias("w")).where("w > 0").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("held"))  # at most `nodes`
    one = ends.crossJoin(F.broadcast(held)).withColumn("h", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    grid = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / F.lit(float(points - 1)))
    step = (F.col("high") - F.col("low")) / F.lit(float(nodes - 1))
    gap = lambda e: (F.col("x") - F.col("low") - e["i"] * step) / F.col("h")
    total = F.aggregate("held", F.lit(0.0), lambda a, e: a + e["w"] * F.exp(-0.5 * gap(e) * gap(e)))
    return grid.select("point", "x", (total / (F.col("n") * F.col("h") * F.sqrt(F.lit(2 * math.pi)))).alias("density"))


def pair_sample(df: DataFrame, columns: list[str], label: str | None = None, rows: int = 1000, seed: int = 42) -> DataFrame:
    """At most `rows` rows of a pair plot's columns, those with the smallest hashes: the same on every run."""
    keep = [*columns, *([label] if label else [])]
    order = F.xxhash64(*(f"`{c}`" for c in df.columns), F.lit(seed))
    return df.select(*(f"`{c}`" for c in keep), order.alias("_order")).orderBy("_order").limit(rows).drop("_order")


def boxplot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, 1.5 IQR fences and the number of outliers of each column."""
    quarters = _quantile_columns(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    quarters = quarters.withColumns({"low": F.expr("q1 - 1.5 * (q3 - q1)"), "high": F.expr("q3 + 1.5 * (q3 - q1)")})
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")
    counted = long.join(F.broadcast(quarters), "column", "left").groupBy("column").agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("outliers"))
    return quarters.join(F.broadcast(counted), "column").select("column", "q1", "median", "q3", "low", "high", "outliers")


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value of each column occurs, nulls left out, in one pass."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def rate(df: DataFrame, flag: str) -> DataFrame:
    """One row: the number of flagged rows and their percentage."""
    return df.agg(F.count_if(F.col(flag) == 1).alias("n_flagged"), (100 * F.avg(F.col(flag).cast("double"))).alias("percent"))


def benford_digits(df: DataFrame, column: Column) -> DataFrame:
    """(digit, observed, expected) for all nine digits."""
    digits = df.select(first_digit(column).alias("digit")).where("digit IS NOT NULL").groupBy("digit").agg(F.count("*").alias("n"))
    nine = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    total = digits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    out = nine.join(F.broadcast(digits), "digit", "left").crossJoin(F.broadcast(total))  # nine rows at most
    return out.select("digit", F.coalesce("n", F.lit(0)).alias("observed"), (F.col("total") * F.log10(1 + 1 / F.col("digit"))).alias("expected"))


def benford_chi2(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, n, chi2) of each column's first digits; chi2 is null without digits."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("column"), first_digit(c).alias("digit")) for k, c in columns.items()))).alias("x")).select("x.*").where("digit IS NOT NULL")
    counts = long.groupBy("column").agg(F.count("*").alias("n"), *(F.count_if(F.col("digit") == d).alias(f"d{d}") for d in range(1, 10)))
    e = lambda d: F.col("n") * F.log10(F.lit(1 + 1 / d))
    return counts.select("column", "n", sum((F.col(f"d{d}") - e(d)) * (F.col(f"d{d}") - e(d)) / e(d) for d in range(1, 10)).alias("chi2"))


def benford_column(df: DataFrame, column: Column, to: str = "benford_chi2") -> DataFrame:
    """df with its chi-squared value of the column's first digits in every row."""
    one = benford_chi2(df, {"x": column}).agg(F.max("chi2").alias(to))
    return df.crossJoin(F.broadcast(one))  # one row
