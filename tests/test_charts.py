"""Charts: the density against its definition, and what the SVG holds."""

import re

import numpy as np

from finsift.operators import metrics as M
from finsift.operators import stats
from finsift.sources import plots


def test_density(spark):
    x = np.concatenate([np.random.default_rng(1).normal(0, 1, 300), np.random.default_rng(2).normal(5, 0.5, 100)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    rows = stats.kde(df, "v", 50).orderBy("point").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r.x for r in rows], grid) and np.allclose([r.density for r in rows], want, rtol=1e-3, atol=1e-6)
    assert stats.kde(spark.createDataFrame([(1.0,)] * 3, "v double"), "v").count() == 0 and stats.kde(df.limit(0), "v").count() == 0
    svg = plots.density_plot(stats.histogram(df.na.drop(), "v", 10), stats.kde(df, "v", 50), "v")
    assert sum(plots.values(svg)) == 400 and len(re.search('points="([^"]+)"', svg)[1].split()) == 50


def test_other_charts(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11), i % 2) for i in range(200)], "id int, a double, b double, label int")
    sample = stats.pair_sample(df, ["a", "b"], "label", 50)
    assert sample.count() == 50 and sorted(map(tuple, sample.collect())) == sorted(map(tuple, stats.pair_sample(df.repartition(5), ["a", "b"], "label", 50).collect()))
    svg = plots.pair_plot(sample, ["a", "b"], {c: stats.kde(df, c, 20) for c in ("a", "b")}, "pairs", "label")
    assert svg.count("<circle") == 100 and svg.count("<polyline") == 2
    told = spark.createDataFrame([("m", 0.9, 0.4), ("<n>", 0.5, None)], "model string, auc double, ap double")
    bars = plots.metric_plot(told, "metrics")
    assert plots.values(bars) == [0.5, 0.0, 0.9, 0.4] and "&lt;n&gt;" in bars
    curve = M.curve(spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, prob double"))
    points = re.search('points="([^"]+)"', plots.pr_plot(curve, "pr"))[1].split()
    assert len(points) == 2  # recall a half and whole
    digits = spark.createDataFrame([(d, 10 * d, 5.0) for d in range(1, 10)], "digit int, observed int, expected double")
    assert plots.values(plots.benford_plot(digits, "b"))[::2] == [10.0 * d for d in range(1, 10)]
