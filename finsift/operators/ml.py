"""Trainers: Spark ML where it has the model, and anomaly scores on top. All return (id, score, flag) or a model."""

from __future__ import annotations

import functools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finsift.operators.metrics import percentile_flag, scaled_score
from finsift.operators.stats import ranges_of
from finsift.operators.vectors import nearest_batch, squared_distance
from finsift.storage import written

SUPERVISED = ("gbt", "random_forest", "decision_tree", "logistic", "linear_svm", "mlp", "xgboost", "lightgbm", "catboost", "lstm", "cnn", "svm")
#: Those of Spark ML that take a number of equal rows as a weight.
WEIGHTED = ("gbt", "decision_tree", "logistic", "linear_svm")
#: Detectors that are fitted once and saved.
FITTED_DETECTORS = ("autoencoder", "oneclass_svm")


def assembled(df: DataFrame, columns: list[str], to: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=to, handleInvalid="error").transform(df)


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n): equal rows once, with their number, for sums in which they give equal parts."""
    return df.groupBy(*(f"`{c}`" for c in columns)).agg(F.count("*").cast("double").alias("n"))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns scaled by mean and population deviation; a constant column becomes 0."""
    one = df.agg(*(f(c).alias(f"{c}__{s}") for c in columns for s, f in (("mean", F.avg), ("std", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(one))
    scaled = {c: (F.col(c) - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__std") > 0, F.col(f"{c}__std")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).select(df.columns)


def classifier(kind: str, label: str = "label", seed: int = 42):
    """An estimator for one of: gbt, random_forest, decision_tree, logistic, linear_svm."""
    common = {"labelCol": label, "featuresCol": "features"}
    made = {
        "gbt": lambda: GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.1, seed=seed, **common),
        "random_forest": lambda: RandomForestClassifier(numTrees=200, maxDepth=30, seed=seed, **common),
        "decision_tree": lambda: DecisionTreeClassifier(maxDepth=10, seed=seed, **common),
        "logistic": lambda: LogisticRegression(maxIter=1000, **common),
        "linear_svm": lambda: LinearSVC(maxIter=100, **common),
    }
    return made[kind]()


def trained(df: DataFrame, columns: list[str], kind: str, label: str = "label", **how):
    """A fitted model of any supervised kind, with transform(). how: settings of the engine's own kinds."""
    from finsift.operators import boosting, forests, machines, networks

    if kind in boosting.KINDS:
        return boosting.boosted(df, columns, label, kind, **how)
    if kind in ("lstm", "cnn"):
        return networks.fitted_network(kind, df, columns, label, **how)
    if kind == "svm":
        return machines.kernel_classifier(df, columns, label, **how)
    if kind == "random_forest" and (made := forests.forest(df, columns, label)) is not None:
        return made
    if kind == "mlp":
        return networks.perceptron(df, columns, label)
    scaling = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    if kind in WEIGHTED:
        scaled = Pipeline(stages=scaling).fit(df)
        own = classifier(kind, label).setWeightCol("n")
        return PipelineModel([*scaled.stages, own.fit(scaled.transform(counted(df, [*columns, label])))])
    return Pipeline(stages=[*scaling, classifier(kind, label)]).fit(df)


def split(df: DataFrame, id_col: str, test_percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the id: the same on every run."""
    bucket = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(100))
    return df.where(bucket >= test_percent), df.where(bucket < test_percent)


def stratified_split(df: DataFrame, id_col: str, label: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, of each label its share: the rows with the lowest hashes of the id, the same on every run."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    cuts = df.select(F.col(label).alias("_label"), order.alias("_h")).groupBy("_label").agg(F.percentile_approx("_h", test_share, 10_000).alias("_cut"))
    told = df.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_label"))).withColumn("_test", order <= F.col("_cut"))
    return tuple(told.where(F.col("_test") == t).drop("_label", "_cut", "_test") for t in (False, True))


def balanced(df: DataFrame, id_col: str, columns: list[str], label: str = "label", ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """(label, columns) of df and of synthetic rows that bring label 1 to ratio times label 0."""
    n = df.agg(F.count_if(F.col(label) != 1).alias("others"), F.count_if(F.col(label) == 1).alias("minority")).first()
    own = df.select(F.col(label).cast("int").alias(label), *(F.col(c).cast("double").alias(c) for c in columns))
    total = smote_total(n["others"], n["minority"], ratio)
    if not total:  # no row is to be made, so no neighbours are to be found
        return own
    minority = df.where(F.col(label) == 1).select(id_col, F.array(*(F.col(c).cast("double") for c in columns)).alias("v"))
    made = smote(minority, id_col, "v", seed=seed, total=total)
    return own.unionByName(made.select(F.lit(1).alias(label), *(F.col("v")[i].alias(c) for i, c in enumerate(columns))))


def predicted(kind: str, df: DataFrame, columns: list[str], id_col: str, model=None, label: str | None = None) -> DataFrame:
    """(id, pred, prob) from one model of any kind: a fitted classifier, or a detector that is fitted on df itself.

    The scores of detectors are scaled to 0 to 1 over all rows; a mixture's likelihood counts negative.
    """
    from finsift.operators import anomaly as A

    from finsift.operators.fitted import Fitted

    if isinstance(model, Fitted) and kind in FITTED_DETECTORS:
        return scaled_score(A.detected(model, df, id_col), "score").select(id_col, F.col("flag").alias("pred"), "prob")
    if isinstance(model, Fitted):
        return model.transform(df).select(id_col, F.col("prediction").cast("int").alias("pred"), "prob")
    if model is not None:
        out = model.transform(df.withColumns({c: F.col(c).cast("double") for c in columns}))
        # A model that has seen one class only has one probability, or none for label 1.
        second = lambda c: F.coalesce(F.try_element_at(vector_to_array(c), F.lit(2)), F.lit(0.0))
        prob = second("probability") if "probability" in out.columns else 1 / (1 + F.exp(-second("rawPrediction")))
        return out.select(id_col, F.col("prediction").cast("int").alias("pred"), prob.alias("prob"))
    made = {
        "kmeans": lambda: kmeans_anomaly(df, columns, id_col),
        "gmm": lambda: gmm_anomaly(df, columns, id_col),
        "pca_anomaly": lambda: pca_anomaly(df, columns, id_col),
        "isolation_forest": lambda: A.isolation_forest(df, columns, id_col),
        "dbscan": lambda: dbscan_scored(df, columns, id_col),
        "lof": lambda: A.local_outlier_factor(df, columns, id_col, label),
        "oneclass_svm": lambda: A.one_class_machine(df, columns, id_col, label),
        "autoencoder": lambda: A.autoencoder_anomaly(df, columns, id_col),
    }
    if kind not in made:
        raise ValueError(f"unknown model: {kind}")
    return scaled_score(made[kind](), "score", negate=kind == "gmm").select(id_col, F.col("flag").alias("pred"), "prob")


def dbscan_scored(df: DataFrame, columns: list[str], id_col: str, eps: float = 0.5, least: int = 5) -> DataFrame:
    """DBSCAN's flag, and as inference has it the distance to the row's 5th nearest row, itself included, as score."""
    from finsift.operators.anomaly import dbscan
    from finsift.operators.vectors import kth_distance

    found = dbscan(df, columns, id_col, eps, least).select(F.col(id_col).cast("long").alias("query_id"), "flag")
    vectors = standardised(df.select(id_col, *(F.col(f"`{c}`").cast("double").alias(c) for c in columns)), columns).select(F.col(id_col).cast("long").alias("vec_id"), F.array(*(f"`{c}`" for c in columns)).alias("embedding"))
    far = kth_distance(vectors, vectors, 5)
    out = found.join(far, "query_id").select("query_id", F.col("distance").alias("score"), "flag")
    return df.select(id_col).join(out, F.col(id_col).cast("long") == F.col("query_id")).select(id_col, "score", "flag")


def stacked(df: DataFrame, columns: list[str], id_col: str, models: dict[str, object], label: str | None = None) -> DataFrame:
    """(id, model, pred, prob) of several models; a model that is None is a detector."""
    each = [predicted(kind, df, columns, id_col, model, label).withColumn("model", F.lit(kind)) for kind, model in models.items()]
    return functools.reduce(DataFrame.unionByName, each).select(id_col, "model", "pred", "prob")


def train_all(df: DataFrame, columns: list[str], id_col: str, kinds: list[str], path: str, label: str = "label") -> dict[str, str]:
    """Fits each kind, writes its folder below path, and returns the folders.

    Classifiers learn from the train rows, balanced, and are measured on test rows that neither training nor balancing
    saw; detectors are fitted and measured on all rows.
    """
    from finsift.operators import metrics as M
    from finsift.operators.anomaly import fitted_detector
    from finsift.sources.sinks import write_model

    train, test = stratified_split(df, id_col, label)
    even = written(balanced(train, id_col, columns, label), "balanced") if any(k in SUPERVISED for k in kinds) else None
    folders = {}
    for kind in kinds:
        model = trained(even, columns, kind, label) if kind in SUPERVISED else fitted_detector(kind, df, columns, label) if kind in FITTED_DETECTORS else None
        rows = test if kind in SUPERVISED else df
        told = written(predicted(kind, rows, columns, id_col, model, label).join(rows.select(id_col, F.col(label).alias("label")), id_col), "told")
        one = M.compared({kind: told}).first().asDict()
        scores = {"accuracy": one["accuracy"], "precision": one["precision"], "recall": one["recall"], "f1_score": one["f1"], "auc_roc": one["auc"] if one["auc"] is not None else 0.5}
        folders[kind] = write_model(model, path, kind, scores, {"columns": ",".join(columns)}, M.confusion(told))
    return folders


def counted_vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """(features, n) of df's scaled rows, equal rows once."""
    return assembled(counted(standardised(df, columns), columns), columns)


def kmeans_anomaly(df: DataFrame, columns: list[str], id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Distance to the nearest centre; the farthest 5 % are flagged."""
    data = assembled(standardised(df, columns), columns)
    centres = [list(map(float, c)) for c in KMeans(k=k, seed=seed, weightCol="n").fit(counted_vectors(df, columns)).clusterCenters()]
    v = vector_to_array("features")
    scored = data.select(id_col, F.least(*(F.sqrt(squared_distance(v, F.array(*map(F.lit, c)))) for c in centres)).alias("score"))
    return percentile_flag(scored, "score", 0.95)


def gmm_anomaly(df: DataFrame, columns: list[str], id_col: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Log-likelihood under a mixture of Gaussians; the lowest 5 % are flagged."""
    import math

    import numpy as np

    data = assembled(standardised(df, columns), columns)
    model = GaussianMixture(k=k, seed=seed, weightCol="n").fit(counted_vectors(df, columns))
    v, d, terms = vector_to_array("features"), len(columns), []
    for weight, row in zip(model.weights, model.gaussiansDF.collect(), strict=True):
        mean, cov = row["mean"].toArray(), row["cov"].toArray() + 1e-9 * np.eye(d)
        low = np.linalg.inv(np.linalg.cholesky(cov))
        centred = F.zip_with(v, F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
        part = [F.aggregate(F.zip_with(centred, F.array(*map(F.lit, r.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for r in low]
        const = math.log(max(weight, 1e-300)) - 0.5 * d * math.log(2 * math.pi) + float(np.log(np.diag(low)).sum())
        terms.append(F.lit(const) - 0.5 * sum(p * p for p in part))
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    scored = data.select(id_col, (top + F.log(sum(F.exp(t - top) for t in terms))).alias("score"))
    return percentile_flag(scored, "score", 0.05, above=False)


def pca_anomaly(df: DataFrame, columns: list[str], id_col: str, keep: float = 0.95) -> DataFrame:
    """Mean squared reconstruction error from the components that explain `keep`; the largest 5 % are flagged."""
    data = assembled(standardised(df, columns), columns)
    model = PCA(k=len(columns), inputCol="features", outputCol="pc").fit(data)
    share, n = 0.0, 0
    for ratio in model.explainedVariance.toArray():
        n, share = n + 1, share + float(ratio)
        if share >= keep:
            break
    axes = model.pc.toArray()[:, :n]
    projector = (axes @ axes.T).tolist()
    v = vector_to_array("features")
    errors = [v[i] - F.aggregate(F.zip_with(v, F.array(*map(F.lit, row)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for i, row in enumerate(projector)]
    return percentile_flag(data.select(id_col, (sum(e * e for e in errors) / len(columns)).alias("score")), "score", 0.95)


def smote(minority: DataFrame, id_col: str, vector_col: str, copies: int = 1, k: int = 5, seed: int = 42, total: int | None = None, block: int = 10_000) -> DataFrame:
    """Synthetic rows between each minority row and one of its k nearest, chosen by hash.

    Each row gives `copies` of them; with `total`, all rows together give so many: equally, and one more by hash.
    """
    near = nearest_batch(minority, minority, k, id_col, vector_col, skip_self=True, block=block).select("query_id", "rank", F.col(id_col).alias("other"))
    draw = lambda salt: F.pmod(F.xxhash64("query_id", "copy", F.lit(salt + seed)), F.lit(1 << 20)) / float(1 << 20)
    picks = near.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "other"))).alias("near"))
    if total is not None:
        picks = picks.join(_shares(minority.select(F.col(id_col).alias("query_id")), total, seed), "query_id").where("copies > 0")
    else:
        picks = picks.withColumn("copies", F.lit(copies))
    picks = picks.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    picks = picks.select("query_id", "copy", F.try_element_at("near", (F.floor(draw(0) * F.size("near")) + 1).cast("int")).alias("other"), draw(1).alias("t"))
    a = minority.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("a"))
    b = minority.select(F.col(id_col).alias("other"), F.col(vector_col).alias("b"))
    out = picks.join(a, "query_id").join(b, "other")
    return out.select(F.col("query_id").alias("from_id"), "other", "copy", F.expr("zip_with(a, b, (x, y) -> x + t * (y - x))").alias(vector_col))


def smote_total(n_majority: int, n_minority: int, ratio: float = 0.5) -> int:
    """Synthetic rows that bring the minority to ratio times the majority; none where it is there already."""
    return max(0, int(n_majority * ratio - n_minority))


def _shares(ids: DataFrame, total: int, seed: int, buckets: int | None = None) -> DataFrame:
    """(query_id, copies), total copies in all: ranked by hash within buckets, so that no task gets all rows."""
    buckets = buckets or ranges_of(ids.sparkSession)
    order = F.xxhash64("query_id", F.lit(seed))
    dealt = ids.withColumn("bucket", F.pmod(order, F.lit(buckets)).cast("int"))
    counts = dict.fromkeys(range(buckets), 0) | {r["bucket"]: r["count"] for r in dealt.groupBy("bucket").count().collect()}
    n = max(1, sum(counts.values()))
    before = F.array(*(F.lit(sum(counts[i] for i in range(b))) for b in range(buckets)))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(order, "query_id")) + F.get(before, F.col("bucket"))
    return dealt.withColumn("rank", rank).select("query_id", (F.lit(total // n) + (F.col("rank") <= total % n).cast("int")).alias("copies"))
