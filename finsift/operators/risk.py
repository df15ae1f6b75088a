"""Risk of documents and records: scores, levels, factors, routing and summaries, each one projection or aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsift.functions import lexicon as L
from finsift.functions.numeric import outlier_share


def features(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """docs with what the scores need: lower-case text, entity counts, amounts and pattern counts."""
    text = F.col(text_col)
    out = docs.withColumns({"low": F.lower(text), "money": F.array_distinct(F.transform(L.hits(text, L.MONEY), F.lower)), "orgs": F.array_distinct(L.hits(text, L.ORGANISATION)), "amounts": L.amounts(text)})
    return out.withColumns(
        {
            "hit_counts": L.hit_counts(F.col("low")),
            "n_terms": F.expr(L.sql_distinct_terms("low", L.FINANCIAL_TERMS)),
            "n_indicators": F.expr(L.sql_distinct_terms("low", L.FRAUD_TERMS)),
            "n_orgs": F.size("orgs"),
            "n_money": F.size("money"),
            "largest": F.coalesce(F.array_max("amounts"), F.lit(0.0)),
            "n_amounts": F.size(F.array_distinct("amounts")),
            "n_percentages": F.regexp_count(text, F.lit(L.PERCENTAGE)),
            "n_dates": F.regexp_count(text, F.lit(L.DATES)),
            "n_money_factor": F.size(L.hits(text, L.MONEY_FACTOR)),
        }
    )


def relationship_scores(relations: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_relations, n_suspicious, relationship) from (id, predicate, relation_type)."""
    weighted = relations.withColumn("w", F.expr(L.sql_relation_weight("relation_type", "predicate")))
    out = weighted.groupBy(id_col).agg(F.count("*").cast("int").alias("n_relations"), F.sum(F.col("relation_type").isin(*L.RELATION_WEIGHTS).cast("int")).cast("int").alias("n_suspicious"), F.sum("w").alias("total"))
    return out.select(id_col, "n_relations", "n_suspicious", F.expr("least(1e0, total / greatest(1e0, 0.5e0 * n_relations))").alias("relationship"))


def relationship_columns(rels: Column) -> dict[str, Column]:
    """The same of a row's own array of (predicate, relation_type), without a shuffle."""
    weights = F.create_map(*(F.lit(x) for pair in L.RELATION_WEIGHTS.items() for x in pair))
    n = F.size(rels)
    each = lambda a, r: a + F.coalesce(F.try_element_at(weights, r["relation_type"]), F.lit(0.0)) + F.when(F.lower(r["predicate"]).isin(*L.SUSPICIOUS_PREDICATES), 0.3).otherwise(0.0)
    score = F.least(F.lit(1.0), F.aggregate(rels, F.lit(0.0), each) / F.greatest(F.lit(1.0), 0.5 * n))
    return {"n_relations": n, "n_suspicious": F.size(F.filter(rels, lambda r: r["relation_type"].isin(*L.RELATION_WEIGHTS))), "relationship": F.when(n > 0, score).otherwise(0.0)}


def document_risk(featured: DataFrame, relations: DataFrame | Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """featured with the four components (0 to 1), overall and its level.

    relations: a table (id, predicate, relation_type), or an array column of such pairs in featured, which needs no shuffle.
    """
    if isinstance(relations, Column):
        featured = featured.withColumns(relationship_columns(relations))
    elif relations is not None:
        featured = featured.join(relationship_scores(relations, id_col), id_col, "left").na.fill(0, ["n_relations", "n_suspicious", "relationship"])
    elif "relationship" not in featured.columns:
        featured = featured.withColumns({"n_relations": F.lit(0), "n_suspicious": F.lit(0), "relationship": F.lit(0.0)})
    out = featured.withColumns(
        {
            "fraud": L.fraud_score(F.col("hit_counts"), F.col("n_indicators")),
            "entity": F.expr(L.sql_entity_score("n_terms", "n_indicators", "n_orgs", "n_money")),
            "financial": F.expr(L.sql_financial_score("largest", "n_amounts", "n_percentages", "n_dates")),
        }
    )
    out = out.withColumn("overall", F.expr(L.sql_overall("fraud", "entity", "financial", "relationship")))
    return out.withColumn("risk_level", F.expr(L.sql_level("overall")))


def _listed(*items: Column, default: str) -> Column:
    some = F.filter(F.array(*items), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(default)))


def document_factors(scored: DataFrame) -> DataFrame:
    """scored with risk_factors."""
    # The messages.
    found = F.filter(F.array(*map(F.lit, L.SEVERITY)), lambda _, i: F.get("hit_counts", i) > 0)
    entity = F.col("entity") > 0.4
    factors = _listed(
        F.when((F.col("fraud") > 0.5) & (F.size(found) > 0), F.concat(F.lit("High-risk keywords detected: "), F.array_join(F.slice(found, 1, 3), ", "))),
        F.when(entity & (F.col("n_indicators") > 0), F.format_string("Fraud indicators found: %d instances", "n_indicators")),
        F.when(entity & (F.col("n_terms") > 5), F.format_string("Complex financial structures: %d terms", "n_terms")),
        F.when(entity & (F.col("n_orgs") > 3), F.format_string("Multiple organizations involved: %d entities", "n_orgs")),
        F.when((F.col("financial") > 0.3) & (F.col("n_money_factor") > 0), F.format_string("Large financial amounts: %d transactions", "n_money_factor")),
        F.when((F.col("relationship") > 0.3) & (F.col("n_suspicious") > 0), F.format_string("Suspicious relationships: %d connections", "n_suspicious")),
        default="No significant risk factors detected",
    )
    return scored.withColumn("risk_factors", factors)


def document_routing(scored: DataFrame) -> DataFrame:
    """scored with priority, recommended_agents and processing_hints, by the rounded score."""
    score = F.round("overall", 2)
    # The names of agents and hints.
    agents = _listed(
        F.when(score >= 80, F.lit("fraud_investigation_agent")).when(score >= 60, F.lit("risk_assessment_agent")),
        F.when(F.col("n_terms") > 5, F.lit("nlp_disclosure_agent")),
        F.when(F.col("n_relations") > 3, F.lit("graph_linkage_agent")),
        F.when(F.col("n_indicators") > 0, F.lit("fraud_detection_agent")),
        default="general_analysis_agent",
    )
    hints = F.filter(F.array(F.when(F.col("n_terms") > 5, F.lit("complex_financial_language")), F.when(F.col("n_relations") > 3, F.lit("complex_entity_relationships")), F.when(F.col("n_indicators") > 0, F.lit("fraud_indicators_present"))), lambda x: x.isNotNull())
    return scored.withColumns({"priority": F.when(score >= 80, "critical").when(score >= 60, "high").otherwise("normal"), "recommended_agents": agents, "processing_hints": hints, "requires_investigation": score >= 60})


def risk_summary(scored: DataFrame, score_col: str = "overall", level_col: str = "risk_level") -> DataFrame:
    """One row, of scores rounded to two places: totals, extremes, median and a count for each level, zeros included."""
    rounded = scored.select(F.round(score_col, 2).alias("score"), F.col(level_col).alias("level"))
    # All of it follows from how often each rounded score occurs, of which there are 10,001 at most: one pass, one row.
    s, n = F.col("score"), F.col("n")
    by_score = rounded.groupBy("score", "level").agg(F.count("*").alias("n"))
    levels = [F.coalesce(F.sum(F.when(F.col("level") == name, n)), F.lit(0)).alias(f"n_{name.lower()}") for name in (*(x for x, _ in L.LEVELS), "MINIMAL")]
    held = F.when(s.isNotNull(), n)
    one = by_score.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.max(s).alias("highest"), F.min(s).alias("lowest"), F.coalesce(F.sum(F.when(s >= 60, n)), F.lit(0)).alias("n_high_risk"), *levels,
        F.sum(held).alias("_rows"), F.try_divide(F.sum(s * n), F.sum(held)).alias("_mean"), F.sort_array(F.collect_list(F.when(s.isNotNull(), F.struct(s.alias("s"), n.alias("n"))))).alias("_scores"),
    )
    spread = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x["n"] * (x["s"] - F.col("_mean")) * (x["s"] - F.col("_mean")))

    def place(p):
        """The score at a place, counted from 0."""
        start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(None).cast("double").alias("v"))
        return F.aggregate("_scores", start, lambda a, x: F.struct((a["to"] + x["n"]).alias("to"), F.when((a["to"] <= p) & (p < a["to"] + x["n"]), x["s"].cast("double")).otherwise(a["v"]).alias("v")), lambda a: a["v"])

    middle = (F.col("_rows") - 1) / F.lit(2.0)
    median = (place(F.floor(middle)) + place(F.ceil(middle))) / 2
    return one.select("total", F.round("_mean", 2).alias("average"), "highest", "lowest", F.round(F.sqrt(F.try_divide(spread, F.col("_rows"))), 2).alias("deviation"), "n_high_risk", *(f"n_{x.lower()}" for x in (*(x for x, _ in L.LEVELS), "MINIMAL")), F.round(median, 2).alias("median"))


def level_shares(scored: DataFrame, level_col: str = "risk_level") -> DataFrame:
    """(risk_level, n, percent) of all levels, those without rows too."""
    total = F.count("*")
    names = [*(n for n, _ in L.LEVELS), "MINIMAL"]
    counts = scored.agg(total.alias("total"), *(F.count_if(F.col(level_col) == n).alias(n) for n in names))
    rows = F.array(*(F.struct(F.lit(n).alias("risk_level"), F.col(n).alias("n"), F.coalesce(F.try_divide(F.col(n) * 100.0, F.col("total")), F.lit(0.0)).alias("percent")) for n in names))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def high_risk(scored: DataFrame, n: int | None = 10, score_col: str = "overall", id_col: str = "doc_id", least: float = 60) -> DataFrame:
    """The rows with the highest scores, of those whose rounded score is at least `least`.

    The bound comes after the limit, which gives the same rows: before it, Spark would move it below the scores and
    compute them there once for every place that names them. Without a limit the scores are written first.
    """
    from finsift.storage import written

    score = F.round(score_col, 2)
    if n:
        return scored.orderBy(F.desc(score), id_col).limit(n).where(score >= least)
    return written(scored, "scored").where(score >= least).orderBy(F.desc(score), id_col)


def with_failures(docs: DataFrame, scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, overall, risk_level) of every document; those that could not be scored have 0 and UNKNOWN."""
    out = docs.select(id_col).join(scored.select(id_col, "overall", "risk_level"), id_col, "left")
    return out.select(id_col, F.coalesce("overall", F.lit(0.0)).alias("overall"), F.coalesce("risk_level", F.lit("UNKNOWN")).alias("risk_level"))


def record_risk(predictions: DataFrame, ensemble: DataFrame, features: DataFrame | None = None, id_col: str = "record_id") -> DataFrame:
    """Risk of records from long predictions (id, model, pred, prob), (id, probability) and optional (id, features array)."""
    models = predictions.groupBy(id_col).agg(F.avg("pred").alias("agreement_ratio"), F.avg("prob").alias("mean_prob"), F.stddev_pop("prob").alias("std_prob"), F.count_if(F.col("prob") >= 0.8).alias("n_confident"))
    out = ensemble.join(models, id_col, "left")
    out = out.join(features, id_col, "left").withColumn("anomaly", F.coalesce(outlier_share(F.col("features")), F.lit(0.0))) if features is not None else out.withColumn("anomaly", F.lit(0.0))
    p = F.col("probability")
    out = out.withColumns({"confidence": 100 * p, "agreement": F.coalesce(100 * F.col("agreement_ratio"), F.lit(50.0)), "strength": F.coalesce(100 * F.col("mean_prob") * (1 - F.least(F.col("std_prob"), F.lit(0.5))), 100 * p)})
    w = L.RECORD_WEIGHTS
    out = out.withColumn("overall", sum(F.lit(w[k]) * F.col(k) for k in w)).withColumn("risk_level", F.expr(L.sql_level("overall")))
    ratio = F.coalesce("agreement_ratio", F.lit(0.0))
    # The messages.
    factors = _listed(
        F.when(p >= 0.8, F.format_string("Very high fraud probability: %.2f%%", F.bround(p * 100, 2))).when(p >= 0.6, F.format_string("High fraud probability: %.2f%%", F.bround(p * 100, 2))),
        F.when(ratio >= 0.8, F.format_string("Strong model consensus: %.0f%% agreement", F.bround(ratio * 100, 0))).when(ratio >= 0.6, F.format_string("Moderate model consensus: %.0f%% agreement", F.bround(ratio * 100, 0))),
        F.when(F.col("n_confident") >= 3, F.format_string("%d models show high confidence", "n_confident")),
        F.when(F.col("anomaly") >= 50, F.lit("Significant feature anomalies detected")),
        default="Standard risk assessment",
    )
    return out.withColumns({"risk_factors": factors, "requires_investigation": F.col("overall") >= 80})


def record_routing(scored: DataFrame) -> DataFrame:
    s, ratio = F.round("overall", 2), F.round(F.coalesce("agreement_ratio", F.lit(0.0)), 2)
    lit = lambda *xs: F.array(*map(F.lit, xs))
    base = F.when(s >= 80, lit("fraud_investigation_agent", "alert_agent")).when(s >= 60, lit("fraud_detection_agent", "risk_assessment_agent")).when(s >= 40, lit("risk_assessment_agent")).otherwise(lit("general_analysis_agent"))
    hints = F.array(F.when(s >= 80, "immediate_review_required").when(s >= 60, "priority_review"), F.when(ratio >= 0.8, "high_model_consensus").when(ratio <= 0.4, "low_model_consensus_needs_review"))
    return scored.withColumns({"recommended_agents": F.sort_array(F.concat(base, lit("statistical_analysis_agent"))), "priority": F.when(s >= 80, "critical").when(s >= 60, "high").when(s >= 40, "normal").otherwise("low"), "processing_hints": F.filter(hints, lambda x: x.isNotNull())})
