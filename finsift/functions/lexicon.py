"""Lexicons, weights and patterns of the risk rules, and expressions over them.

Expressions that are plain SQL are built as text, so that the DataFrame operators and a SQL engine can share them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms with their severity, in order.
SEVERITY = {
    "fictitious": 0.95, "fabricated": 0.95, "concealment": 0.90, "material weakness": 0.90, "restatement": 0.85,
    "manipulation": 0.85, "misstatement": 0.80, "overstatement": 0.75, "understatement": 0.75, "round-trip": 0.70,
    "special purpose entity": 0.70, "off-balance sheet": 0.65, "related party": 0.60, "derivative": 0.55,
    "restructuring": 0.50, "write-off": 0.50, "write-down": 0.50, "impairment": 0.45, "goodwill": 0.40,
    "contingency": 0.35, "subsidiary": 0.30, "joint venture": 0.25, "revenue recognition": 0.20,
}
# The terms that count as entities.
FINANCIAL_TERMS = (
    "special purpose entity", "spe", "derivative", "goodwill", "restructuring", "restatement", "write-off", "write-down", "impairment", "round-trip",
    "revenue recognition", "accounts receivable", "liability", "subsidiary", "joint venture", "related party", "off-balance sheet", "contingency",
)
FRAUD_TERMS = ("fictitious", "fabricated", "manipulation", "misstatement", "overstatement", "understatement", "concealment", "material weakness", "restatement")
# Weights of relations and components, level bounds, verbs, labels.
RELATION_WEIGHTS = {"CONCEALED": 0.90, "TRANSFERRED": 0.70, "CREATED": 0.50, "OWNS": 0.40, "CONTROLS": 0.40, "MANAGES": 0.30}
SUSPICIOUS_PREDICATES = ("concealed", "hid", "transferred", "manipulated")
DOCUMENT_WEIGHTS = {"fraud": 0.35, "entity": 0.25, "financial": 0.25, "relationship": 0.15}
RECORD_WEIGHTS = {"confidence": 0.40, "agreement": 0.30, "strength": 0.20, "anomaly": 0.10}
LEVELS = (("CRITICAL", 80), ("HIGH", 60), ("MEDIUM", 40), ("LOW", 20))
VERBS = {"is": "IS", "has": "HAS", "owns": "OWNS", "manages": "MANAGES", "controls": "CONTROLS", "reports": "REPORTS_TO", "created": "CREATED", "transferred": "TRANSFERRED", "hid": "CONCEALED", "concealed": "CONCEALED"}
NODE_LABELS = {"PERSON": "Person", "ORG": "Company", "MONEY": "MonetaryAmount", "DATE": "Date", "GPE": "Location", "FINANCIAL_TERM": "FinancialTerm", "FRAUD_INDICATOR": "FraudIndicator"}
# Patterns, in a form that Java's and other regular expressions read alike.
MONEY = r"(?i)\$\s*\d+(?:\.\d+)?(?:\s*(?:million|billion|thousand|M|B|K))?"
MONEY_PARTS = r"(?i)\$\s*(\d+(?:\.\d+)?)(?:\s*(million|billion|thousand|M|B|K))?"
MONEY_FACTOR = r"(?i)\$\s*\d+(?:\.\d+)?(?:\s*(?:million|billion|M|B))?"
PERCENTAGE = r"\d+(?:\.\d+)?%"
DATES = r"(?i)\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"
ORGANISATION = r"[A-Z][a-z]+ (?:Corp|Inc|Ltd|LLC)"

# Names of places that the rules know.
PLACES = (
    "Algeria", "Argentina", "Australia", "Austria", "Belgium", "Bermuda", "Brazil", "Canada", "Cayman Islands", "Chile", "China", "Cyprus", "Denmark", "Egypt", "Ethiopia", "Finland", "France", "Germany",
    "Greece", "Hong Kong", "India", "Indonesia", "Iran", "Iraq", "Ireland", "Israel", "Italy", "Japan", "Jordan", "Kenya", "Luxembourg", "Malaysia", "Mexico", "Morocco", "Mozambique", "Netherlands",
    "New Zealand", "Nigeria", "Norway", "Panama", "Peru", "Poland", "Portugal", "Romania", "Russia", "Saudi Arabia", "Singapore", "South Africa", "South Korea", "Spain", "Sweden", "Switzerland", "Taiwan",
    "Thailand", "Turkey", "United Kingdom", "United States", "Vietnam", "Alabama", "Arizona", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Illinois", "Massachusetts",
    "Michigan", "Minnesota", "Nevada", "New Jersey", "New York", "Ohio", "Pennsylvania", "Texas", "Virginia", "Washington", "Chicago", "Houston", "London", "Los Angeles", "San Francisco", "Tokyo",
)
PLACE = r"\b(?:" + "|".join(PLACES) + r")\b"
PERSON = r"\b(?:Mr|Mrs|Ms|Dr|Prof|Judge|President|Chairman|Director)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?"
NAMED_DATE = DATES + r"|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b|\b\d{4}-\d{2}-\d{2}\b|\bfiscal(?: year)? \d{4}\b"


def sql_count(text: str, term: str) -> str:
    """Non-overlapping hits of term in text (both lower-case)."""
    return f"CAST((length({text}) - length(replace({text}, '{term}', ''))) / {len(term)} AS INT)"


def sql_has(text: str, term: str) -> str:
    return f"CASE WHEN contains({text}, '{term}') THEN 1 ELSE 0 END"


def sql_distinct_terms(text: str, terms: tuple[str, ...]) -> str:
    return " + ".join(sql_has(text, t) for t in terms)


def sql_level(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {low} THEN '{name}'" for name, low in LEVELS) + " ELSE 'MINIMAL' END"


def sql_fraud_score(text: str, indicators: str) -> str:
    """Severity of the terms found, saturating with their hits, over the number found."""
    found = [sql_count(text, t) for t in SEVERITY]
    total = " + ".join(f"CASE WHEN {c} > 0 THEN {s}e0 * least(1e0, 0.3e0 + 0.1e0 * {c}) ELSE 0e0 END" for c, s in zip(found, SEVERITY.values(), strict=True))
    total += f" + CASE WHEN {indicators} > 0 THEN least(0.5e0, 0.1e0 * {indicators}) ELSE 0e0 END"
    number = sql_distinct_terms(text, tuple(SEVERITY)) + f" + {indicators}"
    return f"CASE WHEN ({number}) > 0 THEN least(1e0, ({total}) / greatest(1e0, 0.8e0 * ({number}))) ELSE 0e0 END"


def fraud_score(hit_counts: Column, indicators: Column) -> Column:
    """sql_fraud_score() from the hits of each term of SEVERITY, in order."""
    weights = F.array(*map(F.lit, SEVERITY.values()))
    each = F.zip_with(hit_counts, weights, lambda c, s: F.when(c > 0, s * F.least(F.lit(1.0), F.lit(0.3) + F.lit(0.1) * c)).otherwise(0.0))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) + F.when(indicators > 0, F.least(F.lit(0.5), F.lit(0.1) * indicators)).otherwise(0.0)
    number = F.size(F.filter(hit_counts, lambda c: c > 0)) + indicators
    return F.when(number > 0, F.least(F.lit(1.0), total / F.greatest(F.lit(1.0), F.lit(0.8) * number))).otherwise(0.0)


def hit_counts(low: Column) -> Column:
    """Hits of each term of SEVERITY in lower-case text; counted only where the term is there at all."""
    count = lambda t: ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int")
    return F.array(*(F.when(low.contains(t), count(t)).when(low.isNotNull(), 0) for t in SEVERITY))


def sql_entity_score(terms: str, indicators: str, orgs: str, money: str) -> str:
    parts = (f"CASE WHEN {terms} > 5 THEN least(0.4e0, 0.05e0 * {terms}) ELSE 0e0 END", f"CASE WHEN {indicators} > 0 THEN least(0.5e0, 0.15e0 * {indicators}) ELSE 0e0 END")
    parts += (f"CASE WHEN {orgs} > 3 THEN least(0.3e0, 0.05e0 * ({orgs} - 3)) ELSE 0e0 END", f"CASE WHEN {money} > 3 THEN least(0.2e0, 0.03e0 * ({money} - 3)) ELSE 0e0 END")
    return f"least(1e0, {' + '.join(parts)})"


def sql_financial_score(largest: str, distinct: str, percentages: str, dates: str) -> str:
    size = f"CASE WHEN {largest} > 1e8 THEN 0.3e0 WHEN {largest} > 1e7 THEN 0.2e0 WHEN {largest} > 1e6 THEN 0.1e0 ELSE 0e0 END"
    return f"least(1e0, {size} + CASE WHEN {distinct} > 5 THEN 0.2e0 ELSE 0e0 END + CASE WHEN {percentages} > 3 THEN 0.1e0 ELSE 0e0 END + CASE WHEN {dates} > 5 THEN 0.15e0 ELSE 0e0 END)"


def sql_overall(fraud: str, entity: str, financial: str, relationship: str) -> str:
    w = DOCUMENT_WEIGHTS
    return f"100e0 * ({w['fraud']}e0 * {fraud} + {w['entity']}e0 * {entity} + {w['financial']}e0 * {financial} + {w['relationship']}e0 * {relationship})"


def sql_relation_weight(kind: str, predicate: str) -> str:
    weight = " ".join(f"WHEN '{k}' THEN {w}e0" for k, w in RELATION_WEIGHTS.items())
    listed = ", ".join(f"'{p}'" for p in SUSPICIOUS_PREDICATES)
    return f"(CASE {kind} {weight} ELSE 0e0 END + CASE WHEN lower({predicate}) IN ({listed}) THEN 0.3e0 ELSE 0e0 END)"


def sql_map(value: str, table: dict[str, str], default: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def amounts(text: Column) -> Column:
    """Money amounts, units applied."""
    number, unit = (F.regexp_extract_all(text, F.lit(MONEY_PARTS), F.lit(g)) for g in (1, 2))
    factor = lambda u: F.when(F.lower(u).isin("billion", "b"), 1e9).when(F.lower(u).isin("million", "m"), 1e6).when(F.lower(u).isin("thousand", "k"), 1e3).otherwise(1.0)
    return F.zip_with(number, unit, lambda n, u: n.cast("double") * factor(u))
