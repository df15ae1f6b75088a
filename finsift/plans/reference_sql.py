"""The risk rules restated as SQL, by hand and apart from the engine's own constants, for comparison with its results.

Nothing here is built from finsift.functions: a wrong constant or formula there gives other rows than this text.
"""

# Terms with severities, entity terms, weights of relations and components, bounds of levels, patterns.
MONEY = r"(?i)\$\s*\d+(?:\.\d+)?(?:\s*(?:million|billion|thousand|M|B|K))?"
MONEY_FACTOR = r"(?i)\$\s*\d+(?:\.\d+)?(?:\s*(?:million|billion|M|B))?"
PERCENT = r"\d+(?:\.\d+)?%"
DATE = r"(?i)\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"
ORGANISATION = "[A-Z][a-z]+ (?:Corp|Inc|Ltd|LLC)"
SEVERITIES = """(VALUES (0, 'fictitious', 0.95e0), (1, 'fabricated', 0.95e0), (2, 'concealment', 0.9e0), (3, 'material weakness', 0.9e0), (4, 'restatement', 0.85e0),
 (5, 'manipulation', 0.85e0), (6, 'misstatement', 0.8e0), (7, 'overstatement', 0.75e0), (8, 'understatement', 0.75e0), (9, 'round-trip', 0.7e0),
 (10, 'special purpose entity', 0.7e0), (11, 'off-balance sheet', 0.65e0), (12, 'related party', 0.6e0), (13, 'derivative', 0.55e0),
 (14, 'restructuring', 0.5e0), (15, 'write-off', 0.5e0), (16, 'write-down', 0.5e0), (17, 'impairment', 0.45e0), (18, 'goodwill', 0.4e0),
 (19, 'contingency', 0.35e0), (20, 'subsidiary', 0.3e0), (21, 'joint venture', 0.25e0), (22, 'revenue recognition', 0.2e0)) AS severities(ord, term, severity)"""
TERMS = "['accounts receivable', 'contingency', 'derivative', 'goodwill', 'impairment', 'joint venture', 'liability', 'off-balance sheet', 'related party', 'restatement', 'restructuring', 'revenue recognition', 'round-trip', 'spe', 'special purpose entity', 'subsidiary', 'write-down', 'write-off']"
INDICATORS = "['concealment', 'fabricated', 'fictitious', 'manipulation', 'material weakness', 'misstatement', 'overstatement', 'restatement', 'understatement']"
LABEL = "CASE ent_type WHEN 'PERSON' THEN 'Person' WHEN 'ORG' THEN 'Company' WHEN 'MONEY' THEN 'MonetaryAmount' WHEN 'DATE' THEN 'Date' WHEN 'GPE' THEN 'Location' WHEN 'FINANCIAL_TERM' THEN 'FinancialTerm' WHEN 'FRAUD_INDICATOR' THEN 'FraudIndicator' ELSE 'Entity' END"
LEVEL = "CASE WHEN {0} >= 80 THEN 'CRITICAL' WHEN {0} >= 60 THEN 'HIGH' WHEN {0} >= 40 THEN 'MEDIUM' WHEN {0} >= 20 THEN 'LOW' ELSE 'MINIMAL' END"
AMOUNT = "CAST(regexp_extract(m, '[0-9]+([.][0-9]+)?') AS DOUBLE) * CASE WHEN regexp_matches(lower(m), '(billion|b)$') THEN 1e9 WHEN regexp_matches(lower(m), '(million|m)$') THEN 1e6 WHEN regexp_matches(lower(m), '(thousand|k)$') THEN 1e3 ELSE 1e0 END"
VERBS = "is|has|owns|manages|controls|reports|created|transferred|hid|concealed"


def features(filings: str) -> str:
    """CTEs raw and features after one that gives filings (doc_id, content)."""
    return f"""{filings},
 raw AS (SELECT doc_id, content, lower(content) AS low, regexp_extract_all(content, '{MONEY}') AS ms, regexp_extract_all(content, '{ORGANISATION}') AS os FROM filings),
 features AS (SELECT doc_id, content, low, ms, len(list_filter({TERMS}, lambda t: contains(low, t))) AS n_terms, len(list_filter({INDICATORS}, lambda t: contains(low, t))) AS n_indicators,
  len(list_distinct(os)) AS n_orgs, len(list_distinct(list_transform(ms, lambda m: lower(m)))) AS n_money,
  coalesce(list_max(list_transform(ms, lambda m: {AMOUNT})), 0e0) AS largest, len(list_distinct(list_transform(ms, lambda m: {AMOUNT}))) AS n_amounts,
  len(regexp_extract_all(content, '{PERCENT}')) AS n_percentages, len(regexp_extract_all(content, '{DATE}')) AS n_dates, len(regexp_extract_all(content, '{MONEY_FACTOR}')) AS n_money_factor FROM raw)"""


def relations(filings: str) -> str:
    """features(), rel (each triple once), and rs: relations by document."""
    part = lambda g: f"regexp_extract(t, '^([A-Z][a-z]+) ({VERBS}) ([A-Z][a-z]+)$', {g})"
    return f"""{features(filings)},
 tri AS (SELECT doc_id, i AS ord, t, {part(1)} AS subject, {part(2)} AS predicate, {part(3)} AS object
  FROM (SELECT doc_id, ts[i] AS t, i FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(content, '[A-Z][a-z]+ ({VERBS}) [A-Z][a-z]+') AS ts FROM filings)))),
 sen AS (SELECT doc_id, unnest(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM filings),
 rel AS (SELECT DISTINCT doc_id, subject, predicate, object, CASE lower(predicate) WHEN 'is' THEN 'IS' WHEN 'has' THEN 'HAS' WHEN 'owns' THEN 'OWNS' WHEN 'manages' THEN 'MANAGES' WHEN 'controls' THEN 'CONTROLS' WHEN 'reports' THEN 'REPORTS_TO' WHEN 'created' THEN 'CREATED' WHEN 'transferred' THEN 'TRANSFERRED' WHEN 'hid' THEN 'CONCEALED' WHEN 'concealed' THEN 'CONCEALED' ELSE 'RELATED_TO' END AS relation_type FROM tri
  UNION SELECT doc_id, regexp_extract(s, '{ORGANISATION}'), 'CONCEALED', regexp_extract(s, '{MONEY}'), 'FRAUD_ACTION' FROM sen WHERE regexp_matches(lower(s), 'hid|concealed|transferred') AND regexp_matches(s, '{ORGANISATION}') AND regexp_matches(s, '{MONEY}')),
 weighed AS (SELECT *, CASE relation_type WHEN 'CONCEALED' THEN 0.9e0 WHEN 'TRANSFERRED' THEN 0.7e0 WHEN 'CREATED' THEN 0.5e0 WHEN 'OWNS' THEN 0.4e0 WHEN 'CONTROLS' THEN 0.4e0 WHEN 'MANAGES' THEN 0.3e0 END AS weight FROM rel),
 rs AS (SELECT doc_id, count(*) AS n_relations, count(weight) AS n_suspicious, sum(coalesce(weight, 0) + CASE WHEN lower(predicate) IN ('concealed', 'hid', 'transferred', 'manipulated') THEN 0.3e0 ELSE 0e0 END) AS total FROM weighed GROUP BY doc_id)"""


def scored(filings: str) -> str:
    """relations() and scored: the four components from 0 to 1, overall and risk_level."""
    overall = "100e0 * (fraud * 0.35e0 + entity * 0.25e0 + financial * 0.25e0 + relationship * 0.15e0)"
    return f"""{relations(filings)},
 hits AS (SELECT doc_id, ord, term, severity, (length(low) - length(replace(low, term, ''))) // length(term) AS c FROM features, {SEVERITIES}),
 words AS (SELECT doc_id, sum(severity * least(1e0, 0.3e0 + 0.1e0 * c)) AS total, count(*) AS n, list(term ORDER BY ord) AS found FROM hits WHERE c > 0 GROUP BY doc_id),
 comp AS (SELECT f.*, coalesce(n_relations, 0) AS n_relations, coalesce(n_suspicious, 0) AS n_suspicious, coalesce(w.found, []) AS found,
  CASE WHEN n_relations IS NULL THEN 0e0 ELSE least(1e0, rs.total / greatest(1e0, 0.5e0 * n_relations)) END AS relationship,
  CASE WHEN coalesce(w.n, 0) + n_indicators = 0 THEN 0e0 ELSE least(1e0, (coalesce(w.total, 0e0) + least(0.5e0, 0.1e0 * n_indicators)) / greatest(1e0, 0.8e0 * (coalesce(w.n, 0) + n_indicators))) END AS fraud,
  least(1e0, CASE WHEN n_terms > 5 THEN least(0.4e0, 0.05e0 * n_terms) ELSE 0e0 END + CASE WHEN n_indicators > 0 THEN least(0.5e0, 0.15e0 * n_indicators) ELSE 0e0 END
   + CASE WHEN n_orgs > 3 THEN least(0.3e0, 0.05e0 * (n_orgs - 3)) ELSE 0e0 END + CASE WHEN n_money > 3 THEN least(0.2e0, 0.03e0 * (n_money - 3)) ELSE 0e0 END) AS entity,
  least(1e0, CASE WHEN largest > 100000000 THEN 0.3e0 WHEN largest > 10000000 THEN 0.2e0 WHEN largest > 1000000 THEN 0.1e0 ELSE 0e0 END + CASE WHEN n_amounts > 5 THEN 0.2e0 ELSE 0e0 END
   + CASE WHEN n_percentages > 3 THEN 0.1e0 ELSE 0e0 END + CASE WHEN n_dates > 5 THEN 0.15e0 ELSE 0e0 END) AS financial
  FROM features f LEFT JOIN rs ON f.doc_id = rs.doc_id LEFT JOIN words w ON f.doc_id = w.doc_id),
 scored AS (SELECT *, {overall} AS overall, {LEVEL.format(f"({overall})")} AS risk_level FROM comp)"""


def entities(filings: str) -> str:
    """relations() and ent: (doc_id, ent_type, text, start, ord), each text of a type at its first place."""
    place = lambda s: f"coalesce(list_sum(list_transform(string_split_regex(content, '{s}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)"
    matched = lambda kind, pattern, base: f"""SELECT doc_id, '{kind}' AS ent_type, arg_min(m, i) AS text, arg_min(pos, i) AS start, {base} + min(i) AS ord FROM
   (SELECT doc_id, found[i] AS m, i, {place(pattern)} AS pos FROM (SELECT doc_id, content, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, content, regexp_extract_all(content, '{pattern}') AS found FROM raw))) GROUP BY doc_id, lower(m)"""  # noqa: E731
    return f"""{relations(filings)}, ent AS (
 SELECT doc_id, 'FINANCIAL_TERM' AS ent_type, t AS text, instr(low, t) - 1 AS start, i AS ord FROM features, (SELECT unnest({TERMS}) AS t, generate_subscripts({TERMS}, 1) AS i) WHERE contains(low, t)
 UNION ALL SELECT doc_id, 'FRAUD_INDICATOR', t, instr(low, t) - 1, 100 + i FROM features, (SELECT unnest({INDICATORS}) AS t, generate_subscripts({INDICATORS}, 1) AS i) WHERE contains(low, t)
 UNION ALL {matched("MONEY", MONEY, 200)}
 UNION ALL {matched("ORG", ORGANISATION, 300)})"""
