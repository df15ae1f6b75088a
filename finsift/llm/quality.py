"""Quality rules: a threshold table compiled into one projection of native expressions.

Words are runs of characters other than ASCII white space. No Python runs on the rows. A null or empty text has
no words and no lines with words; it fails the base rule. Very long texts are handled whole: the repeated
windows are found by sorting the windows' hashes within the row, not by comparing pairs. Rows are judged one by
one, so ties, repeated rows and an empty table need no special case. Added columns replace columns of the same
name (compared without case).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm._shared import ASCII_SPACE, fresh, read

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "at", "this", "by", "are", "from",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "est", "dans", "pour", "par", "avec", "au", "aux",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als",
    "el", "los", "las", "y", "se", "del", "con", "una", "su", "al", "lo", "como", "es", "por", "para",
)

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """count is within [low, high] hundredths of base; a bound of None is open."""

    name: str
    count: str
    base: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> str:
        parts = [f"100 * {self.count} >= {self.low} * {self.base}"] if self.low is not None else []
        parts += [f"100 * {self.count} <= {self.high} * {self.base}"] if self.high is not None else []
        return "(" + " AND ".join(parts or ["true"]) + ")"


#: Length, symbol, stop-word and line rules; valid both in Spark SQL and in other dialects.
RULES = (
    Rule("word_length", "word_chars", "n_words", 150, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("exclamations", "n_exclamations", "n_words", None, 20),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_text_lines", None, 30),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_exclamations", "n_stop_words")


def base_failed_sql() -> str:
    return f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    return " AND ".join(r.holds() for r in rules)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the counts, base_failed, a flag rule_<name> for each rule, and kept."""
    made = [*METRICS, "base_failed", *(f"rule_{r.name}" for r in rules), "kept"]
    carried = [c for c in docs.columns if c.lower() not in made]
    words, lines, sorted_, where = (fresh([*docs.columns, *made], n) for n in ("words", "text_lines", "windows", "starts"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    held = fresh([*docs.columns, *made], "whole_text")
    own = [F.col(f"`{c}`") for c in carried]
    out = docs.select(*own, text.alias(held))
    out = out.select(
        *own,
        held,
        F.array_remove(F.split(F.col(held), f"[{ASCII_SPACE}]+"), "").alias(words),
        F.filter(F.split(F.col(held), "\n"), lambda x: x.rlike(f"[^{ASCII_SPACE}]")).alias(lines),
    )
    out = out.select(
        *own,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(held, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(held) - F.length(F.translate(held, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(held) - F.length(F.translate(held, "!", ""))).cast("long").alias("n_exclamations"),
        F.size(F.filter(words, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_text_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        # Hash and start of each 3-word window, in the order of the hashes: equal windows become neighbours.
        F.expr(
            f"sort_array(if(size({words}) >= 3, transform(sequence(0, size({words}) - 3), i -> struct(xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)) AS h, i AS i)),"
            f" cast(array() AS array<struct<h: bigint, i: int>>)))"
        ).alias(sorted_),
    )
    out = out.withColumn(
        where,
        F.expr(f"sort_array(transform(filter({sorted_}, (x, k) -> x.h = get({sorted_}, k - 1).h OR x.h = get({sorted_}, k + 1).h), x -> x.i))"),
    ).drop(sorted_)
    # A start covers three words, fewer if the next start comes sooner.
    out = out.withColumn("n_repeat_words", F.expr(f"aggregate(transform({where}, (p, k) -> least(3, coalesce(get({where}, k + 1) - p, 3))), 0L, (a, x) -> a + x)")).drop(where)
    # Rows of one struct each: a filter on the result stops above them, so that the counts are never computed for it again.
    counts = fresh([*docs.columns, *made], "counts")
    out = out.select(*own, F.explode(F.array(F.struct(*METRICS))).alias(counts)).select(*own, f"{counts}.*")
    out = out.withColumn("base_failed", F.expr(base_failed_sql()))
    return out.select(*own, *METRICS, "base_failed", *(F.expr(r.holds()).alias(f"rule_{r.name}") for r in rules), F.expr(f"NOT base_failed AND {verdict_sql(rules)}").alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    space = r"\x20\x09-\x0D"
    flags = ", ".join(f"{r.holds()} AS rule_{r.name}" for r in RULES)
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[{space}]+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls FROM d),
    win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
    cov AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + j AS p FROM rep, (SELECT unnest([0, 1, 2]) AS j)) GROUP BY doc_id),
    m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{space}]', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
                 CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations,
                 CAST(len(list_filter(ws, lambda x: list_contains([{stops}], lower(x)))) AS BIGINT) AS n_stop_words,
                 CAST(len(ls) AS BIGINT) AS n_text_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
    f AS (SELECT *, {base_failed_sql()} AS base_failed FROM m)
    SELECT doc_id, {", ".join(METRICS)}, base_failed, {flags}, NOT base_failed AND {verdict_sql()} AS kept FROM f
    """
