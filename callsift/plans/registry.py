"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB
statement of each (same column names) used as the correctness oracle.

Every query reads the driver tables (documents, conversations, events,
labels, pages) and the built-in rule tables; its work grows with the data.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.functions import pii as PII
from callsift.functions import text as TX
from callsift.operators import analytics as A
from callsift.plans import oracle_sql as O
from callsift.plans.classify import classify, classify_ccre
from callsift.session import scratch_path
from callsift.sources import rules as R
from callsift.sources import transcripts as TR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def classified_docs(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    return classify(TR.from_documents(spark, sf_dir), R.keyword_rules(spark),
                    R.hierarchy(spark), with_text=with_text)


def W(select_sql: str) -> str:
    return O.with_classified(select_sql)


# --------------------------------------------------------------------------
# Classification (C1-C9) and the flagship distribution
# --------------------------------------------------------------------------

@register("hybrid_classify", W(
    "SELECT transcript_id, agent_name, rule_id, category, subcategory, tertiary, quaternary, cat_no, "
    "confidence, matched_keywords, num_rules_activated, resolve_reason, source, program, transcript, "
    "redacted_transcript FROM classified"))
def q_hybrid(spark, sf):
    return classified_docs(spark, sf, with_text=True).drop("call_id", "ts")


@register("ccre_classify", W(
    "SELECT transcript_id, CASE WHEN rule_ord IS NULL THEN 'Unclassified' ELSE u2.category END AS category, "
    "CASE WHEN rule_ord IS NOT NULL THEN u2.subcategory WHEN is_empty THEN 'Empty Transcript' ELSE 'No Match' END "
    "AS subcategory, coalesce(ccre_conf, CAST(0.0 AS DOUBLE)) AS confidence, "
    "coalesce(ccre_kws, '') AS matched_keywords, num_rules_activated, ccre.rule_id, "
    "CASE WHEN is_empty THEN 'Empty or invalid input' WHEN rule_ord IS NOT NULL THEN "
    "'Highest confidence rule (matched ' || CAST(matched_groups AS VARCHAR) || ' groups)' "
    "ELSE 'No rules activated (threshold: 0.4)' END AS resolve_reason "
    "FROM ccre LEFT JOIN (SELECT rule_id AS rid, category, subcategory FROM "
    + O.values([(r[1], r[2], r[3]) for r in O.parsed_keyword_rules()], ["rule_id", "category", "subcategory"])
    + ") u2 ON ccre.rule_id = u2.rid"))
def q_ccre(spark, sf):
    c = classify_ccre(TR.from_documents(spark, sf), R.keyword_rules(spark))
    return c.select("transcript_id", "category", "subcategory", "confidence", "matched_keywords",
                    "num_rules_activated", "rule_id", "resolve_reason")


@register("category_distribution", W(
    "SELECT category, COUNT(*) AS count, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS percentage "
    "FROM classified GROUP BY category ORDER BY count DESC, category LIMIT 10"))
def q_catdist(spark, sf):
    return A.category_distribution(classified_docs(spark, sf))


@register("subcategory_distribution", W(
    "SELECT category, subcategory, COUNT(*) AS count, "
    "ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS percentage FROM classified "
    "GROUP BY category, subcategory ORDER BY count DESC, category, subcategory LIMIT 20"))
def q_subdist(spark, sf):
    return A.subcategory_distribution(classified_docs(spark, sf))


@register("subcategory_distribution_filtered", W(
    "SELECT category, subcategory, COUNT(*) AS count, "
    "ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS percentage FROM classified "
    "WHERE category = 'Language' "
    "GROUP BY category, subcategory ORDER BY count DESC, category, subcategory LIMIT 20"))
def q_subdist_f(spark, sf):
    return A.subcategory_distribution(classified_docs(spark, sf), "Language")


@register("resolve_reason_distribution", W(
    "SELECT resolve_reason, COUNT(*) AS count, "
    "ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS percentage FROM classified "
    "GROUP BY resolve_reason ORDER BY count DESC, resolve_reason"))
def q_reasons(spark, sf):
    return A.resolve_reason_distribution(classified_docs(spark, sf))


@register("summary_stats", W(
    "SELECT COUNT(*) AS total_transcripts, coalesce(ROUND(AVG(confidence), 3), 0.0) AS avg_confidence, "
    "COUNT(DISTINCT category) AS unique_categories, COUNT(DISTINCT subcategory) AS unique_subcategories, "
    "COUNT(DISTINCT agent_name) AS unique_agents FROM classified"))
def q_summary(spark, sf):
    return A.summary_stats(classified_docs(spark, sf))


@register("agent_performance", W(
    "SELECT agent_name, COUNT(*) AS total_calls, ROUND(AVG(confidence), 3) AS avg_confidence, "
    "COUNT(DISTINCT category) AS unique_categories, COUNT(DISTINCT subcategory) AS unique_subcategories, "
    "ROUND(AVG(num_rules_activated), 1) AS avg_rules_activated FROM classified "
    "WHERE agent_name IS NOT NULL GROUP BY agent_name ORDER BY total_calls DESC, agent_name"))
def q_agents(spark, sf):
    return A.agent_performance(classified_docs(spark, sf))


@register("low_confidence_cases", W(
    "SELECT transcript_id, category, subcategory, confidence, resolve_reason, agent_name FROM classified "
    "WHERE confidence < CAST(0.6 AS DOUBLE) ORDER BY confidence, transcript_id LIMIT 100"))
def q_lowconf(spark, sf):
    return A.low_confidence_cases(classified_docs(spark, sf))


@register("classification_stats", W(
    "SELECT total_transcripts, classified, (classified / total_transcripts) * 100.0 AS classified_pct, "
    "total_transcripts - classified AS unclassified, "
    "((total_transcripts - classified) / total_transcripts) * 100.0 AS unclassified_pct, avg_confidence, "
    "high_confidence, medium_confidence, low_confidence FROM (SELECT COUNT(*) AS total_transcripts, "
    "count(*) FILTER (WHERE category <> 'Unclassified') AS classified, "
    f"ROUND(AVG(confidence), {A.AVG_DIGITS}) AS avg_confidence, "
    "count(*) FILTER (WHERE confidence >= CAST(0.7 AS DOUBLE)) AS high_confidence, "
    "count(*) FILTER (WHERE confidence >= CAST(0.5 AS DOUBLE) AND confidence < CAST(0.7 AS DOUBLE)) "
    "AS medium_confidence, "
    "count(*) FILTER (WHERE confidence >= CAST(0.4 AS DOUBLE) AND confidence < CAST(0.5 AS DOUBLE)) "
    "AS low_confidence FROM classified) s WHERE total_transcripts > 0"))
def q_cstats(spark, sf):
    return A.classification_stats(classified_docs(spark, sf))


@register("confidence_bands", W(
    "SELECT band, count, count / total * 100.0 AS percentage FROM (SELECT COUNT(*) AS total, "
    "count(*) FILTER (WHERE confidence >= CAST(0.7 AS DOUBLE)) AS h, "
    "count(*) FILTER (WHERE confidence >= CAST(0.5 AS DOUBLE) AND confidence < CAST(0.7 AS DOUBLE)) AS m, "
    "count(*) FILTER (WHERE confidence >= CAST(0.4 AS DOUBLE) AND confidence < CAST(0.5 AS DOUBLE)) AS l "
    "FROM classified) s, LATERAL (VALUES ('high', h), ('medium', m), ('low', l)) v(band, count) "
    "WHERE total > 0"))
def q_bands(spark, sf):
    return A.confidence_bands(classified_docs(spark, sf))


@register("by_source", W(
    "SELECT source, COUNT(*) AS count, COUNT(*) / SUM(COUNT(*)) OVER () * 100.0 AS percentage "
    "FROM classified GROUP BY source"))
def q_by_source(spark, sf):
    return A.by_source(classified_docs(spark, sf))


@register("top_categories", W(
    "SELECT category, COUNT(*) AS count, COUNT(*) / SUM(COUNT(*)) OVER () * 100.0 AS percentage "
    "FROM classified GROUP BY category ORDER BY count DESC, category LIMIT 10"))
def q_topcats(spark, sf):
    return A.top_categories(classified_docs(spark, sf))


@register("display_results", W(
    "SELECT transcript_id, agent_name, call_id, transcript, category, subcategory, tertiary, quaternary, confidence, "
    "matched_keywords, source, printf('%.1f%%', confidence * 100.0) AS confidence_display FROM classified"))
def q_display(spark, sf):
    return A.display_results(classified_docs(spark, sf, with_text=True))


@register("custom_sql", W(
    "SELECT category, count(*) AS n, max(confidence) AS max_conf FROM classified "
    "GROUP BY category HAVING count(*) > 1"))
def q_custom(spark, sf):
    return A.run_custom_query(
        spark, classified_docs(spark, sf),
        "SELECT category, count(*) AS n, max(confidence) AS max_conf FROM transcripts "
        "GROUP BY category HAVING count(*) > 1")


# --------------------------------------------------------------------------
# One roll-up behind the analytics and the report
# --------------------------------------------------------------------------

from callsift.operators import rollup as RU  # noqa: E402


def _band_sql(low: str, high: str | None = None) -> str:
    top = f" AND confidence < CAST({high} AS DOUBLE)" if high else ""
    return f"count(*) FILTER (WHERE confidence >= CAST({low} AS DOUBLE){top})"


@register("analytics_rollup", W(
    "SELECT CASE WHEN GROUPING(agent_name) = 0 THEN 'agent' WHEN GROUPING(subcategory) = 0 THEN 'subcategory' "
    "WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(source) = 0 THEN 'source' "
    "WHEN GROUPING(resolve_reason) = 0 THEN 'reason' ELSE 'all' END AS level, "
    "agent_name, category, subcategory, source, resolve_reason, count(*) AS count, count(transcript_id) AS ids, "
    "count(*) FILTER (WHERE category <> 'Unclassified') AS classified, "
    f"{_band_sql('0.7')} AS high_confidence, {_band_sql('0.5', '0.7')} AS medium_confidence, "
    f"{_band_sql('0.4', '0.5')} AS low_confidence, round(avg(confidence), {A.AVG_DIGITS}) AS avg_confidence, "
    "round(avg(num_rules_activated), 1) AS avg_rules_activated, count(DISTINCT category) AS unique_categories, "
    "count(DISTINCT subcategory) AS unique_subcategories, count(DISTINCT agent_name) AS unique_agents "
    "FROM (SELECT *, category AS c2, subcategory AS s2, agent_name AS a2 FROM classified) x "
    "GROUP BY GROUPING SETS ((), (category), (category, subcategory), (source), (resolve_reason), (agent_name))"
    .replace("DISTINCT category", "DISTINCT c2").replace("DISTINCT subcategory", "DISTINCT s2")
    .replace("DISTINCT agent_name", "DISTINCT a2").replace("WHERE category <>", "WHERE c2 <>")))
def q_rollup(spark, sf):
    return RU.measures(RU.rollup(classified_docs(spark, sf)))


def _report_query(name: str):
    @register(f"rollup_{name}", ORACLE[name])
    def q(spark, sf):
        return RU.reports(classified_docs(spark, sf))[name]


for _name in ("summary_stats", "agent_performance", "category_distribution", "classification_stats"):
    _report_query(_name)


# --------------------------------------------------------------------------
# Text preparation and PII
# --------------------------------------------------------------------------

_TURN_ID = "conv_id || ':' || turn"
_TURN_LINE = (
    "'[' || printf('%02d:%02d:%02d', CAST(trunc(turn / 3600) AS INTEGER), CAST(trunc(turn / 60) AS INTEGER) % 60, "
    "turn % 60) || ' ' || CASE role WHEN 'assistant' THEN 'AGENT' WHEN 'system' THEN 'SYSTEM' ELSE 'CUSTOMER' END "
    "|| ']: ' || coalesce(text, '')")


@register("clean_transcript", (
    f"WITH src AS (SELECT {_TURN_ID} AS transcript_id, {_TURN_LINE} AS transcript FROM conversations) "
    f"SELECT transcript_id, {O.clean_sql('transcript')} AS cleaned FROM src"))
def q_clean(spark, sf):
    t = TR.from_conversation_turns(spark, sf)
    return t.select("transcript_id", TX.clean_transcript("transcript").alias("cleaned"))


@register("normalize_text", (
    f"SELECT doc_id, {O.normalize_sql('text')} AS normalized FROM documents"))
def q_normalize(spark, sf):
    d = TR.table(spark, sf, "documents")
    return d.select("doc_id", TX.normalize_text("text").alias("normalized"))


@register("tokenize", (
    f"WITH n AS (SELECT doc_id, {O.normalize_sql('text')} AS t FROM documents) "
    "SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS INTEGER) AS n_tokens, "
    "CASE WHEN t = '' THEN NULL ELSE string_split(t, ' ')[1] END AS first_token, "
    "CASE WHEN t = '' THEN NULL ELSE string_split(t, ' ')[-1] END AS last_token FROM n"))
def q_tokenize(spark, sf):
    d = TR.table(spark, sf, "documents").select("doc_id", TX.tokenize("text").alias("tok"))
    return d.select("doc_id", F.size("tok").alias("n_tokens"),
                    F.try_element_at("tok", F.lit(1)).alias("first_token"),
                    F.try_element_at("tok", F.lit(-1)).alias("last_token"))


@register("avg_words", (
    f"WITH n AS (SELECT {O.normalize_sql('text')} AS t FROM documents) "
    f"SELECT ROUND(AVG(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END), {A.AVG_DIGITS}) "
    "AS avg_words, COUNT(*) AS total_rows FROM n"))
def q_avg_words(spark, sf):
    return A.avg_words(TR.from_documents(spark, sf))


@register("pii_redact", (
    f"SELECT doc_id, {O.redact_sql('text')} AS redacted FROM documents"))
def q_pii_redact(spark, sf):
    d = TR.table(spark, sf, "documents")
    return d.select("doc_id", PII.redact("text").alias("redacted"))


@register("pii_redact_urls", (
    f"SELECT page_id, {O.redact_sql('url')} AS redacted_url, md5({O.redact_sql('html')}) AS redacted_html_md5 FROM pages"))
def q_pii_urls(spark, sf):
    p = TR.table(spark, sf, "pages")
    return p.select("page_id", PII.redact("url").alias("redacted_url"),
                    F.md5(PII.redact("html")).alias("redacted_html_md5"))


def _pii_stats_sql(table: str, col: str) -> str:
    parts = O.pii_count_sqls(col)
    sums = ", ".join(f"CAST(coalesce(sum({e}), 0) AS BIGINT) AS {n}" for n, e in parts)
    unpivot = ", ".join(f"('{n}', {n})" for n, _ in parts)
    return (f"WITH s AS (SELECT {sums} FROM {table}) "
            f"SELECT v.pii_type, v.hits FROM s, LATERAL (VALUES {unpivot}) v(pii_type, hits)")


@register("pii_stats", _pii_stats_sql("documents", "text"))
def q_pii_stats(spark, sf):
    return PII.pii_stats(TR.table(spark, sf, "documents"), "text")


@register("pii_observed", _pii_stats_sql(f"(SELECT {O.clean_sql('text')} AS text FROM documents) d", "text"))
def q_pii_observed(spark, sf):
    """What the redaction replaced while the classified table was written."""
    stats = PII.RedactionStats()
    out = classify(TR.from_documents(spark, sf), R.keyword_rules(spark), R.hierarchy(spark), with_text=True, stats=stats)
    out.write.parquet(scratch_path(spark, "classified"))
    return spark.createDataFrame(sorted(stats.snapshot().items()), "pii_type string, hits long")


@register("estimate_tokens", (
    "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS est_tokens, md5(text) AS content_hash, "
    "substring(text, 1, 200) AS preview FROM documents"))
def q_tokens(spark, sf):
    d = TR.table(spark, sf, "documents")
    return d.select("doc_id", TX.estimate_tokens("text").alias("est_tokens"),
                    TX.content_hash("text").alias("content_hash"),
                    TX.truncate("text", 200).alias("preview"))


@register("map_columns", (
    "SELECT doc_id AS transcript_id, text AS transcript, source AS agent_name, "
    "CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS TIMESTAMP) AS ts, lang, n_chars FROM documents"))
def q_map_columns(spark, sf):
    d = TR.table(spark, sf, "documents")
    return TR.map_columns(d, transcript=TR.detect_transcript_column(d.columns),
                          agent="source", transcript_id="doc_id")


@register("preview", "SELECT doc_id, lang, source, n_chars, text FROM documents LIMIT 10")
def q_preview(spark, sf):
    """The first rows of the file (both engines read it in its order)."""
    return TR.preview(TR.table(spark, sf, "documents")).select("doc_id", "lang", "source", "n_chars", "text")


# --------------------------------------------------------------------------
# Proximity rules
# --------------------------------------------------------------------------

from callsift.operators import proximity as PX  # noqa: E402
from callsift.plans.classify import prepare  # noqa: E402


def _prepared_docs(spark, sf):
    return prepare(TR.from_documents(spark, sf)).select("transcript_id", "norm_text")


# --------------------------------------------------------------------------
# Stages of the keyword engine, each checked on its own
# --------------------------------------------------------------------------

from callsift.operators import keyword as K  # noqa: E402
from callsift.plans.classify import rule_base  # noqa: E402


@register("ccre_keyword_hits", W("SELECT transcript_id, term, pos, neg, wb FROM hits"))
def q_kw_hits(spark, sf):
    hits = K.keyword_hits(_prepared_docs(spark, sf), rule_base(R.keyword_rules(spark)))
    return hits.select("transcript_id", "term", "pos", "neg", "wb")


@register("ccre_forbidden", W(
    "SELECT DISTINCT transcript_id, CAST(rule_ord AS BIGINT) AS rule_ord FROM slot_hits WHERE group_no < 0"))
def q_forbidden(spark, sf):
    rules = R.keyword_rules(spark)
    vetoes = K.keyword_hits(_prepared_docs(spark, sf), rule_base(rules)).filter("wb")
    terms = R.rule_terms(R.parse_keyword_rules(rules)[0]).filter("group_no < 0").select("term", "rule_ord")
    return vetoes.join(terms, "term").select("transcript_id", F.col("rule_ord").cast("long").alias("rule_ord")).distinct()


@register("ccre_scores", W(
    "SELECT transcript_id, CAST(rule_ord AS BIGINT) AS rule_ord, matched_groups, confidence FROM kept"))
def q_scores(spark, sf):
    sc = K.rule_scores(_prepared_docs(spark, sf), rule_base(R.keyword_rules(spark)))
    return sc.select("transcript_id", F.col("rule_ord").cast("long").alias("rule_ord"),
                     F.col("matched_groups").cast("long").alias("matched_groups"), "confidence")


@register("prox_classify", "WITH " + O.proximity_sql(O.prepared_docs_sql()).strip()
          + "\nSELECT * FROM pbest")
def q_prox(spark, sf):
    return PX.proximity_classify(_prepared_docs(spark, sf), R.proximity_rules(spark))


@register("prox_classify_program", "WITH " + O.proximity_sql(O.prepared_docs_sql(), "PNC").strip()
          + "\nSELECT * FROM pbest")
def q_prox_p(spark, sf):
    return PX.proximity_classify(_prepared_docs(spark, sf), R.proximity_rules(spark), program="PNC")


@register("prox_match_counts", "WITH " + O.proximity_sql(O.prepared_docs_sql()).strip()
          + "\nSELECT rule_ord, count(*) AS matches FROM pmatch GROUP BY rule_ord")
def q_prox_counts(spark, sf):
    m = PX.proximity_matches(_prepared_docs(spark, sf), R.proximity_rules(spark))
    return m.groupBy("rule_ord").agg(F.count(F.lit(1)).alias("matches"))


@register("prox_candidates", "WITH " + O.proximity_sql(O.prepared_docs_sql()).strip()
          + "\nSELECT DISTINCT transcript_id, CAST(rule_ord AS BIGINT) AS rule_ord FROM pcand")
def q_prox_cand(spark, sf):
    c = PX.proximity_candidates(_prepared_docs(spark, sf), R.proximity_rules(spark))
    return c.select("transcript_id", F.col("rule_ord").cast("long").alias("rule_ord"))


@register("prox_matches", "WITH " + O.proximity_sql(O.prepared_docs_sql()).strip()
          + "\nSELECT transcript_id, CAST(rule_ord AS BIGINT) AS rule_ord, confidence FROM pmatch")
def q_prox_matches(spark, sf):
    m = PX.proximity_matches(_prepared_docs(spark, sf), R.proximity_rules(spark))
    return m.select("transcript_id", F.col("rule_ord").cast("long").alias("rule_ord"), "confidence")


# --------------------------------------------------------------------------
# Review sampling and corrections
# --------------------------------------------------------------------------

from callsift.operators import feedback as FB  # noqa: E402

_STRATUM_SQL = ("CASE WHEN confidence >= CAST(0.7 AS DOUBLE) THEN 'high' "
                "WHEN confidence >= CAST(0.5 AS DOUBLE) THEN 'medium' ELSE 'low' END")
_STRATIFIED_SQL = (
    f", strat AS (SELECT *, {_STRATUM_SQL} AS stratum, md5(CAST(transcript_id AS VARCHAR) || '|42') AS k "
    "FROM classified), "
    "cnt AS (SELECT count(*) AS n, count(*) FILTER (WHERE stratum = 'high') AS h, "
    "count(*) FILTER (WHERE stratum = 'medium') AS m FROM strat), "
    "quota AS (SELECT n, CAST(trunc((h / n) * 50) AS BIGINT) AS qh, CAST(trunc((m / n) * 50) AS BIGINT) AS qm "
    "FROM cnt), "
    "sampled AS (SELECT s.* FROM strat s, quota q WHERE q.n <= 50 OR "
    "(row_number() OVER (PARTITION BY s.stratum ORDER BY s.k)) <= CASE s.stratum WHEN 'high' THEN q.qh "
    "WHEN 'medium' THEN q.qm ELSE 50 - q.qh - q.qm END) ")


def _sample_cols(df):
    return df.select("transcript_id", "agent_name", "category", "subcategory", "confidence", "stratum")


@register("stratified_sample")
def q_strat(spark, sf):
    return _sample_cols(FB.stratified_sample(classified_docs(spark, sf)))


ORACLE["stratified_sample"] = (
    "WITH " + O.classified_ctes().strip() + _STRATIFIED_SQL.replace(
        "sampled AS (SELECT s.* FROM strat s, quota q WHERE q.n <= 50 OR "
        "(row_number() OVER (PARTITION BY s.stratum ORDER BY s.k)) <= ",
        "ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.stratum ORDER BY s.k) AS rn "
        "FROM strat s), sampled AS (SELECT r.* FROM ranked r, quota q WHERE q.n <= 50 OR r.rn <= ").replace(
        "CASE s.stratum", "CASE r.stratum")
    + "SELECT transcript_id, agent_name, category, subcategory, confidence, stratum FROM sampled")


@register("low_confidence_sample", W(
    "SELECT transcript_id, agent_name, category, subcategory, confidence FROM classified "
    "WHERE confidence < CAST(0.6 AS DOUBLE) ORDER BY confidence, transcript_id LIMIT 50"))
def q_lowsample(spark, sf):
    s = FB.low_confidence_sample(classified_docs(spark, sf))
    return s.select("transcript_id", "agent_name", "category", "subcategory", "confidence")


_CORR_SQL = ("SELECT doc_id AS transcript_id, CASE WHEN quality = 0 THEN 'low_quality' ELSE 'toxic' END AS correct_category, "
             "CASE WHEN quality = 0 AND toxic = 1 THEN 'toxic' END AS correct_subcategory, "
             "CAST(NULL AS VARCHAR) AS correct_tertiary FROM labels WHERE quality = 0 OR toxic = 1")


@register("corrections_to_examples", (
    f"WITH corr AS ({_CORR_SQL}), "
    f"txt AS (SELECT doc_id AS transcript_id, {O.redact_sql(O.clean_sql('text'))} AS redacted_transcript "
    "FROM documents) "
    "SELECT c.transcript_id, substring(t.redacted_transcript, 1, 200) AS example_phrase, "
    "c.correct_category AS category, c.correct_subcategory AS subcategory, "
    "c.correct_tertiary AS tertiary_category, CAST(0.95 AS DOUBLE) AS confidence, 'feedback' AS source "
    "FROM corr c JOIN txt t ON c.transcript_id = t.transcript_id"))
def q_corr_examples(spark, sf):
    corr = FB.corrections_from_labels(TR.table(spark, sf, "labels"))
    return FB.corrections_to_examples(corr, TR.from_documents(spark, sf), prepare_fn=prepare)


@register("correction_stats", (
    f"WITH corr AS ({_CORR_SQL}), per AS (SELECT correct_category, count(*) AS n FROM corr "
    "GROUP BY correct_category), s AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_corrections FROM per), "
    "top AS (SELECT min(correct_category) AS top_correction FROM per WHERE n = (SELECT max(n) FROM per)) "
    "SELECT total_corrections, coalesce(round(total_corrections / (SELECT CAST(count(*) AS DOUBLE) FROM labels) * 100.0, 1), "
    "0.0) AS correction_rate, top_correction, (SELECT string_agg(correct_category || '=' || n, ',' ORDER BY "
    "correct_category) FROM per) AS categories_corrected FROM s, top"))
def q_corr_stats(spark, sf):
    """The labelled documents are the reviewed samples."""
    labels = TR.table(spark, sf, "labels")
    stats = FB.correction_stats(FB.corrections_from_labels(labels), labels)
    return stats.withColumn("categories_corrected", F.array_join(F.transform(
        F.map_entries("categories_corrected"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@register("correction_counts", (
    f"SELECT correct_category, count(*) AS corrections FROM ({_CORR_SQL}) c GROUP BY correct_category"))
def q_corr_counts(spark, sf):
    return FB.correction_counts(FB.corrections_from_labels(TR.table(spark, sf, "labels")))


# --------------------------------------------------------------------------
# User examples
# --------------------------------------------------------------------------

from callsift.operators import examples as EX  # noqa: E402


def _turn_texts(spark, sf):
    return TR.from_conversation_turns(spark, sf).select("transcript_id", TX.clean_transcript("transcript").alias("transcript"))


_TURNS_SQL = f"SELECT {_TURN_ID} AS transcript_id, {O.clean_sql(_TURN_LINE)} AS transcript FROM conversations"


_PHRASE = f"lower(regexp_replace(substring(txt.t, 1, 200), '^{O.P.WS}+|{O.P.WS}+$', '', 'g'))"


def _examples_sql() -> str:
    from callsift.sources import ruleset
    rows = []
    for i, (ph, cat, sub, ter, conf) in enumerate(ruleset.USER_EXAMPLES):
        p = str(ph).lower().strip()
        rows.append((i, p, " ".join(p.split()), str(cat).strip(), sub and sub.strip(), ter and ter.strip(),
                     conf if conf is not None else 0.95))
    return O.values(rows, ["example_ord", "phrase", "phrase_norm", "category", "subcategory", "tertiary_category",
                           "example_confidence"])


@register("example_classify", (
    f"WITH tx AS ({_TURNS_SQL}), ex AS (SELECT * FROM {_examples_sql()}), "
    "m AS (SELECT tx.transcript_id, ex.*, row_number() OVER (PARTITION BY tx.transcript_id ORDER BY example_ord) AS r "
    "FROM tx JOIN ex ON contains(trim(regexp_replace(lower(tx.transcript), '\\s+', ' ', 'g')), ex.phrase_norm)) "
    "SELECT transcript_id, category, subcategory, tertiary_category, example_confidence AS confidence, "
    "phrase AS matched_phrase, CAST(1.0 AS DOUBLE) AS similarity, 'user_example' AS source FROM m WHERE r = 1"))
def q_examples(spark, sf):
    """The part that SQL decides: contained examples (threshold 1), first on
    ties. The fuzzy ratio is held against difflib in the tests."""
    return EX.example_classify(_turn_texts(spark, sf), R.user_examples(spark), threshold=1.0)


@register("example_classify_fuzzy")
def q_examples_fuzzy(spark, sf):
    """All matches at the operator's default threshold, fuzzy ones too; no
    oracle, as SQL has no difflib ratio (held against it in the tests)."""
    return EX.example_classify(_turn_texts(spark, sf), R.user_examples(spark))


def _corrected_examples(spark, sf):
    """Examples that grow with the data: the phrases of all corrections."""
    corr = FB.corrections_from_labels(TR.table(spark, sf, "labels"))
    ex = FB.corrections_to_examples(corr, TR.from_documents(spark, sf), prepare_fn=prepare)
    return ex.select(F.col("transcript_id").alias("example_ord"), "example_phrase", "category", "subcategory",
                     "tertiary_category", "confidence")


def _redacted_docs(spark, sf):
    return prepare(TR.from_documents(spark, sf)).select("transcript_id", F.col("redacted_transcript").alias("transcript"))


_CORRECTED_SQL = (
    f"WITH corr AS ({_CORR_SQL}), "
    f"txt AS (SELECT doc_id AS transcript_id, {O.redact_sql(O.clean_sql('text'))} AS t FROM documents), "
    f"own AS (SELECT transcript_id, trim(regexp_replace(lower(t), '{O.P.WS}+', ' ', 'g')) AS t FROM txt), "
    "ex AS (SELECT c.transcript_id AS example_ord, c.correct_category AS category, c.correct_subcategory AS subcategory, "
    f"{_PHRASE} AS phrase FROM corr c JOIN txt USING (transcript_id)), "
    f"n AS (SELECT *, regexp_replace(phrase, '{O.P.WS}+', ' ', 'g') AS norm FROM ex), "
    "m AS (SELECT own.transcript_id, n.*, row_number() OVER (PARTITION BY own.transcript_id ORDER BY example_ord) AS r "
    "FROM own JOIN n ON contains(own.t, n.norm)) "
    "SELECT transcript_id, category, subcategory, CAST(NULL AS VARCHAR) AS tertiary_category, CAST(0.95 AS DOUBLE) AS confidence, "
    "phrase AS matched_phrase, CAST(1.0 AS DOUBLE) AS similarity, 'user_example' AS source FROM m WHERE r = 1")


@register("example_classify_corrections", _CORRECTED_SQL)
def q_examples_corrections(spark, sf):
    """Documents by the phrases of the corrected ones, as the operator reads
    them (up to the bound on the driver)."""
    return EX.example_classify(_redacted_docs(spark, sf), _corrected_examples(spark, sf), threshold=1.0)


@register("example_classify_dealt", _CORRECTED_SQL)
def q_examples_dealt(spark, sf):
    """The same with the examples dealt into parts, as beyond the bound."""
    return EX.example_classify(_redacted_docs(spark, sf), _corrected_examples(spark, sf), threshold=1.0,
                               local_examples=0, part_examples=100)


@register("example_contains", (
    f"WITH tx AS ({_TURNS_SQL}), ex AS (SELECT * FROM {_examples_sql()}) "
    "SELECT ex.example_ord, count(*) AS n_texts FROM tx JOIN ex "
    "ON contains(trim(regexp_replace(lower(tx.transcript), '\\s+', ' ', 'g')), ex.phrase_norm) "
    "GROUP BY ex.example_ord"))
def q_example_contains(spark, sf):
    p = EX.example_pairs(_turn_texts(spark, sf), R.user_examples(spark), threshold=1.0)
    return p.groupBy("example_ord").agg(F.count(F.lit(1)).alias("n_texts"))


# --------------------------------------------------------------------------
# Result caches and upload history (K1-K5, A14-A15), rows derived from events
# --------------------------------------------------------------------------

from callsift.sources import tables as TB  # noqa: E402

UPLOAD_USER = "7"
SPLIT_TS = "2024-01-10 00:00:00"
NOW_TS = "2024-01-25 00:00:00"


def _class_cache_rows(spark, sf):
    e = TR.table(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("user_id"), F.md5("event_type").alias("transcript_hash"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("v"), (F.floor("value").cast("long") % 5).cast("string")).alias("subcategory"),
        (F.col("value") - F.floor("value")).alias("confidence"), F.col("props").alias("matched_keywords"),
        F.lit("cached").alias("resolve_reason"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr(TB.TTL)).alias("expires_at"))


_CLASS_ROWS_SQL = (
    "SELECT CAST(user_id AS VARCHAR) AS user_id, md5(event_type) AS transcript_hash, event_type AS category, "
    "'v' || CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR) AS subcategory, value - floor(value) AS confidence, "
    "props AS matched_keywords, 'cached' AS resolve_reason, ts AS created_at, "
    "ts + INTERVAL 7 DAYS AS expires_at FROM events")
_CLASS_UPSERT_SQL = (
    f"SELECT * FROM ({_CLASS_ROWS_SQL}) r QUALIFY row_number() OVER (PARTITION BY user_id, transcript_hash "
    "ORDER BY created_at DESC, category DESC, subcategory DESC, confidence DESC, matched_keywords DESC, "
    "resolve_reason DESC, expires_at DESC) = 1")


def _class_cache(spark, sf):
    rows = _class_cache_rows(spark, sf)
    old = rows.filter(F.col("created_at") < F.lit(SPLIT_TS).cast("timestamp"))
    new = rows.filter(F.col("created_at") >= F.lit(SPLIT_TS).cast("timestamp"))
    return TB.upsert(old, new, TB.CLASSIFICATION_KEY)


@register("cache_upsert", _CLASS_UPSERT_SQL)
def q_cache_upsert(spark, sf):
    return _class_cache(spark, sf)


_PROBE_SQL = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, md5(event_type) AS transcript_hash FROM events"


@register("cache_hits", (
    f"WITH c AS ({_CLASS_UPSERT_SQL}), p AS ({_PROBE_SQL}) SELECT p.user_id, p.transcript_hash, c.category, "
    "c.confidence, c.expires_at FROM p JOIN c ON p.user_id = c.user_id AND p.transcript_hash = c.transcript_hash "
    f"WHERE c.expires_at >= TIMESTAMP '{NOW_TS}'"))
def q_cache_hits(spark, sf):
    probe = _class_cache_rows(spark, sf).select(*TB.CLASSIFICATION_KEY).distinct()
    hits, _ = TB.lookup(probe, _class_cache(spark, sf), TB.CLASSIFICATION_KEY, NOW_TS)
    return hits.select("user_id", "transcript_hash", "category", "confidence", "expires_at")


@register("cache_misses", (
    f"WITH c AS ({_CLASS_UPSERT_SQL}), p AS ({_PROBE_SQL}) SELECT p.user_id, p.transcript_hash FROM p "
    f"WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND c.transcript_hash = p.transcript_hash "
    f"AND c.expires_at >= TIMESTAMP '{NOW_TS}')"))
def q_cache_misses(spark, sf):
    probe = _class_cache_rows(spark, sf).select(*TB.CLASSIFICATION_KEY).distinct()
    _, misses = TB.lookup(probe, _class_cache(spark, sf), TB.CLASSIFICATION_KEY, NOW_TS)
    return misses


def _coach_cache_rows(spark, sf):
    e = TR.table(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("agent"), (F.col("user_id") % 7).cast("string")).alias("agent_name"),
        F.md5(F.concat("event_type", "props")).alias("prompt_hash"), F.col("props").alias("coaching_json"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model_used"),
        F.col("ts").alias("created_at"), (F.col("ts") + F.expr(TB.TTL)).alias("expires_at"))


_COACH_UPSERT_SQL = (
    "SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, 'agent' || CAST(user_id % 7 AS VARCHAR) AS "
    "agent_name, md5(event_type || props) AS prompt_hash, props AS coaching_json, "
    "'m' || CAST(event_id % 3 AS VARCHAR) AS model_used, ts AS created_at, ts + INTERVAL 7 DAYS AS expires_at "
    "FROM events) r QUALIFY row_number() OVER (PARTITION BY user_id, agent_name, prompt_hash "
    "ORDER BY created_at DESC, coaching_json DESC, model_used DESC, expires_at DESC) = 1")


def _coach_cache(spark, sf):
    rows = _coach_cache_rows(spark, sf)
    old = rows.filter(F.col("created_at") < F.lit(SPLIT_TS).cast("timestamp"))
    new = rows.filter(F.col("created_at") >= F.lit(SPLIT_TS).cast("timestamp"))
    return TB.upsert(old, new, TB.COACHING_KEY)


@register("coaching_cache_upsert", _COACH_UPSERT_SQL)
def q_coach_upsert(spark, sf):
    return _coach_cache(spark, sf)


@register("cache_evict", (
    f"SELECT (SELECT count(*) FROM ({_CLASS_UPSERT_SQL}) a WHERE expires_at < TIMESTAMP '{NOW_TS}') "
    "AS classifications, "
    f"(SELECT count(*) FROM ({_COACH_UPSERT_SQL}) b WHERE expires_at < TIMESTAMP '{NOW_TS}') AS coaching"))
def q_cache_evict(spark, sf):
    return TB.eviction_counts({"classifications": _class_cache(spark, sf),
                               "coaching": _coach_cache(spark, sf)}, NOW_TS)


@register("cache_evict_kept", (
    f"SELECT * FROM ({_CLASS_UPSERT_SQL}) a WHERE expires_at >= TIMESTAMP '{NOW_TS}' OR expires_at IS NULL"))
def q_cache_kept(spark, sf):
    kept, _ = TB.evict(_class_cache(spark, sf), NOW_TS)
    return kept


@register("coaching_cache_hits", (
    f"WITH c AS ({_COACH_UPSERT_SQL}) SELECT user_id, agent_name, prompt_hash, coaching_json, model_used FROM c "
    f"WHERE expires_at >= TIMESTAMP '{NOW_TS}'"))
def q_coach_hits(spark, sf):
    probe = _coach_cache_rows(spark, sf).select(*TB.COACHING_KEY).distinct()
    hits, _ = TB.lookup(probe, _coach_cache(spark, sf), TB.COACHING_KEY, NOW_TS)
    return hits.select(*TB.COACHING_KEY, "coaching_json", "model_used")


# --------------------------------------------------------------------------
# Tables stored by user, and classification through the cache
# --------------------------------------------------------------------------

from callsift.plans.cached import CACHE_SCHEMA, RESULT, classify_cached  # noqa: E402
from callsift.sources.user_table import UserTable  # noqa: E402

# rows of the last hours come as a second write, which touches some users only
LATE_TS = "2024-01-30 12:00:00"
_LATE_SQL = f"created_at < TIMESTAMP '{SPLIT_TS}' OR created_at >= TIMESTAMP '{LATE_TS}'"


def _stored_cache(spark, sf) -> UserTable:
    """The classification cache as a table by user: a first load and a merge."""
    rows, at = _class_cache_rows(spark, sf), F.col("created_at")
    table = UserTable(spark, scratch_path(spark, "user-cache"), CACHE_SCHEMA)
    table.merge(rows.filter(at < F.lit(SPLIT_TS).cast("timestamp")), TB.CLASSIFICATION_KEY)
    table.merge(rows.filter(at >= F.lit(LATE_TS).cast("timestamp")), TB.CLASSIFICATION_KEY)
    return table


_STORED_SQL = _CLASS_UPSERT_SQL.replace(") r QUALIFY", f") r WHERE {_LATE_SQL} QUALIFY")


@register("user_cache_merge", _STORED_SQL)
def q_user_cache_merge(spark, sf):
    return _stored_cache(spark, sf).read()


@register("user_cache_of_one", f"SELECT * FROM ({_STORED_SQL}) s WHERE user_id = '{UPLOAD_USER}'")
def q_user_cache_of_one(spark, sf):
    return _stored_cache(spark, sf).read(UPLOAD_USER)


@register("user_cache_evict", f"SELECT * FROM ({_STORED_SQL}) s WHERE expires_at >= TIMESTAMP '{NOW_TS}' OR expires_at IS NULL")
def q_user_cache_evict(spark, sf):
    table = _stored_cache(spark, sf)
    table.evict(NOW_TS)
    return table.read()


CACHED_AT, LONG_AGO, CACHE_USER = "2024-01-24 00:00:00", "2024-01-02 00:00:00", "7"


def _reviewed(spark, sf) -> UserTable:
    """A cache in which the English documents have a live entry of the user,
    the German ones an expired one, and the French ones one of another user."""
    d = TR.table(spark, sf, "documents").filter("text IS NOT NULL")
    entry = d.select(F.when(F.col("lang") == "fr", "8").otherwise(CACHE_USER).alias("user_id"),
                     TX.content_hash("text").alias("transcript_hash"), "lang",
                     F.lit("Reviewed").alias("category"), F.concat(F.lit("by "), "lang").alias("subcategory"),
                     F.lit(0.99).alias("confidence"), F.lit("").alias("matched_keywords"), F.lit("cached").alias("resolve_reason"),
                     F.when(F.col("lang") == "de", F.lit(LONG_AGO)).otherwise(F.lit(CACHED_AT)).cast("timestamp").alias("created_at"))
    table = UserTable(spark, scratch_path(spark, "reviewed-cache"), CACHE_SCHEMA)
    table.merge(TB.with_expiry(entry.filter("lang IN ('en', 'de', 'fr')")).drop("lang"), TB.CLASSIFICATION_KEY)
    return table


def _cached_run(spark, sf):
    table = _reviewed(spark, sf)
    return table, classify_cached(TR.from_documents(spark, sf), table, R.keyword_rules(spark), R.hierarchy(spark),
                                  CACHE_USER, NOW_TS)


# Every text of the classified table by its hash (equal texts classify alike).
_CACHED_CTES = (
    ", live AS (SELECT DISTINCT md5(text) AS transcript_hash FROM documents WHERE lang = 'en' AND text IS NOT NULL), "
    "own AS (SELECT c.*, md5(coalesce(transcript, '')) AS transcript_hash FROM classified c), "
    "res AS (SELECT transcript_id, transcript_hash, "
    + ", ".join(f"CASE WHEN l.transcript_hash IS NOT NULL THEN {v} ELSE own.{c} END AS {c}" for c, v in (
        ("category", "'Reviewed'"), ("subcategory", "'by en'"), ("confidence", "CAST(0.99 AS DOUBLE)"),
        ("matched_keywords", "''"), ("resolve_reason", "'cached'")))
    + ", l.transcript_hash IS NOT NULL AS from_cache FROM own LEFT JOIN live l USING (transcript_hash))")


@register("classify_cached", "WITH " + O.classified_ctes().strip() + _CACHED_CTES + " SELECT * FROM res")
def q_classify_cached(spark, sf):
    return _cached_run(spark, sf)[1]


@register("classify_cached_table", "WITH " + O.classified_ctes().strip() + _CACHED_CTES + (
    f", mine AS (SELECT DISTINCT transcript_hash, {', '.join(RESULT)}, from_cache FROM res) "
    f"SELECT '{CACHE_USER}' AS user_id, transcript_hash, {', '.join(RESULT)}, made_at AS created_at, made_at + INTERVAL 7 DAYS AS expires_at "
    f"FROM (SELECT *, CASE WHEN from_cache THEN TIMESTAMP '{CACHED_AT}' ELSE TIMESTAMP '{NOW_TS}' END AS made_at FROM mine) "
    f"UNION ALL SELECT DISTINCT '8', md5(text), 'Reviewed', 'by fr', CAST(0.99 AS DOUBLE), '', 'cached', "
    f"TIMESTAMP '{CACHED_AT}', TIMESTAMP '{CACHED_AT}' + INTERVAL 7 DAYS FROM documents WHERE lang = 'fr' AND text IS NOT NULL"))
def q_classify_cached_table(spark, sf):
    """The cache of all users after the run: live, renewed and new entries."""
    return _cached_run(spark, sf)[0].read()


@register("upload_history_topk", (
    "SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type || '_' || CAST(event_id AS VARCHAR) "
    "|| '.csv' AS filename, CAST(event_id % 1000 AS BIGINT) AS row_count, value AS processing_time_seconds, "
    "ts AS created_at FROM events) h QUALIFY row_number() OVER (PARTITION BY user_id "
    "ORDER BY created_at DESC, filename) <= 10"))
def q_history(spark, sf):
    e = TR.table(spark, sf, "events")
    h = e.select(F.col("user_id").cast("string").alias("user_id"),
                 F.concat("event_type", F.lit("_"), F.col("event_id").cast("string"), F.lit(".csv")).alias("filename"),
                 (F.col("event_id") % 1000).cast("long").alias("row_count"),
                 F.col("value").alias("processing_time_seconds"), F.col("ts").alias("created_at"))
    return TB.upload_history(h)


# --------------------------------------------------------------------------
# Coaching preparation
# --------------------------------------------------------------------------

from callsift.operators import coaching as CO  # noqa: E402


def _bundle(spark, sf):
    docs = TR.from_documents(spark, sf)
    return CO.coaching_bundle(classified_docs(spark, sf), docs, prepare_fn=prepare)


_BUNDLE_CTES = (
    ", m AS (SELECT agent_name, count(*) AS total_calls, round(avg(confidence), 3) AS avg_confidence, "
    "count(DISTINCT category) AS unique_categories, count(DISTINCT subcategory) AS unique_subcategories "
    "FROM classified WHERE agent_name IS NOT NULL GROUP BY agent_name), "
    "ac AS (SELECT agent_name, category, count(*) AS count, min(transcript_id) AS sample_id, "
    "arg_min(subcategory, transcript_id) AS sample_subcategory, arg_min(confidence, transcript_id) "
    "AS sample_confidence FROM classified WHERE agent_name IS NOT NULL AND category IS NOT NULL "
    "GROUP BY agent_name, category), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY agent_name ORDER BY count DESC, category) AS rank FROM ac), "
    "bundle AS (SELECT r.agent_name, m.total_calls, m.avg_confidence, m.unique_categories, m.unique_subcategories, "
    "r.rank, r.category, r.count, CASE WHEN r.rank <= 5 THEN r.sample_id END AS sample_id, "
    "CASE WHEN r.rank <= 5 THEN r.sample_subcategory END AS sample_subcategory, "
    "CASE WHEN r.rank <= 5 THEN r.sample_confidence END AS sample_confidence, "
    "CASE WHEN r.rank <= 5 THEN substring(p.redacted_transcript, 1, 500) END AS sample_text "
    "FROM r JOIN m ON r.agent_name = m.agent_name LEFT JOIN prep p ON p.transcript_id = r.sample_id "
    "WHERE r.rank <= 10)")


@register("coaching_bundle", "WITH " + O.classified_ctes().strip() + _BUNDLE_CTES + " SELECT * FROM bundle")
def q_bundle(spark, sf):
    return _bundle(spark, sf)


def _prompt_ctes(context: int) -> str:
    """The prompts of ``coaching_prompts`` over ``bundle``; ~ is a line end."""
    over = f"length(f) // 4 > {int(context * 0.7)}"
    sql = """,
    head AS (SELECT agent_name, '~You coach contact-center agents. Review the data below.~~Agent: ' || agent_name
               || '~~Metrics:~- Calls: ' || any_value(total_calls)
               || '~- Mean confidence: ' || CAST(any_value(avg_confidence) AS VARCHAR)
               || '~- Categories: ' || any_value(unique_categories) || '~- Subcategories: ' || any_value(unique_subcategories)
               || '~~Category counts:~{~' || string_agg('  ' || to_json(category) || ': ' || count, ',~' ORDER BY rank)
               || '~}~~Sample transcripts (redacted):~' AS h,
               coalesce(string_agg('~Sample ' || rank || ':~Category: ' || category || ' / ' || sample_subcategory
                 || ' (confidence ' || printf('%.3f', sample_confidence) || ')~Text: ' || sample_text || '~~', ''
                 ORDER BY rank) FILTER (WHERE sample_id IS NOT NULL), '') AS s,
               coalesce(string_agg('~Sample ' || rank || ':~Category: ' || category || ' / ' || sample_subcategory
                 || '~Text: ' || substring(sample_text, 1, 200) || '...~~', ''
                 ORDER BY rank) FILTER (WHERE sample_id IS NOT NULL AND rank <= 3), '') AS cut
             FROM bundle GROUP BY agent_name),
    full_prompt AS (SELECT *, h || s || '~~Answer with one JSON object with the keys root_cause, coaching_points, '
               || 'sample_script, kpi_recommendations, strengths and priority (High/Medium/Low).' AS f FROM head),
    prompt AS (SELECT agent_name, OVER AS was_truncated, CASE WHEN OVER THEN
               h || '[... shortened to fit the context window ...]~~' || cut || '~~Answer with the same JSON object only.'
               ELSE f END AS prompt FROM full_prompt),
    prompts AS (SELECT agent_name, was_truncated, CAST(length(prompt) // 4 AS BIGINT) AS est_tokens,
               md5(prompt) AS prompt_hash FROM prompt)"""
    sql = sql.replace("'~You coach", "'You coach").replace("OVER AS", over + " AS").replace("WHEN OVER THEN", f"WHEN {over} THEN")
    return _BUNDLE_CTES + sql.replace("~", "\n")


# 840 tokens of budget; ``coaching_pending`` alone stays at 950 (665 tokens),
# as its SQL does
PROMPT_CONTEXT, PENDING_CONTEXT = 1200, 950


@register("coaching_prompts", "WITH " + O.classified_ctes().strip() + _prompt_ctes(PROMPT_CONTEXT) + " SELECT * FROM prompts")
def q_prompts(spark, sf, context=PROMPT_CONTEXT):
    return _prompts(spark, sf, context)


def _prompts(spark, sf, context):
    p = CO.coaching_prompts(CO.nest_bundle(_bundle(spark, sf)), context_limit=context)
    return p.select("agent_name", "was_truncated", "est_tokens", "prompt_hash")


# Replies derived from the data, so that each path of the reply reader occurs.
# {h}: a hash of the row, {t}: its text.
_REPLIES = [
    '\n{"root_cause": "{h}", "coaching_points": ["a", "b"],\n "sample_script": "s", "priority": "High"}\n',
    'Here:\n```json\n{"root_cause": "{h}", "coaching_points": ["a"],\n "sample_script": "s"}\n```',
    'Sure: {"root_cause": "{h}"} bye',
    "{t}",
    None,
    "5",
    '{"a": {"root_cause": "x"}}',
    "{'root_cause': 'x', 'coaching_points': [], 'sample_script': 's'}",
    '{"root_cause": "{h}", "coaching_points": "do it", "sample_script": null, "priority": null}',
]


def _reply_parts(x: str, h, t, literal) -> list:
    return [h if p == "{h}" else t if p == "{t}" else literal(p) for p in re.split(r"(\{[ht]\})", x) if p]


def _reply_sql(n: str, h: str, t: str) -> str:
    return f"CASE {n} % {len(_REPLIES)} " + " ".join(
        f"WHEN {i} THEN " + ("NULL" if x is None else " || ".join(_reply_parts(x, h, t, O.q)))
        for i, x in enumerate(_REPLIES)) + " END"


def _reply(n, h, t):
    out = F.lit(None).cast("string")
    for i, x in enumerate(_REPLIES):
        if x is not None:
            out = F.when(n % len(_REPLIES) == i, F.concat(*_reply_parts(x, h, t, F.lit))).otherwise(out)
    return out


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{O.P.WS}+|{O.P.WS}+$', '', 'g')"


def _parsed_sql(src: str) -> str:
    """``src`` (with content) plus the fields that the reply reader gives."""
    def js(x):
        return f"CASE WHEN json_valid({x}) THEN {x} END"

    def good(x, test):
        return f"coalesce(json_type({js(x)}) = 'OBJECT' AND {test.replace('%s', js(x))}, FALSE)"

    every = " AND ".join(f"json_exists(%s, '$.{k}')" for k in O.P.REPLY_KEYS)
    either = "(json_exists(%s, '$.root_cause') OR json_exists(%s, '$.coaching_points'))"
    d, j = O.P.REPLY_DEFAULTS, js("js")
    return f"""
    (SELECT *, CASE path WHEN 'error' THEN {O.q(O.P.PARSING_ERROR)} || CASE WHEN c IS NULL THEN 'no content' ELSE
                 'argument of type ' || chr(39) || CASE json_type({js('c')}) WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool'
                 WHEN 'NULL' THEN 'NoneType' ELSE 'int' END || chr(39) || ' is not iterable' END
               WHEN 'text' THEN coalesce(lines[1], {O.q(O.P.UNREADABLE)})
               ELSE coalesce(json_extract_string({j}, '$.root_cause'),
                             CASE WHEN path = 'object' THEN {O.q(d['root_cause'])} END) END AS root_cause,
             CAST(CASE path WHEN 'error' THEN 1 WHEN 'text' THEN greatest(1, least(3, len(lines) - 1)) ELSE
               CASE coalesce(json_type({j}, '$.coaching_points'), '') WHEN 'ARRAY' THEN json_array_length({j}, '$.coaching_points')
               WHEN '' THEN 0 WHEN 'NULL' THEN NULL ELSE 1 END END AS INTEGER) AS n_points,
             CASE path WHEN 'error' THEN 'Low' WHEN 'text' THEN 'Medium' WHEN 'object' THEN
               CASE WHEN json_exists({j}, '$.priority') THEN json_extract_string({j}, '$.priority') ELSE 'Medium' END
               ELSE json_extract_string({j}, '$.priority') END AS priority,
             CASE WHEN path = 'text' THEN CAST(length(substring(c, 1, 500)) AS INTEGER) END AS raw_len
      FROM (SELECT *, CASE path WHEN 'json' THEN c WHEN 'fenced' THEN fence WHEN 'object' THEN brace END AS js,
              [l FOR l IN [{_strip_sql('x')} FOR x IN string_split(c, chr(10))] IF l <> ''] AS lines
            FROM (SELECT *, CASE WHEN c IS NULL OR json_type({js('c')}) NOT IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN 'error'
                    WHEN {good('c', every)} THEN 'json' WHEN {good('fence', every)} THEN 'fenced'
                    WHEN {good('brace', either)} THEN 'object' ELSE 'text' END AS path
                  FROM (SELECT *, regexp_extract(c, {O.q('(?s)' + O.P.FENCED_JSON)}, 1) AS fence,
                               regexp_extract(c, {O.q(O.P.BRACE_OBJECT)}) AS brace
                        FROM (SELECT *, {_strip_sql('content')} AS c FROM ({src}) a) b) d) e) g)"""


_REPLY_ROWS_SQL = ("SELECT conv_id, turn, " + _reply_sql("(conv_id + turn)", "md5(coalesce(text, ''))", "coalesce(text, '')")
                   + " AS content FROM conversations")


@register("parse_responses", (
    "SELECT conv_id, turn, path AS parse_path, root_cause, n_points, priority, raw_len FROM "
    + _parsed_sql(_REPLY_ROWS_SQL) + " p"))
def q_parse(spark, sf):
    """Every turn of every conversation becomes a reply; all paths occur."""
    c = TR.table(spark, sf, "conversations")
    text = F.coalesce("text", F.lit(""))
    r = c.select("conv_id", "turn", _reply(F.col("conv_id") + F.col("turn"), F.md5(text), text).alias("content"))
    return CO.parse_responses(r).select(
        "conv_id", "turn", "parse_path", "root_cause",
        F.when(F.col("coaching_points").isNotNull(), F.size("coaching_points")).alias("n_points"), "priority",
        F.length("raw_response").alias("raw_len"))


# The coaching cache of the prompts themselves, by the first digit of the
# prompt's hash: 0-7 live, 8-b expired, the others absent.
def _prompt_cache(prompts):
    digit = F.substring("prompt_hash", 1, 1)
    now = F.lit(NOW_TS).cast("timestamp")
    age = F.when(digit < "8", F.expr("INTERVAL 1 DAYS")).otherwise(F.expr("INTERVAL 9 DAYS"))
    return TB.with_expiry(prompts.filter(digit < "c").select(
        F.lit(UPLOAD_USER).alias("user_id"), "agent_name", "prompt_hash",
        F.concat(F.lit('{"root_cause":"'), "prompt_hash", F.lit('"}')).alias("coaching_json"),
        F.lit("cached-model").alias("model_used"), (now - age).alias("created_at")))


@register("coaching_pending", "WITH " + O.classified_ctes().strip() + _prompt_ctes(PENDING_CONTEXT)
          + " SELECT * FROM prompts WHERE substring(prompt_hash, 1, 1) >= '8'")
def q_coaching_pending(spark, sf, context=PENDING_CONTEXT):
    prompts = write_table(_prompts(spark, sf, context), "prompts")
    return CO.pending_prompts(prompts, _prompt_cache(prompts), UPLOAD_USER, NOW_TS).select(
        "agent_name", "was_truncated", "est_tokens", "prompt_hash")


def _coaching(spark, sf, context):
    prompts = write_table(_prompts(spark, sf, context), "prompts")
    n = F.conv(F.substring("prompt_hash", 2, 2), 16, 10).cast("int")
    replies = prompts.select("agent_name", "prompt_hash", _reply(n, F.col("prompt_hash"), F.col("agent_name")).alias("content"))
    return CO.coaching_results(prompts, replies, _prompt_cache(prompts), UPLOAD_USER, NOW_TS, "asked-model")


_ANSWERED_SQL = _parsed_sql(
    "SELECT agent_name, prompt_hash, was_truncated, "
    + _reply_sql("CAST('0x' || substring(prompt_hash, 2, 2) AS INTEGER)", "prompt_hash", "agent_name")
    + " AS content FROM prompts WHERE substring(prompt_hash, 1, 1) >= '8'")


@register("coaching_cache_first", "WITH " + O.classified_ctes().strip() + _prompt_ctes(PROMPT_CONTEXT) + (
    " SELECT agent_name, prompt_hash, was_truncated, TRUE AS cached, 'cached-model' AS model_used, 'cache' AS parse_path, "
    "prompt_hash AS root_cause FROM prompts WHERE substring(prompt_hash, 1, 1) < '8' UNION ALL "
    f"SELECT agent_name, prompt_hash, was_truncated, FALSE, 'asked-model', path, root_cause FROM {_ANSWERED_SQL} a"))
def q_coaching_results(spark, sf, context=PROMPT_CONTEXT):
    results, _ = _coaching(spark, sf, context)
    return results.select("agent_name", "prompt_hash", "was_truncated", "cached", "model_used", "parse_path",
                          F.get_json_object("coaching_json", "$.root_cause").alias("root_cause"))


@register("coaching_cache_write", "WITH " + O.classified_ctes().strip() + _prompt_ctes(PROMPT_CONTEXT) + (
    f" SELECT '{UPLOAD_USER}' AS user_id, agent_name, prompt_hash, root_cause, 'asked-model' AS model_used, "
    f"TIMESTAMP '{NOW_TS}' + INTERVAL 7 DAYS AS expires_at FROM {_ANSWERED_SQL} a WHERE path <> 'error'"))
def q_coaching_write(spark, sf, context=PROMPT_CONTEXT):
    _, rows = _coaching(spark, sf, context)
    return rows.select("user_id", "agent_name", "prompt_hash", F.get_json_object("coaching_json", "$.root_cause").alias("root_cause"),
                       "model_used", "expires_at")


# The same at the operator's own context, the reference's default.
for _name, _query, _context in (("coaching_prompts", q_prompts, PROMPT_CONTEXT), ("coaching_pending", q_coaching_pending, PENDING_CONTEXT),
                                ("coaching_cache_first", q_coaching_results, PROMPT_CONTEXT),
                                ("coaching_cache_write", q_coaching_write, PROMPT_CONTEXT)):
    register(f"{_name}_default", ORACLE[_name].replace(_prompt_ctes(_context), _prompt_ctes(CO.DEFAULT_CONTEXT)))(
        functools.partial(_query, context=None))


# --------------------------------------------------------------------------
# Report aggregates (E16) and exports
# --------------------------------------------------------------------------

from callsift.operators import report as RP  # noqa: E402
from callsift.sources import export as XP  # noqa: E402
from callsift.session import write_table  # noqa: E402


@register("report_summary", W(
    f"SELECT count(*) AS total, ROUND(avg(confidence), {A.AVG_DIGITS}) AS avg_confidence, "
    "count(DISTINCT category) AS unique_categories, count(DISTINCT subcategory) AS unique_subcategories "
    "FROM classified"))
def q_rep_summary(spark, sf):
    return RP.report_summary(classified_docs(spark, sf))


@register("report_top_agents", W(
    f"SELECT agent_name, count(transcript_id) AS total_calls, ROUND(avg(confidence), {A.AVG_DIGITS}) "
    "AS avg_confidence, count(DISTINCT category) AS unique_categories FROM classified "
    "WHERE agent_name IS NOT NULL GROUP BY agent_name ORDER BY total_calls DESC, agent_name LIMIT 10"))
def q_rep_agents(spark, sf):
    return RP.report_top_agents(classified_docs(spark, sf))


@register("report_top_issues", W(
    "SELECT category, subcategory, count(*) AS count FROM classified "
    "WHERE category IS NOT NULL AND subcategory IS NOT NULL GROUP BY category, subcategory "
    "ORDER BY count DESC, category, subcategory LIMIT 10"))
def q_rep_issues(spark, sf):
    return RP.report_top_issues(classified_docs(spark, sf))


@register("report_top_categories", W(
    "SELECT category, count(*) AS count FROM classified WHERE category IS NOT NULL "
    "GROUP BY category ORDER BY count DESC, category LIMIT 10"))
def q_rep_cats(spark, sf):
    return RP.report_top_categories(classified_docs(spark, sf))


@register("export_parquet", W(
    "SELECT transcript_id, transcript, redacted_transcript, agent_name, category, subcategory, tertiary, quaternary, "
    "cat_no, confidence, matched_keywords, source FROM classified"))
def q_export(spark, sf):
    out = classified_docs(spark, sf, with_text=True).select(
        "transcript_id", "transcript", "redacted_transcript", "agent_name", "category", "subcategory", "tertiary", "quaternary", "cat_no",
        "confidence", "matched_keywords", "source")
    path = XP.export_parquet(out, scratch_path(spark, "export"))
    return spark.read.parquet(path)


@register("export_csv", W(
    "SELECT transcript_id, transcript, redacted_transcript, agent_name, category, subcategory, tertiary, quaternary, "
    "cat_no, confidence, matched_keywords, source FROM classified"))
def q_export_csv(spark, sf):
    out = classified_docs(spark, sf, with_text=True).select(
        "transcript_id", "transcript", "redacted_transcript", "agent_name", "category", "subcategory", "tertiary", "quaternary", "cat_no",
        "confidence", "matched_keywords", "source")
    path = XP.export_csv(out, scratch_path(spark, "export-csv"))
    return XP.read_export_csv(spark, path, out.schema)


# --------------------------------------------------------------------------
# Streaming (M1, M2)
# --------------------------------------------------------------------------

from callsift.streaming import classify_stream as ST  # noqa: E402


ARRIVALS = 4


def _stream(spark, sf):
    """Documents arrive in four lots, one per micro-batch; a lot of a large
    table is as many files as the table is read in parts."""
    docs = TR.table(spark, sf, "documents")
    landing = scratch_path(spark, "stream-landing")
    parts = max(1, min(docs.rdd.getNumPartitions(), docs.count() // 1000))  # few rows: no part without any
    docs.repartition(ARRIVALS * parts, "doc_id").write.parquet(landing)
    files = len(spark.read.schema(docs.schema).parquet(landing).inputFiles())
    to_t = lambda b: TR.map_columns(b.select("doc_id", "text", "source"), transcript="text",
                                    agent="source", transcript_id="doc_id")
    return ST.run_classification_stream(spark, landing, docs.schema, to_t, R.keyword_rules(spark), R.hierarchy(spark),
                                        max_files_per_trigger=max(1, -(-files // ARRIVALS)), file_glob="*.parquet")


@register("stream_classify", W(
    "SELECT transcript_id, category, subcategory, cat_no, confidence, num_rules_activated FROM classified"))
def q_stream(spark, sf):
    paths = _stream(spark, sf)
    return spark.read.parquet(paths["classified"]).select(
        "transcript_id", "category", "subcategory", "cat_no", "confidence", "num_rules_activated")


@register("stream_running_stats", W(
    "SELECT CAST(4 AS BIGINT) AS batches, n AS total_transcripts, c AS classified, c / n * 100.0 AS classified_pct, "
    "n - c AS unclassified, (n - c) / n * 100.0 AS unclassified_pct, avg_confidence, high_confidence, medium_confidence, "
    "low_confidence FROM (SELECT CAST(count(*) AS BIGINT) AS n, "
    f"count(*) FILTER (WHERE category <> 'Unclassified') AS c, ROUND(AVG(confidence), {A.AVG_DIGITS}) AS avg_confidence, "
    "count(*) FILTER (WHERE confidence >= CAST(0.7 AS DOUBLE)) AS high_confidence, "
    "count(*) FILTER (WHERE confidence >= CAST(0.5 AS DOUBLE) AND confidence < CAST(0.7 AS DOUBLE)) "
    "AS medium_confidence, count(*) FILTER (WHERE confidence >= CAST(0.4 AS DOUBLE) AND "
    "confidence < CAST(0.5 AS DOUBLE)) AS low_confidence FROM classified) s"))
def q_stream_stats(spark, sf):
    return ST.running_stats(spark.read.parquet(_stream(spark, sf)["stats"]))


def _stateful(spark, sf):
    """Documents arrive in four lots and one of these a second time; the
    stream is run after two lots and again after the rest, about a lot per
    micro-batch however many files it is."""
    docs = TR.table(spark, sf, "documents").withColumn("ts", F.timestamp_seconds(F.lit(1577836800) + F.coalesce("doc_id", F.lit(0))))
    files, landing, out = (scratch_path(spark, n) for n in ("stream-files", "stream-landing", "stream-state"))
    docs.withColumn("file", F.pmod(F.xxhash64("doc_id"), F.lit(4))).write.partitionBy("file").parquet(files)
    to_t = lambda b: TR.map_columns(b.select("doc_id", "text", "source", "ts"), transcript="text", agent="source",
                                    transcript_id="doc_id", timestamp="ts")
    landed = 0
    for part in ((0, 1), (2, 0, 3)):
        for f in part:
            spark.read.schema(docs.schema).parquet(f"{files}/file={f}").write.mode("append").parquet(landing)
        before, landed = landed, len(spark.read.schema(docs.schema).parquet(landing).inputFiles())
        paths = ST.run_stateful_stream(spark, landing, docs.schema, to_t, R.keyword_rules(spark), R.hierarchy(spark), out,
                                       lateness="3650 days", max_files_per_trigger=max(1, -(-(landed - before) // len(part))),
                                       file_glob="*.parquet")
    return paths


@register("stream_stateful_classify", ORACLE["stream_classify"])
def q_stream_stateful(spark, sf):
    return spark.read.parquet(_stateful(spark, sf)["classified"]).select(
        "transcript_id", "category", "subcategory", "cat_no", "confidence", "num_rules_activated")


@register("stream_state_totals", ORACLE["stream_running_stats"].replace("CAST(4 AS BIGINT) AS batches, ", ""))
def q_stream_state(spark, sf):
    return ST.latest_totals(spark.read.parquet(_stateful(spark, sf)["totals"]))


# --------------------------------------------------------------------------
# Hierarchy validation (C11), distinct agents (H5)
# --------------------------------------------------------------------------

from callsift.operators import hierarchy as HY  # noqa: E402


@register("hierarchy_validate", W(
    ", ccre_cat AS (SELECT c.transcript_id, CASE WHEN c.rule_ord IS NULL THEN 'Unclassified' "
    "ELSE u.category END AS category, CASE WHEN c.rule_ord IS NOT NULL THEN u.subcategory "
    "WHEN c.is_empty THEN 'Empty Transcript' ELSE 'No Match' END AS subcategory "
    "FROM ccre c LEFT JOIN rules u ON c.rule_ord = u.rule_ord), "
    "paths AS (SELECT DISTINCT L1, CAST(NULL AS VARCHAR) AS L2 FROM hier WHERE Program = 'CCRE' "
    "UNION SELECT DISTINCT L1, L2 FROM hier WHERE Program = 'CCRE') "
    "SELECT transcript_id, category, subcategory, EXISTS (SELECT 1 FROM paths p WHERE "
    "p.L1 IS NOT DISTINCT FROM ccre_cat.category AND p.L2 IS NOT DISTINCT FROM ccre_cat.subcategory) "
    "AS path_valid FROM ccre_cat"))
def q_hier_validate(spark, sf):
    c = classify_ccre(TR.from_documents(spark, sf), R.keyword_rules(spark))
    return HY.validate_paths(c.select("transcript_id", "category", "subcategory"), R.hierarchy(spark),
                             "CCRE", [("category", "L1"), ("subcategory", "L2")])


@register("distinct_agents", W(
    "SELECT DISTINCT agent_name FROM classified WHERE agent_name IS NOT NULL ORDER BY agent_name"))
def q_agents_distinct(spark, sf):
    return (classified_docs(spark, sf).filter(F.col("agent_name").isNotNull())
            .select("agent_name").distinct().orderBy("agent_name"))


# --------------------------------------------------------------------------
# User-scoped hierarchy and examples tables (A9-A13), rows derived from
# events (current table) and from the data (uploads)
# --------------------------------------------------------------------------



# every 97th row has no owner, every 13th no phrase
_OWNER_SQL = "CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS VARCHAR) END"
_PHRASE_SQL = "CASE WHEN event_id % 13 <> 0 THEN props END"


def _owner():
    return F.when(F.col("event_id") % 97 != 0, F.col("user_id").cast("string"))


def _user_hier_current(spark, sf):
    return TR.table(spark, sf, "events").select(
        _owner().alias("user_id"), F.col("event_type").alias("category"),
        F.concat(F.lit("sub"), (F.col("event_id") % 3).cast("string")).alias("subcategory"),
        F.lit(None).cast("string").alias("tertiary_category"))


def _user_hier_upload(spark, sf):
    e = TR.table(spark, sf, "events").filter(F.col("user_id") == int(UPLOAD_USER))
    return e.select(F.concat(F.lit(" "), F.col("event_type"), F.lit("  ")).alias("category"),
                    F.when(F.col("event_id") % 2 == 0, F.lit(None))
                     .otherwise(F.concat(F.lit("\tx"), (F.col("event_id") % 5).cast("string"))).alias("subcategory"),
                    F.concat(F.lit(" t"), (F.col("event_id") % 4).cast("string"), F.lit(" ")).alias("tertiary_category"))


_HIER_CURRENT_SQL = (
    f"SELECT {_OWNER_SQL} AS user_id, event_type AS category, 'sub' || CAST(event_id % 3 AS VARCHAR) AS subcategory, "
    "CAST(NULL AS VARCHAR) AS tertiary_category FROM events")


@register("hierarchy_replace", (
    f"SELECT * FROM ({_HIER_CURRENT_SQL}) c WHERE user_id IS DISTINCT FROM '{UPLOAD_USER}' "
    f"UNION ALL SELECT '{UPLOAD_USER}', event_type, CASE WHEN event_id % 2 = 0 THEN NULL ELSE "
    "'x' || CAST(event_id % 5 AS VARCHAR) END, 't' || CAST(event_id % 4 AS VARCHAR) FROM events "
    f"WHERE user_id = {UPLOAD_USER}"))
def q_hier_replace(spark, sf):
    return TB.replace_user_hierarchy(_user_hier_current(spark, sf), _user_hier_upload(spark, sf), UPLOAD_USER)


@register("user_hierarchy_read", (
    f"SELECT category, subcategory, tertiary_category FROM ({_HIER_CURRENT_SQL}) c WHERE user_id = '{UPLOAD_USER}'"))
def q_hier_read(spark, sf):
    return TB.read_user_hierarchy(_user_hier_current(spark, sf), UPLOAD_USER)


def _examples_current(spark, sf):
    return TR.table(spark, sf, "events").select(
        _owner().alias("user_id"), F.when(F.col("event_id") % 13 != 0, F.col("props")).alias("example_phrase"),
        F.col("event_type").alias("category"), F.lit(None).cast("string").alias("subcategory"),
        F.lit(None).cast("string").alias("tertiary_category"),
        (F.col("value") / 100.0).alias("confidence"), F.lit("manual").alias("source"))


_EXAMPLES_CURRENT_SQL = (
    f"SELECT {_OWNER_SQL} AS user_id, {_PHRASE_SQL} AS example_phrase, event_type AS category, "
    "CAST(NULL AS VARCHAR) AS subcategory, CAST(NULL AS VARCHAR) AS tertiary_category, "
    "value / 100.0 AS confidence, 'manual' AS source FROM events")


@register("user_examples_read", (
    f"SELECT * EXCLUDE (user_id) FROM ({_EXAMPLES_CURRENT_SQL}) c WHERE user_id = '{UPLOAD_USER}'"))
def q_examples_read(spark, sf):
    return TB.read_user_examples(_examples_current(spark, sf), UPLOAD_USER)


@register("examples_append", (
    f"WITH corr AS ({_CORR_SQL}), "
    f"txt AS (SELECT doc_id AS transcript_id, {O.redact_sql(O.clean_sql('text'))} AS redacted_transcript "
    "FROM documents) "
    f"{_EXAMPLES_CURRENT_SQL} UNION ALL SELECT '{UPLOAD_USER}', "
    "trim(substring(t.redacted_transcript, 1, 200)), c.correct_category, c.correct_subcategory, "
    "c.correct_tertiary, CAST(0.95 AS DOUBLE), 'feedback' "
    "FROM corr c JOIN txt t ON c.transcript_id = t.transcript_id"))
def q_examples_append(spark, sf):
    corr = FB.corrections_from_labels(TR.table(spark, sf, "labels"))
    upload = FB.corrections_to_examples(corr, TR.from_documents(spark, sf), prepare_fn=prepare)
    return TB.append_user_examples(_examples_current(spark, sf), upload, UPLOAD_USER)


@register("examples_delete", (
    f"SELECT x.* FROM ({_EXAMPLES_CURRENT_SQL}) x LEFT JOIN (VALUES ('8', '{{\"k\": 69}}')) d(u, p) "
    "ON x.user_id = d.u AND x.example_phrase = d.p WHERE d.u IS NULL AND coalesce(x.user_id, '') <> '9'"))
def q_examples_delete(spark, sf):
    t = TB.delete_user_examples(_examples_current(spark, sf), "8", '{"k": 69}')
    return TB.delete_user_examples(t, "9")
