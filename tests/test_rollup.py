"""The roll-up's reports against the single operators."""

import pytest

from callsift.functions import pii
from callsift.operators import analytics, report, rollup
from callsift.plans.classify import classify
from callsift.sources import rules as R
from callsift.sources import transcripts as TR
from paths import SF

SCHEMA = ("transcript_id long, agent_name string, category string, subcategory string, source string, resolve_reason string, "
          "confidence double, num_rules_activated int")
ROWS = [(1, "a", "B", "x", "ccre", "r1", 0.9, 2), (2, "a", "B", "y", "ccre", "r1", 0.5, 1), (3, "b", "C", "x", "ccre", "r2", 0.7, 1),
        (None, "b", "C", "x", "ccre", "r2", 0.45, 3), (5, None, "Unclassified", "No Match", "none", "r3", 0.0, 0),
        (6, "c", None, None, "none", None, None, None), (7, "c", "B", None, "ccre", "r1", 0.61, 1), (8, "a", "B", "x", "ccre", "r1", 0.9, 2)]
SINGLE = {
    "summary_stats": analytics.summary_stats, "category_distribution": analytics.category_distribution,
    "subcategory_distribution": analytics.subcategory_distribution,
    "resolve_reason_distribution": analytics.resolve_reason_distribution, "agent_performance": analytics.agent_performance,
    "classification_stats": analytics.classification_stats, "confidence_bands": analytics.confidence_bands,
    "by_source": analytics.by_source, "top_categories": analytics.top_categories, "report_summary": report.report_summary,
    "report_top_categories": report.report_top_categories, "report_top_agents": report.report_top_agents,
    "report_top_issues": report.report_top_issues}


def canon(df):
    return df.columns, sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [ROWS, ROWS[4:6], []])
def test_reports_equal_the_single_operators(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = rollup.reports(df)
    assert set(got) == set(SINGLE)
    for name, single in SINGLE.items():
        assert canon(got[name]) == canon(single(df)), name


def test_one_scan_serves_all_levels(spark):
    out = rollup.rollup(classify(TR.from_documents(spark, SF), R.keyword_rules(spark), R.hierarchy(spark)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1 and plan.count("MapInArrow") == 1


def test_redaction_counts_while_the_table_is_written(spark, tmp_path):
    docs = TR.from_documents(spark, SF)
    stats = pii.RedactionStats()
    assert stats.snapshot() == dict.fromkeys(pii.PII_TYPES, 0)
    out = classify(docs, R.keyword_rules(spark), R.hierarchy(spark), with_text=True, stats=stats)
    assert out._jdf.queryExecution().executedPlan().toString().count("documents.parquet") == 1
    out.write.parquet(f"{tmp_path}/classified")
    want = {r.pii_type: r.hits for r in pii.pii_stats(
        docs.select(classify_text().alias("transcript")), "transcript").collect()}
    assert stats.snapshot() == want and any(want.values())
    plain = classify(docs, R.keyword_rules(spark), R.hierarchy(spark), with_text=True)
    assert sorted(spark.read.parquet(f"{tmp_path}/classified").collect(), key=str) == sorted(plain.collect(), key=str)
    stats.redact(docs.limit(0), "transcript", "t").collect()
    assert stats.snapshot() == want
    stats.reset()
    assert stats.snapshot() == dict.fromkeys(pii.PII_TYPES, 0)


def classify_text():
    from callsift.functions.text import clean_transcript
    return clean_transcript("transcript")


def test_counted_redaction_keeps_nulls_and_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now"), (2, None), (3, "")], "_t long, t string")
    stats = pii.RedactionStats()
    got = stats.redact(df, "t", "t")
    assert got.columns == ["_t", "t"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "mail <REDACTED_EMAIL> now"), (2, None), (3, "")]
    assert stats.snapshot()["EMAIL"] == 1
