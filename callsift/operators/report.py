"""Summary report aggregates (null keys dropped, as pandas group-bys do)
and an HTML rendering of the bounded (at most ten-row) results."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.operators.analytics import AVG_DIGITS
from callsift.session import write_table


def report_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.round(F.avg("confidence"), AVG_DIGITS).alias("avg_confidence"),
                  F.countDistinct("category").alias("unique_categories"),
                  F.countDistinct("subcategory").alias("unique_subcategories"))


def report_top_categories(df: DataFrame, n: int = 10) -> DataFrame:
    return (df.filter(F.col("category").isNotNull()).groupBy("category")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("category")).limit(n))


def report_top_agents(df: DataFrame, n: int = 10) -> DataFrame:
    return (df.filter(F.col("agent_name").isNotNull()).groupBy("agent_name").agg(
        F.count("transcript_id").alias("total_calls"),
        F.round(F.avg("confidence"), AVG_DIGITS).alias("avg_confidence"),
        F.countDistinct("category").alias("unique_categories"))
        .orderBy(F.desc("total_calls"), F.asc("agent_name")).limit(n))


def report_top_issues(df: DataFrame, n: int = 10) -> DataFrame:
    return (df.filter(F.col("category").isNotNull() & F.col("subcategory").isNotNull())
            .groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("category"), F.asc("subcategory")).limit(n))


def _table(df: DataFrame) -> str:
    rows = df.collect()  # bounded: at most ten rows
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def export_html(df: DataFrame, title: str = "Classification report") -> str:
    """A plain HTML page of the four report aggregates. The four read the
    same rows, so the needed columns are written once to the shared folder
    rather than computed four times."""
    cols = [c for c in ("transcript_id", "agent_name", "category", "subcategory", "confidence")
            if c in df.columns]
    df = write_table(df.select(*cols), "report")
    s = report_summary(df).first()
    parts = [f"<h1>{html.escape(title)}</h1>",
             f"<p>Transcripts: {s['total']} &middot; mean confidence: {s['avg_confidence']} &middot; "
             f"categories: {s['unique_categories']} &middot; subcategories: {s['unique_subcategories']}</p>",
             "<h2>Top categories</h2>", _table(report_top_categories(df))]
    if "agent_name" in df.columns:
        parts += ["<h2>Top agents by volume</h2>", _table(report_top_agents(df))]
    parts += ["<h2>Top issues</h2>", _table(report_top_issues(df))]
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>" + html.escape(title) + \
        "</title></head><body>" + "".join(parts) + "</body></html>"
