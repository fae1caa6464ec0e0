"""One roll-up that the analytics and report tables derive from.

The classified table is read once and aggregated to cells: one row for each
combination of the grouping columns that occurs (bounded by agents times
hierarchy paths; partial aggregation, so a hot agent is spread). GROUPING SETS
over the cells give every level with its measures; distinct counts are exact,
as the cells hold each combination once. ``reports`` writes that small table
and takes each result from it by a filter, an order and a limit.

Null keys are groups of their own, as in the SQL aggregates; the report tables
leave them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.operators.analytics import AVG_DIGITS
from callsift.session import write_table

KEYS = ["agent_name", "category", "subcategory", "source", "resolve_reason"]
LEVELS = {"all": [], "category": ["category"], "subcategory": ["category", "subcategory"], "source": ["source"],
          "reason": ["resolve_reason"], "agent": ["agent_name"]}
_SUMS = ["count", "ids", "scored", "sum_confidence", "ruled", "sum_rules", "classified", "high_confidence",
         "medium_confidence", "low_confidence"]


def cells(df: DataFrame) -> DataFrame:
    """Counts and sums for each combination of KEYS."""
    c = F.col("confidence")
    return df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("count"), F.count("transcript_id").alias("ids"),
        F.count("confidence").alias("scored"), F.sum(c).alias("sum_confidence"),
        F.count("num_rules_activated").alias("ruled"), F.sum("num_rules_activated").alias("sum_rules"),
        F.count_if(F.col("category") != "Unclassified").alias("classified"),
        F.count_if(c >= F.lit(0.70)).alias("high_confidence"),
        F.count_if((c >= F.lit(0.50)) & (c < F.lit(0.70))).alias("medium_confidence"),
        F.count_if((c >= F.lit(0.40)) & (c < F.lit(0.50))).alias("low_confidence"))


def rollup(df: DataFrame) -> DataFrame:
    """(level, KEYS, measures): one row per group of every level; keys that a
    level does not group by are null. An empty table has no groups."""
    # copies: a distinct count must not see the keys that a set blanks out
    own = cells(df).withColumns({f"own_{k}": F.col(k) for k in ("agent_name", "category", "subcategory")})
    sets = own.groupingSets([[F.col(k) for k in keys] for keys in LEVELS.values()], *KEYS).agg(
        F.grouping_id().alias("set"), *(F.sum(s).alias(s) for s in _SUMS),
        F.countDistinct("own_category").alias("unique_categories"),
        F.countDistinct("own_subcategory").alias("unique_subcategories"),
        F.countDistinct("own_agent_name").alias("unique_agents"))
    level = F.lit(None).cast("string")
    for name, keys in LEVELS.items():
        bits = sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys)
        level = F.when(F.col("set") == bits, name).otherwise(level)
    return sets.select(level.alias("level"), *KEYS, *(F.coalesce(s, F.lit(0)).alias(s) for s in _SUMS),
                       "unique_categories", "unique_subcategories", "unique_agents")


def measures(r: DataFrame) -> DataFrame:
    """The roll-up with rounded means in place of sums."""
    return r.select(
        "level", *KEYS, "count", "ids", "classified", "high_confidence", "medium_confidence", "low_confidence",
        F.round(F.try_divide("sum_confidence", "scored"), AVG_DIGITS).alias("avg_confidence"),
        F.round(F.try_divide("sum_rules", "ruled"), 1).alias("avg_rules_activated"),
        "unique_categories", "unique_subcategories", "unique_agents")


def reports(df: DataFrame, limit: int = 10, subcategories: int = 20) -> dict[str, DataFrame]:
    """The analytics and report tables by name, all from one roll-up of
    ``df``, which is read once."""
    r = write_table(rollup(df), "rollup")

    def level(name: str) -> DataFrame:
        return r.filter(F.col("level") == name)

    def mean(digits: int):
        return F.round(F.try_divide("sum_confidence", "scored"), digits)

    def share(digits: int | None = 2):
        # over the rows of a level: groups, never transcripts
        x = F.col("count") / F.sum("count").over(Window.partitionBy()) * F.lit(100.0)
        return (x if digits is None else F.round(F.col("count") * F.lit(100.0) / F.sum("count").over(Window.partitionBy()), digits)
                ).alias("percentage")

    # an empty table has no groups, but totals
    every = r.sparkSession.range(1).select(F.lit("all").alias("level")).join(level("all"), "level", "left").fillna(
        0, [f.name for f in r.schema.fields if f.dataType == T.LongType()])
    category, sub, agent = level("category"), level("subcategory"), level("agent")
    n = F.col("count")
    named = agent.filter("agent_name IS NOT NULL")
    stats = every.filter("count > 0").select(
        n.alias("total_transcripts"), "classified", (F.col("classified") / n * F.lit(100.0)).alias("classified_pct"),
        (n - F.col("classified")).alias("unclassified"), ((n - F.col("classified")) / n * F.lit(100.0)).alias("unclassified_pct"),
        mean(AVG_DIGITS).alias("avg_confidence"), "high_confidence", "medium_confidence", "low_confidence")
    return {
        "summary_stats": every.select(n.alias("total_transcripts"), F.coalesce(mean(3), F.lit(0.0)).alias("avg_confidence"),
                                      "unique_categories", "unique_subcategories", "unique_agents"),
        "category_distribution": category.select("category", "count", share()).orderBy(F.desc("count"), "category").limit(limit),
        "subcategory_distribution": sub.select("category", "subcategory", "count", share()).orderBy(
            F.desc("count"), "category", "subcategory").limit(subcategories),
        "resolve_reason_distribution": level("reason").select("resolve_reason", "count", share()).orderBy(
            F.desc("count"), "resolve_reason"),
        "agent_performance": named.select(
            "agent_name", n.alias("total_calls"), mean(3).alias("avg_confidence"), "unique_categories", "unique_subcategories",
            F.round(F.try_divide("sum_rules", "ruled"), 1).alias("avg_rules_activated")).orderBy(F.desc("total_calls"), "agent_name"),
        "classification_stats": stats,
        "confidence_bands": stats.select(F.expr(
            "stack(3, 'high', high_confidence, 'medium', medium_confidence, 'low', low_confidence) as (band, count)"),
            "total_transcripts").select("band", "count", (n / F.col("total_transcripts") * F.lit(100.0)).alias("percentage")),
        "by_source": level("source").select("source", "count", share(None)),
        "top_categories": category.select("category", "count", share(None)).orderBy(F.desc("count"), "category").limit(limit),
        "report_summary": every.select(n.alias("total"), mean(AVG_DIGITS).alias("avg_confidence"), "unique_categories",
                                       "unique_subcategories"),
        "report_top_categories": category.filter("category IS NOT NULL").select("category", "count").orderBy(
            F.desc("count"), "category").limit(limit),
        "report_top_agents": named.select("agent_name", F.col("ids").alias("total_calls"), mean(AVG_DIGITS).alias("avg_confidence"),
                                          "unique_categories").orderBy(F.desc("total_calls"), "agent_name").limit(limit),
        "report_top_issues": sub.filter("category IS NOT NULL AND subcategory IS NOT NULL").select(
            "category", "subcategory", "count").orderBy(F.desc("count"), "category", "subcategory").limit(limit),
    }
