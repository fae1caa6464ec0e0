"""Analytics over the classified table (all DataFrame -> DataFrame).

Distributions aggregate first (partial aggregation map-side), then compute
shares with a window over the *aggregated* rows, whose count is bounded by
the category hierarchy; ties in top-k are broken by the key, ascending.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsift.functions.patterns import QUERY_ERROR
from callsift.functions.text import percent_display, word_count
from callsift.session import write_table

# Averages of doubles are rounded to this many places where the reference
# reports them unrounded: the summation order differs between engines.
AVG_DIGITS = 10


def _share(count_col: str = "count", digits: int = 2):
    total = F.sum(count_col).over(Window.partitionBy())
    return F.round(F.col(count_col) * F.lit(100.0) / total, digits)


def summary_stats(df: DataFrame, with_agents: bool = True) -> DataFrame:
    """One row: total, average confidence (3 places, null -> 0.0), distinct
    categories / subcategories and, when present, distinct named agents."""
    aggs = [
        F.count(F.lit(1)).alias("total_transcripts"),
        F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("avg_confidence"),
        F.countDistinct("category").alias("unique_categories"),
        F.countDistinct("subcategory").alias("unique_subcategories"),
    ]
    if with_agents and "agent_name" in df.columns:
        aggs.append(F.countDistinct("agent_name").alias("unique_agents"))
    return df.agg(*aggs)


def category_distribution(df: DataFrame, limit: int = 10) -> DataFrame:
    g = df.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    return (g.select("category", "count", _share().alias("percentage"))
            .orderBy(F.desc("count"), F.asc("category")).limit(limit))


def subcategory_distribution(df: DataFrame, parent_category: str | None = None,
                             limit: int = 20) -> DataFrame:
    """Share is within the filtered set; the filter is a Column predicate
    (no SQL text is assembled from the argument)."""
    if parent_category:
        df = df.filter(F.col("category") == F.lit(parent_category))
    g = df.groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("count"))
    return (g.select("category", "subcategory", "count", _share().alias("percentage"))
            .orderBy(F.desc("count"), F.asc("category"), F.asc("subcategory")).limit(limit))


def resolve_reason_distribution(df: DataFrame) -> DataFrame:
    g = df.groupBy("resolve_reason").agg(F.count(F.lit(1)).alias("count"))
    return (g.select("resolve_reason", "count", _share().alias("percentage"))
            .orderBy(F.desc("count"), F.asc("resolve_reason")))


def agent_performance(df: DataFrame) -> DataFrame:
    """Per named agent; one hot agent is fine: partial aggregates per task."""
    return (df.filter(F.col("agent_name").isNotNull())
            .groupBy("agent_name").agg(
                F.count(F.lit(1)).alias("total_calls"),
                F.round(F.avg("confidence"), 3).alias("avg_confidence"),
                F.countDistinct("category").alias("unique_categories"),
                F.countDistinct("subcategory").alias("unique_subcategories"),
                F.round(F.avg("num_rules_activated"), 1).alias("avg_rules_activated"))
            .orderBy(F.desc("total_calls"), F.asc("agent_name")))


def low_confidence_cases(df: DataFrame, threshold: float = 0.6, limit: int = 100) -> DataFrame:
    """Review list: lowest confidence first (ties by id), top ``limit``."""
    cols = ["transcript_id", "category", "subcategory", "confidence", "resolve_reason"]
    if "agent_name" in df.columns:
        cols.append("agent_name")
    return (df.filter(F.col("confidence") < F.lit(float(threshold))).select(*cols)
            .orderBy(F.asc("confidence"), F.asc("transcript_id")).limit(limit))


def classification_stats(df: DataFrame) -> DataFrame:
    """Run statistics in one global aggregate: totals, classified and
    unclassified counts and shares, mean confidence (zeros included) and the
    three confidence bands >= .70, [.50,.70), [.40,.50). Empty input -> no row."""
    c = F.col("confidence")
    is_cls = F.col("category") != F.lit("Unclassified")
    a = df.agg(
        F.count(F.lit(1)).alias("total_transcripts"),
        F.count_if(is_cls).alias("classified"),
        F.round(F.avg(c), AVG_DIGITS).alias("avg_confidence"),
        F.count_if(c >= F.lit(0.70)).alias("high_confidence"),
        F.count_if((c >= F.lit(0.50)) & (c < F.lit(0.70))).alias("medium_confidence"),
        F.count_if((c >= F.lit(0.40)) & (c < F.lit(0.50))).alias("low_confidence"),
    ).filter(F.col("total_transcripts") > 0)
    t = F.col("total_transcripts")
    return a.select(
        "total_transcripts", "classified",
        ((F.col("classified") / t) * F.lit(100.0)).alias("classified_pct"),
        (t - F.col("classified")).alias("unclassified"),
        (((t - F.col("classified")) / t) * F.lit(100.0)).alias("unclassified_pct"),
        "avg_confidence", "high_confidence", "medium_confidence", "low_confidence")


def confidence_bands(df: DataFrame) -> DataFrame:
    """Band counts and their share of all transcripts (long form)."""
    s = classification_stats(df)
    t = F.col("total_transcripts")
    return s.select(F.expr(
        "stack(3, 'high', high_confidence, 'medium', medium_confidence, 'low', low_confidence) "
        "as (band, count)"), t).select(
        "band", "count", (F.col("count") / t * F.lit(100.0)).alias("percentage"))


def by_source(df: DataFrame) -> DataFrame:
    g = df.groupBy("source").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return g.select("source", "count", (F.col("count") / total * F.lit(100.0)).alias("percentage"))


def top_categories(df: DataFrame, n: int = 10) -> DataFrame:
    g = df.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return (g.select("category", "count", (F.col("count") / total * F.lit(100.0)).alias("percentage"))
            .orderBy(F.desc("count"), F.asc("category")).limit(n))


def avg_words(df: DataFrame, text_col: str = "transcript") -> DataFrame:
    """Mean whitespace word count per transcript (null text counts 0)."""
    return df.agg(F.round(F.avg(word_count(text_col)), AVG_DIGITS).alias("avg_words"),
                  F.count(F.lit(1)).alias("total_rows"))


def display_results(df: DataFrame) -> DataFrame:
    """Result table with the confidence shown as a percentage (one place);
    the numeric value is kept next to it."""
    cols = ["transcript_id"] + [c for c in ("agent_name", "call_id", "transcript") if c in df.columns] + [
        "category", "subcategory", "tertiary", "quaternary", "confidence", "matched_keywords", "source"]
    return df.select(*cols, percent_display("confidence").alias("confidence_display"))


def check_read_only(spark: SparkSession, sql: str) -> None:
    """Raises ValueError for a text that is no query, or that holds a command
    or a write anywhere in its plan. The text is parsed, nothing runs."""
    jvm, plans = spark._jvm, "org.apache.spark.sql.catalyst.plans.logical."
    try:
        todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    except (PySparkException, Py4JJavaError) as e:
        raise ValueError(f"{QUERY_ERROR}: {e}") from e
    refused = [jvm.java.lang.Class.forName(plans + name) for name in (
        "Command", "ParsedStatement", "CompoundPlanStatement", "ExecutableDuringAnalysis")]
    while todo:
        node = todo.pop()
        if node.nodeName() == "UnresolvedExecuteImmediate" or any(kind.isInstance(node) for kind in refused):
            raise ValueError(f"{QUERY_ERROR}: only queries are allowed, not {node.nodeName()}")
        for many in (node.children(), node.innerChildren()):
            todo += [x for x in (many.apply(i) for i in range(many.size())) if hasattr(x, "nodeName")]


def run_custom_query(spark: SparkSession, df: DataFrame, sql: str,
                     view: str = "transcripts") -> DataFrame:
    """Ad-hoc SQL over the classified table under the name ``transcripts``.
    Only queries: a command or a write is refused before anything runs. The
    name is bound for this query only (a view of that name that the session
    had is put back). Any error of the query, also one at run time, surfaces
    as ValueError: the result is written once, as a table, and reread."""
    check_read_only(spark, sql)
    had = spark.table(view) if spark.catalog.tableExists(view) else None
    df.createOrReplaceTempView(view)
    try:
        out = spark.sql(sql)
        # a table's columns need names of their own and a type
        plain = out.toDF(*(f"c{i}" for i in range(len(out.columns))))
        plain = plain.select(*(F.col(c).cast("string") if t == "void" else F.col(c) for c, t in plain.dtypes))
        return write_table(plain, "custom-sql").toDF(*out.columns)
    except (PySparkException, Py4JJavaError) as e:
        raise ValueError(f"{QUERY_ERROR}: {e}") from e
    finally:
        if had is None:
            spark.catalog.dropTempView(view)
        else:
            had.createOrReplaceTempView(view)
