"""Rule tables: schemas, loading (CSV or built-in), parsing, lookups."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from callsift.plans.dims import read_configuration
from callsift.sources import ruleset

KEYWORD_RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("required_groups", T.StringType()),
    T.StructField("forbidden_terms", T.StringType()),
])

HIERARCHY_SCHEMA = T.StructType([
    T.StructField("Program", T.StringType()),
    T.StructField("CatNo", T.StringType()),
    T.StructField("L1", T.StringType()),
    T.StructField("L2", T.StringType()),
    T.StructField("L3", T.StringType()),
    T.StructField("L4", T.StringType()),
])

PROXIMITY_SCHEMA = T.StructType([
    T.StructField("Program", T.StringType()),
    T.StructField("CatNo", T.StringType()),
    T.StructField("Term1", T.StringType()),
    T.StructField("Operator1", T.StringType()),
    T.StructField("Term2", T.StringType()),
    T.StructField("Operator2", T.StringType()),
    T.StructField("Term3", T.StringType()),
    T.StructField("Proximity", T.DoubleType()),
    T.StructField("WithinWords", T.DoubleType()),
    T.StructField("SentBy", T.StringType()),
])

EXAMPLE_SCHEMA = T.StructType([
    T.StructField("example_phrase", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("tertiary_category", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

def _local(spark: SparkSession, rows: list, schema: T.StructType, ord_name: str) -> DataFrame:
    """A small configuration table from driver-side rows, with its ordinal."""
    fields = [T.StructField(ord_name, T.IntegerType(), False)] + list(schema.fields)
    data = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, T.StructType(fields))


def keyword_rules(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return _local(spark, ruleset.KEYWORD_RULES if rows is None else rows,
                  KEYWORD_RULE_SCHEMA, "rule_ord")


def hierarchy(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return _local(spark, ruleset.HIERARCHY if rows is None else rows,
                  HIERARCHY_SCHEMA, "hier_ord")


def proximity_rules(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return _local(spark, ruleset.PROXIMITY_RULES if rows is None else rows,
                  PROXIMITY_SCHEMA, "rule_ord")


def user_examples(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return _local(spark, ruleset.USER_EXAMPLES if rows is None else rows,
                  EXAMPLE_SCHEMA, "example_ord")


def read_rule_csv(spark: SparkSession, path: str, schema: T.StructType,
                  ord_name: str = "rule_ord") -> DataFrame:
    """CSV rule/hierarchy files with header; a missing path gives an empty,
    typed table. The ordinal follows the file names and the order in each file
    (rules are configuration: their few rows are numbered in one place)."""
    try:
        df = (spark.read.schema(schema)
              .option("header", True).option("multiLine", True).option("escape", '"')
              .csv(path))
        df.schema  # resolve the path now
    except AnalysisException:
        return spark.createDataFrame(
            [], T.StructType([T.StructField(ord_name, T.LongType(), False)] + list(schema.fields)))
    # a file with line breaks inside values is read by one task, in order
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_place"))
    number = F.row_number().over(Window.orderBy("_file", "_place")) - 1
    return placed.select(number.cast("long").alias(ord_name), *schema.fieldNames())


def _strings(value, depth: int, nulls: bool) -> bool:
    """Whether a JSON value is a list (of lists) of strings."""
    if depth == 0:
        return isinstance(value, str) or (nulls and value is None)
    return isinstance(value, list) and all(_strings(v, depth - 1, nulls) for v in value)


def parse_keyword_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON columns -> arrays. Returns (parsed, quarantine), both driver-local
    relations: rules are configuration that every text task receives.

    A rule whose ``required_groups`` is not a JSON list of lists of strings, or
    whose non-null ``forbidden_terms`` is not a JSON list of strings, is set
    aside (the original skips it with a warning); the other rules are
    unaffected. JSON is strict: single quotes, text after the value or a null
    forbidden term set the rule aside. A null keyword never matches."""
    good, bad = [], []
    for r in read_configuration(rules.select(
            "rule_ord", "rule_id", "category", "subcategory", "required_groups", "forbidden_terms"), "keyword rules"):
        try:
            groups = json.loads(r.required_groups or "")
            forbidden = [] if r.forbidden_terms is None else json.loads(r.forbidden_terms)
            if not _strings(groups, 2, True) or not _strings(forbidden, 1, False):
                raise ValueError("not a list of strings")
            good.append((r.rule_ord, r.rule_id, r.category, r.subcategory, groups, forbidden, len(groups)))
        except ValueError:
            bad.append((r.rule_ord, r.rule_id, r.required_groups, r.forbidden_terms, "malformed JSON"))
    spark, kind = rules.sparkSession, rules.schema["rule_ord"].dataType.simpleString()
    head = f"rule_ord {kind}, rule_id string, "
    return (spark.createDataFrame(good, head + "category string, subcategory string, groups array<array<string>>, "
                                               "forbidden array<string>, n_groups int"),
            spark.createDataFrame(bad, head + "required_groups string, forbidden_terms string, error string"))


def rule_terms(parsed: DataFrame) -> DataFrame:
    """One row per keyword slot: (rule_ord, group_no, kw_no, keyword, term).

    Forbidden terms get ``group_no = -1``. ``term`` is the lower-cased text
    that is searched for; ``keyword`` keeps the rule's own spelling."""
    req = (parsed.select("rule_ord", F.posexplode("groups").alias("group_no", "grp"))
           .select("rule_ord", "group_no", F.posexplode("grp").alias("kw_no", "keyword")))
    forb = parsed.select("rule_ord", F.lit(-1).alias("group_no"),
                         F.posexplode("forbidden").alias("kw_no", "keyword"))
    both = req.unionByName(forb).filter(F.col("keyword").isNotNull())
    return both.withColumn("term", F.lower("keyword"))


def hierarchy_lookup(hier: DataFrame) -> DataFrame:
    """(Program, CatNo) -> L1..L4; a repeated key keeps its last row."""
    return (hier.groupBy("Program", "CatNo")
            .agg(F.max_by(F.struct("L1", "L2", "L3", "L4"), "hier_ord").alias("h"))
            .select("Program", "CatNo", "h.L1", "h.L2", "h.L3", "h.L4"))


def programs(hier: DataFrame) -> DataFrame:
    """Sorted distinct programs."""
    return hier.select("Program").distinct().orderBy("Program")


def by_program(df: DataFrame, program: str) -> DataFrame:
    return df.filter(F.col("Program") == F.lit(program))


def rules_of_program(rules: DataFrame, hier: DataFrame, program: str) -> tuple[DataFrame, DataFrame]:
    """The rules and the hierarchy of a program; both empty if either is."""
    both = by_program(rules, program), by_program(hier, program)
    if any(df.isEmpty() for df in both):
        return tuple(df.limit(0) for df in both)
    return both
