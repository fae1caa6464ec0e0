"""Rule-base management: merge custom uploads, validate them, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED_RULE_COLUMNS = ["Program", "CatNo", "Term1"]
REQUIRED_HIERARCHY_COLUMNS = ["Program", "CatNo", "L1", "L2", "L3", "L4"]


# FIXED VALUES: the messages an upload is refused with.
MISSING_COLUMNS = "{what} missing columns: {columns}"
UNKNOWN_CATEGORIES = "Rules reference categories not in hierarchy: {categories}"
ACCEPTED = "Valid"


def merge_custom_rules(custom_rules: DataFrame | None, custom_hierarchy: DataFrame | None,
                       base_rules: DataFrame, base_hierarchy: DataFrame,
                       mode: str = "extend") -> tuple[DataFrame | None, DataFrame | None]:
    """How an upload joins the base tables: ``extend`` keeps all rules (UNION
    ALL) and the base categories that the upload does not define; ``replace``
    is the upload alone (None stays None). Other modes raise ValueError."""
    def with_upload(base: DataFrame, upload: DataFrame | None) -> DataFrame:
        return base if upload is None else base.unionByName(upload, allowMissingColumns=True)

    def undefined(upload: DataFrame | None) -> DataFrame:
        return base_hierarchy if upload is None else base_hierarchy.join(
            upload.select("CatNo").distinct(), "CatNo", "left_anti")

    merges = {
        "replace": lambda: (custom_rules, custom_hierarchy),
        "extend": lambda: (with_upload(base_rules, custom_rules),
                           with_upload(undefined(custom_hierarchy), custom_hierarchy)),
    }
    if mode not in merges:
        raise ValueError(f"mode is one of {sorted(merges)}, not {mode!r}")
    return merges[mode]()


def upload_problems(rules: DataFrame | None, hierarchy: DataFrame | None) -> list[str]:
    """What is wrong with an upload: a check per table for its columns, then
    (if both tables have one) the rule categories that the hierarchy lacks,
    of which at most five reach the driver."""
    needs = [("Proximity rules", rules, REQUIRED_RULE_COLUMNS), ("Hierarchy", hierarchy, REQUIRED_HIERARCHY_COLUMNS)]
    found = [MISSING_COLUMNS.format(what=what, columns=lacks) for what, df, columns in needs
             if df is not None and (lacks := sorted(set(columns) - set(df.columns), key=columns.index))]
    if all(df is not None and "CatNo" in df.columns for df in (rules, hierarchy)):
        unknown = [r["CatNo"] for r in orphan_categories(rules, hierarchy).take(5)]
        found += [UNKNOWN_CATEGORIES.format(categories=unknown)] if unknown else []
    return found


def validate_custom_upload(rules: DataFrame | None, hierarchy: DataFrame | None) -> tuple[bool, str]:
    """(whether an upload is accepted, its problems or ``Valid``)."""
    problems = upload_problems(rules, hierarchy)
    return not problems, "; ".join(problems) or ACCEPTED


def orphan_categories(rules: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Distinct rule CatNos missing from the hierarchy, sorted."""
    return (rules.select("CatNo").distinct()
            .join(hierarchy.select("CatNo").distinct(), "CatNo", "left_anti").orderBy("CatNo"))


def hierarchy_stats(hierarchy: DataFrame, program: str | None = None) -> DataFrame:
    """Row count and distinct programs / L1..L4 (nulls not counted)."""
    h = hierarchy.filter(F.col("Program") == F.lit(program)) if program else hierarchy
    aggs = [F.count(F.lit(1)).alias("total_categories")] + [
        F.countDistinct(c).alias(f"unique_{c.lower()}") for c in ("L1", "L2", "L3", "L4")]
    if not program:
        aggs.insert(0, F.countDistinct("Program").alias("total_programs"))
    out = h.agg(*aggs)
    return out.withColumn("program", F.lit(program)) if program else out


def rulebase_stats(proximity_rules: DataFrame, hierarchy: DataFrame, default_rules: DataFrame) -> DataFrame:
    """One row: rule and category counts, programs, default-rules flag."""
    h = hierarchy.agg(F.count(F.lit(1)).alias("total_categories"),
                      F.countDistinct("Program").alias("total_programs"),
                      F.sort_array(F.collect_set("Program")).alias("programs"))
    return h.select(
        proximity_rules.agg(F.count(F.lit(1))).scalar().alias("total_proximity_rules"), "total_categories",
        "total_programs", "programs", default_rules.agg(F.count(F.lit(1)) > 0).scalar().alias("has_default_rules"))
