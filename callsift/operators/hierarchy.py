"""Category-hierarchy operators: path validation and program filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.plans.dims import broadcast_if_small

DEFAULT_LEVELS = (("category", "L1"), ("subcategory", "L2"), ("tertiary", "L3"))


def valid_paths(hierarchy: DataFrame, levels: list[str], program: str | None = None) -> DataFrame:
    """Distinct path prefixes of the hierarchy: (L1), (L1, L2), ... with the
    deeper levels null, so a partially given path validates against them."""
    h = hierarchy.filter(F.col("Program") == F.lit(program)) if program else hierarchy
    parts = []
    for depth in range(1, len(levels) + 1):
        parts.append(h.select(*[F.col(c) if i < depth else F.lit(None).cast("string").alias(c)
                                for i, c in enumerate(levels)]))
    return reduce(DataFrame.unionByName, parts).distinct()


def validate_paths(df: DataFrame, hierarchy: DataFrame, program: str | None = None,
                   mapping=DEFAULT_LEVELS) -> DataFrame:
    """Adds ``path_valid``: the (category, subcategory, ...) path, with null
    meaning "not given", exists in the hierarchy of ``program``. The path
    table is broadcast after a size check (null-safe equi-join)."""
    levels = [lvl for _, lvl in mapping]
    paths = valid_paths(hierarchy, levels, program).withColumn("_valid", F.lit(True))
    paths = broadcast_if_small(paths)
    cond = [df[c].eqNullSafe(paths[lvl]) for c, lvl in mapping]
    j = df.join(paths, cond, "left")
    return j.select(*[df[c] for c in df.columns],
                    F.coalesce(F.col("_valid"), F.lit(False)).alias("path_valid"))


def categories_for_program(hierarchy: DataFrame, program: str) -> DataFrame:
    return hierarchy.filter(F.col("Program") == F.lit(program))
