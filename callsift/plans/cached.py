"""Cache-first classification: each distinct text once, and only if no live
cache entry of the user has its content hash.

  rows -> one row per content hash (partial aggregation, so copies of a text
          meet as one row per task) -> anti-join with the user's live entries
       -> classification of the rest -> a table
  results = rows (without texts) joined on the hash with live entries and the table
  the table is merged into the user's cache, valid for seven days
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.functions.text import content_hash
from callsift.operators.keyword import RuleBase
from callsift.plans.classify import classify
from callsift.session import write_table
from callsift.sources.tables import CLASSIFICATION_KEY, with_expiry
from callsift.sources.user_table import UserTable

RESULT = ["category", "subcategory", "confidence", "matched_keywords", "resolve_reason"]
CACHE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("user_id", T.StringType()), ("transcript_hash", T.StringType()), ("category", T.StringType()),
    ("subcategory", T.StringType()), ("confidence", T.DoubleType()), ("matched_keywords", T.StringType()),
    ("resolve_reason", T.StringType()), ("created_at", T.TimestampType()), ("expires_at", T.TimestampType()))])


def classify_cached(transcripts: DataFrame, cache: UserTable, rules: DataFrame | RuleBase, hierarchy: DataFrame,
                    user_id: str, now, enforce_ttl: bool = True, **options) -> DataFrame:
    """transcript_id, transcript_hash, the cached columns and from_cache for
    every row; what was not cached is classified (``options`` go to
    ``classify``) and written back. A null transcript is an empty one. The
    result reads the cache as it was before the call."""
    hashed = transcripts.withColumn("transcript", F.coalesce(F.col("transcript").cast("string"), F.lit("")))
    hashed = hashed.withColumn("transcript_hash", content_hash("transcript"))
    live = cache.read(user_id)
    if enforce_ttl:
        live = live.filter(F.col("expires_at") >= F.lit(now).cast("timestamp"))
    live = live.select("transcript_hash", *RESULT)
    distinct = hashed.groupBy("transcript_hash").agg(F.any_value("transcript").alias("transcript"))
    misses = distinct.join(live.select("transcript_hash"), "transcript_hash", "left_anti").withColumnRenamed(
        "transcript_hash", "transcript_id")
    fresh = write_table(classify(misses, rules, hierarchy, **options).select(
        F.col("transcript_id").alias("transcript_hash"), *RESULT), "classified-misses")
    cache.merge(with_expiry(fresh.select(
        F.lit(user_id).alias("user_id"), "*", F.lit(now).cast("timestamp").alias("created_at"))), CLASSIFICATION_KEY)
    known = live.withColumn("from_cache", F.lit(True)).unionByName(fresh.withColumn("from_cache", F.lit(False)))
    return hashed.select("transcript_id", "transcript_hash").join(known, "transcript_hash").select(
        "transcript_id", "transcript_hash", *RESULT, "from_cache")
