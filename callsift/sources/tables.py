"""Result tables kept per user: classification and coaching caches (7-day
TTL, upsert on a key), upload history, user hierarchy and user examples.

Every table carries ``user_id`` (the isolation column and the partition
column when written). Upserts keep the newest row per key with an aggregate
(``max_by``: partial aggregation map-side, so a key holding a third of all
rows is still spread over many tasks); writes go to a fresh directory in the
shared folder, then the caller switches to the new path (one writer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from callsift.functions.patterns import WS

TTL = "INTERVAL 7 DAYS"
CLASSIFICATION_KEY = ["user_id", "transcript_hash"]
COACHING_KEY = ["user_id", "agent_name", "prompt_hash"]


def _strip(c: str) -> Column:
    return F.regexp_replace(F.col(c).cast("string"), f"^{WS}+|{WS}+$", "")


def with_expiry(df: DataFrame, created: str = "created_at") -> DataFrame:
    return df.withColumn("expires_at", F.col(created) + F.expr(TTL))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str],
           order: list[str] = ("created_at",)) -> DataFrame:
    """Newest row per key (by ``order``, then the remaining values, so ties
    are deterministic) from the union of both tables."""
    both = existing.unionByName(incoming)
    values = [c for c in both.columns if c not in key]
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in values if c not in order])
    best = both.groupBy(*key).agg(F.max_by(F.struct(*values), rank).alias("_v"))
    return best.select(*key, *[F.col(f"_v.{c}").alias(c) for c in values])


def lookup(probe: DataFrame, cache: DataFrame, key: list[str], now,
           enforce_ttl: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of probe keys against the cache; an expired entry is a
    miss unless ``enforce_ttl`` is off. Only misses need classifying."""
    live = cache.filter(F.col("expires_at") >= F.lit(now).cast("timestamp")) if enforce_ttl else cache
    hits = probe.join(live, key, "inner")
    misses = probe.join(live.select(*key), key, "left_anti")
    return hits, misses


def evict(cache: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): rows with ``expires_at < now`` are removed."""
    expired = F.col("expires_at") < F.lit(now).cast("timestamp")
    return cache.filter(~expired | F.col("expires_at").isNull()), cache.filter(expired)


def eviction_counts(caches: dict[str, DataFrame], now) -> DataFrame:
    """One row with the number of evicted rows per named cache."""
    exprs = []
    out = None
    for name, df in caches.items():
        c = df.agg(F.count_if(F.col("expires_at") < F.lit(now).cast("timestamp")).alias(name))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
        exprs.append(F.max(name).alias(name))
    return out.agg(*exprs)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt_buckets: int = 32, salt_col: str | None = None) -> DataFrame:
    """Top ``k`` rows per group in two rounds: first within (group, salt)
    buckets, then over the at most ``k * salt_buckets`` survivors per group,
    so a group holding a third of all rows is ranked by many tasks."""
    salt = F.pmod(F.hash(*(F.col(c) for c in ([salt_col] if salt_col else df.columns))),
                  F.lit(salt_buckets))
    s = df.withColumn("_salt", salt)
    r1 = s.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order)))
    r1 = r1.filter(F.col("_rn") <= k).drop("_rn", "_salt")
    r2 = r1.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return r2.filter(F.col("_rn") <= k).drop("_rn")


def upload_history(history: DataFrame, user_id: str | None = None, limit: int = 10) -> DataFrame:
    """Newest uploads first: for one user a plain top-k; for all users the
    salted per-user top-k."""
    cols = ["user_id", "filename", "row_count", "processing_time_seconds", "created_at"]
    order = [F.desc("created_at"), F.asc("filename")]
    if user_id is not None:
        return (history.filter(F.col("user_id") == F.lit(user_id)).select(*cols)
                .orderBy(*order).limit(limit))
    return top_k_per_group(history.select(*cols), ["user_id"], order, limit)


def log_upload(history: DataFrame, user_id: str, filename: str, row_count: int,
               seconds: float, now) -> DataFrame:
    """Append one upload record (returns the new table; write with append)."""
    row = history.sparkSession.createDataFrame(
        [(user_id, filename, int(row_count), float(seconds))],
        "user_id string, filename string, row_count bigint, processing_time_seconds double"
    ).withColumn("created_at", F.lit(now).cast("timestamp"))
    return history.unionByName(row)


def replace_user_hierarchy(current: DataFrame, upload: DataFrame, user_id: str) -> DataFrame:
    """Delete the user's rows, insert the upload (labels stripped; missing
    optional levels stay null). Written with dynamic partition overwrite on
    ``user_id`` only the user's partition is rewritten."""
    new = upload.select(F.lit(user_id).alias("user_id"), _strip("category").alias("category"),
                        _strip("subcategory").alias("subcategory"),
                        _strip("tertiary_category").alias("tertiary_category"))
    return current.filter(~F.col("user_id").eqNullSafe(F.lit(user_id))).unionByName(new)


def read_user_hierarchy(table: DataFrame, user_id: str) -> DataFrame:
    """The user's hierarchy rows (isolation: nobody else's, no null owner)."""
    return table.filter(F.col("user_id") == F.lit(user_id)).select(
        "category", "subcategory", "tertiary_category")


def read_user_examples(table: DataFrame, user_id: str) -> DataFrame:
    """The user's examples (isolation as above)."""
    return table.filter(F.col("user_id") == F.lit(user_id)).select(
        "example_phrase", "category", "subcategory", "tertiary_category", "confidence", "source")


def append_user_examples(current: DataFrame, upload: DataFrame, user_id: str) -> DataFrame:
    """Append examples: phrase and labels stripped, confidence default 0.95,
    source default 'manual'."""
    cols = upload.columns
    conf = F.col("confidence").cast("double") if "confidence" in cols else F.lit(None).cast("double")
    src = F.col("source").cast("string") if "source" in cols else F.lit(None).cast("string")
    new = upload.select(
        F.lit(user_id).alias("user_id"), _strip("example_phrase").alias("example_phrase"),
        _strip("category").alias("category"),
        (_strip("subcategory") if "subcategory" in cols else F.lit(None).cast("string")).alias("subcategory"),
        (_strip("tertiary_category") if "tertiary_category" in cols
         else F.lit(None).cast("string")).alias("tertiary_category"),
        F.coalesce(conf, F.lit(0.95)).alias("confidence"),
        F.coalesce(src, F.lit("manual")).alias("source"))
    return current.unionByName(new)


def delete_user_examples(current: DataFrame, user_id: str, phrase: str | None = None) -> DataFrame:
    """Delete one phrase of a user, or all of the user's examples."""
    mine = F.col("user_id").eqNullSafe(F.lit(user_id))
    if phrase is not None:
        mine = mine & F.col("example_phrase").eqNullSafe(F.lit(phrase))
    return current.filter(~mine)


def write_table(df: DataFrame, path: str, partition_by: list[str] = ("user_id",),
                mode: str = "overwrite") -> str:
    """Write a table version to ``path`` (a fresh directory per version). Rows
    are clustered by the partition columns first, so each task holds few
    users (adaptive execution splits a hot one), not a file for every user."""
    df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path
