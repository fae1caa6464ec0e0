"""Mixing sources to target weights by Poisson replication (built-in functions only).

Every document of source s is repeated N times, N ~ Poisson(rate_s), where
``rate_s = share_s * epoch_docs / n_s``: the mean number of times a document of
the source has to be seen so that the mixture holds the source's target share.
N is drawn by inverting the Poisson distribution at a uniform number hashed
from (seed, id), so a rerun, a retry or another partitioning draws the same.
The copies are then ordered globally by a hash key.

Defined results: a null source is a source of its own; a null id hashes as the
empty text; rows with the same id draw the same count; a source without a given
weight has weight 0; null and empty texts are copied like any other; an empty
table gives an empty mixture; input columns named like an output are carried as
``<name>_input``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.work import Work, free_names, set_aside

SEED = "mix-7"
TEMPERATURE = 0.5
# One draw inverts a distribution of at most this mean; larger rates are sums
# of independent draws (exp(-rate) stays far from underflow).
MAX_MEAN = 64.0
# Rates of up to so many sources (under 2 kB each) are broadcast; beyond it the
# join shuffles, with the same result.
BROADCAST_SOURCES = 20_000
OUTPUTS = {"copy", "n_copies", "rate", "shuffle_key"}


def _hash52(*parts: Column) -> Column:
    """52 bits of md5 over the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: DataFrame | None = None, epoch_docs: int | None = None,
                 temperature: float = TEMPERATURE, source: str = "source") -> DataFrame:
    """(source, n_docs, share, rate): share is the given weight (``weights``
    with columns source, weight), else n_docs ** temperature, normalised over
    the sources present. One row per source."""
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature))))
    else:
        w = weights.groupBy(F.col("source").alias("ws")).agg(F.sum("weight").cast("double").alias("w"))
        n = n.join(w, F.col("source").eqNullSafe(F.col("ws")), "left").select(
            "source", "n_docs", F.coalesce("w", F.lit(0.0)).alias("w"))
    share = F.col("w") / n.agg(F.sum("w")).scalar()
    size = n.agg(F.sum("n_docs")).scalar() if epoch_docs is None else F.lit(int(epoch_docs))
    return (n.withColumn("share", F.coalesce(share, F.lit(0.0)))
            .select("source", "n_docs", "share", (F.col("share") * size / F.col("n_docs")).alias("rate")))


def _thresholds(mean: Column) -> Column:
    """CDF(0), CDF(1), ... of Poisson(mean), far beyond the last one below 1."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.exp(-mean)
    run = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf")),
        lambda a, k: F.struct(
            (a.p * mean / k).alias("p"), (a.c + a.p * mean / k).alias("c"),
            F.concat(a.cdf, F.array(a.c + a.p * mean / k)).alias("cdf")))
    return run.getField("cdf")


def replicate(docs: DataFrame, weights: DataFrame | None = None, epoch_docs: int | None = None,
              temperature: float = TEMPERATURE, seed: str = SEED, id_col: str = "doc_id",
              source: str = "source", work: Work | None = None) -> DataFrame:
    """The shuffled mixture: the input's columns for every copy, plus copy
    (from 0), n_copies, rate and shuffle_key (the global order)."""
    docs = set_aside(docs, OUTPUTS)
    spark = docs.sparkSession
    its_source, draws, cdf, uniform, part = free_names(docs, "_source", "_draws", "_cdf", "_uniform", "_part")
    rates = source_rates(docs, weights, epoch_docs, temperature, source)
    rates = rates.withColumn(draws, F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int"))
    rates = rates.select(F.col("source").alias(its_source), F.col("rate"), draws,
                         _thresholds(F.col("rate") / F.col(draws)).alias(cdf))
    rates = (work or Work(spark, "poisson-mix")).table(rates, "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # one hash a draw, held against the thresholds
    numbers = F.transform(F.sequence(F.lit(1), F.col(draws)), lambda j: _hash52(
        F.lit(seed), ident, j.cast("string")) / F.lit(float(1 << 52)))
    count = F.aggregate(F.col(uniform), F.lit(0), lambda n, u: n + F.size(F.filter(cdf, lambda c: c <= u)))
    out = (docs.join(rates, F.col(source).eqNullSafe(F.col(its_source)))
           .withColumn(uniform, numbers).withColumn("n_copies", count)
           .filter("n_copies > 0")
           .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
           .withColumn("shuffle_key", _hash52(F.lit(seed + "-order"), ident, F.col("copy").cast("string"))))
    # keys are uniform, so equal ranges of them are even parts of the global
    # order, with no pass to sample them
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = out.withColumn(part, F.least(F.floor(F.col("shuffle_key") / F.lit(float(1 << 52)) * parts), F.lit(parts - 1)).cast("int"))
    columns = [*docs.columns, "copy", "n_copies", "rate", "shuffle_key"]
    return (out.select(*columns, part).repartitionById(parts, part)
            .sortWithinPartitions("shuffle_key", id_col, "copy").select(*columns))
