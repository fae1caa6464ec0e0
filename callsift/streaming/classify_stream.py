"""Incremental classification with Structured Streaming.

Transcripts arriving as Parquet files are classified batch by batch
(``foreachBatch``: the keyword argmax aggregates per text, which is plain
batch work inside each micro-batch) and appended to a result table; each
batch also appends its partial run statistics, so running totals are a sum
over the partials. Checkpoints and outputs live in the shared folder.

``run_stateful_stream`` keeps its own state instead: arrivals are deduplicated
within a watermark (state store: one key per transcript that is not yet too
old), classified as a stream (the classification is map-side) into an
exactly-once table, and a second stream over that table holds the running
totals as a streaming aggregate. Both continue from their checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.operators.analytics import AVG_DIGITS
from callsift.plans.classify import classify, rule_base
from callsift.session import scratch_path


def batch_stats(df: DataFrame, batch_id: int) -> DataFrame:
    """Partial statistics of one micro-batch (sums, not means)."""
    c = F.col("confidence")
    return df.agg(
        F.lit(batch_id).cast("long").alias("batch_id"),
        F.count(F.lit(1)).alias("total_transcripts"),
        F.count_if(F.col("category") != "Unclassified").alias("classified"),
        F.sum(c).alias("sum_confidence"),
        F.count_if(c >= F.lit(0.70)).alias("high_confidence"),
        F.count_if((c >= F.lit(0.50)) & (c < F.lit(0.70))).alias("medium_confidence"),
        F.count_if((c >= F.lit(0.40)) & (c < F.lit(0.50))).alias("low_confidence"))


def running_stats(partials: DataFrame) -> DataFrame:
    """Totals, shares and the mean confidence over all batches so far (no row
    of shares before the first transcript)."""
    sums = partials.agg(
        F.count(F.lit(1)).alias("batches"),
        *(F.sum(c).alias(c) for c in ("total_transcripts", "classified", "sum_confidence", "high_confidence",
                                      "medium_confidence", "low_confidence"))).filter("total_transcripts > 0")
    n = F.col("total_transcripts")
    return sums.select(
        "batches", "total_transcripts", "classified", (F.col("classified") / n * F.lit(100.0)).alias("classified_pct"),
        (n - F.col("classified")).alias("unclassified"),
        ((n - F.col("classified")) / n * F.lit(100.0)).alias("unclassified_pct"),
        F.round(F.col("sum_confidence") / n, AVG_DIGITS).alias("avg_confidence"),
        "high_confidence", "medium_confidence", "low_confidence")


def run_classification_stream(spark: SparkSession, source_dir: str, schema, to_transcripts,
                              rules: DataFrame, hierarchy: DataFrame,
                              out_dir: str | None = None, max_files_per_trigger: int = 1,
                              file_glob: str | None = None) -> dict:
    """Process every file present in ``source_dir`` (``availableNow``) and
    return the paths of the result and statistics tables."""
    out_dir = out_dir or scratch_path(spark, "stream")
    result_path, stats_path = f"{out_dir}/classified", f"{out_dir}/stats"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    stream = reader.parquet(source_dir)
    rb = rule_base(rules)  # parsed and measured once for all micro-batches

    def handle(batch: DataFrame, batch_id: int) -> None:
        out = classify(to_transcripts(batch), rb, hierarchy).drop("transcript", "redacted_transcript")
        # One directory per batch, overwritten on a retry: idempotent sink.
        part = f"{result_path}/batch_id={batch_id}"
        out.write.mode("overwrite").parquet(part)
        batch_stats(spark.read.parquet(part), batch_id).drop("batch_id").write.mode(
            "overwrite").parquet(f"{stats_path}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(handle)
         .option("checkpointLocation", f"{out_dir}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return {"classified": result_path, "stats": stats_path}


def run_stateful_stream(spark: SparkSession, source_dir: str, schema, to_transcripts, rules: DataFrame,
                        hierarchy: DataFrame, out_dir: str, lateness: str = "1 day", max_files_per_trigger: int = 1,
                        file_glob: str | None = None) -> dict:
    """Process the files that have arrived in ``source_dir`` since the last call
    with this ``out_dir`` (also after a crash), and return the paths of the
    classified table and of the totals.

    ``to_transcripts`` gives the role columns with ``ts``, the event time. A
    transcript (id and text) that arrives again, in whatever file, counts once;
    its key is kept for ``lateness`` behind the newest event, and an arrival
    older than that is dropped as too late. Rows without ``ts`` are dropped."""
    result_path, totals_path = f"{out_dir}/classified", f"{out_dir}/totals"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    arrivals = to_transcripts(reader.parquet(source_dir)).filter("ts IS NOT NULL")
    hashed = arrivals.withColumn("text_hash", F.md5(F.coalesce("transcript", F.lit(""))))
    once = hashed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["transcript_id", "text_hash"]).drop("text_hash")
    classified = classify(once, rules, hierarchy).drop("transcript", "redacted_transcript")
    (classified.writeStream.format("parquet").option("path", result_path)
     .option("checkpointLocation", f"{out_dir}/_checkpoint-classify").trigger(availableNow=True).start().awaitTermination())

    c = F.col("confidence")
    results = spark.readStream.schema(classified.schema).parquet(result_path)
    totals = results.groupBy().agg(
        F.count(F.lit(1)).alias("total_transcripts"), F.count_if(F.col("category") != "Unclassified").alias("classified"),
        F.sum(c).alias("sum_confidence"), F.count_if(c >= F.lit(0.70)).alias("high_confidence"),
        F.count_if((c >= F.lit(0.50)) & (c < F.lit(0.70))).alias("medium_confidence"),
        F.count_if((c >= F.lit(0.40)) & (c < F.lit(0.50))).alias("low_confidence"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        # the totals up to this batch; overwritten on a retry
        batch.write.mode("overwrite").parquet(f"{totals_path}/batch_id={batch_id}")

    (totals.writeStream.outputMode("complete").foreachBatch(keep)
     .option("checkpointLocation", f"{out_dir}/_checkpoint-totals").trigger(availableNow=True).start().awaitTermination())
    return {"classified": result_path, "totals": totals_path}


def latest_totals(totals: DataFrame) -> DataFrame:
    """The row of the last batch of ``run_stateful_stream``'s totals, as running statistics."""
    last = totals.orderBy(F.desc("batch_id")).limit(1)
    return running_stats(last).drop("batches")
