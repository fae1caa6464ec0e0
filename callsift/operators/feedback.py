"""Review sampling and reviewer corrections.

Sampling draws whole rows, never caps a stratum below its quota, and never
gathers a stratum into one task: each stratum is a distributed top-k on a
hash order (``md5(id|seed)``), which is reproducible and needs no shuffle
of the stratum itself. NumPy's exact draw is not reproduced; the quotas are.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.session import write_table

HIGH, MEDIUM = 0.7, 0.5


def stratum(conf="confidence"):
    c = F.col(conf)
    return (F.when(c >= F.lit(HIGH), "high").when(c >= F.lit(MEDIUM), "medium")
            .otherwise("low"))


def sample_key(seed: int = 42):
    return F.md5(F.concat(F.col("transcript_id").cast("string"), F.lit(f"|{seed}")))


def stratum_quotas(total: int, high: int, medium: int, size: int = 50) -> dict[str, int]:
    """Proportional quotas in doubles, truncated; the low stratum takes the
    remainder (58/100*50 = 28.999999999999996 -> 28)."""
    n_high = int((high / total) * size)
    n_med = int((medium / total) * size)
    return {"high": n_high, "medium": n_med, "low": size - n_high - n_med}


def _task_samples(df: DataFrame, size: int) -> DataFrame:
    """Of every task, each stratum's first ``size`` rows in ``_k`` order;
    ``_n`` on the first of them counts the task's rows of the stratum."""
    def keep(batches):
        held, n = None, {}
        for b in batches:
            t = pa.Table.from_batches([b])
            for c in pc.value_counts(t.column("stratum")).to_pylist():
                n[c["values"]] = n.get(c["values"], 0) + c["counts"]
            t = (pa.concat_tables([held, t]) if held is not None else t).sort_by("_k")
            held = pa.concat_tables([t.filter(pc.equal(t.column("stratum"), name)).slice(0, size) for name in sorted(n)])
        if held is not None:
            first = set()
            counts = [0 if s in first else first.add(s) or n[s] for s in held.column("stratum").to_pylist()]
            yield from held.append_column("_n", pa.array(counts, pa.int64())).to_batches()

    return df.mapInArrow(keep, df.withColumn("_n", F.lit(0).cast("long")).schema)


def stratified_sample(df: DataFrame, size: int = 50, seed: int = 42) -> DataFrame:
    """All rows when there are at most ``size``; otherwise per-stratum quotas
    (>= .7, [.5,.7), < .5), each stratum's first rows in hash order.

    ``df`` is read once: every task hands on its counts and at most ``size``
    rows per stratum; counts and draws come from those."""
    s = write_table(_task_samples(df.withColumn("stratum", stratum()).withColumn("_k", sample_key(seed)), size), "sample")
    c = s.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
              *(F.coalesce(F.sum(F.when(F.col("stratum") == name, F.col("_n"))), F.lit(0)).alias(name)
                for name in ("high", "medium"))).first()
    if c["n"] <= size:
        return s.drop("_k", "_n")
    quotas = stratum_quotas(c["n"], c["high"], c["medium"], size)
    parts = [s.filter(F.col("stratum") == name).orderBy("_k").limit(q)
             for name, q in quotas.items() if q > 0]
    if not parts:
        return s.limit(0).drop("_k", "_n")
    return reduce(DataFrame.unionByName, parts).drop("_k", "_n")


def low_confidence_sample(df: DataFrame, threshold: float = 0.6, size: int = 50,
                          seed: int = 42) -> DataFrame:
    """Worst first: confidence < threshold ascending (ties by id), first
    ``size``; the stratified sample when no row is below the threshold."""
    # The bounded top-k is computed once (at most ``size`` rows are kept)
    # and tested for emptiness on its written copy, not by a second pass.
    low = df.filter(F.col("confidence") < F.lit(float(threshold)))
    top = write_table(low.orderBy(F.asc("confidence"), F.asc("transcript_id")).limit(size), "low-confidence")
    if top.isEmpty():
        return stratified_sample(df, size, seed)
    return top


def corrections_from_labels(labels: DataFrame) -> DataFrame:
    """Reviewer corrections derived from labels: a low-quality text is
    corrected to 'low_quality' (sub-category 'toxic' when flagged), another
    flagged one to 'toxic'."""
    low, toxic = F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.filter(low | toxic).select(
        F.col("doc_id").alias("transcript_id"),
        F.when(low, "low_quality").otherwise("toxic").alias("correct_category"),
        F.when(low & toxic, F.lit("toxic")).alias("correct_subcategory"),
        F.lit(None).cast("string").alias("correct_tertiary"))


def corrections_to_examples(corrections: DataFrame, texts: DataFrame, prepare_fn=None) -> DataFrame:
    """Corrections -> user examples: the corrected text's first 200
    characters (redacted) as the phrase, confidence 0.95, source 'feedback'.
    Corrections of unknown transcripts are dropped; of several transcripts
    with the corrected id the first row counts: by ``row_order`` where the texts
    have that column (``with_order``), else in the order they are read.

    ``texts`` holds ``redacted_transcript``, or raw transcripts together with
    ``prepare_fn`` (clean + redact), which then runs on corrected rows only."""
    column = "redacted_transcript" if prepare_fn is None else "transcript"
    corr = corrections.withColumn("_c", F.monotonically_increasing_id())
    place = F.col("row_order") if "row_order" in texts.columns else F.monotonically_increasing_id()
    rows = texts.select("transcript_id", column, place.alias("_r"))
    j = (corr.join(rows, "transcript_id").groupBy("_c").agg(F.min_by(F.struct(
        "transcript_id", "correct_category", "correct_subcategory", "correct_tertiary", column), "_r").alias("v"))
        .select("v.*"))
    if prepare_fn is not None:
        j = prepare_fn(j)
    return j.select(
        "transcript_id",
        F.substring("redacted_transcript", 1, 200).alias("example_phrase"),
        F.col("correct_category").alias("category"),
        F.col("correct_subcategory").alias("subcategory"),
        F.col("correct_tertiary").alias("tertiary_category"),
        F.lit(0.95).alias("confidence"),
        F.lit("feedback").alias("source"))


def correction_counts(corrections: DataFrame) -> DataFrame:
    """(correct_category, corrections): how often each category was corrected to."""
    return corrections.groupBy("correct_category").agg(F.count(F.lit(1)).alias("corrections"))


def correction_stats(corrections: DataFrame, samples: DataFrame | None) -> DataFrame:
    """One row: number of corrections, rate against the reviewed samples
    (percent, one place; 0.0 without samples), the counts per category as a
    map, and the most corrected category (ties: smallest name). No
    corrections -> (0, 0.0)."""
    per = correction_counts(corrections).agg(
        F.coalesce(F.sum("corrections"), F.lit(0)).cast("long").alias("total_corrections"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("correct_category", "corrections")))).alias("categories_corrected"),
        F.min_by("correct_category", F.struct(-F.col("corrections"), F.col("correct_category"))).alias("top_correction"))
    size = samples.agg(F.count(F.lit(1))).scalar() if samples is not None else F.lit(0)
    rate = F.round(F.try_divide(F.col("total_corrections").cast("double"), size) * F.lit(100.0), 1)
    return per.select("total_corrections", F.coalesce(rate, F.lit(0.0)).alias("correction_rate"),
                      "categories_corrected", "top_correction")
