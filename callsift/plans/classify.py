"""End-to-end classification: clean -> redact -> normalize -> keyword rules
-> hierarchy enrichment. Produces the classified table every analytics,
sampling, coaching and export operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.functions.pii import RedactionStats, redact
from callsift.functions.text import clean_transcript
from callsift.operators.keyword import RuleBase, score_texts
from callsift.plans.dims import read_configuration
from callsift.sources.rules import hierarchy_lookup, parse_keyword_rules

CLASSIFIED_COLUMNS = [
    "transcript_id", "transcript", "redacted_transcript", "agent_name", "call_id", "ts",
    "rule_id", "category", "subcategory", "tertiary", "quaternary", "cat_no", "confidence",
    "matched_keywords", "num_rules_activated", "resolve_reason", "source", "program",
]


def prepare(transcripts: DataFrame, pii: bool = True, stats: RedactionStats | None = None) -> DataFrame:
    """Adds ``redacted_transcript`` (cleaned, then PII-redacted) and
    ``norm_text`` (lower-cased, whitespace collapsed). Map-only. ``stats``
    counts what the redaction replaces, in the same pass."""
    # Cleaned text as its own column first: the redaction reads it twice
    # (pre-test and chain), and a column reference is not recomputed.
    cleaned = transcripts.withColumn("redacted_transcript", clean_transcript("transcript"))
    if pii and stats is not None:
        redacted = stats.redact(cleaned, "redacted_transcript", "redacted_transcript")
    else:
        redacted = cleaned.withColumn("redacted_transcript", redact("redacted_transcript", enabled=pii))
    # a cleaned text is trimmed and single-spaced, and the redaction puts in no
    # white space: its marks in lower case are all that normalizing would change
    return redacted.withColumn("norm_text", F.lower("redacted_transcript"))


def ccre_result(j: DataFrame) -> DataFrame:
    """Keyword-engine record from per-text attributes left-joined with the
    winners: defaults for an empty text and for a text that kept no rule."""
    empty = F.col("is_empty")
    hit = F.col("rule_ord").isNotNull()
    reason = F.when(empty, "Empty or invalid input").when(
        hit, F.format_string("Highest confidence rule (matched %d groups)", F.col("matched_groups"))
    ).otherwise("No rules activated (threshold: 0.4)")
    keep = [c for c in j.columns if c not in (
        "rule_ord", "rule_id", "category", "subcategory", "confidence", "matched_groups",
        "matched_keywords", "num_rules_activated")]  # the rest is carried
    return j.select(
        *keep,
        F.when(hit, F.col("rule_id")).alias("rule_id"),
        F.when(hit, F.col("category")).otherwise("Unclassified").alias("category"),
        F.when(hit, F.col("subcategory"))
         .otherwise(F.when(empty, "Empty Transcript").otherwise("No Match")).alias("subcategory"),
        F.when(hit, F.col("confidence")).otherwise(0.0).alias("confidence"),
        reason.alias("resolve_reason"),
        F.when(hit, F.col("matched_keywords")).otherwise("").alias("matched_keywords"),
        F.coalesce(F.col("num_rules_activated"), F.lit(0)).alias("num_rules_activated"),
        F.col("matched_groups"),
    )


def rule_base(rules: DataFrame) -> RuleBase:
    """Parsed rules with their matcher; build once and pass it to
    ``classify`` when the same rules serve many inputs (stream batches)."""
    parsed, _ = parse_keyword_rules(rules)
    return RuleBase(parsed)


def classify_ccre(transcripts: DataFrame, rules: DataFrame | RuleBase, pii: bool = True,
                  carry: list[str] = ("agent_name", "call_id", "ts"), stats: RedactionStats | None = None) -> DataFrame:
    """Keyword-engine result for every transcript row, with ``carry`` columns.

    One map-side pass over the text (see ``callsift.operators.keyword``);
    every input row gives one output row, whatever its id."""
    rb = rules if isinstance(rules, RuleBase) else rule_base(rules)
    prepared = prepare(transcripts, pii, stats).withColumn("is_empty", F.col("norm_text") == "")
    carry = ["transcript_id", *(c for c in carry if c in prepared.columns), "is_empty"]
    return ccre_result(score_texts(prepared.select(*carry, "norm_text"), rb))


def enrich(ccre: DataFrame, hierarchy: DataFrame, program: str = "CCRE",
           threshold: float = 0.40, empty_col: str = "is_empty") -> DataFrame:
    """Hierarchy enrichment of keyword results (the hybrid classifier).

    Kept when confidence >= threshold and ``(program, rule_id)`` is in the
    hierarchy with a level-1 name other than 'Unclassified'; otherwise the
    standard unclassified record."""
    # the hierarchy is configuration, held as a local relation like the rules
    look = hierarchy_lookup(hierarchy).filter(F.col("Program") == F.lit(program))
    look = F.broadcast(ccre.sparkSession.createDataFrame(read_configuration(look, "hierarchy"), look.schema)
                       .withColumn("_found", F.lit(True)))
    j = ccre.join(look, ccre["rule_id"] == look["CatNo"], "left")
    ok = (F.col("rule_id").isNotNull() & (F.col("confidence") >= F.lit(float(threshold)))
          & F.coalesce(F.col("_found"), F.lit(False))
          & ~F.col("L1").eqNullSafe(F.lit("Unclassified")))
    ok = F.coalesce(ok, F.lit(False)) & ~F.col(empty_col)
    reason = F.when(F.col(empty_col), "Empty transcript").otherwise("No rules matched above threshold")
    return j.select(
        *[c for c in ccre.columns if c not in ("category", "subcategory", "confidence",
                                                 "matched_keywords", "resolve_reason",
                                                 "matched_groups", empty_col)],
        F.when(ok, F.col("L1")).otherwise("Unclassified").alias("category"),
        F.when(ok, F.col("L2")).otherwise("No Match").alias("subcategory"),
        F.when(ok, F.col("L3")).otherwise("").alias("tertiary"),
        F.when(ok, F.col("L4")).otherwise("").alias("quaternary"),
        F.when(ok, F.col("rule_id")).otherwise("UNCLASS").alias("cat_no"),
        F.when(ok, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(ok, F.col("matched_keywords")).otherwise("").alias("matched_keywords"),
        F.when(ok, F.col("resolve_reason")).otherwise(reason).alias("resolve_reason"),
        F.when(ok, "ccre").otherwise("none").alias("source"),
        F.when(ok, F.lit(program)).otherwise("").alias("program"),
    )


def classify(transcripts: DataFrame, rules: DataFrame | RuleBase, hierarchy: DataFrame,
             program: str = "CCRE", threshold: float = 0.40, pii: bool = True,
             with_text: bool = False, stats: RedactionStats | None = None) -> DataFrame:
    """Transcripts (role columns) -> classified table (``CLASSIFIED_COLUMNS``).

    With ``with_text`` the transcript and its redacted form ride along in the
    same pass; without it they are null and dropped at the scan stage.
    ``stats`` counts the personal data replaced while the result is written."""
    texts = ["transcript", "redacted_transcript"] if with_text else []
    ccre = classify_ccre(transcripts, rules, pii, carry=["agent_name", "call_id", "ts", *texts], stats=stats)
    out = enrich(ccre, hierarchy, program, threshold)
    for c in CLASSIFIED_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("timestamp" if c == "ts" else "string"))
    return out.select(*CLASSIFIED_COLUMNS)
