"""Coaching data preparation for every agent at once: metrics, category
mix, sample transcripts, token-budgeted prompts, cache-first pending list,
and parsing of model responses. The model call itself stays outside.

All per-agent work is aggregate-first: (agent, category) counts come from a
partial aggregation (a hot agent is spread over many tasks), and windows
only rank the already aggregated rows. Sample texts are fetched with a join
whose small side (at most five rows per agent) is broadcast when its
measured size allows.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.functions import patterns as P
from callsift.functions.text import content_hash, estimate_tokens
from callsift.plans.dims import broadcast_if_small
from callsift.session import write_table
from callsift.sources.tables import TTL

# FIXED VALUES: context window (tokens) per hosted model name; any other
# model gets DEFAULT_CONTEXT.
MODEL_CONTEXT = {
    "deepseek/deepseek-chat-v3.1:free": 64000,
    "deepseek/deepseek-r1-distill-llama-70b:free": 32000,
    "meta-llama/llama-3.3-70b-instruct:free": 8000,
    "qwen/qwen2.5-vl-32b-instruct:free": 32000,
    "qwen/qwen3-235b-a22b:free": 32000,
    "mistralai/mistral-7b-instruct:free": 8000,
    "openchat/openchat-7b:free": 8000,
    "gryphe/mythomax-l2-13b:free": 8000,
    "openai/gpt-oss-20b:free": 8000,
    "meta-llama/llama-4-maverick:free": 16000,
    "moonshotai/kimi-vl-a3b-thinking:free": 32000,
    "moonshotai/kimi-k2:free": 16000,
}
DEFAULT_CONTEXT = 8000


def context_for_model(model: str | None) -> int:
    """Context window of a model name (unknown or missing -> 8000)."""
    return MODEL_CONTEXT.get(model, DEFAULT_CONTEXT) if model else DEFAULT_CONTEXT
MAX_SAMPLES = 5
TOP_CATEGORIES = 10


def agent_metrics(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("agent_name").isNotNull()).groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
        F.countDistinct("category").alias("unique_categories"),
        F.countDistinct("subcategory").alias("unique_subcategories")))


def agent_categories(df: DataFrame) -> DataFrame:
    """(agent, category, count, rank, first transcript id of the category).

    Fixed-width hash aggregate (count, min id); the sample's own columns are
    fetched afterwards for the few ranked ids only."""
    g = (df.filter(F.col("agent_name").isNotNull() & F.col("category").isNotNull())
         .groupBy("agent_name", "category").agg(
             F.count(F.lit(1)).alias("count"),
             F.min("transcript_id").alias("sample_id")))
    w = Window.partitionBy("agent_name").orderBy(F.desc("count"), F.asc("category"))
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP_CATEGORIES)
            .select("agent_name", "category", "count", "rank", "sample_id"))


def coaching_bundle(df: DataFrame, texts: DataFrame, max_samples: int = MAX_SAMPLES,
                    prepare_fn=None) -> DataFrame:
    """Flat bundle rows: per agent its metrics and top-10 categories; the
    first ``max_samples`` ranks carry a sample (first 500 characters of the
    redacted text of the category's first transcript).

    ``texts`` holds ``redacted_transcript``, or raw transcripts together with
    ``prepare_fn`` (clean + redact), which then runs only on the sample rows."""
    # Three branches read the classified rows (sample-size check, category
    # ranks, metrics): write the five needed columns once to the shared
    # folder instead of scoring the transcripts three times.
    df = write_table(df.select("transcript_id", "agent_name", "category", "subcategory", "confidence"), "coached")
    # at most ten rows an agent, read by the size check, the samples and the result
    cats = write_table(agent_categories(df), "agent-categories")
    samples = broadcast_if_small(cats.filter(F.col("rank") <= max_samples).select("sample_id").distinct())
    t = texts.withColumnRenamed("transcript_id", "sample_id").join(samples, "sample_id", "left_semi")
    if prepare_fn is not None:
        t = prepare_fn(t.withColumnRenamed("sample_id", "transcript_id")).withColumnRenamed(
            "transcript_id", "sample_id")
    t = t.select("sample_id", F.substring("redacted_transcript", 1, 500).alias("sample_text")).dropDuplicates(["sample_id"])
    # The sample is the row with the category's smallest id (one row of a
    # repeated id).
    rows = df.select(F.col("transcript_id").alias("sample_id"),
                     F.col("subcategory").alias("sample_subcategory"),
                     F.col("confidence").alias("sample_confidence")).join(
        samples, "sample_id", "left_semi").dropDuplicates(["sample_id"])
    out = (cats.join(agent_metrics(df), "agent_name")
           .join(rows, "sample_id", "left")
           .join(t, "sample_id", "left"))
    keep = F.col("rank") <= max_samples
    return out.select(
        "agent_name", "total_calls", "avg_confidence", "unique_categories", "unique_subcategories",
        "rank", "category", "count",
        F.when(keep, F.col("sample_id")).alias("sample_id"),
        F.when(keep, F.col("sample_subcategory")).alias("sample_subcategory"),
        F.when(keep, F.col("sample_confidence")).alias("sample_confidence"),
        F.when(keep, F.col("sample_text")).alias("sample_text"))


def nest_bundle(flat: DataFrame) -> DataFrame:
    """One row per agent: metrics struct, category map, sample array
    (bounded: ten categories and five samples per agent)."""
    return flat.groupBy("agent_name").agg(
        F.first(F.struct("total_calls", "avg_confidence", "unique_categories",
                         "unique_subcategories")).alias("metrics"),
        F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("rank", "category", "count"))),
                                       lambda e: F.struct(e["category"], e["count"])))
         .alias("category_distribution"),
        F.transform(F.sort_array(F.collect_list(F.when(
            F.col("sample_id").isNotNull(),
            F.struct("rank", "sample_text", "category", "sample_subcategory", "sample_confidence")))),
            lambda s: F.struct(s["sample_text"].alias("transcript"), s["category"].alias("category"),
                               s["sample_subcategory"].alias("subcategory"),
                               s["sample_confidence"].alias("confidence"))).alias("sample_transcripts"))


def _json_text(c):
    """A string as a JSON string, with its quotes."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _distribution_json(c):
    entries = F.transform(F.map_entries(c), lambda e: F.concat(
        F.lit("  "), _json_text(e["key"]), F.lit(": "), e["value"].cast("string")))
    return F.concat(F.lit("{\n"), F.array_join(entries, ",\n"), F.lit("\n}"))


def coaching_prompts(bundles: DataFrame, context_limit: int | None = None,
                     model: str | None = None) -> DataFrame:
    """Prompt per agent with a token budget of ``int(context * 0.7)`` at four
    characters per token; over budget, the first three samples are cut to
    200 characters and the prompt is marked truncated (this template is
    shorter than the original's, so that edge lies at longer samples). The context comes
    from ``context_limit``, else from the ``model`` name. Returns
    (agent_name, prompt, was_truncated, est_tokens, prompt_hash)."""
    if context_limit is None:
        context_limit = context_for_model(model)
    budget = int(context_limit * 0.7)
    m = F.col("metrics")
    head = F.concat(
        F.lit("You coach contact-center agents. Review the data below.\n\nAgent: "),
        F.col("agent_name"),
        F.lit("\n\nMetrics:\n- Calls: "), m["total_calls"].cast("string"),
        F.lit("\n- Mean confidence: "), m["avg_confidence"].cast("string"),
        F.lit("\n- Categories: "), m["unique_categories"].cast("string"),
        F.lit("\n- Subcategories: "), m["unique_subcategories"].cast("string"),
        F.lit("\n\nCategory counts:\n"), _distribution_json(F.col("category_distribution")),
        F.lit("\n\nSample transcripts (redacted):\n"))
    full_samples = F.array_join(F.transform(
        "sample_transcripts", lambda s, i: F.format_string(
            "\nSample %d:\nCategory: %s / %s (confidence %.3f)\nText: %s\n\n",
            i + 1, s["category"], s["subcategory"], s["confidence"], s["transcript"])), "")
    tail = F.lit("\n\nAnswer with one JSON object with the keys root_cause, coaching_points, "
                 "sample_script, kpi_recommendations, strengths and priority (High/Medium/Low).")
    full = F.concat(head, full_samples, tail)
    cut_samples = F.concat(F.lit("[... shortened to fit the context window ...]\n\n"), F.array_join(
        F.transform(F.slice("sample_transcripts", 1, 3), lambda s, i: F.format_string(
            "\nSample %d:\nCategory: %s / %s\nText: %s...\n\n",
            i + 1, s["category"], s["subcategory"], F.substring(s["transcript"], 1, 200))), ""))
    short = F.concat(head, cut_samples, F.lit("\n\nAnswer with the same JSON object only."))
    over = estimate_tokens(full) > F.lit(budget)
    prompt = F.when(over, short).otherwise(full)
    return bundles.select("agent_name", prompt.alias("prompt"), over.alias("was_truncated")).select(
        "agent_name", "prompt", "was_truncated", estimate_tokens("prompt").alias("est_tokens"),
        content_hash("prompt").alias("prompt_hash"))


def _live(cache: DataFrame, user_id: str, now) -> DataFrame:
    return cache.filter((F.col("user_id") == F.lit(user_id))
                        & (F.col("expires_at") >= F.lit(now).cast("timestamp")))


def pending_prompts(prompts: DataFrame, cache: DataFrame, user_id: str, now) -> DataFrame:
    """Prompts without a live cache entry for (user, agent, prompt hash):
    the list an external caller sends to the model."""
    return prompts.join(_live(cache, user_id, now).select("agent_name", "prompt_hash"),
                        ["agent_name", "prompt_hash"], "left_anti")


def coaching_results(prompts: DataFrame, replies: DataFrame, cache: DataFrame, user_id: str, now,
                     model: str) -> tuple[DataFrame, DataFrame]:
    """Cache first: (results, new cache rows).

    A prompt with a live entry returns the stored coaching; the others get
    their reply (``replies``: agent_name, prompt_hash, content), parsed. New
    cache rows are the parsed replies but for error records."""
    key = ["agent_name", "prompt_hash"]
    hits = prompts.join(_live(cache, user_id, now).select(*key, "coaching_json", "model_used", "created_at"), key).select(
        *key, "was_truncated", "coaching_json", "model_used", F.lit(True).alias("cached"),
        F.col("created_at").alias("cached_at"), F.lit("cache").alias("parse_path"))
    asked = parse_responses(pending_prompts(prompts, cache, user_id, now).join(replies.select(*key, "content"), key))
    fresh = asked.select(
        *key, "was_truncated", F.to_json(F.struct(*REPLY_FIELDS)).alias("coaching_json"),
        F.lit(model).alias("model_used"), F.lit(False).alias("cached"), F.lit(None).cast("timestamp").alias("cached_at"),
        "parse_path")
    at = F.lit(now).cast("timestamp")
    rows = fresh.filter("parse_path <> 'error'").select(
        F.lit(user_id).alias("user_id"), *key, "coaching_json", "model_used", at.alias("created_at"),
        (at + F.expr(TTL)).alias("expires_at"))
    return hits.unionByName(fresh), rows


REPLY_FIELDS = ["root_cause", "coaching_points", "sample_script", "kpi_recommendations", "strengths", "priority"]
_REPLY_SCHEMA = [("parse_path", "string"), ("root_cause", "string"), ("coaching_points", "array<string>"),
                 ("sample_script", "string"), ("kpi_recommendations", "array<string>"), ("strengths", "array<string>"),
                 ("priority", "string"), ("raw_response", "string")]
_LISTS = {"coaching_points", "kpi_recommendations", "strengths"}


def _loaded(text: str | None) -> tuple[bool, object]:
    """(whether the text is strict JSON, its value)."""
    try:
        return True, json.loads(text or "")
    except (ValueError, RecursionError):
        return False, None


def _typed(name: str, value):
    """A JSON value as the column holds it: text, or a list of texts."""
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    if name not in _LISTS or value is None:
        return text(value)
    return [text(v) for v in value] if isinstance(value, list) else [text(value)]


def _record(path: str, raw: str | None = None, **fields) -> dict:
    known = {k: fields.get(k) for k in REPLY_FIELDS}
    return {"parse_path": path, "raw_response": raw} | {k: _typed(k, v) for k, v in known.items()}


def _error(message: str) -> dict:
    return _record("error", **P.REPLY_DEFAULTS | {
        "root_cause": P.PARSING_ERROR + message, "coaching_points": [P.CHECK_RAW], "priority": "Low"})


def read_reply(content: str | None) -> dict:
    """A model reply as a coaching record, by the first rule that applies:
    (json) the stripped reply is a JSON object with the three required keys at
    its top level; (fenced) the same in a fenced block; (object) the first
    brace object is JSON with root_cause or coaching_points, its missing
    fields defaulted; (text) line 1, lines 2 to 4, first 500 characters.
    A missing reply, or one that is a bare JSON number or constant, gives an
    error record of priority Low. A list field that holds another value keeps
    it as its only element."""
    if content is None:
        return _error("no content")
    text = content.strip()
    ok, value = _loaded(text)
    if ok and not isinstance(value, (dict, list, str)):
        return _error(f"argument of type '{type(value).__name__}' is not iterable")
    fenced, brace = re.search(P.FENCED_JSON, text, re.DOTALL), re.search(P.BRACE_OBJECT, text)
    fenced, brace = _loaded(fenced and fenced[1])[1], _loaded(brace and brace[0])[1]
    for path, found in (("json", value), ("fenced", fenced)):
        if isinstance(found, dict) and set(P.REPLY_KEYS) <= set(found):
            return _record(path, **found)
    if isinstance(brace, dict) and {"root_cause", "coaching_points"} & set(brace):
        return _record("object", **P.REPLY_DEFAULTS | brace)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    return _record("text", text[:500], **P.REPLY_DEFAULTS | {
        "root_cause": lines[0] if lines else P.UNREADABLE, "coaching_points": lines[1:4] or [P.SEE_BELOW]})


def parse_responses(responses: DataFrame, content_col: str = "content") -> DataFrame:
    """The input's columns with parse_path, the coaching fields and (for the
    text path) raw_response; see ``read_reply``. One Arrow pass."""
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = T.StructType([*responses.schema.fields, *T.StructType.fromDDL(
        ", ".join(f"{n} {k}" for n, k in _REPLY_SCHEMA)).fields])

    def run(batches):
        for b in batches:
            got = [read_reply(c) for c in b.column(content_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array([g[n] for g in got], kinds[k]) for n, k in _REPLY_SCHEMA)],
                [*b.schema.names, *(n for n, _ in _REPLY_SCHEMA)])

    return responses.mapInArrow(run, schema)
