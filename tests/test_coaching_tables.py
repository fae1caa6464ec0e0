"""Replies, caches, user tables and samples on rows with nulls and repeats."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callsift.operators import analytics, coaching, feedback
from callsift.session import scratch_path
from callsift.sources import rules as R
from callsift.sources import tables as TB
from callsift.streaming import classify_stream as ST

FULL = {"root_cause": "x", "coaching_points": ["a"], "sample_script": "s"}


@pytest.mark.parametrize("content,path,cause,points,priority", [
    ("\n" + json.dumps(FULL, indent=2) + "\n", "json", "x", ["a"], None),
    ("Here:\n```json\n" + json.dumps(FULL, indent=1) + "\n```", "fenced", "x", ["a"], None),
    ('Sure: {"root_cause": "y"} bye', "object", "y", [], "Medium"),
    ('{"coaching_points": ["p", 2]} and more', "object", "See raw response", ["p", "2"], "Medium"),
    ("line 1\r\n\tline 2  \n\nline 3\nline 4\nline 5", "text", "line 1", ["line 2", "line 3", "line 4"], "Medium"),
    ("only", "text", "only", ["See raw response below"], "Medium"),
    ("", "text", "Unable to parse response", ["See raw response below"], "Medium"),
    ("5", "error", "Parsing error: argument of type 'int' is not iterable", ["Check raw response"], "Low"),
    ("null", "error", "Parsing error: argument of type 'NoneType' is not iterable", ["Check raw response"], "Low"),
    (None, "error", "Parsing error: no content", ["Check raw response"], "Low"),
    ('{"a": {"root_cause": "x"}}', "text", '{"a": {"root_cause": "x"}}', ["See raw response below"], "Medium"),
    ('{"Root_Cause": "x"}', "text", '{"Root_Cause": "x"}', ["See raw response below"], "Medium"),
    ("{'root_cause': 'x', 'coaching_points': [], 'sample_script': 's'}", "text",
     "{'root_cause': 'x', 'coaching_points': [], 'sample_script': 's'}", ["See raw response below"], "Medium"),
    (json.dumps(FULL | {"coaching_points": "one", "priority": "High"}), "json", "x", ["one"], "High"),
    (json.dumps(FULL) + " trailing", "object", "x", ["a"], "Medium"),
    ('["root_cause", "coaching_points", "sample_script"]', "text",
     '["root_cause", "coaching_points", "sample_script"]', ["See raw response below"], "Medium"),
    ("{" * 3000, "text", "{" * 3000, ["See raw response below"], "Medium"),
])
def test_read_reply(content, path, cause, points, priority):
    r = coaching.read_reply(content)
    assert (r["parse_path"], r["root_cause"], r["coaching_points"], r["priority"]) == (path, cause, points, priority)
    assert r["raw_response"] == (content.strip()[:500] if path == "text" else None)


def test_cache_first_writes_back_what_was_parsed(spark):
    prompts = spark.createDataFrame([("a", "h1", False), ("b", "h2", True), ("c", "h3", False), ("d", "h4", False)],
                                    "agent_name string, prompt_hash string, was_truncated boolean")
    replies = spark.createDataFrame([("b", "h2", json.dumps(FULL)), ("c", "h3", "7"), ("d", "h4", "text")],
                                    "agent_name string, prompt_hash string, content string")
    cache = TB.with_expiry(spark.createDataFrame(
        [("u", "a", "h1", "{}", "m0", "2024-01-09 00:00:00"), ("u", "b", "h2", "{}", "m0", "2024-01-01 00:00:00"),
         ("other", "d", "h4", "{}", "m0", "2024-01-09 00:00:00")],
        "user_id string, agent_name string, prompt_hash string, coaching_json string, model_used string, created_at string")
        .withColumn("created_at", F.col("created_at").cast("timestamp")))
    results, rows = coaching.coaching_results(prompts, replies, cache, "u", "2024-01-10 00:00:00", "m1")
    assert {(r.agent_name, r.cached, r.parse_path) for r in results.collect()} == {
        ("a", True, "cache"), ("b", False, "json"), ("c", False, "error"), ("d", False, "text")}
    assert {(r.user_id, r.agent_name, r.model_used) for r in rows.collect()} == {("u", "b", "m1"), ("u", "d", "m1")}
    # the next run finds them
    after = TB.upsert(cache, rows, TB.COACHING_KEY)
    again, new = coaching.coaching_results(prompts, replies, after, "u", "2024-01-11 00:00:00", "m1")
    assert {r.agent_name for r in again.filter("cached").collect()} == {"a", "b", "d"} and new.count() == 0


def test_prompt_names_are_escaped(spark):
    bundle = spark.createDataFrame([("a", 1, 0.5, 1, 1, 1, 'say "hi"\n', 3, None, None, None, None)],
                                   "agent_name string, total_calls long, avg_confidence double, unique_categories long, "
                                   "unique_subcategories long, rank int, category string, count long, sample_id long, "
                                   "sample_subcategory string, sample_confidence double, sample_text string")
    prompt = coaching.coaching_prompts(coaching.nest_bundle(bundle)).first().prompt
    start = prompt.index("{\n")
    assert json.loads(prompt[start:prompt.index("\n}", start) + 2]) == {'say "hi"\n': 3}


EXAMPLES = "user_id string, example_phrase string, category string, subcategory string, tertiary_category string, " \
           "confidence double, source string"


def test_deletes_and_replacements_keep_rows_with_null_keys(spark):
    rows = [("8", "p1", "c", None, None, 0.9, "manual"), ("8", None, "c", None, None, 0.9, "manual"),
            (None, "p1", "c", None, None, 0.9, "manual"), ("9", "p1", "c", None, None, 0.9, "manual")]
    t = spark.createDataFrame(rows, EXAMPLES)
    assert Counter(map(tuple, TB.delete_user_examples(t, "8", "p1").collect())) == Counter(rows[1:])
    assert Counter(map(tuple, TB.delete_user_examples(t, "8").collect())) == Counter(rows[2:])
    assert [r.example_phrase for r in TB.read_user_examples(t, "9").collect()] == ["p1"]
    h = spark.createDataFrame([(None, "a", None, None), ("7", "b", None, None)],
                              "user_id string, category string, subcategory string, tertiary_category string")
    new = spark.createDataFrame([(" x ", "\ty", None)], "category string, subcategory string, tertiary_category string")
    got = TB.replace_user_hierarchy(h, new, "7")
    assert Counter(map(tuple, got.collect())) == Counter([(None, "a", None, None), ("7", "x", "y", None)])
    assert [tuple(r) for r in TB.read_user_hierarchy(got, "7").collect()] == [("x", "y", None)]


def test_user_partitions_are_written_clustered(spark):
    import glob
    df = spark.range(2000).repartition(16).select((F.col("id") % 5).cast("string").alias("user_id"), "id")
    path = TB.write_table(df, scratch_path(spark, "users"))
    files = glob.glob(f"{path.removeprefix('file://')}/user_id=*/*.parquet")
    assert len(files) < 5 * 16 and spark.read.parquet(path).count() == 2000


def test_program_tables_are_both_empty_if_either_is(spark):
    rules = R.proximity_rules(spark, [("P", "1", "t", None, None, None, None, None, None, None)])
    hier = R.hierarchy(spark, [("Q", "1", "a", "b", "c", "d"), ("P", "1", "a", "b", "c", "d")])
    assert [df.count() for df in R.rules_of_program(rules, hier, "P")] == [1, 1]
    assert [df.count() for df in R.rules_of_program(rules, hier, "Q")] == [0, 0]


def test_stratified_sample_draws_by_hash_order(spark):
    import hashlib
    rows = [(i, None if i == 3 else f"a{i}", (i * 37 % 100) / 100) for i in range(400)]
    df = spark.createDataFrame(rows, "transcript_id long, agent_name string, confidence double").repartition(7)
    got = feedback.stratified_sample(df, size=40).collect()
    strata = {"high": [], "medium": [], "low": []}
    for i, _, c in rows:
        strata["high" if c >= 0.7 else "medium" if c >= 0.5 else "low"].append(i)
    quotas = feedback.stratum_quotas(400, len(strata["high"]), len(strata["medium"]), 40)
    want = {i for s, ids in strata.items()
            for i in sorted(ids, key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())[:quotas[s]]}
    assert {r.transcript_id for r in got} == want and "_k" not in got[0].asDict()


def test_corrections_take_the_first_transcript_and_count_by_category(spark):
    texts = spark.createDataFrame([(1, "First"), (1, "Second"), (2, None), (3, "z" * 300)],
                                  "transcript_id long, transcript string").coalesce(1)
    corr = spark.createDataFrame([(1, "A", None, None), (2, "B", "s", None), (3, "A", None, None), (99, "C", None, None)],
                                 "transcript_id long, correct_category string, correct_subcategory string, correct_tertiary string")
    from callsift.plans.classify import prepare
    out = feedback.corrections_to_examples(corr, texts, prepare_fn=prepare)
    assert sorted((r.transcript_id, r.example_phrase, r.category) for r in out.collect()) == [
        (1, "first", "A"), (2, "", "B"), (3, "z" * 200, "A")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("REDACTED_EMAIL") < plan.index("Join")  # redacted above the join
    s = feedback.correction_stats(corr, spark.range(8)).first()
    assert (s.total_corrections, s.correction_rate, s.categories_corrected, s.top_correction) == (
        4, 50.0, {"A": 2, "B": 1, "C": 1}, "A")
    none = feedback.correction_stats(corr.limit(0), None).first()
    assert (none.total_corrections, none.correction_rate) == (0, 0.0)


def test_custom_sql_leaves_the_session_as_it_was(spark):
    df = spark.createDataFrame([(1, "c")], "transcript_id long, category string")
    spark.range(7).createOrReplaceTempView("transcripts")
    assert analytics.run_custom_query(spark, df, "SELECT category FROM transcripts").first()[0] == "c"
    assert spark.table("transcripts").count() == 7
    with pytest.raises(ValueError, match="Query execution failed"):  # an error at run time
        analytics.run_custom_query(spark, df, "SELECT raise_error('no') FROM transcripts")
    spark.catalog.dropTempView("transcripts")


@pytest.mark.parametrize("sql", [
    "DROP TABLE IF EXISTS transcripts", "CREATE TABLE x AS SELECT 1", "CREATE OR REPLACE TEMP VIEW v AS SELECT 1",
    "INSERT INTO kept SELECT 1", "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT 1", "SET spark.sql.ansi.enabled=false",
    "WITH a AS (SELECT 1) INSERT INTO kept SELECT * FROM a", "FROM transcripts INSERT INTO kept SELECT 1 INSERT INTO kept SELECT 2",
    "TRUNCATE TABLE kept", "CACHE TABLE transcripts", "SHOW TABLES", "ALTER TABLE kept ADD COLUMNS (c int)", "DELETE FROM kept",
    "BEGIN SELECT 1; END", "CALL p()", "EXECUTE IMMEDIATE 'DROP TABLE kept'", "SELEKT 1", ""])
def test_custom_sql_refuses_all_but_queries(spark, sql):
    spark.range(3).createOrReplaceTempView("kept")
    df = spark.createDataFrame([(1, "c")], "transcript_id long, category string")
    with pytest.raises(ValueError, match="Query execution failed"):
        analytics.run_custom_query(spark, df, sql)
    assert spark.table("kept").count() == 3 and not spark.catalog.tableExists("v")
    spark.catalog.dropTempView("kept")


def test_custom_sql_runs_every_kind_of_query(spark):
    df = spark.createDataFrame([(1, "c"), (2, "d")], "transcript_id long, category string")
    for sql, want in (("WITH a AS (SELECT * FROM transcripts) SELECT count(*) FROM a", [(2,)]), ("VALUES (1), (2)", [(1,), (2,)]),
                      ("SELECT category, category, NULL AS n FROM transcripts WHERE transcript_id = 1", [("c", "c", None)]),
                      ("FROM transcripts SELECT max(transcript_id)", [(2,)]), ("TABLE transcripts", [(1, "c"), (2, "d")]),
                      ("SELECT 1 UNION ALL SELECT (SELECT count(*) FROM transcripts)", [(1,), (2,)])):
        assert sorted(tuple(r) for r in analytics.run_custom_query(spark, df, sql).collect()) == want


def arrivals(spark, folder, name, rows):
    """A file of transcripts (id, text, day)."""
    import datetime
    spark.createDataFrame([(i, t, datetime.datetime(2024, 1, d)) for i, t, d in rows], ARRIVAL).coalesce(1).write.parquet(
        f"{folder}/{name}")


ARRIVAL = "transcript_id long, transcript string, ts timestamp"


def stateful(spark, folder, out, lateness="5 days"):
    schema = spark.createDataFrame([], ARRIVAL).schema
    paths = ST.run_stateful_stream(spark, f"{folder}/*", schema, lambda b: b, R.keyword_rules(spark), R.hierarchy(spark), out,
                                   lateness=lateness)
    rows = sorted(r.transcript_id for r in spark.read.parquet(paths["classified"]).collect())
    return rows, ST.latest_totals(spark.read.parquet(paths["totals"])).first()


def test_stateful_stream_restarts_and_counts_repeats_once(spark, tmp_path):
    files = [("f0", [(1, "refund my bill", 1), (2, "close my account", 2)]), ("f1", [(3, "refund", 3), (1, "refund my bill", 3)]),
             ("f2", [(1, "refund my bill", 1), (2, "close my account", 2)]), ("f3", [(4, None, 4), (1, "another text", 4)])]
    once = f"{tmp_path}/all"
    for name, rows in files:
        arrivals(spark, once, name, rows)
    whole = stateful(spark, once, scratch_path(spark, "state"))
    step, out = f"{tmp_path}/steps", scratch_path(spark, "state")
    for name, rows in files[:2]:
        arrivals(spark, step, name, rows)
    assert stateful(spark, step, out)[0] == [1, 2, 3]
    for name, rows in files[2:]:
        arrivals(spark, step, name, rows)
    assert stateful(spark, step, out) == whole and whole[0] == [1, 1, 2, 3, 4]
    assert whole[1].total_transcripts == 5
    assert stateful(spark, step, out) == whole  # nothing new has arrived


def test_stateful_stream_survives_a_crash_between_its_parts(spark, tmp_path, monkeypatch):
    arrivals(spark, str(tmp_path), "f0", [(1, "refund my bill", 1)])
    out, real = scratch_path(spark, "state"), ST.F.count_if

    def fail(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(ST.F, "count_if", fail)
    with pytest.raises(RuntimeError):  # classified, not yet totalled
        stateful(spark, str(tmp_path), out)
    monkeypatch.setattr(ST.F, "count_if", real)
    arrivals(spark, str(tmp_path), "f1", [(2, "refund my bill", 2), (1, "refund my bill", 2)])
    rows, totals = stateful(spark, str(tmp_path), out)
    assert rows == [1, 2] and totals.total_transcripts == 2


def test_arrivals_behind_the_watermark_are_dropped(spark, tmp_path):
    arrivals(spark, str(tmp_path), "f0", [(1, "a", 20)])
    out = scratch_path(spark, "state")
    stateful(spark, str(tmp_path), out, "2 days")
    arrivals(spark, str(tmp_path), "f1", [(2, "b", 1), (3, "c", 19)])
    assert stateful(spark, str(tmp_path), out, "2 days")[0] == [1, 3]


def test_corrections_take_the_first_row_in_file_order(spark, tmp_path):
    for name, texts in (("b", ["second file"]), ("a", ["first file, first row" + " pad" * 5000, "first file, later row"])):
        spark.createDataFrame([(7, t) for t in texts], "transcript_id long, redacted_transcript string").coalesce(1).write.parquet(
            f"{tmp_path}/{name}")
    corr = spark.createDataFrame([(7, "x", None, None)],
                                 "transcript_id long, correct_category string, correct_subcategory string, correct_tertiary string")
    from callsift.sources.transcripts import with_order
    for parts in (1, 5):
        texts = with_order(spark.read.parquet(f"{tmp_path}/*")).repartition(parts)
        got = feedback.corrections_to_examples(corr, texts).first()
        assert got.example_phrase.startswith("first file, first row")


def test_running_statistics_over_batches(spark):
    def batch(n, rows):
        return ST.batch_stats(spark.createDataFrame(rows, "category string, confidence double"), n)

    parts = batch(0, [("A", 0.9), ("Unclassified", 0.0)]).unionByName(batch(1, [("A", 0.6), ("B", 0.45)]))
    r = ST.running_stats(parts).first()
    assert (r.batches, r.total_transcripts, r.classified, r.classified_pct, r.unclassified, r.unclassified_pct,
            r.avg_confidence) == (2, 4, 3, 75.0, 1, 25.0, 0.4875)
    assert (r.high_confidence, r.medium_confidence, r.low_confidence) == (1, 1, 1)
    assert ST.running_stats(parts.limit(0)).count() == 0
