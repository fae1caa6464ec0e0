"""Sources, sinks and rule-table statistics against plain-Python statements
of the same semantics."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from callsift.operators import examples, proximity, report, rulebase
from callsift.operators.hierarchy import categories_for_program
from callsift.session import scratch_path
from callsift.sources import export, rules as R, ruleset, tables, transcripts as TR
from paths import SF


def _write_csv(path, header, rows):
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-0.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def test_transcript_csv_scan_and_roles(spark):
    p = scratch_path(spark, "csv-in")
    rows = [("c1", "Ann", '[00:00:01 AGENT]: hi, "there"\nsecond line', "2024-01-02 03:04:05"),
            ("c2", "", "plain text", "")]
    _write_csv(p, ["call", "agent", "Conversation Text", "when"], rows)
    df = TR.read_transcripts_csv(spark, p)
    assert TR.detect_transcript_column(df.columns) == "Conversation Text"
    assert TR.detect_transcript_column(["a", "b"]) == "a"
    m = TR.map_columns(df, agent="agent", call_id="call", timestamp="when")
    got = sorted((r.call_id, r.agent_name, r.transcript) for r in m.collect())
    assert got == [("c1", "Ann", rows[0][2]), ("c2", None, "plain text")]
    assert m.columns[:5] == ["transcript_id", "transcript", "agent_name", "call_id", "ts"]
    assert m.select("transcript_id").distinct().count() == 2


def test_rule_csv_scan_and_missing_file(spark):
    p = scratch_path(spark, "rules-in")
    _write_csv(p, ["rule_id", "category", "subcategory", "required_groups", "forbidden_terms"],
               [tuple("" if v is None else v for v in r) for r in ruleset.KEYWORD_RULES])
    read = R.read_rule_csv(spark, p, R.KEYWORD_RULE_SCHEMA)
    parsed, bad = R.parse_keyword_rules(read)
    want, want_bad = R.parse_keyword_rules(R.keyword_rules(spark))
    key = lambda r: (r.rule_id, json.dumps(r.groups), json.dumps(r.forbidden))
    assert sorted(map(key, parsed.collect())) == sorted(map(key, want.collect()))
    assert [r.rule_id for r in bad.collect()] == [r.rule_id for r in want_bad.collect()]
    empty = R.read_rule_csv(spark, p + "-missing", R.KEYWORD_RULE_SCHEMA)
    assert empty.count() == 0 and "rule_id" in empty.columns


def test_preview_follows_file_order(spark, tmp_path):
    for name, ids in (("b", [9, 8]), ("a", [5, 7, 6]), ("c", [1])):
        spark.createDataFrame([(i, "x" * i) for i in ids], "i long, t string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    df = spark.read.parquet(f"{tmp_path}/*")
    assert [r.i for r in TR.preview(df, 4).collect()] == [5, 7, 6, 9] and TR.preview(df).count() == 6
    assert TR.preview(df).columns == ["i", "t"]


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    rows = [(str(i), f"text {i}", "a") for i in range(20_000)]
    _write_csv(str(tmp_path / "in"), ["call_id", "transcript", "agent"], rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        whole = TR.read_transcripts_csv(spark, str(tmp_path / "in"))
        parts = TR.read_transcripts_csv(spark, str(tmp_path / "in"), line_breaks=False)
        # one task against many
        tasks = [df.select(F.spark_partition_id().alias("p")).distinct().count() for df in (whole, parts)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks[0] == 1 and tasks[1] > 3
    assert sorted(parts.collect()) == sorted(whole.collect()) and parts.count() == 20_000


def test_rules_of_several_files_keep_file_order(spark, tmp_path):
    names = R.KEYWORD_RULE_SCHEMA.fieldNames()
    for name, rows in (("b.csv", [("B1", "c", "s", '[["x"]]', "")]),
                       ("a.csv", [(f"A{i}", "c", "s" * 500, '[["x\ny"]]', "") for i in range(40)]), ("c.csv", [("C1", "c", "s", '[["x"]]', "")])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([names, *rows])
    got = R.read_rule_csv(spark, str(tmp_path), R.KEYWORD_RULE_SCHEMA).orderBy("rule_ord").collect()
    assert [r.rule_id for r in got] == [*(f"A{i}" for i in range(40)), "B1", "C1"]
    assert [r.rule_ord for r in got] == list(range(42))


def test_exports_round_trip_and_html(spark):
    df = TR.from_documents(spark, SF).select("transcript_id", "agent_name",
                                             F.substring("transcript", 1, 50).alias("t"))
    pc = export.export_csv(df, scratch_path(spark, "out-csv"))
    back = export.read_export_csv(spark, pc, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    pp = export.export_parquet(df, scratch_path(spark, "out-pq"), partition_by=["agent_name"])
    assert sorted(spark.read.parquet(pp).select("transcript_id").collect()) == \
        sorted(df.select("transcript_id").collect())
    export.register_view(df, "transcripts")
    assert spark.sql("SELECT count(*) AS n FROM transcripts").first().n == df.count()
    cls = spark.createDataFrame(
        [(1, "a1", "Billing", "Refund", 0.9), (2, "a1", "Billing", "Invoice", 0.5),
         (3, "a2", "Account", "Close", 0.7), (4, None, None, None, 0.0)],
        "transcript_id long, agent_name string, category string, subcategory string, confidence double")
    page = report.export_html(cls)
    assert page.startswith("<!DOCTYPE html>") and "Transcripts: 4" in page
    assert page.index("<td>Billing</td>") < page.index("<td>Account</td>")


def test_csv_export_of_hostile_texts(spark):
    """Quotes, line breaks, commas, backslashes, null against '': read back by
    our reader and by Python's csv module."""
    import glob
    texts = ['say "hi"\nthere, you', '"', '""', 'ends with \\', '\\"', "a\r\nb", "a,b;c\td", " padded ", "", None, "ünï", "'", "null",
             '"quoted"', 'x"y', "\n", "end\n"]
    rows = [(i, t, f"agent, {i}" if i % 3 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "transcript_id long, t string, agent string").coalesce(1)
    path = export.export_csv(df, scratch_path(spark, "hostile-csv"))
    assert sorted(map(tuple, export.read_export_csv(spark, path, df.schema).collect()), key=lambda r: r[0]) == rows
    (part,) = glob.glob(f"{path}/part-*.csv")
    with open(part, newline="", encoding="utf-8") as f:
        got = list(csv.reader(f))
    assert got[0] == ["transcript_id", "t", "agent"]
    assert got[1:] == [[str(i), t or "", a or ""] for i, t, a in rows]


def test_rule_table_stats(spark):
    hier = R.hierarchy(spark)
    rows = ruleset.HIERARCHY
    s = rulebase.hierarchy_stats(hier).first()
    assert s.total_programs == len({r[0] for r in rows}) and s.total_categories == len(rows)
    assert s.unique_l1 == len({r[2] for r in rows}) and s.unique_l4 == len({r[5] for r in rows})
    sp = rulebase.hierarchy_stats(hier, "PNC").first()
    assert sp.total_categories == sum(r[0] == "PNC" for r in rows) and sp.program == "PNC"
    assert [r.Program for r in R.programs(hier).collect()] == sorted({r[0] for r in rows})
    assert categories_for_program(hier, "PNC").count() == sum(r[0] == "PNC" for r in rows)
    assert R.by_program(R.proximity_rules(spark), "PNC").count() == \
        sum(r[0] == "PNC" for r in ruleset.PROXIMITY_RULES)
    rb = rulebase.rulebase_stats(R.proximity_rules(spark), hier, R.keyword_rules(spark)).first()
    assert rb.total_proximity_rules == len(ruleset.PROXIMITY_RULES)
    assert rb.programs == sorted({r[0] for r in rows}) and rb.has_default_rules

    # proximity statistics: all terms' index keys, words per program
    parsed = []
    for prog, cat, *terms_ops in ruleset.PROXIMITY_RULES:
        t1, o1, t2, o2, t3 = terms_ops[:5]
        terms = [str(t).lower().strip() for t in (t1, t2, t3) if t is not None]
        if terms:
            parsed.append((prog, terms))
    g = proximity.proximity_stats(R.proximity_rules(spark)).first()
    keys = {t.split()[0] if " " in t else t for _, ts in parsed for t in ts}
    assert (g.total_rules, g.programs, g.unique_keywords) == (len(parsed), len({p for p, _ in parsed}), len(keys))
    pg = proximity.proximity_stats(R.proximity_rules(spark), "CCRE").first()
    words = {w for p, ts in parsed if p == "CCRE" for t in ts for w in t.split()}
    assert pg.unique_keywords == len(words)

    # example statistics, with a missing category counted as a value
    ex_rows = ruleset.USER_EXAMPLES + [("Extra  words here", None, None, None, None)]
    e = examples.example_stats(R.user_examples(spark, ex_rows)).first()
    cats = {str(r[1]).strip() for r in ex_rows}
    avg = round(sum(len(str(r[0]).lower().strip().split()) for r in ex_rows) / len(ex_rows), 1)
    assert (e.total_examples, e.unique_categories, e.avg_phrase_length) == (len(ex_rows), len(cats), avg)


def test_upload_log_and_history(spark):
    import datetime as dt
    h = spark.createDataFrame([], "user_id string, filename string, row_count bigint, "
                                  "processing_time_seconds double, created_at timestamp")
    t0 = dt.datetime(2024, 1, 1)
    for i in range(15):
        h = tables.log_upload(h, "u1" if i % 3 else "u2", f"f{i}.csv", i, 0.5, t0 + dt.timedelta(hours=i))
    one = [r.filename for r in tables.upload_history(h, "u1", limit=3).collect()]
    assert one == ["f14.csv", "f13.csv", "f11.csv"]
    allu = tables.upload_history(h, limit=2).collect()
    assert sorted((r.user_id, r.filename) for r in allu) == \
        [("u1", "f13.csv"), ("u1", "f14.csv"), ("u2", "f12.csv"), ("u2", "f9.csv")]


def test_custom_sql_errors_and_shares(spark):
    from callsift.operators import analytics as A
    df = spark.createDataFrame([(i, f"c{i % 13}", f"s{i % 29}", (i % 10) / 10.0) for i in range(500)],
                               "transcript_id long, category string, subcategory string, confidence double")
    ok = A.run_custom_query(spark, df, "SELECT category, count(*) AS n FROM transcripts GROUP BY category")
    assert ok.count() == 13
    for bad in ("SELEC 1", "SELECT nope FROM transcripts"):
        try:
            A.run_custom_query(spark, df, bad)
            raise AssertionError(bad)
        except ValueError as e:
            assert str(e).startswith("Query execution failed")
    # shares of all groups sum to 100 (up to rounding to 2 places)
    cats = A.category_distribution(df, limit=100).collect()
    assert len(cats) == 13 and abs(sum(r.percentage for r in cats) - 100.0) < 13 * 0.005 + 1e-9
    subs = A.subcategory_distribution(df, "c3", limit=100).collect()
    assert {r.category for r in subs} == {"c3"} and abs(sum(r.percentage for r in subs) - 100.0) < 0.2


def test_configuration_beyond_its_bound_is_refused(spark, monkeypatch):
    from callsift.plans import dims
    rules = R.keyword_rules(spark)
    assert len(dims.read_configuration(rules, "rules")) == len(ruleset.KEYWORD_RULES)
    monkeypatch.setattr(dims, "MAX_BROADCAST_BYTES", 2000)
    for df in (rules, R.keyword_rules(spark, [("a", "b", "c", "x" * 3000, None)])):
        with pytest.raises(ValueError, match="keyword rules: over"):
            R.parse_keyword_rules(df)
