import json
import os
import random

from pyspark.sql import functions as F

import model
from callsift.operators import keyword
from callsift.operators.keyword import KeywordMatcher
from callsift.plans.classify import classify, classify_ccre
from callsift.sources import rules as R
from callsift.sources import ruleset
from callsift.sources import transcripts as TR
from paths import SF


def ccre_one(spark, text, groups, forbidden=None):
    rules = R.keyword_rules(spark, [("X1", "C", "S", json.dumps(groups),
                                     json.dumps(forbidden) if forbidden else None)])
    t = spark.createDataFrame([(1, text)], "transcript_id long, transcript string")
    r = classify_ccre(t, rules, pii=False).first()
    return r


GOLDEN = [
    ("i want a refund for my bill", [["refund"], ["bill"]], None, 1.0),
    ("i do not want a refund", [["refund"], ["bill"]], None, 0.4),
    ("i do not want a refund", [["refund", "money back"], ["bill"], ["card"]], None, None),
    ("refund now", [["refund"]], None, 1.0),
    ("no refund", [["refund"]], None, 0.9),
    ("the knot refund", [["refund"]], None, 1.0),
    ("xx knot " + "y" * 45 + " refund", [["refund"]], None, 0.9),
    ("a refund for the manager", [["refund"]], ["manager"], None),
    ("a refund for the managers", [["refund"]], ["manager"], 1.0),
    ("prefunded account", [["refund"]], None, 1.0),
    ("alpha " + "x" * 60 + " beta ", [["alpha"], ["beta"], ["gamma"], ["delta"]], None, 0.65),
    ("do not alpha " + "x" * 130 + " never beta", [["alpha"], ["beta"], ["gamma"], ["delta"]], None, None),
    ("your <REDACTED_ACCOUNT> is fine", [["account"]], None, 1.0),
]


def test_keyword_golden(spark):
    for text, groups, forb, want in GOLDEN:
        r = ccre_one(spark, text, groups, forb)
        if want is None:
            assert r["rule_id"] is None, text
            assert r["subcategory"] == "No Match"
        else:
            assert r["confidence"] == want, (text, r["confidence"])


def test_empty_and_ties(spark):
    rules = R.keyword_rules(spark, [("A", "C1", "S1", '[["x"]]', None), ("B", "C2", "S2", '[["x"]]', None),
                                    ("BAD", "C", "S", '[["x", ["y"]', None)])
    t = spark.createDataFrame([(1, "x marks"), (2, ""), (3, None), (4, "nothing")],
                              "transcript_id long, transcript string")
    rows = {r.transcript_id: r for r in classify_ccre(t, rules).collect()}
    assert rows[1]["rule_id"] == "A" and rows[1]["num_rules_activated"] == 2
    assert rows[2]["subcategory"] == "Empty Transcript" and rows[3]["subcategory"] == "Empty Transcript"
    assert rows[4]["subcategory"] == "No Match" and rows[4]["confidence"] == 0.0


def test_parse_quarantine(spark):
    parsed, bad = R.parse_keyword_rules(R.keyword_rules(spark))
    assert [r.rule_id for r in bad.collect()] == ["R20"]
    assert parsed.count() == len(ruleset.KEYWORD_RULES) - 1


def test_rule_json_is_strict(spark):
    """Single quotes, text after the value, null or non-string terms and other
    shapes set a rule aside; the others are unaffected."""
    cases = [('[["x"]]', None, True), ("[['x']]", None, False), ('[["x"]] y', None, False), ('[["x"]]', '["a", null]', False),
             ('[["x"]]', '[]', True), ('[]', None, True), ('[[1]]', None, False), ('{"a": 1}', None, False),
             ('"x"', None, False), ('[["x"]]', '"abc"', False), (None, None, False), ('["ab"]', None, False)]
    parsed, bad = R.parse_keyword_rules(R.keyword_rules(spark, [(str(i), "C", "S", g, f) for i, (g, f, _) in enumerate(cases)]))
    assert {int(r.rule_id) for r in parsed.collect()} == {i for i, c in enumerate(cases) if c[2]}
    assert {int(r.rule_id) for r in bad.collect()} == {i for i, c in enumerate(cases) if not c[2]}


def test_hybrid_matches_model(spark):
    out = classify(TR.from_documents(spark, SF), R.keyword_rules(spark), R.hierarchy(spark)).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rules = model.parse_rules(ruleset.KEYWORD_RULES)
    for r in out:
        exp = model.hybrid(model.redact(model.clean(docs[r.transcript_id])), rules, ruleset.HIERARCHY)
        got = (r.category, r.subcategory, r.tertiary, r.quaternary, r.cat_no, r.confidence,
               r.matched_keywords, r.source, r.program, r.num_rules_activated)
        assert got == exp, r.transcript_id


def test_partition_invariance(spark):
    base = TR.from_documents(spark, SF)
    a = classify(base.repartition(1), R.keyword_rules(spark), R.hierarchy(spark))
    b = classify(base.repartition(7), R.keyword_rules(spark), R.hierarchy(spark))
    cols = ["transcript_id", "cat_no", "confidence", "num_rules_activated", "matched_keywords"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_confidence_domain(spark):
    out = classify(TR.from_documents(spark, SF), R.keyword_rules(spark), R.hierarchy(spark))
    bad = out.filter(~((F.col("confidence") == 0.0) | F.col("confidence").between(0.4, 1.0)))
    assert bad.count() == 0
    assert out.count() == out.select("transcript_id").distinct().count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_is_one_map_side_pass(spark):
    """Text scan, one Arrow pass, broadcast joins of configuration: no exchange
    of the texts, and nothing runs or is written by building the frame."""
    from callsift.session import shared_dir
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    out = classify(TR.from_documents(spark, SF), R.keyword_rules(spark), R.hierarchy(spark), with_text=True)
    plan = plan_of(out)
    assert plan.count("documents.parquet") == 1 and plan.count("MapInArrow") == 1
    assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "EvalPython" not in plan
    out.write.format("noop").mode("overwrite").save()
    assert set(os.listdir(folder)) == before


def test_rows_keep_their_own_result_whatever_their_id(spark):
    """Duplicate and null ids: each row is classified by its own text."""
    rows = [(1, "refund please"), (1, "my bill now"), (2, "close it"), (2, "vip here"), (None, "refund and bill"),
            (None, None)]
    rules = [("X1", "C", "S", '[["refund"], ["bill"]]', None), ("X2", "C", "S", '[["close"]]', '["vip"]')]
    got = classify_ccre(spark.createDataFrame(rows, "transcript_id long, transcript string"),
                        R.keyword_rules(spark, rules), carry=["transcript"]).collect()
    parsed = model.parse_rules(rules)
    want = [(i, t, *model.ccre(model.redact(model.clean(t)), parsed)[:5]) for i, t in rows]
    assert sorted(((r.transcript_id, r.transcript, r.category, r.subcategory, r.confidence, r.matched_keywords,
                    r.num_rules_activated) for r in got), key=str) == sorted(want, key=str)


def test_generated_rules_match_model(spark):
    """A generated 300-rule base (up to 4 groups, forbidden words)."""
    rows = ruleset.large_keyword_rules(300)
    docs = TR.from_documents(spark, SF)
    parsed = model.parse_rules(rows)
    want = {}
    for r in docs.select("transcript_id", "transcript").collect():
        _, _, conf, kws, n, rid, _ = model.ccre(model.redact(model.clean(r.transcript)), parsed)
        want[r.transcript_id] = (rid, conf, kws, n)
    out = classify_ccre(docs, R.keyword_rules(spark, rows)).collect()
    assert {r.transcript_id: (r.rule_id, r.confidence, r.matched_keywords, r.num_rules_activated)
            for r in out} == want


def test_text_prepared_once_in_plans(spark):
    """Clean + redact appear once in the optimized plans of the text stages
    (a filter pushed below the preparation would inline it a second time)."""
    from callsift.plans import registry
    for name in ("prox_classify", "ccre_scores", "hybrid_classify"):
        p = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert p.count("<REDACTED_EMAIL>") == 1 and p.count("AGENT|CUSTOMER") == 1


def test_array_scoring_equals_the_model_on_random_rules():
    """Keywords that contain each other, shared and repeated terms, empty
    groups, negations and forbidden words at every kind of boundary."""
    r = random.Random(11)
    words = ["no", "not", "refund", "fund", "bill", "card", "stop", "stra\u00dfe", "\u00df", "na\u00efve", "under_score", "x-y",
             "\u00fcber", "", "REFUND"]
    for _ in range(800):
        rules = [(f"R{i}", f"c{i}", "s", json.dumps([[r.choice(words) for _ in range(r.randint(0, 3))] for _ in range(r.randint(0, 3))]),
                  json.dumps([r.choice(words) for _ in range(r.choice([0, 0, 1, 2]))])) for i in range(r.randint(0, 6))]
        parsed = model.parse_rules(rules)
        matcher = KeywordMatcher(parsed)
        texts = [model.normalize("".join(r.choice([*words, " ", " ", ". ", "_", " a " * 20]) + r.choice(["", " "])
                                         for _ in range(r.randint(0, 14)))) for _ in range(4)] + [None, ""]
        n, ords, confidence, groups, rid, cat, _, keywords = [c.to_pylist() for c in matcher.winners(texts)]
        kept = matcher.kept(texts)[0].to_pylist()
        for i, t in enumerate(texts):
            own, _, conf, kws, count, want, matched = model.ccre(t or "", parsed)
            assert (rid[i], confidence[i] or 0.0, keywords[i] or "", n[i], groups[i], cat[i] or "Unclassified") == (
                want, conf, kws, count, matched, own), (t, rules)
            scores = {k[0]: model.score(t, k) for k in parsed} if t else {}
            assert {k["rule_ord"]: (k["confidence"], k["matched_groups"]) for k in kept[i]} == {
                o: (s[0], len(s[1])) for o, s in scores.items() if s}


def test_scoring_in_small_batches_is_the_same(monkeypatch):
    rows = ruleset.large_keyword_rules(200)
    matcher = KeywordMatcher(model.parse_rules(rows))
    texts = [model.normalize(" ".join(k for g in json.loads(r[3]) for k in g)) for r in rows[:40]] + ["", None]
    whole = [c.to_pylist() for c in matcher.winners(texts)]
    monkeypatch.setattr(keyword, "BATCH_SLOTS", 10)
    assert [c.to_pylist() for c in matcher.winners(texts)] == whole
    assert any(whole[1])


def test_texts_are_looked_at_in_small_pieces():
    """A large Arrow batch is matched a few rows at a time, in order and whole."""
    import pyarrow as pa
    from callsift.operators import matching
    batches = [pa.RecordBatch.from_pydict({"i": list(range(at, at + n)), "t": [None if k % 7 == 0 else "x" * (k % 50) for k in range(n)]},
                                          schema=pa.schema([("i", pa.int64()), ("t", pa.string())]))
               for at, n in ((0, 1000), (1000, 0), (1000, 3), (1003, matching.SLICE_ROWS), (5000, matching.SLICE_ROWS + 1))]
    got = list(matching._slices(iter(batches)))
    assert max(b.num_rows for b in got) == matching.SLICE_ROWS
    assert pa.Table.from_batches(got).to_pydict() == pa.Table.from_batches(batches).to_pydict()
