import difflib

from pyspark.sql import functions as F

from callsift.operators import coaching, examples, feedback, proximity, rulebase
from callsift.sources import rules as R
from callsift.sources import tables as TB
from paths import SF

PROX = [
    ("please cancel my card", ("cancel", None, None, None, None, None), 0.95),
    ("please cancel my card", ("cancel", "NEAR", "card", None, None, 2.0), 0.90),
    ("cancel a b c d e f card", ("cancel", "NEAR", "card", None, None, 2.0), 0.90),
    ("cancel a b c d e f g card", ("cancel", "NEAR", "card", None, None, 2.0), None),
    ("cancel the discards today", ("cancel", "NEAR", "card", None, None, 2.0), 0.90),
    ("cancel the discards today", ("cancel", "NEAR", "card", "NEAR", "today", 2.0), None),
    ("card then cancel", ("cancel", "NEAR", "card", None, None, 2.0), None),
    ("card then cancel", ("cancel", "AND", "card", None, None, None), 0.90),
    ("only card here", ("cancel", "OR", "card", None, None, None), None),
    ("cancel here", ("cancel", "OR", "card", None, None, None), 0.90),
    ("cancel card", ("cancel", "NOT", "card", None, None, None), None),
    ("cancel card, today", ("cancel", "NOT", "card", None, None, None), 0.90),
    ("cancel card now", ("cancel", "NEAR", "card", "AND", "now", 2.0), 0.9500000000000001),
    ("cancel x", ("cancel", "XOR", "x", None, None, None), None),
]


def test_proximity_golden(spark):
    for text, (t1, o1, t2, o2, t3, within), want in PROX:
        rules = R.proximity_rules(spark, [("P", "C1", t1, o1, t2, o2, t3, None, within, None)])
        t = spark.createDataFrame([(1, text)], "transcript_id long, norm_text string")
        got = proximity.proximity_classify(t, rules).collect()
        assert (got[0]["confidence"] if got else None) == want, text


def test_near_over_long_texts_and_windows(spark):
    """20,000 tokens and a 20,000-word window; the last word is just in reach."""
    text = "cancel " + "x " * 19_998 + "card"
    for within, want in ((20_000.0, 0.90), (19_994.0, 0.90), (19_993.0, None)):
        rules = R.proximity_rules(spark, [("P", "C", "cancel", "NEAR", "card", None, None, None, within, None)])
        t = spark.createDataFrame([(1, text)], "transcript_id long, norm_text string")
        got = proximity.proximity_classify(t, rules).collect()
        assert (got[0].confidence if got else None) == want, within


def test_many_rules_share_the_positions_of_a_long_text():
    """2,000 rules on a text of 20,000 tokens: as every rule by itself, and in
    one pass over the text."""
    import random
    import time

    import model
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["card", "cards", "re", "refund", "a b"]
    rules = []
    for i in range(2000):
        t = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 1, 2]))) for _ in range(3)]
        ops = [rnd.choice(["NEAR", "AND", "OR", "NOT", None, "XOR"]) for _ in range(2)]
        rules.append(("P", "C", t[0], ops[0], rnd.choice([t[1], None]), ops[1], t[2], None, float(rnd.randint(0, 9)), None))
    rows = [(n, terms, [t.split() for t in terms], [o for o in ops], d, sorted(keys))
            for n, _, terms, ops, d, keys in model.prox_parse(rules)]
    match = proximity.ProximityMatcher(rows, True)
    small = " ".join(rnd.choice(words[:40] + words[60:]) for _ in range(150))
    assert dict(match(small)) == model.prox_matches(small, model.prox_parse(rules))
    text = " ".join(rnd.choice(words) for _ in range(20_000))
    at = time.perf_counter()
    found = dict(match(text))
    took = time.perf_counter() - at
    alone = {}
    for r in rnd.sample(rows, 60):
        alone |= {r[0]: dict(proximity.ProximityMatcher([r], True)(text)).get(r[0])}
    assert {n: found.get(n) for n in alone} == alone and len(found) > 500
    assert took < 5


def test_examples_golden_and_difflib(spark):
    ex = R.user_examples(spark, [("i want to cancel the order", "A", None, None, None),
                                 ("where is my parcel", "B", None, None, None),
                                 ("xyz", "C", None, None, None)])
    t = spark.createDataFrame([(1, "i want to cancel my order"), (2, "where is my package"), (3, "abc")],
                              "transcript_id long, transcript string")
    got = {r.transcript_id: r for r in examples.example_classify(t, ex).collect()}
    assert got[1]["similarity"] == 0.9019607843137255 and got[1]["confidence"] == 0.8568627450980392
    assert got[2]["similarity"] == 0.8648648648648649
    assert 3 not in got
    # brute force over conversation turns vs the stdlib
    from callsift.plans import registry
    rows = registry.QUERIES["example_classify"](spark, SF).collect()
    turns = {r.transcript_id: r.transcript for r in registry._turn_texts(spark, SF).collect()}
    from callsift.sources import ruleset
    exs = [(" ".join(str(p).lower().strip().split()), str(p).lower().strip()) for p, *_ in ruleset.USER_EXAMPLES]
    expect = {}
    for tid, txt in turns.items():
        tn = " ".join((txt or "").lower().strip().split())
        best, score = None, 0.0
        for i, (pn, _p) in enumerate(exs):
            s = 1.0 if pn in tn else difflib.SequenceMatcher(None, tn, pn).ratio()
            if s >= 0.85 and s > score:
                best, score = i, s
        if best is not None:
            expect[tid] = score
    assert {r.transcript_id: r.similarity for r in rows} == expect


def test_quotas():
    assert feedback.stratum_quotas(1000, 600, 300) == {"high": 30, "medium": 15, "low": 5}
    assert feedback.stratum_quotas(100, 58, 22) == {"high": 28, "medium": 11, "low": 11}
    assert feedback.stratum_quotas(51, 17, 17) == {"high": 16, "medium": 16, "low": 18}


def test_stratified_small_returns_all(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(10)], "transcript_id long, confidence double")
    assert feedback.stratified_sample(df).count() == 10


def test_upsert_and_evict(spark):
    rows = [("u1", "h", "a", "2024-01-01 00:00:00"), ("u1", "h", "b", "2024-01-02 00:00:00"),
            ("u2", "h", "c", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id string, transcript_hash string, category string, created_at string")
    df = TB.with_expiry(df.withColumn("created_at", F.col("created_at").cast("timestamp")))
    up = TB.upsert(df.limit(0), df, TB.CLASSIFICATION_KEY)
    got = {(r.user_id, r.category) for r in up.collect()}
    assert got == {("u1", "b"), ("u2", "c")}
    kept, gone = TB.evict(up, "2024-01-08 12:00:00")
    assert {r.user_id for r in gone.collect()} == {"u2"}


def test_parse_responses(spark):
    data = [('{"root_cause":"x","coaching_points":["a"],"sample_script":"s"}',),
            ('```json\n{"root_cause":"x","coaching_points":["a"],"sample_script":"s"}\n```',),
            ('Sure: {"root_cause":"x"} bye',), ("line1\nline2",), (None,)]
    r = coaching.parse_responses(spark.createDataFrame(data, "content string")).collect()
    assert [x.parse_path for x in r] == ["json", "fenced", "object", "text", "error"]
    assert r[2].sample_script == "N/A" and r[2].priority == "Medium" and r[2].coaching_points == []
    assert r[3].root_cause == "line1" and r[3].coaching_points == ["line2"]
    assert r[4].priority == "Low"


def test_rulebase(spark):
    base_h = R.hierarchy(spark, [("P", "1", "a", "b", "c", "d"), ("P", "2", "a", "b", "c", "d")])
    cust_h = R.hierarchy(spark, [("P", "2", "x", "y", "z", "w"), ("P", "3", "x", "y", "z", "w")])
    rules_b = R.proximity_rules(spark, [("P", "1", "t", None, None, None, None, None, None, None)])
    _, h = rulebase.merge_custom_rules(None, cust_h, rules_b, base_h, "extend")
    assert sorted((r.CatNo, r.L1) for r in h.collect()) == [("1", "a"), ("2", "x"), ("3", "x")]
    assert rulebase.merge_custom_rules(None, None, rules_b, base_h, "replace") == (None, None)
    try:
        rulebase.merge_custom_rules(None, None, rules_b, base_h, "merge")
        raise AssertionError
    except ValueError:
        pass
    r9 = R.proximity_rules(spark, [("P", "1", "t", None, None, None, None, None, None, None),
                                   ("P", "9", "t", None, None, None, None, None, None, None)])
    h1 = R.hierarchy(spark, [("P", "1", "a", "b", "c", "d")])
    ok, msg = rulebase.validate_custom_upload(r9, h1)
    assert not ok and "['9']" in msg
    look = {(r.Program, r.CatNo): r.L3 for r in R.hierarchy_lookup(R.hierarchy(spark)).collect()}
    assert look[("CCRE", "R05")] == "License Terms"


def test_proximity_matches_model_random(spark):
    """Random texts over a small vocabulary x random rules (phrases, empty and
    whitespace terms, substrings, odd distances, unknown operators) against
    the row-at-a-time model."""
    import random

    import model
    rnd = random.Random(7)
    vocab = ["a", "b", "ab", "ba", "c", "abc", "the", "he", "x.y", "q\\e", "(a"]
    texts = []
    for i in range(300):
        n = rnd.choice([0, 1, 2, 5, 12, 30])
        texts.append((i, " ".join(rnd.choice(vocab) for _ in range(n))))
    term_pool = vocab + ["a b", "b a", "ab c", "a  b", "a\tb", "", "  ", "he a", "b ab", "c the"]

    def term():
        return rnd.choice(term_pool) if rnd.random() < 0.9 else None

    def op():
        return rnd.choice(["NEAR", "near", "AND", "OR", "NOT", "XOR", None])

    rows = []
    for j in range(120):
        dist = rnd.choice([None, 0.0, 1.0, 2.7, -3.0, -8.0, 4.0])
        within = rnd.choice([None, None, 1.0, 3.0, -1.0])
        rows.append(("P" if j % 3 else "Q", f"C{j}", term(), op(), term(), op(), term(),
                     dist, within, None))
    rules = R.proximity_rules(spark, rows)
    t = spark.createDataFrame(texts, "transcript_id long, norm_text string")
    got = {(r.transcript_id, r.rule_ord): r.confidence
           for r in proximity.proximity_matches(t, rules).collect()}
    parsed = model.prox_parse(rows)
    want = {}
    for tid, txt in texts:
        for o, c in model.prox_matches(txt, parsed).items():
            want[(tid, o)] = c
    assert got == want
    got_p = {(r.transcript_id, r.rule_ord) for r in proximity.proximity_matches(t, rules, "Q").collect()}
    want_p = {(tid, o) for tid, txt in texts for o in model.prox_matches(txt, parsed, "Q")}
    assert got_p == want_p
    # The DuckDB oracle statement on the same fixture.
    import duckdb
    import pandas as pd
    from callsift.plans import oracle_sql as O
    con = duckdb.connect()
    con.register("rt", pd.DataFrame(texts, columns=["transcript_id", "t"]))
    sql = "WITH " + O.proximity_sql("SELECT transcript_id, t FROM rt", rule_rows=rows).strip()
    got_sql = {(int(a), int(b)): c for a, b, c in
               con.execute(sql + "\nSELECT transcript_id, rule_ord, confidence FROM pmatch").fetchall()}
    assert got_sql == want


def test_coaching_prompt_budget_by_model(spark):
    """Prompt truncation follows int(context * 0.7) tokens at 4 characters,
    with the context looked up from the model name (unknown -> 8000)."""
    assert coaching.context_for_model("deepseek/deepseek-chat-v3.1:free") == 64000
    assert coaching.context_for_model("no/such-model") == 8000 == coaching.context_for_model(None)
    long_text = "x" * 500
    flat = spark.createDataFrame(
        [("a1", 9, 0.8, 3, 4, r, f"cat{r}", 10 - r, r, "sub", 0.8, long_text) for r in range(1, 6)]
        + [("a1", 9, 0.8, 3, 4, r, f"cat{r}", 10 - r, None, None, None, None) for r in range(6, 9)]
        + [("a2", 1, 0.5, 1, 1, 1, "c", 1, 99, "s", 0.5, "short")],
        "agent_name string, total_calls long, avg_confidence double, unique_categories long, "
        "unique_subcategories long, rank int, category string, count long, sample_id long, "
        "sample_subcategory string, sample_confidence double, sample_text string")
    bundles = coaching.nest_bundle(flat)
    small = {r.agent_name: r for r in coaching.coaching_prompts(bundles, context_limit=800).collect()}
    big = {r.agent_name: r for r in coaching.coaching_prompts(
        bundles, model="deepseek/deepseek-chat-v3.1:free").collect()}
    assert small["a1"].was_truncated and not big["a1"].was_truncated
    assert not small["a2"].was_truncated
    import re
    assert len(re.findall(r"\nSample \d+:", small["a1"].prompt)) == 3
    assert len(re.findall(r"\nSample \d+:", big["a1"].prompt)) == 5
    for r in list(small.values()) + list(big.values()):
        assert r.est_tokens == len(r.prompt) // 4


def test_default_prompt_queries_keep_whole_samples(spark, monkeypatch):
    """Agents over the small context's budget get their whole prompts at the operator's default."""
    from callsift.plans import registry
    flat = spark.createDataFrame(
        [("a1", 9, 0.8, 3, 4, r, f"cat{r}" * 30, 10 - r, r, "sub", 0.8, "x" * 500) for r in range(1, 6)]
        + [(f"b{i}", 1, 0.5, 1, 1, 1, "c", 1, 99, "s", 0.5, "short") for i in range(20)],
        "agent_name string, total_calls long, avg_confidence double, unique_categories long, "
        "unique_subcategories long, rank int, category string, count long, sample_id long, "
        "sample_subcategory string, sample_confidence double, sample_text string")
    monkeypatch.setattr(registry, "_bundle", lambda spark, sf: flat)
    run = {k: {r.agent_name: r for r in registry.QUERIES[k](spark, "").collect()} for k in (
        "coaching_prompts", "coaching_prompts_default", "coaching_pending_default", "coaching_cache_first_default",
        "coaching_cache_write_default")}
    whole = {r.agent_name: r for r in coaching.coaching_prompts(coaching.nest_bundle(flat)).collect()}
    small, got = run["coaching_prompts"], run["coaching_prompts_default"]
    assert small["a1"].was_truncated and not got["a1"].was_truncated and whole["a1"].prompt.count("x" * 500) == 5
    assert {a: r.prompt_hash for a, r in got.items()} == {a: r.prompt_hash for a, r in whole.items()}
    assert small["a1"].prompt_hash != got["a1"].prompt_hash
    assert {a: r.prompt_hash for a, r in run["coaching_cache_first_default"].items()}.items() <= {
        a: r.prompt_hash for a, r in whole.items()}.items()
    pending = {a: r.prompt_hash for a, r in whole.items() if r.prompt_hash[0] >= "8"}
    assert {a: r.prompt_hash for a, r in run["coaching_pending_default"].items()} == pending
    assert {a: r.prompt_hash for a, r in run["coaching_cache_write_default"].items()}.items() <= pending.items()


def test_prompt_queries_keep_samples_of_their_former_context(spark, monkeypatch):
    """A prompt of 665 to 840 tokens keeps its five whole samples, in the query and its SQL."""
    from callsift.plans import registry
    flat = spark.createDataFrame(
        [("a1", 9, 0.8, 3, 4, r, f"cat{r}", 10 - r, r, "sub", 0.8, "x" * 450) for r in range(1, 6)],
        "agent_name string, total_calls long, avg_confidence double, unique_categories long, "
        "unique_subcategories long, rank int, category string, count long, sample_id long, "
        "sample_subcategory string, sample_confidence double, sample_text string")
    monkeypatch.setattr(registry, "_bundle", lambda spark, sf: flat)
    whole = coaching.coaching_prompts(coaching.nest_bundle(flat)).first()
    assert 665 < whole.est_tokens <= 840
    got = registry.QUERIES["coaching_prompts"](spark, "").first()
    assert not got.was_truncated and got.prompt_hash == whole.prompt_hash
    for name in ("coaching_prompts", "coaching_cache_first", "coaching_cache_write"):
        assert "length(f) // 4 > 840" in registry.ORACLE[name] and "length(f) // 4 > 665" not in registry.ORACLE[name]
    for name in ("coaching_cache_first", "coaching_cache_write"):
        assert all(r.prompt_hash == whole.prompt_hash for r in registry.QUERIES[name](spark, "").collect())


def test_example_pairs_random(spark):
    """Every (text, example) pair at several thresholds against brute force
    over all pairs (substring -> 1.0, else difflib ratio), including empty
    and duplicate phrases and lengths far apart."""
    import random
    rnd = random.Random(11)
    vocab = ["ab", "abc", "b", "cab", "ba", "zz", "a"]
    texts = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 3, 6, 15]))))
             for i in range(150)]
    phrases = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 3, 4]))) for _ in range(25)]
    phrases += [phrases[3], "  AB  Cab ", None]
    texts.append((150, "it was none of mine"))
    ex = R.user_examples(spark, [(p, "C", None, None, None) for p in phrases])
    t = spark.createDataFrame(texts, "transcript_id long, transcript string")
    norm = [" ".join(str(p).lower().strip().split()) for p in phrases]
    for thr in (0.85, 0.5, 1.0, 0.0):
        got = {(r.transcript_id, r.example_ord, round(r.similarity, 12))
               for r in examples.example_pairs(t, ex, threshold=thr).collect()}
        want = set()
        for tid, txt in texts:
            tn = " ".join(txt.lower().strip().split())
            for o, pn in enumerate(norm):
                s = 1.0 if pn in tn else difflib.SequenceMatcher(None, tn, pn).ratio()
                if s >= thr:
                    want.add((tid, o, round(s, 12)))
        assert got == want, thr
        dealt = examples.example_pairs(t, ex, threshold=thr, local_examples=0, part_examples=7, cell_chars=900)
        assert {(r.transcript_id, r.example_ord, round(r.similarity, 12)) for r in dealt.collect()} == want, thr
        best = {}
        for tid, o, s in sorted(want, key=lambda m: (-m[2], m[1])):
            best.setdefault(tid, (norm[o], s))
        for kw in ({}, {"local_examples": 0, "part_examples": 7, "cell_chars": 900}):
            own = examples.example_classify(t, ex, threshold=thr, **kw).collect()
            assert {r.transcript_id: (" ".join(r.matched_phrase.split()), round(r.similarity, 12)) for r in own} == best


def test_anchors_find_every_contained_phrase():
    """Against ``in``, over phrases about the pieces' size, with pieces that many phrases share."""
    import random
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcde \U0001f600\u00fc") for _ in range(3000)) + "ab" * 200
    texts = [text, text[40:700], text[::-1], "ab" * 60, "", "a", text[7:39], text[7:40]]
    phrases = [text[i:i + n] for i in range(0, 300, 7) for n in (0, 1, 5, 31, 32, 33, 47, 48, 90, 200)]
    phrases += ["ab" * n for n in (3, 16, 17, 40, 100)] + [p[:-1] + "#" for p in phrases if p] + ["#" + p for p in phrases]
    anchors = examples.Anchors(phrases)
    for x in texts:
        assert anchors.find(x) == {p for p in phrases if p in x}


def test_dealt_texts_are_not_copied_for_each_part(spark, monkeypatch):
    """Rows that meet in cells: each text once, and no more phrases than texts, by characters."""
    texts = spark.createDataFrame([(i, f"text number {i} " + "and so on " * 40) for i in range(60)],
                                  "transcript_id long, transcript string")
    ex = R.user_examples(spark, [(f"number {i} and so on", "C", None, None, None) for i in range(60)])
    own, prepared = examples._normal(texts, "transcript"), examples.prepare_examples(ex).select("example_ord", "phrase_norm")
    left, right, _ = examples._cells(own, prepared, 1.0, 1)

    def size(df, column):
        return df.selectExpr("count(*)", f"sum(length({column}))").first()

    assert size(left, "_norm")[0] == 60 and size(right, "phrase_norm")[1] <= size(left, "_norm")[1] + size(prepared, "phrase_norm")[1]
    kw = {"threshold": 1.0, "local_examples": 0, "part_examples": 2, "cell_chars": 5000}
    whole = {r.transcript_id: r.matched_phrase for r in examples.example_classify(texts, ex, **kw).collect()}
    assert whole == {i: f"number {i} and so on" for i in range(60)}
    # phrases beyond a cell's characters are dealt into groups, with the same result
    monkeypatch.setattr(examples, "GROUP_CHARS", 300)
    assert examples._cells(own, prepared, 1.0, 5000)[0].select("part").distinct().count() > 2
    assert {r.transcript_id: r.matched_phrase for r in examples.example_classify(texts, ex, **kw).collect()} == whole


def test_bounds_keep_every_similar_phrase():
    """Phrases of 150 to 260 characters (difflib leaves popular letters out
    from 200 on) with edits, against difflib over all pairs."""
    import random
    rnd = random.Random(6)
    vocab = "my card was charged twice for the order refund please help with account login".split()
    phrases = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([30, 40, 45]))) for _ in range(25)]
    texts = ["", "a"]
    for p in phrases * 3:
        words = p.split()
        for _ in range(rnd.randrange(0, 9)):
            at = rnd.randrange(len(words))
            words[at:at + 1] = rnd.choice([[], [rnd.choice(vocab)], [words[at], rnd.choice(vocab)], [words[at][::-1]]])
        texts.append(" ".join(words))
    for thr in (0.95, 0.85, 0.7, 0.6):
        match, found = examples.ExampleMatcher(list(enumerate(phrases)), thr), 0
        for text in texts:
            want = {}
            for o, p in enumerate(phrases):
                s = 1.0 if p in text else difflib.SequenceMatcher(None, text, p).ratio()
                if s >= thr:
                    want[o] = s
            assert dict(match(text)) == want
            found += len(want)
        assert found > len(phrases)
    # of texts in many words the bigram bound leaves few phrases to difflib
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(500)]
    phrases = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(200)]
    index = examples.BigramIndex(phrases, 0.85)
    assert sum(len(index.near(p)) for p in phrases) < 1.05 * len(phrases)


def test_many_examples_never_reach_the_driver(spark):
    """100,000 examples: parts and cells, joined by shuffles, no local relation of examples."""
    n = examples.LOCAL_EXAMPLES
    ex = spark.range(100_000).select(
        F.col("id").cast("int").alias("example_ord"), F.concat(F.lit("please close account number "), F.col("id").cast("string"))
        .alias("example_phrase"), F.lit("Account").alias("category"), F.lit("Close").alias("subcategory"),
        F.lit(None).cast("string").alias("tertiary_category"), F.lit(0.9).alias("confidence"))
    texts = spark.createDataFrame(
        [(1, "hello, please close account number 4711 now"), (2, "please close acount number 99999"), (None, "nothing"), (3, None)],
        "transcript_id long, transcript string")
    assert n < 100_000
    out = examples.example_classify(texts, ex)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "LocalRelation" not in plan and "Cartesian" not in plan
    got = {r.transcript_id: (r.matched_phrase, r.similarity) for r in out.collect()}
    # of contained phrases ("... 4", "... 47", "... 471", "... 4711") the first
    assert got[1] == ("please close account number 4", 1.0)
    assert set(got) == {1, 2} and 0.95 < got[2][1] < 1


def test_fuzzy_example_query_equals_difflib(spark, tmp_path):
    """The registered query at the default threshold, over turns near the examples."""
    import random

    from callsift.plans import registry
    from callsift.sources import ruleset
    rnd = random.Random(4)
    rows = [(1, 0, "user", None), (1, 1, "user", "zzqx never appears"), (None, None, None, "zzqx never appear")]
    for i, (ph, *_) in enumerate(ruleset.USER_EXAMPLES):
        for k in range(12):
            text = list(ph.strip())
            for _ in range(k // 2):
                text[rnd.randrange(len(text))] = rnd.choice("aeq x")
            rows.append((10 + i, k, rnd.choice(["user", "assistant", "system"]), "".join(text)))
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    want = set()
    for t in registry._turn_texts(spark, str(tmp_path)).collect():
        text, best = " ".join(t.transcript.lower().split()), None
        for ph, cat, sub, ter, conf in ruleset.USER_EXAMPLES:
            norm = " ".join(ph.lower().split())
            s = 1.0 if norm in text else difflib.SequenceMatcher(None, text, norm).ratio()
            if s >= 0.85 and (best is None or s > best[0]):
                best = (s, ph.lower().strip(), cat, sub, ter, round((0.95 if conf is None else conf) * s, 9))
        if best:
            want.add((t.transcript_id, round(best[0], 9), *best[1:]))
    got = registry.QUERIES["example_classify_fuzzy"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and any(r.similarity < 1 for r in got)
    assert {(r.transcript_id, round(r.similarity, 9), r.matched_phrase, r.category, r.subcategory, r.tertiary_category,
             round(r.confidence, 9)) for r in got} == want


def test_low_confidence_sample_worst_first_and_fallback(spark):
    rows = [(i, 0.3 + (i % 7) / 10.0) for i in range(120)]
    df = spark.createDataFrame(rows, "transcript_id long, confidence double")
    got = [(r.transcript_id, r.confidence) for r in feedback.low_confidence_sample(df, size=10).collect()]
    assert got == sorted([r for r in rows if r[1] < 0.6], key=lambda r: (r[1], r[0]))[:10]
    high = spark.createDataFrame([(i, 0.65 + (i % 3) / 10.0) for i in range(120)],
                                 "transcript_id long, confidence double")
    s = feedback.low_confidence_sample(high, size=10).collect()
    # quotas int(80/120*10)=6 high, int(40/120*10)=3 medium, remainder 1 on the empty low stratum
    assert sorted(r.stratum for r in s) == ["high"] * 6 + ["medium"] * 3
