"""Tables kept by user, and classification through the cache."""

import glob
import os

import model
import pytest
from pyspark.sql import functions as F

from callsift.plans import cached
from callsift.plans.cached import CACHE_SCHEMA, classify_cached
from callsift.session import scratch_path
from callsift.sources import rules as R
from callsift.sources import ruleset
from callsift.sources import tables as TB
from callsift.sources.user_table import UserTable

ROWS = "user_id string, k string, v int, created_at timestamp, expires_at timestamp"


def stamp(day):
    import datetime
    return datetime.datetime(2024, 1, day)


def table_of(spark, rows):
    df = spark.createDataFrame([(u, k, v, stamp(d), stamp(d + 7)) for u, k, v, d in rows], ROWS)
    t = UserTable(spark, scratch_path(spark, "users"), df.schema)
    t.merge(df, ["user_id", "k"])
    return t


def values(df):
    return sorted((r.user_id, r.k, r.v) for r in df.collect())


def files(t):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{t.root}/rows/**/part-*.parquet", recursive=True)}


def incoming(spark, rows):
    return spark.createDataFrame([(u, k, v, stamp(d), stamp(d + 7)) for u, k, v, d in rows], ROWS)


def test_merge_touches_only_the_users_of_the_rows(spark):
    t = table_of(spark, [("a", "x", 1, 1), ("a", "x", 2, 2), ("b", "x", 3, 1), ("007", "y", 4, 1), (None, "z", 5, 1)])
    assert values(t.read()) == [("007", "y", 4), ("a", "x", 2), ("b", "x", 3)]
    before, old = files(t), t.read()
    assert t.merge(incoming(spark, [("a", "x", 9, 1), ("a", "w", 8, 3), ("c d/e", "x", 7, 3)]), ["user_id", "k"]) == 2
    assert {f: m for f, m in files(t).items() if f in before} == before
    assert not any("user_id=b" in f or "user_id=007" in f for f in files(t) if f not in before)
    assert values(t.read()) == [("007", "y", 4), ("a", "w", 8), ("a", "x", 2), ("b", "x", 3), ("c d/e", "x", 7)]
    assert values(old) == [("007", "y", 4), ("a", "x", 2), ("b", "x", 3)]  # a frame keeps its version
    assert values(t.read("a")) == [("a", "w", 8), ("a", "x", 2)] and t.read("nobody").count() == 0


def test_reads_of_a_user_prune_partitions(spark):
    t = table_of(spark, [("a", "x", 1, 1), ("b", "x", 3, 1)])
    plan = t.read("a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_id" in plan or "PartitionFilters: [isnotnull(version" in plan
    assert "(user_id" in plan.split("PartitionFilters")[1] and "= a" in plan


def test_replace_append_delete_and_evict(spark):
    t = table_of(spark, [("a", "x", 1, 1), ("a", "y", 2, 9), ("b", "x", 3, 1), ("c", "x", 4, 9)])
    t.append(incoming(spark, [("b", "x", 3, 1), (None, "x", 3, 1)]))
    assert values(t.read("b")) == [("b", "x", 3)] * 2
    before = files(t)
    t.evict("2024-01-10 00:00:00")
    new = [f for f in files(t) if f not in before]
    assert values(t.read()) == [("a", "y", 2), ("c", "x", 4)] and new and not any("user_id=c" in f for f in new)
    t.replace(incoming(spark, [("c", "z", 7, 2), ("c", "z", 7, 2)]))
    assert values(t.read("c")) == [("c", "z", 7)] * 2
    t.replace(incoming(spark, []), users=spark.createDataFrame([("c",)], "user_id string"))
    assert values(t.read()) == [("a", "y", 2)]
    t.delete(F.col("k") == "nothing")
    assert values(t.read()) == [("a", "y", 2)]
    t.vacuum()
    assert values(t.read()) == [("a", "y", 2)]
    # a's rows, and the version at which c has none
    assert {os.path.basename(f) for f in glob.glob(f"{t.root}/rows/version=*")} == {"version=3", "version=5"}
    assert len(glob.glob(f"{t.root}/pointer/*")) == 1


def test_commits_of_many_users_share_folders(spark, monkeypatch):
    from callsift.sources import user_table
    monkeypatch.setattr(user_table, "MAX_FOLDERS", 20)
    many = [(f"u{i}", k, i, 1 + 8 * (i % 2)) for i in range(3 * user_table.BUCKETS) for k in ("x", "y")]
    t = table_of(spark, many)
    want = {(u, k): v for u, k, v, _ in many}
    assert values(t.read()) == sorted((*k, v) for k, v in want.items())
    assert len(glob.glob(f"{t.root}/*/version=1/*=*")) <= user_table.BUCKETS < len({u for u, *_ in many})
    assert values(t.read("u5")) == [("u5", "x", 5), ("u5", "y", 5)] and t.read("nobody").count() == 0
    plan = t.read("u5")._jdf.queryExecution().executedPlan().toString()
    assert "(_bucket" in plan.split("PartitionFilters")[1]
    # a commit of few users beside it, in folders of their own, after one that failed in the other layout
    incoming(spark, [("u5", "x", 99, 5)]).withColumn("_bucket", user_table._bucket(F.col("user_id"))).write.partitionBy(
        "_bucket").parquet(f"{t.root}/packed/version=2")
    t.merge(incoming(spark, [("u5", "x", 7, 20), ("new", "x", 8, 20)]), ["user_id", "k"])
    want |= {("u5", "x"): 7, ("new", "x"): 8}
    assert values(t.read()) == sorted((*k, v) for k, v in want.items())
    assert values(t.read("u5")) == [("u5", "x", 7), ("u5", "y", 5)] and values(t.read("u6")) == [("u6", "x", 6), ("u6", "y", 6)]
    t.evict("2024-01-10 00:00:00")  # half of the users: packed again
    day = {f"u{i}": 1 + 8 * (i % 2) for i in range(3 * user_table.BUCKETS)} | {"new": 20}
    want = {k: v for k, v in want.items() if day[k[0]] + 7 >= 10 or k == ("u5", "x")}
    assert values(t.read()) == sorted((*k, v) for k, v in want.items()) and t.read("u6").count() == 0
    t.vacuum()
    assert values(t.read()) == sorted((*k, v) for k, v in want.items())


def test_an_unfinished_commit_is_not_seen_and_is_overwritten(spark):
    t = table_of(spark, [("a", "x", 1, 1)])
    os.makedirs(f"{t.root}/pointer/2")  # a writer died before its pointer was complete
    incoming(spark, [("a", "x", 99, 5)]).write.partitionBy("user_id").parquet(f"{t.root}/rows/version=2")
    assert t.version() == 1 and values(t.read()) == [("a", "x", 1)]
    t.merge(incoming(spark, [("a", "y", 2, 2)]), ["user_id", "k"])
    assert t.version() == 2 and values(t.read()) == [("a", "x", 1), ("a", "y", 2)]


def test_an_empty_table(spark):
    t = UserTable(spark, scratch_path(spark, "users"), CACHE_SCHEMA)
    assert t.read().count() == 0 and t.read("a").count() == 0 and t.version() == 0


def cache_with(spark, entries):
    t = UserTable(spark, scratch_path(spark, "cache"), CACHE_SCHEMA)
    rows = [(u, h, "Cached", "Hit", 0.5, "k", "cached", stamp(d)) for u, h, d in entries]
    names = [c for c in CACHE_SCHEMA.names if c != "expires_at"]
    df = spark.createDataFrame(rows, "user_id string, transcript_hash string, category string, subcategory string, "
                                     "confidence double, matched_keywords string, resolve_reason string, created_at timestamp")
    t.merge(TB.with_expiry(df.select(names)), TB.CLASSIFICATION_KEY)
    return t


@pytest.fixture
def counted(monkeypatch):
    """The texts that are classified."""
    seen = []
    real = cached.classify

    def spy(transcripts, *a, **kw):
        seen.append([r.transcript for r in transcripts.collect()])
        return real(transcripts, *a, **kw)

    monkeypatch.setattr(cached, "classify", spy)
    return seen


def test_only_misses_are_classified_each_text_once(spark, counted):
    import hashlib
    h = lambda t: hashlib.md5(t.encode()).hexdigest()
    texts = [(1, "refund my bill"), (2, "refund my bill"), (None, "refund my bill"), (3, "close my account"), (4, None), (5, ""),
             (6, "live one"), (6, "live one"), (7, "expired one"), (8, "someone else's")]
    table = cache_with(spark, [("u", h("live one"), 20), ("u", h("expired one"), 2), ("v", h("someone else's"), 20)])
    docs = spark.createDataFrame(texts, "transcript_id long, transcript string")
    now = "2024-01-24 00:00:00"
    got = classify_cached(docs, table, R.keyword_rules(spark), R.hierarchy(spark), "u", now).collect()
    assert sorted(counted[0]) == sorted(["refund my bill", "close my account", "", "expired one", "someone else's"])
    rules = model.parse_rules(ruleset.KEYWORD_RULES)
    assert len(got) == len(texts)
    for r in got:
        text = next(t or "" for i, t in texts if h(t or "") == r.transcript_hash)
        if text == "live one":
            assert (r.category, r.from_cache) == ("Cached", True)
        else:
            want = model.hybrid(model.redact(model.clean(text)), rules, ruleset.HIERARCHY)
            assert (r.category, r.subcategory, r.confidence, r.matched_keywords, r.from_cache) == (*want[:2], want[5], want[6], False)
    mine = {r.transcript_hash: r for r in table.read("u").collect()}
    assert set(mine) == {h(t) for t in ("refund my bill", "close my account", "", "expired one", "someone else's", "live one")}
    assert mine[h("expired one")].expires_at == stamp(31) and mine[h("live one")].category == "Cached"
    assert [r.category for r in table.read("v").collect()] == ["Cached"]
    again = classify_cached(docs, table, R.keyword_rules(spark), R.hierarchy(spark), "u", now).collect()
    assert counted[1] == [] and all(r.from_cache for r in again)
    strip = lambda rows: sorted(map(str, (tuple(r)[:-1] for r in rows)))
    assert strip(again) == strip(got)


def test_expired_entries_count_when_the_ttl_is_off(spark, counted):
    import hashlib
    table = cache_with(spark, [("u", hashlib.md5(b"old").hexdigest(), 2)])
    docs = spark.createDataFrame([(1, "old")], "transcript_id long, transcript string")
    got = classify_cached(docs, table, R.keyword_rules(spark), R.hierarchy(spark), "u", "2024-01-24 00:00:00", enforce_ttl=False)
    assert [(r.category, r.from_cache) for r in got.collect()] == [("Cached", True)] and counted == [[]]
