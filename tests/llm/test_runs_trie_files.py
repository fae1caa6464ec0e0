"""Periodic runs, prefix trie and token-id files against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_brute import words_of

from callsift.llm import periodic_runs, prefix_trie, rank_codec
from callsift.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def brute_runs(w, least=24, repeats=3):
    n, out = len(w), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, repeats * q) and not any(
                    all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.add((i, size, q))
            i = j
    return sorted(out)


def brute_cycle(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def run_row(doc_id, words):
    runs = brute_runs(words)
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(kept.encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(3, 24))
def test_runs_equal_brute_force(seed, least):
    r = random.Random(seed)
    w = [r.randint(0, r.choice([1, 2, 5, 20])) for _ in range(r.randint(0, 70))]
    for _ in range(r.randint(0, 2)):
        if len(w) > 10:
            a = r.randrange(len(w) - 3)
            p = r.randint(1, max(1, (len(w) - a) // 3))
            for i in range(a + p, min(len(w), a + p * r.randint(2, 9))):
                w[i] = w[i - p]
    assert periodic_runs.find_runs(w, least, 3) == brute_runs(w, least, 3)


def test_segments_split_on_rare_words_until_stable():
    # c is frequent in the text, rare in each half once x has split it; so are its neighbours then
    w = np.array([0, 1] * 15 + [2] + [0, 3, 1, 3] * 2 + [9] + [0, 1] * 15)
    assert periodic_runs.segments(w) == [(0, 30), (40, 70)]
    assert periodic_runs.segments(np.zeros(0, np.int64)) == []


def test_long_texts_and_bad_parameters():
    w = [i % 70_000 for i in range(210_001)]
    assert periodic_runs.find_runs(w) == [(0, 210_001, 70_000)]
    assert periodic_runs.find_runs(list(range(100_000))) == []
    with pytest.raises(ValueError):
        periodic_runs.lag_scan(np.zeros(30, np.int64), repeats=2)


def test_runs_of_odd_rows(frame):
    rows = [(1, None, 5), (2, "", None), (3, "a b " * 20, 1), (3, "a b " * 20, 1), (None, "x\x0b\ty " * 30, 2), (4, "ä " * 24 + "é", 3)]
    docs = frame(rows, "doc_id long, text string, runs int")
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "runs_input", "n_words", "runs", "collapsed_text"]
    out = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed_text, r.runs_input) for r in got.collect()}
    assert got.count() == 6
    assert out[(1, 0)] == ([], "", 5) and out[(2, 0)] == ([], "", None)
    assert out[(3, 40)] == ([(0, 40, 2)], "a b", 1)
    assert out[(None, 60)] == ([(0, 60, 2)], "x y", 2)
    assert out[(4, 25)] == ([(0, 24, 1)], "ä é", 3)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_op11_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(run_row(d, brute_cycle(d, words_of(t))) for d, t in docs if len(words_of(t)) < 1500)
    keep = {w[0] for w in want}
    got = sorted((tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect() if r.doc_id in keep), key=lambda r: r[0])
    assert got == want and len(want) > 150 and any(w[1] for w in want)


def brute_trie(rows, family=20):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)} {role}{text}".encode()).digest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0), key, role, text))
    turns = {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in turns.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(turns.get(c - c % family, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, s in full.items():
        ends.setdefault(s, []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)

    def total(s):
        below = [total(k) for k in kids.get(s, [])]
        own = (len(members[s]) - 1) * (len(words_of(s[-1][1])) if s else 0)
        return max(1, sum(b[0] for b in below)) if below else 1, own + sum(b[1] for b in below)

    out = []
    for s, m in members.items():
        leaves, saved = total(s)
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), leaves, saved,
                    hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0], r[2] or 0))


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0], r[2] or 0))


def built(df, **kw):
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df), **kw))


def test_trie_of_random_conversations(spark, frame, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 10)
    r = random.Random(5)
    rows = []
    for c in range(0, 120):
        for t in range(r.choice([0, 1, 2, 3, 5, 9, 17])):
            rows.append((c if r.random() > 0.02 else None, r.choice([t, t, t, None]), r.choice(["u", "a", None]),
                         r.choice(["x", "x y", "", None, " z\tz  z"])))
    rows += [(c, t, "u", "same words here") for c in range(200, 260) for t in range(4)]
    rows += rows[:15]
    schema = "conv_id long, turn int, role string, text string"
    df = frame(rows, schema).selectExpr("*", "1 AS name", "2 AS seq", "3 AS depth")
    assert trie_rows(built(df)) == brute_trie(rows)
    assert built(frame([], schema)).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 33])
def test_trie_depths(frame, length):
    """A chain and its branches: totals cross every cut."""
    rows = [(100 + 20 * b, t, "u", f"t{t}" if t < length - b else f"t{t} b{b}") for b in range(length) for t in range(length)]
    assert trie_rows(built(frame(rows, "conv_id long, turn int, role string, text string"))) == brute_trie(rows)


def test_turnless_conversations_are_members_of_the_root(frame):
    # of conversations 1 to 60 some lose all turns to an absent first conversation
    rows = [(c, 0, "u", "only") for c in range(1, 60)]
    got = trie_rows(built(frame(rows, "conv_id long, turn int, role string, text string")))
    assert got == brute_trie(rows) and got[0][3] == 59
    assert got[0][-1] != hashlib.sha256(b"").hexdigest()


def test_op12_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(QUERIES["op12_prefix_trie"](spark, SF)) == brute_trie(rows)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n b", "a \nb", "a\n\nb", "\ta\x0bb\x0c\r\n", "it's we'll 's", "x<|endoftext|>y",
       "<|endoftext|", "\x1f", "a\x1fb \x1f c", "a\x1c\x1d b", " a  b c　", "日本語 テスト。\n日本", "é é É İ ſ", "🙂 🙂🙂", "1234 56",
       "\x85a\x85 b", "  x ​ y ᠎ z ﻿", "a" * 3000 + " b" * 2000, "\x00 \x00"]


def test_tokenizer_equals_the_library(tokenizer):
    own = rank_codec.ByteTokenizer(tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(3)
    alphabet = list(" \n\t'.,a1éÉß漢🙂  \x1c\x1f") + ["  ", "\n\n", " the", "ing", "'s", "<|"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40))
def test_codes_round_trip(values):
    codes = np.array(values, np.uint32)
    control, data = rank_codec.pack_codes(codes)
    assert len(control) == -(-len(values) // 4)
    assert rank_codec.unpack_codes(control, data, len(values)).tolist() == values


def test_damaged_blocks_are_refused():
    good = rank_codec.block(0, 0, [1, None], [2, 1], np.array([5, 70_000, 3], np.uint32)) + b"\n"
    (shard, number, ids, counts, codes), = rank_codec.blocks_of(good)
    assert (shard, number, ids.to_pylist(), counts.tolist(), codes.tolist()) == (0, 0, [1, None], [2, 1], [5, 70_000, 3])
    for bad in (good[:-3], b"x" + good[1:], good[:40] + bytes([good[40] ^ 1]) + good[41:]):
        with pytest.raises(ValueError):
            list(rank_codec.blocks_of(bad))


def test_files_of_odd_rows(spark, frame, tokenizer, tmp_path):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, "null id", 7), (-5, None, 7), (3, "repeated", 7), (3, "repeated", 7)]
    docs = frame(rows, "doc_id long, text string, shard int").repartition(5)
    path = str(tmp_path / "files")
    rank_codec.write_ids(docs, path, tokenizer_path("byte_bpe_50k.json"), block_codes=50, shard_codes=2000, least_codes=100)
    got = rank_codec.read_ids(spark, path).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(r.ids))
        at += len(ids)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted(
        (str(d), plain(tokenizer, t)) for d, t, _ in rows)


def test_ranks_follow_the_counts(spark, frame, tokenizer):
    docs = frame([(i, t) for i, t in enumerate(["b a a", "a a c", None])], "doc_id long, text string")
    tokens = rank_codec.token_ids(docs, tokenizer_path("byte_bpe_50k.json"))
    count = {}
    for t in ["b a a", "a a c", None]:
        for i in plain(tokenizer, t):
            count[i] = count.get(i, 0) + 1
    assert rank_codec.frequency_ranks(tokens, "<u2").tolist() == sorted(count, key=lambda i: (-count[i], i))


def test_files_of_an_empty_table(spark, frame, tmp_path):
    path = str(tmp_path / "files")
    rank_codec.write_ids(frame([], "doc_id long, text string"), path, tokenizer_path("byte_bpe_50k.json"))
    assert rank_codec.read_ids(spark, path).collect() == []


def test_op13_equals_the_library(spark, tokenizer):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for d, t in docs:
        ids = plain(tokenizer, t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op13_token_files"](spark, SF).collect()) == want
