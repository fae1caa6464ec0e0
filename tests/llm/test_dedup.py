import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from callsift.llm import phrase_dedup, prob_minhash
from callsift.llm.textops import gram_hashes, shingles, window_argmin, word_hashes, word_spans
from tests_llm_brute import brute_repeats, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text):
    return (i, text, "en", "s", 0)


def passage(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def repeat_corpus(seed):
    rng = random.Random(seed)
    shared = [passage(rng, n) for n in (34, 35, 36, 60, 140)]
    texts = [None, "", " \t\n", "one", passage(rng, 34), "be " * 200, "a b " * 90, "x\x0bé\x1cy z " * 40]
    for i in range(60):
        parts = [passage(rng, rng.randrange(1, 70)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(4), rng.choice(shared))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    base = passage(rng, 160).split()
    for i in range(40):  # near copies, each with edits of its own
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(160)] = f"e{rng.randrange(9)}"
        texts.append(" ".join(copy))
    # overlapping halves of one passage, and one document that repeats itself
    long = passage(rng, 120).split()
    texts += [" ".join(long[:80]), " ".join(long[40:]), " ".join(long[20:60]), " ".join(long[:50] + ["z"] + long[:50])]
    rows = [row(i, t) for i, t in enumerate(texts)]
    return rows + [row(3, "one"), row(None, texts[8]), rows[9], rows[9], row(9, texts[10])]


@pytest.mark.parametrize("seed,shard_words", [(1, 1_000_000), (2, 700)])
def test_removed_words_equal_brute_force(frame, seed, shard_words):
    rows = repeat_corpus(seed)
    df = frame(rows, DOCS).withColumnRenamed("source", "n_words")  # a clashing name
    got = phrase_dedup.remove_repeats(df, shard_words=shard_words).collect()
    want = brute_repeats(rows, 35)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(want)
    assert got[0].n_words_input == "s"
    for r in got:
        assert hashlib.sha256(" ".join(words_of(r.kept_text)).encode()).hexdigest() == r.kept_sha256
    by_id = {r[0]: r[1] for r in rows[:-5]}
    assert all(r.kept_text == by_id[r.doc_id] for r in got if not r.n_removed and r.doc_id in (0, 1, 2, 3, 4))


def test_shards_hold_a_bounded_number_of_words(frame, monkeypatch):
    """Long documents that share one short passage: what a task loads is
    bounded by the words of their texts."""
    rng = random.Random(3)
    shared = passage(rng, 40)
    texts = [passage(rng, 1000, 10 ** 6) + " " + shared + " " + passage(rng, 1000, 10 ** 6) for _ in range(40)]
    rows = [row(i, t) for i, t in enumerate(texts)]
    sizes, real = [], phrase_dedup._sharded

    def spy(marked, shard_words, work):
        out = work.table(real(marked, shard_words, work), "seen")
        sizes.extend(r.n for r in out.groupBy("shard").agg({"words": "sum"}).withColumnRenamed("sum(words)", "n").collect())
        return out

    monkeypatch.setattr(phrase_dedup, "_sharded", spy)
    got = phrase_dedup.remove_repeats(frame(rows, DOCS), shard_words=10_000).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(brute_repeats(rows, 35))
    # rows are dealt by hash: a shard may hold some more than its share
    assert sum(sizes) == 40 * 2040 and max(sizes) <= 25_000


def test_more_rows_than_are_looked_at_together(frame):
    rng = random.Random(12)
    shared = [passage(rng, n) for n in (40, 90)]
    rows = [row(i, None if i % 50 == 7 else " ".join([passage(rng, 20), shared[i % 2] if i % 9 == 0 else "end", passage(rng, 20)]))
            for i in range(1300)]
    got = phrase_dedup.remove_repeats(frame(rows, DOCS).coalesce(1)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(brute_repeats(rows, 35))
    before = {r[0]: r[1] for r in rows}
    assert all(r.kept_text == before[r.doc_id] for r in got if not r.n_removed)


def test_repeats_of_an_empty_table(frame):
    assert phrase_dedup.remove_repeats(frame([], DOCS)).collect() == []


def test_hashes_follow_words():
    data = "ab c\tab  c ab\nabc".encode()
    h = word_hashes(data, *word_spans(data))
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3
    g = gram_hashes(h, 2)
    assert g[0] == g[2] and g[1] == g[3] and len(set(g.tolist())) == 3
    a = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    for w in range(1, 8):
        assert window_argmin(a, w).tolist() == [i + int(np.argmin(a[i:i + w])) for i in range(len(a) - w + 1)]


def near_corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", "  \n", "one", "one", "two words", "two  words", "three two words"]
    for n in (30, 120, 300):
        base = passage(rng, n).split()
        for k in range(25):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8]) * n // 120):
                copy[rng.randrange(n)] = f"e{rng.randrange(500)}"
            texts.append(" ".join(copy))
    texts += [passage(rng, 100) for _ in range(20)] + ["be " * 60, "be " * 64, "be " * 200]
    return [row(i, t) for i, t in enumerate(texts)] + [row(None, texts[20]), row(8, texts[8]), row(9, None)]


def brute_similarity(a, b):
    (ha, wa), (hb, wb) = ((dict(zip(*map(np.ndarray.tolist, shingles(t, 5)))), None) for t in (a, b))
    return sum(1 / sum(max(ha.get(j, 0) / ha[i], hb.get(j, 0) / hb[i]) for j in ha.keys() | hb.keys())
               for i in ha.keys() & hb.keys())


def brute_groups(rows):
    distinct = sorted({r[1] for r in rows if words_of(r[1])})
    group = {t: t for t in distinct}

    def find(t):
        while group[t] != t:
            t = group[t]
        return t

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if find(a) != find(b) and brute_similarity(a, b) >= 0.8:
                group[find(a)] = find(b)
    low = {}
    for r in rows:
        if words_of(r[1]) and r[0] is not None:
            low[find(r[1])] = min(low.get(find(r[1]), r[0]), r[0])
    n = Counter(r[1] for r in rows)
    return Counter((r[0], low[find(r[1])], n[r[1]], r[0] == low[find(r[1])]) if words_of(r[1]) else (r[0], r[0], 1, True)
                   for r in rows)


@pytest.mark.parametrize("seed", [4])
def test_groups_equal_brute_force(frame, seed):
    rows = near_corpus(seed)
    got = prob_minhash.near_duplicates(frame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.component_id, r.n_copies, r.kept) for r in got) == brute_groups(rows)


def test_one_of_each_group_stays(frame):
    rows = near_corpus(6)
    got = prob_minhash.drop_near_duplicates(frame(rows, DOCS)).collect()
    want = {(i, low) for i, low, _, kept in brute_groups(rows) if kept}
    assert sorted(str(r.doc_id) for r in got if words_of(r.text)) == sorted(
        {str(i) for i, _ in want if words_of(dict((r[0], r[1]) for r in rows[:-1]).get(i))})
    assert sum(not words_of(r.text) for r in got) == sum(not words_of(r[1]) for r in rows)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_signature_agreement_estimates_the_similarity():
    rng = random.Random(9)
    base = passage(rng, 400).split() + ["r"] * 40
    other = list(base)
    for _ in range(12):
        other[rng.randrange(400)] = "q"
    x, y = (shingles(" ".join(t), 5) for t in (base, other))
    who = prob_minhash.signatures([x, y], 4096)
    s = prob_minhash.similarity(x, y)
    assert abs(s - brute_similarity(" ".join(base), " ".join(other))) < 1e-12
    assert abs((who[0] == who[1]).mean() - s) < 4 * (s * (1 - s) / 4096) ** 0.5


def test_no_documents(frame):
    assert prob_minhash.near_duplicates(frame([], DOCS)).collect() == []
