import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from callsift.llm import poisson_mix, swap_pack
from callsift.llm.queries import tokenizer_path
from tests_llm_brute import brute_poisson, plain_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["Hello, world's BEST... (really)", "", None, "don't I'll x'ss 'tis", "é ü ß İstanbul ΣΑΣ, á b\x1cc",
         "<|endoftext|> inside <|x", "\t\n ", "123abc,, --..!! a.b,c's", "word " * 9000, "x" * 5000, "日本語、テスト。"]


def test_pieces_equal_the_tokenizer_and_sequences_are_gapless(frame):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(1, "", "x", "y", 0), (None, "null id", None, None, 1),
        (2 ** 53 + 1, "large id", None, None, 1)]
    got = swap_pack.pack(frame(rows, DOCS), tokenizer_path()).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        ids = plain_ids(t)
        parts = [ids[s:s + 4096] for s in range(0, len(ids), 4096)]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        if i == 1:  # the repeated row is a document of its own
            assert len(own) == 2 and {r.piece for r in own} == {0}
            own = own[:1]
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [
            (4096 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
    assert len(by_doc[None]) == len(by_doc[2 ** 53 + 1]) == 1
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) == math.ceil(sum(r.length for r in got) / 4096)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("texts", [TEXTS, ["", None], [" \t", "a"], ["<|", None, "École ÉCOLE J\u030c\u0300 ǰ ẞß\u0301 ŉ' Ǆ!"]])
def test_batches_of_texts_equal_the_tokenizer(texts, kind):
    batch = pa.record_batch({"text": pa.array(texts, kind)})
    for size in (1, 60, 1 << 20):
        got = [ids for b in swap_pack.text_slices([batch, batch.slice(0, 0)], size)
               for ids in swap_pack.WordTokenizer(tokenizer_path()).encode(b.column("text"))]
        assert [[*np.frombuffer(ids, "<u4"), 1] for ids in got] == [plain_ids(t) for t in texts]


def test_a_batch_looks_each_word_up_once_and_tasks_share_what_is_known():
    tok = swap_pack.WordTokenizer(tokenizer_path())
    asked = []

    class Asked(type(tok.known)):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    tok.known = Asked(tok._word, 100)
    tok.encode(pa.array(["one two two", None, "two one " * 500]))
    assert sorted(w for w in asked if w) == ["one", "two"]
    assert swap_pack.tokenizer(tokenizer_path()) is swap_pack.tokenizer(tokenizer_path())


def test_lower_case_is_the_tokenizers_normal_form_of_latin_letters():
    tok = swap_pack.WordTokenizer(tokenizer_path())
    letters = [chr(c) for c in range(0x80, 0x300) if chr(c).isalpha()]
    words = letters + [a + b for a in "aZİßΣ" for b in letters] + ["ΣΑΣ", "J\u030c"]
    assert [tok._normal(w) for w in words] == [tok.pieces.tok.normalizer.normalize_str(w) for w in words]


def test_no_pieces_of_an_empty_table(frame):
    assert swap_pack.pack(frame([], DOCS), tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_valid_and_not_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, [100, 60, 40, 100, 12, 99][seed], 300)
    bins, offset = swap_pack.pack_lengths(size, 100)
    fills = np.bincount(bins, size)
    assert fills.max() <= 100
    first = swap_pack.Bins(size, 100)
    first.best_fit()
    used = (fills > 0).sum()
    assert math.ceil(size.sum() / 100) <= used <= len(first.fill)
    for b in np.unique(bins):
        own = np.argsort(offset[bins == b])
        at = np.cumsum(size[bins == b][own])
        assert (offset[bins == b][own] == np.r_[0, at[:-1]]).all()


def test_search_empties_a_bin_that_best_fit_leaves():
    # best fit decreasing opens a fourth bin; exchanges close it again
    size = np.array([25, 26, 45, 26, 33, 56, 30, 35])
    first = swap_pack.Bins(size, 100)
    first.best_fit()
    before = len(first.fill)
    squares = (first.fill.astype(int) ** 2).sum()
    first.improve()
    assert before == 4 and (first.fill > 0).sum() == 3
    assert (first.fill ** 2).sum() > squares and first.fill.max() <= 100


@pytest.mark.parametrize("seed,low,high,n", [(1, 26, 51, 300), (2, 10, 70, 600), (13, 25, 48, 300), (20, 20, 60, 150)])
def test_search_ends_only_when_no_bin_improves(seed, low, high, n):
    size = np.random.default_rng(seed).integers(low, high, n)
    b = swap_pack.Bins(size, 100)
    b.best_fit()
    first = (b.fill > 0).sum()
    b.improve()
    used = (b.fill > 0).sum()
    assert used <= first and b.fill.max() <= 100 and (np.bincount(b.bin, size, len(b.fill)) == b.fill).all()
    if b.surplus():
        assert not any(b._step(d) for d in np.flatnonzero(b.fill))
    if seed == 1:  # a donor that failed once empties after later exchanges
        assert used == 123


def test_replication_counts_and_order(frame):
    import hashlib

    rows = [(i, f"t{i}", "en", "a" if i % 3 else "b", 1) for i in range(60)] + [
        (None, None, None, None, None), (7, "t7", "en", "a", 1)]
    df = frame(rows, DOCS).withColumnRenamed("n_chars", "copy")
    got = poisson_mix.replicate(df, temperature=0.5).collect()
    n = Counter(r[3] for r in rows)
    w = {s: math.sqrt(x) for s, x in n.items()}
    want = Counter()
    for i, t, _, s, _ in rows:
        rate = w[s] / sum(w.values()) * len(rows) / n[s]
        u = int(hashlib.md5(f"mix-7|{'' if i is None else i}|1".encode()).hexdigest()[:13], 16) / 2 ** 52
        want[(i, s)] += brute_poisson(rate, u)
    assert Counter((r.doc_id, r.source) for r in got) == +want
    assert "copy_input" in got[0].asDict()
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)


def test_given_weights_and_large_rates(frame, spark):
    docs = frame([(i, "x", "en", "a" if i < 5 else "b", 1) for i in range(400)], DOCS)
    w = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "source string, weight double")
    got = poisson_mix.replicate(docs, w, epoch_docs=2000).groupBy("source").count().collect()
    assert [r.source for r in got] == ["a"] and abs(got[0]["count"] - 2000) < 6 * math.sqrt(2000)
    assert poisson_mix.replicate(frame([], DOCS)).collect() == []
