import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
from callsift.llm import ftrl_langid, poisson_mix, prob_minhash
from callsift.llm.textops import shingles
from callsift.llm.work import id_remainder
from tests_llm_brute import brute_poisson, brute_repeats, plain_ids, words_of

SF = "/root/testdata/sf0.001"


def groups(rows):
    """Smallest id of each document's group, by comparing all pairs."""
    sets = {r.doc_id: shingles(r.text, 5) for r in rows if words_of(r.text)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if find(a) != find(b) and prob_minhash.similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def test_each_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    known = stage["language_id"](spark, docs, SF).cache()
    model = ftrl_langid.fit(docs.filter(id_remainder() != 0).select("text", "lang"))
    want = [r for r in docs.collect() if model.predict(r.text)[0] != "und"]
    assert known.columns == columns and sorted(known.collect()) == sorted(want)

    unique = stage["minhash_near_dedup"](spark, known, SF).cache()
    low = groups(want)
    want = [r for r in want if low.get(r.doc_id, r.doc_id) == r.doc_id]
    assert unique.columns == columns and sorted(unique.collect()) == sorted(want)

    cut = stage["substring_dedup"](spark, unique, SF).cache()
    removed = {i: (n, sha) for i, _, n, sha in brute_repeats(want, 35)}
    got = cut.collect()
    assert cut.columns == columns and sorted(r.doc_id for r in got) == sorted(removed)
    before = {r.doc_id: r for r in want}
    for r in got:
        n, sha = removed[r.doc_id]
        assert hashlib.sha256(" ".join(words_of(r.text)).encode()).hexdigest() == sha
        assert r.n_chars == len(r.text) if n else r == before[r.doc_id]

    mixed = stage["poisson_mix"](spark, cut, SF).cache()
    size = Counter(r.source for r in got)
    total = sum(math.sqrt(n) for n in size.values())
    copies = Counter()
    for r in got:
        u = int(hashlib.md5(f"{poisson_mix.SEED}|{r.doc_id}|1".encode()).hexdigest()[:13], 16) / 2 ** 52
        copies[r] += brute_poisson(math.sqrt(size[r.source]) / total * len(got) / size[r.source], u)
    assert mixed.columns == columns and Counter(mixed.collect()) == +copies

    packed = stage["best_fit_packing"](spark, mixed, SF).collect()
    lengths = Counter()
    for r, n in copies.items():
        ids = len(plain_ids(r.text))
        for s in range(0, ids, 4096):
            lengths[(r.doc_id, s, min(4096, ids - s))] += n
    assert Counter((p.doc_id, p.start, p.length) for p in packed) == +lengths
    fill = defaultdict(int)
    for p in packed:
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 4096 and len(fill) <= math.ceil(sum(fill.values()) / 4096) + 1


def test_stages_on_odd_rows_and_clashing_names(spark):
    """Nulls in every column, repeated rows, a very long text, and columns
    named like the operators' outputs and helpers."""
    long = " ".join(f"word{i % 977}x{i // 977}" for i in range(60_000))
    text = " ".join(f"common{i}" for i in range(50))
    rows = [(i, f"alpha beta gamma number{i} tail", "en", "a", 30) for i in range(12)]
    rows += [(20, long, "en", "a", len(long)), (21, text, "en", "b", 1), (22, text + " end", "de", "b", 1), (23, text, None, None, None),
             (None, None, None, None, None), (24, "", "en", None, 0), (25, "12 34", "de", "a", 5), (None, "no id here", "de", None, None),
             rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["lang_pred", "score", "_digest", "_row", "_kept_id", "_source", "_draws", "_cdf", "_uniform", "_part", "rate", "copy",
             "n_copies", "shuffle_key", "n_words", "n_removed", "runs", "shard", "row_key", "kept_text", "node", "component_id", "h"]
    for c in extra:
        docs = docs.selectExpr("*", f"concat('{c}', doc_id) AS `{c}`")
    key = lambda r: str([r[c] for c in docs.columns])
    stage = dict(corpus_pipeline.STAGES)

    known = stage["language_id"](spark, docs, SF)
    kept = [r for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    assert known.columns == docs.columns and sorted(map(key, known.collect())) == sorted(map(key, kept))

    unique = stage["minhash_near_dedup"](spark, docs, SF)
    got = unique.collect()
    assert unique.columns == docs.columns
    assert sum(r.text == rows[0][1] for r in got) == 1 and sum(r.text is None for r in got) == 1
    assert sorted(r.doc_id for r in got if r.text and "common1 " in r.text) == [21]
    assert set(map(key, got)) <= set(map(key, docs.collect()))

    cut = stage["substring_dedup"](spark, docs, SF)
    got = cut.collect()
    assert cut.columns == docs.columns and len(got) == len(rows)
    assert [r.text for r in got if r.doc_id in (21, 23)] == ["", ""] and [r.text for r in got if r.doc_id == 22] == ["end"]
    assert sum(r.text is None for r in got) == 1 and [r.text for r in got if r.doc_id == 20] == [long]
    same = [r for r in got if r.doc_id not in (21, 22, 23)]
    assert sorted(map(key, same)) == sorted(map(key, (r for r in docs.collect() if r.doc_id not in (21, 22, 23))))

    mixed = stage["poisson_mix"](spark, docs, SF)
    got = mixed.collect()
    assert mixed.columns == docs.columns and set(map(key, got)) <= set(map(key, docs.collect()))
    assert sum(key(r) == key(docs.first()) for r in got) % 3 == 0  # copies of repeated rows alike

    packed = stage["best_fit_packing"](spark, docs, SF).collect()
    assert sum(p.length for p in packed) == sum(len(plain_ids(r[1])) for r in rows)
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, docs.limit(0), SF).collect() == [], name


def test_documents_that_close_languages_share_stay(spark):
    # four languages of the same words: no score of a text reaches 0.5
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit"]
    rows = [(i, " ".join(words[(i // 4 + k) % 6] for k in range(4)), f"l{i % 4}", "web", 25) for i in range(400)]
    rows += [(400, "123 --", "l0", "web", 6), (401, None, "l1", "web", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = ftrl_langid.fit(docs.filter(id_remainder() != 0).select("text", "lang"))
    assert any(model.predict(r[1])[1] < 0.5 for r in rows[:400])
    got = corpus_pipeline.language_id(spark, docs, SF).collect()
    assert sorted(tuple(r) for r in got) == rows[:400]


def test_run_of_all_stages_and_of_an_empty_table(spark, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
