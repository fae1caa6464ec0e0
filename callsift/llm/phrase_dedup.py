"""Repeated-passage removal with sharded Aho-Corasick automata.

A window is ``size`` consecutive words of one document. Every word covered by
a window whose word sequence also starts anywhere else is removed; windows are
judged on the input.

1. Anchors. Each window is named by its smallest ``gram``-word hash (the first
   of equals). Windows that share an anchor's place are a run; equal windows
   have equal anchors, so only runs whose anchor recurs are candidates.
2. Confirmation. Runs with equal words (hash) confirm each other whole. What
   stays open, mostly the ends of passages, is settled window by window:
   window hashes of one example of each run in the same anchor's family are
   counted and those seen once are dropped.
3. Phrases. Consecutive confirmed windows of a document are a recurring
   passage. Passages are cut at content-defined anchors (neighbours overlap by
   size - 1 words, so no window is lost), which gives copies the same phrases,
   and made distinct.
4. Automata. Candidate documents are dealt into shards of a bounded number of
   words. A phrase goes to every shard whose documents hold the anchor of its
   first window, and so to every document where it can occur. Each shard
   compiles its phrases into one automaton over word numbers (no hashes: a
   located phrase is equal word by word), streams its documents through it and
   marks every occurrence.

All phrases of a document are in its own shard, and only recurring windows are
in phrases, so the marked words are exactly those to remove.

Defined results: a null text has no words; repeated rows (same id and text)
repeat each other's windows; documents shorter than a window lose nothing; an
empty table gives no rows; other columns are carried, and input columns named
like an output become ``<name>_input``. A text that loses nothing is kept as it
is; else its kept words are joined by one space.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.textops import gram_hashes, mix, window_argmin, word_hashes, word_spans
from callsift.llm.work import Work, lean, set_aside, slices

SIZE = 35
GRAM = 8
SHARD_WORDS = 1_000_000
# One anchor in CUT starts a new phrase.
CUT = 8
OUTPUTS = {"n_words", "n_removed", "kept_sha256", "row_key", "runs", "shard", "kept_text"}


def _anchors(text: str | None, size: int, gram: int):
    """Window hashes of a text; start, length and anchor of its runs."""
    data = (text or "").encode()
    words = word_hashes(data, *word_spans(data))
    if len(words) < size:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)
    grams = gram_hashes(words, gram)
    at = window_argmin(grams, size - gram + 1)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return gram_hashes(words, size), start, np.diff(np.r_[start, len(at)]), grams[at[start]]


def _runs(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(row_key, s, n, anchor, body, words): runs of n windows from word s;
    ``body`` hashes the run's words, ``words`` counts those of the text."""
    def run(batches):
        for b in slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for key, text in zip(b.column("row_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                windows, s, n, anchor = _anchors(text, size, gram)
                if not len(s):
                    continue
                # a run has at most size - gram + 1 windows: its words are those of its first and last
                body = mix(windows[s] + mix(windows[s + n - 1] + n.astype(np.uint64)))
                total = np.full(len(s), len(windows) + size - 1)
                for col, x in zip(out, (np.full(len(s), key), s, n, anchor.view(np.int64), body.view(np.int64), total), strict=True):
                    col.append(x)
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                ["row_key", "s", "n", "anchor", "body", "words"])

    return docs.select("row_key", "text").mapInArrow(
        lean(run), "row_key long, s int, n int, anchor long, body long, words int")


def _candidates(runs: DataFrame, work: Work) -> DataFrame:
    """(row_key, words, runs): the runs of a row whose anchor recurs, each with
    ``sure`` (its words occur twice) and ``open`` (to be compared by window)."""
    # a written table: both sides of the join are then plain exchanges, and a
    # hot anchor's runs can be split
    again = work.table(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"), "again")
    found = work.table(runs.join(again, "anchor", "left_semi"), "recurring")
    kinds = found.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row_key", "s")).alias("one"))
    many = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    kinds = work.table(kinds.join(many, "anchor", "left").select(
        "anchor", "body", "c", "one", F.coalesce("kinds", F.lit(1)).alias("kinds")), "kinds")
    sure = F.col("c") > 1
    example = (F.col("one.row_key") == F.col("row_key")) & (F.col("one.s") == F.col("s"))
    return (found.join(kinds, ["anchor", "body"])
            .groupBy("row_key").agg(F.max("words").alias("words"), F.array_sort(F.collect_set(F.struct(
                "s", "n", "anchor", sure.alias("sure"), (~sure | (example & (F.col("kinds") > 1))).alias("open")))).alias("runs")))


def _sharded(marked: DataFrame, shard_words: int, work: Work) -> DataFrame:
    """``marked`` with the shard of each row. Rows go by their smallest anchor,
    so copies meet and need their phrases once; a bucket whose texts have more
    words than a shard should hold (a hot group of copies) is split by row. The
    words are those of whole texts: that is what a shard's task loads."""
    marked = work.table(marked, "unsharded")
    size = F.sum(F.col("words").cast("long"))
    total = marked.agg(size).first()[0] or 0
    bucket = F.pmod(F.xxhash64(F.array_min("runs.anchor")), F.lit(max(1, -(-total // shard_words)))).alias("bucket")
    parts = work.table(marked.groupBy(bucket).agg(F.ceil(size / F.lit(shard_words)).alias("parts")), "parts")
    return marked.withColumn("bucket", bucket).join(parts, "bucket").select(
        "row_key", "words", "runs", F.xxhash64("bucket", F.pmod(F.xxhash64(F.col("row_key"), F.lit(1)), "parts")).alias("shard"))


def _digest(words: list[bytes]) -> tuple[str, bytes]:
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest(), kept


def _run_arrays(column: pa.ListArray):
    """For each row, its runs as arrays by field name."""
    flat = column.flatten()
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    ends = np.cumsum(pc.list_value_length(column).to_numpy())
    for start, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
        yield {k: v[start:end] for k, v in fields.items()}


def _open_windows(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """(anchor, hash, weight, row_key, at): the windows of open runs; those of
    sure runs count twice and need no answer (at is null)."""
    def run(batches):
        for b in slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for key, text, runs in zip(b.column("row_key").to_pylist(), b.column("text"), _run_arrays(b.column("runs")), strict=True):
                own = runs["open"].astype(bool)
                if not own.any():
                    continue
                windows = _anchors(text.as_py(), size, gram)[0].view(np.int64)
                s, n = runs["s"][own].astype(np.int64), runs["n"][own].astype(np.int64)
                at = np.arange(int(n.sum())) + np.repeat(s - np.cumsum(n) + n, n)
                sure = np.repeat(runs["sure"][own].astype(bool), n)
                for col, x in zip(out, (np.repeat(runs["anchor"][own], n), windows[at], np.where(sure, 2, 1),
                                        np.full(len(at), key), at, sure), strict=True):
                    col.append(x)
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            sure = cols.pop().astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t, mask=sure if k == 4 else None) for k, (c, t) in enumerate(zip(
                    cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True))],
                ["anchor", "hash", "weight", "row_key", "at"])

    return rows.select("row_key", "text", "runs").mapInArrow(
        lean(run), "anchor long, hash long, weight int, row_key long, at int")


def _phrases(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """(anchor, phrase): the passages of each row, cut into phrases."""
    def run(batches):
        for b in slices(batches):
            out: set[tuple[int, str]] = set()
            for text, runs, single in zip(b.column("text"), _run_arrays(b.column("runs")), b.column("single").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                total = max(0, len(words) - size + 1)
                first, n = runs["s"].astype(np.int64), runs["n"].astype(np.int64)
                at = np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)
                sure, anchor, cut = np.zeros(total, bool), np.zeros(total, np.int64), np.zeros(total, bool)
                anchor[at] = np.repeat(runs["anchor"], n)
                sure[at] = np.repeat(runs["sure"].astype(bool), n)
                cut[first] = runs["anchor"] % CUT == 0
                sure[single or []] = True
                edge = np.flatnonzero(np.diff(np.r_[False, sure, False].astype(np.int8)))
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    inner = [s, *(s + 1 + np.flatnonzero(cut[s + 1:e])).tolist(), e]
                    out |= {(int(anchor[i]), b" ".join(words[i:j + size - 1]).decode("utf-8", "replace"))
                            for i, j in zip(inner, inner[1:])}
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()),
                                              pa.array([p for _, p in out], pa.string())], ["anchor", "phrase"])

    return rows.select("text", "runs", "single").mapInArrow(lean(run), "anchor long, phrase string").distinct()


def locate(phrases: list[str], texts: list[list[bytes]]):
    """For each text, whether each word is covered by an occurrence of a phrase."""
    import ahocorasick

    number: dict[bytes, int] = {}
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in phrases:
        words = p.encode().split()
        auto.add_word(tuple([number.setdefault(w, len(number) + 1) for w in words]), len(words))
    if phrases:
        auto.make_automaton()
    for words in texts:
        edge = np.zeros(len(words) + 1, np.int64)
        if phrases:
            get = number.get
            for end, n in auto.iter(tuple([get(w, 0) for w in words])):
                edge[end - n + 1] += 1
                edge[end + 1] -= 1
        yield np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, shard_words: int = SHARD_WORDS,
                   with_text: bool = True, work: Work | None = None) -> DataFrame:
    """The input's columns but for text, with n_words, n_removed, kept_sha256
    (of the kept words joined by one space) and kept_text (null unless
    ``with_text``), one row per document."""
    work = work or Work(docs.sparkSession, "phrase-dedup")
    docs = set_aside(docs, OUTPUTS)
    own = [c for c in docs.columns if c != "text"]
    keyed = docs.withColumn("text", F.col("text").cast("string")).withColumn(
        "row_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    runs = work.table(_runs(keyed, size, gram), "runs")
    marked = work.table(_sharded(_candidates(runs, work), shard_words, work), "marked")
    work.drop("runs", "again", "recurring", "kinds", "unsharded", "parts")

    results = [F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
               F.lit("").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text")]
    joined = keyed.join(marked.drop("words"), "row_key", "left").select(*own, *results, "row_key", "runs", "shard", "text")
    out = joined.select(*own, "n_words", "n_removed", "kept_sha256", "kept_text").schema

    def put(b: pa.RecordBatch, **cols) -> pa.RecordBatch:
        for name, values in cols.items():
            i = b.schema.get_field_index(name)
            b = b.set_column(i, b.schema.field(i), pa.array(values, b.schema.field(i).type) if isinstance(values, list)
                             else values)
        return b

    def settle(batches):
        """Results of rows without candidates; only the others keep their text."""
        for b in slices(batches):
            done, text = b.column("runs").is_null(), b.column("text")
            none = pa.scalar(None, pa.string())
            words = [(t or "").encode().split() for t in text.to_pylist()]
            yield put(b, n_words=[len(w) for w in words],
                      kept_sha256=[_digest(w)[0] if d else "" for w, d in zip(words, done.to_pylist(), strict=True)],
                      kept_text=pc.if_else(done, text, none) if with_text else b.column("kept_text"),
                      text=pc.if_else(done, none, text))

    split = work.table(joined.mapInArrow(lean(settle), joined.schema), "split")
    rows = split.filter("runs IS NOT NULL")
    windows = work.table(_open_windows(rows, size, gram), "windows")
    twice = windows.groupBy("anchor", "hash").agg(F.sum("weight").alias("w")).filter("w > 1").select("anchor", "hash")
    single = (windows.filter("at IS NOT NULL").join(twice, ["anchor", "hash"], "left_semi")
              .groupBy("row_key").agg(F.collect_set("at").alias("single")))
    phrases = work.table(_phrases(rows.select("row_key", "text", "runs").join(single, "row_key", "left"), size, gram), "phrases")

    work.drop("marked", "windows")
    sent = (rows.select(F.col("shard").alias("at_shard"), F.explode("runs.anchor").alias("anchor")).distinct()
            .join(phrases, "anchor").select("at_shard", "phrase"))

    def stream(texts: pa.Table, keys: pa.Table) -> pa.Table:
        text = texts.column("text").to_pylist()
        words = [(t or "").encode().split() for t in text]
        removed, sha, kept = [], [], []
        for t, own_words, gone in zip(text, words, locate(keys.column("phrase").to_pylist(), words), strict=True):
            s, k = _digest([w for w, g in zip(own_words, gone.tolist(), strict=True) if not g])
            removed.append(int(gone.sum()))
            sha.append(s)
            kept.append((k.decode("utf-8", "replace") if removed[-1] else t) if with_text else None)
        new = {"n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()),
               "kept_text": pa.array(kept, pa.string())}
        return pa.Table.from_arrays([new.get(c, texts.column(c)) for c in out.names], names=out.names)

    streamed = (rows.select(*out.names, "text", "shard").groupBy("shard")
                .cogroup(sent.groupBy("at_shard")).applyInArrow(stream, out))
    settled = split.filter("runs IS NULL").select(*out.names)
    return settled.unionByName(streamed)
