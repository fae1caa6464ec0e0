"""Runs of periodic words, found by recursive frequency splitting.

A run is a maximal stretch of consecutive words with smallest period q (words q
apart are identical) that holds at least ``repeats`` periods and ``least`` words.

1. Splitting. Every word of a run occurs at least ``repeats`` times in it. So a
   word that occurs more rarely within the current segment is in no run of it
   and splits it; pieces shorter than ``least`` words go. The pieces are split
   by their own counts in turn, until no segment changes.
2. Lag scan of the surviving segments. At level g (1, 2, 4, ...) each place has
   as its lag the distance to the next equal g-gram; consecutive places with
   the same lag q, g/2 < q <= g, are a stretch of period q. Each run shows up at
   one level, whole: inside a run no g-gram with g >= q recurs nearer than q (two
   periods of so long a gram would have a common divisor as period), and three
   periods leave places whose gram and its next copy both lie in the run. So
   the scan is exact and takes n log n steps, for any lag.

Words are compared by number, never by hash. Splitting only saves work: no run
crosses a split, so the runs are those of the whole text.

Defined results: a null or empty text has no words, no runs and an empty
collapsed text; texts are read whole, whatever their length; runs of equal
exponent are all kept, sorted by start, then period; repeated rows are documents
of their own; an empty table gives no rows; other columns are carried, and input
columns named like an output become ``<name>_input``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.llm.work import lean, set_aside, slices

LEAST = 24
REPEATS = 3
OUTPUTS = {"n_words", "runs", "collapsed_text"}
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def segments(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """(start, end) of the stretches that are left when words too rare within
    their stretch have split it, again and again."""
    done: list[tuple[int, int]] = []
    start, end = np.zeros(1, np.int64), np.array([len(ids)], np.int64)
    vocabulary = int(ids.max(initial=0)) + 1
    while len(start):
        # all open segments at once: places, and the segment of each
        size = end - start
        segment = np.repeat(np.arange(len(start)), size)
        place = np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)
        words = ids[place]
        if len(start) == 1:
            often = np.bincount(words, minlength=vocabulary)[words] >= repeats
        else:
            _, own, count = np.unique(segment * vocabulary + words, return_inverse=True, return_counts=True)
            often = count[own] >= repeats
        whole = np.bincount(segment, often, len(start)) == size
        done += zip(start[whole].tolist(), end[whole].tolist(), strict=True)
        stay = often & ~whole[segment]
        # pieces: stretches of frequent words within one segment
        first = stay & np.r_[True, ~stay[:-1] | (segment[1:] != segment[:-1])] if len(stay) else stay
        last = stay & np.r_[~stay[1:] | (segment[1:] != segment[:-1]), True] if len(stay) else stay
        start, end = place[first], place[last] + 1
        long = end - start >= least
        start, end = start[long], end[long]
    return sorted(s for s in done if s[1] - s[0] >= least)


def lag_scan(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a segment."""
    if repeats < 3:
        raise ValueError("the scan needs runs of three periods or more")
    out, n, g = [], len(ids), 1
    name = np.unique(ids, return_inverse=True)[1].astype(np.int64)  # of the g-gram at each place
    while repeats * (g // 2 + 1) <= n:
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        if not same.any():
            break
        lag = np.zeros(len(name) + 1, np.int64)
        lag[order[:-1][same]] = (order[1:] - order[:-1])[same]
        lag[(lag <= g // 2) | (lag > g)] = 0
        edge = np.flatnonzero(lag[1:] != lag[:-1]) + 1
        first, last = np.r_[0, edge[:-1]] if len(edge) else edge, edge
        period = lag[first]
        length = last - first - 1 + g + period
        good = (period > 0) & (length >= np.maximum(least, repeats * period))
        out += zip(first[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True)
        if 2 * g > n:
            break
        name = np.unique(name[:-g] * (int(name.max()) + 1) + name[g:], return_inverse=True)[1]
        g *= 2
    return out


def find_runs(words: list, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if len(words) < least:
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return sorted((s + start, n, q) for start, end in segments(ids, least, repeats)
                  for s, n, q in lag_scan(ids[start:end], least, repeats))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone]


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """The input's columns with n_words, runs (an array of (start, length,
    period), places in words) and collapsed_text (the kept words joined by one
    space). One pass, without any exchange."""
    docs = set_aside(docs, OUTPUTS).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed_text", T.StringType())])

    def run(batches):
        for b in slices(batches):
            count, kept, ends, flat = [], [], [0], []
            for text in b.column("text").to_pylist():
                words = (text or "").encode().split()
                runs = find_runs(words, least, repeats)
                count.append(len(words))
                flat += runs
                ends.append(len(flat))
                kept.append(b" ".join(collapse(words, runs)))
            cols = np.array(flat, np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(cols[:, k]) for k in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(count, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())],
                [*b.schema.names, "n_words", "runs", "collapsed_text"])

    return docs.mapInArrow(lean(run), schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equals the
    first. Null without runs."""
    return F.reduce(runs, F.lit(None).cast(RUN), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def with_cycles(docs: DataFrame) -> DataFrame:
    """The documents, of which a tenth (by the hash of the id) end in a cycle of
    their own words: h is the unsigned crc32 of the decimal id, g = h div 10. If
    h ends in 0, every word from place a = g % n on repeats, cyclically, the
    first p = 1 + (n - a) div (3 + g % 8) of those words. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    space = r"[\x20\x09-\x0D]+"
    words = F.filter(F.split(F.col("text").cast("string"), space), lambda w: w != "")
    cycled = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.element_at("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1).cast("int"))))
    n, g = F.size("_words"), F.floor(h / 10)
    out = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), g.alias("_g"))
    out = out.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn(
        "_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    return out.select("doc_id", F.when(n > 0, F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))
