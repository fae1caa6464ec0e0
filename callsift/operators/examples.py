"""User examples: phrase match by substring, else by Ratcliff-Obershelp
similarity (``difflib.SequenceMatcher.ratio``), threshold 0.85.

An automaton over the phrases finds every contained one (similarity 1.0). The
ratio of others is 2 M / S, S the characters of both sides and M the matched
ones. Three bounds keep pairs from difflib, none of them loses one:
  * lengths: M <= the shorter side;
  * bigrams: the matched characters lie in at most S - 2 M + 1 blocks, so the
    sides share at least 3 M - S - 1 bigrams (with multiplicity). Postings
    bigram -> (phrase, count) over the phrases in order of length give the
    shared bigrams of all phrases of the length band at once;
  * characters: M <= the shared characters (``quick_ratio``).

Plan: examples up to a checked size are read by the driver, and one Arrow pass
appends each text's scoring examples; no row is regrouped. Beyond it (examples
grow with every correction) texts are dealt into cells of bounded bytes, and
each cell receives the examples, so a text is shuffled once and the copies of
the examples are no more than the texts (examples beyond a cell's bytes are
dealt by length, and texts meet those they could contain or resemble). In a
cell one look-up per character, whatever the number of phrases, finds the
contained ones; the index of similar ones is made part by part. Nothing of
either side reaches the driver. Both ways give the same.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.functions.patterns import WS
from callsift.functions.text import collapse_ws
from callsift.operators.matching import Phrases, append_structs
from callsift.session import write_table

THRESHOLD = 0.85
DEFAULT_CONFIDENCE = 0.95
FIELDS = [("example_ord", T.LongType()), ("similarity", T.DoubleType())]
# Examples that the driver reads and every task receives: rows, and characters of phrases.
LOCAL_EXAMPLES, LOCAL_CHARS = 20_000, 8 << 20
# Beyond: phrases of a part, characters of texts in a cell, and of phrases in it.
PART_EXAMPLES, CELL_CHARS, GROUP_CHARS = 20_000, 32 << 20, 64 << 20


def prepare_examples(examples: DataFrame) -> DataFrame:
    """Lower-cased, stripped phrase; whitespace-collapsed match form;
    stripped labels; missing confidence -> 0.95."""
    # str() of a missing phrase is "None", as the original renders it.
    phrase = F.regexp_replace(F.lower(F.coalesce(F.col("example_phrase").cast("string"), F.lit("None"))),
                              f"^{WS}+|{WS}+$", "")
    strip = lambda c: F.regexp_replace(F.col(c).cast("string"), f"^{WS}+|{WS}+$", "")
    return examples.select(
        "example_ord", phrase.alias("phrase"), collapse_ws(phrase).alias("phrase_norm"),
        # The category is always rendered as text: a missing one reads "None".
        F.coalesce(strip("category"), F.lit("None")).alias("category"),
        strip("subcategory").alias("subcategory"),
        strip("tertiary_category").alias("tertiary_category"),
        F.coalesce(F.col("confidence"), F.lit(DEFAULT_CONFIDENCE)).alias("example_confidence"))


def _bigrams(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return c[:-1] << 21 | c[1:]


class BigramIndex:
    """Postings bigram -> (phrase, count) over phrases in order of length."""

    def __init__(self, phrases: list[str], threshold: float):
        self.phrases = sorted(phrases, key=lambda p: (len(p), p))
        self.threshold = threshold
        self.lengths = np.array([len(p) for p in self.phrases], np.int64)
        grams = [_bigrams(p) for p in self.phrases]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        self.vocabulary, number = np.unique(flat, return_inverse=True)
        # by bigram, then phrase
        self.key, self.count = np.unique(number * max(len(grams), 1) + owner, return_counts=True)

    def shared(self, text: str, low: int, high: int) -> np.ndarray:
        """The bigrams that a text shares with each phrase from low to high."""
        own, count = np.unique(_bigrams(text), return_counts=True)
        at = np.searchsorted(self.vocabulary, own)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == own[known]
        at, count, width = at[known], count[known], len(self.phrases)
        first, last = np.searchsorted(self.key, at * width + low), np.searchsorted(self.key, at * width + high)
        n = last - first
        entry = np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)
        both = np.minimum(self.count[entry], np.repeat(count, n))
        return np.bincount(self.key[entry] - np.repeat(at * width, n) - low, both, high - low)

    def near(self, text: str) -> list[str]:
        """The phrases whose ratio may reach the threshold."""
        t, n = self.threshold, len(text)
        low, high = 0, len(self.phrases)
        if t > 0.0:  # 2 min / (n + m) >= t holds for m from n t / (2 - t) to n (2 - t) / t
            low = int(np.searchsorted(self.lengths, n * t / (2.0 - t) - 1))
            high = int(np.searchsorted(self.lengths, n * (2.0 - t) / t + 1, side="right"))
        size = n + self.lengths[low:high]
        least = 1.5 * t * size - size - 1 - 1e-6
        if not len(size) or least.max() <= 0:
            return self.phrases[low:high]
        return [self.phrases[low + i] for i in np.flatnonzero(self.shared(text, low, high) >= least).tolist()]


class Anchors:
    """The contained ones of very many phrases. A phrase of some length is
    looked for at one of its pieces of ``SIZE`` characters, the one that fewest
    phrases have; shorter ones go to an automaton. Hashes choose, texts decide."""

    SIZE, STEP = 32, 16  # SIZE: a power of two
    SEEN = 22  # bits of the first look-up

    def __init__(self, phrases: list[str]):
        self.short = Phrases([p for p in phrases if len(p) < self.SIZE])
        self.phrases = sorted({p for p in phrases if len(p) >= self.SIZE})
        owner, place, piece = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at in range(0, len(self.phrases), 1024):
            own = [self.hashes(p)[::self.STEP] for p in self.phrases[at:at + 1024]]
            owner.append(np.repeat(np.arange(at, at + len(own)), [len(h) for h in own]))
            place.append(np.concatenate([np.arange(len(h)) for h in own]) * self.STEP)
            piece.append(np.concatenate(own))
        owner, place, piece = np.concatenate(owner), np.concatenate(place), np.concatenate(piece)
        _, number, count = np.unique(piece, return_inverse=True, return_counts=True)
        order = np.lexsort((place, count[number], owner))
        first = order[np.diff(owner[order], prepend=-1) != 0]
        first = first[np.argsort(piece[first], kind="stable")]
        self.owner, self.place, self.piece = owner[first], place[first], piece[first]
        self.seen = np.zeros(1 << self.SEEN, bool)
        self.seen[self.piece >> np.uint64(64 - self.SEEN)] = True

    @classmethod
    def hashes(cls, text: str) -> np.ndarray:
        """A hash of the ``SIZE`` characters from each place on."""
        h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = 1
        while size < cls.SIZE:
            if len(h) <= size:
                return h[:0]
            h = (h[:-size] * np.uint64(0x9E3779B97F4A7C15) ^ (h[size:] + np.uint64(size))) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            size *= 2
        return h * np.uint64(0x9E3779B97F4A7C15)

    def find(self, text: str) -> set[str]:
        found = {self.short.phrases[i] for i in self.short.find(text)}
        if not len(self.piece) or len(text) < self.SIZE:
            return found
        h = self.hashes(text)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - self.SEEN)])
        h = h[at]
        low, high = np.searchsorted(self.piece, h), np.searchsorted(self.piece, h, side="right")
        for k in np.flatnonzero(high > low).tolist():
            for e in range(int(low[k]), int(high[k])):
                phrase, start = self.phrases[self.owner[e]], int(at[k]) - int(self.place[e])
                if start >= 0 and phrase not in found and text.startswith(phrase, start):
                    found.add(phrase)
        return found


class ExampleMatcher:
    """(example, similarity) of each example that scores ``threshold`` or more;
    with ``best``, of the best one alone (the first of equals)."""

    def __init__(self, examples: list[tuple[int, str]], threshold: float, best: bool = False):
        self.threshold, self.best = float(threshold), best
        self.phrases = Phrases([p for _, p in examples])
        self.of: dict[str, list[int]] = {}
        for o, p in examples:
            self.of.setdefault(p, []).append(o)
        self.index: BigramIndex | None = None  # made by each worker, as the automaton is

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def __call__(self, text: str) -> list[tuple]:
        t = self.threshold
        if t > 1.0:
            return []
        if self.index is None:
            self.lower = _by_lower(self.of)
            self.index = BigramIndex(list(self.lower), t)
        contained = {self.phrases.phrases[i] for i in self.phrases.find(text)}
        score = dict.fromkeys(contained, 1.0)
        if not (self.best and contained):
            score |= _similar(text.lower(), self.index.near, self.lower, contained, t)
        return _scored(score, self.of, self.best)


def _by_lower(phrases) -> dict[str, list[str]]:
    """difflib sees lower case: phrases may differ in it and be alike there."""
    lower: dict[str, list[str]] = {}
    for p in filter(None, phrases):
        lower.setdefault(p.lower(), []).append(p)
    return lower


def _similar(low: str, near, lower: dict[str, list[str]], contained: set[str], t: float) -> dict[str, float]:
    """The ratio of each phrase that is not contained and reaches the threshold."""
    score = {}
    for q in near(low):
        if contained.issuperset(lower[q]) or 2.0 * min(len(low), len(q)) / (len(low) + len(q)) < t:
            continue
        m = difflib.SequenceMatcher(None, low, q)
        if m.quick_ratio() >= t and (r := m.ratio()) >= t:
            score.update((p, r) for p in lower[q] if p not in contained)
    return score


def _scored(score: dict[str, float], of: dict[str, list[int]], best: bool) -> list[tuple]:
    found = [(o, s) for p, s in score.items() for o in of[p]]
    return [max(found, key=lambda f: (f[1], -f[0]))] if best and found else found


def _cell_matches(texts: list[str], examples: list[tuple[int, str]], t: float, best: bool, part: int) -> list[list[tuple]]:
    """What an ``ExampleMatcher`` gives for each text, the phrases looked at in
    parts of neighbouring lengths where they need an index."""
    if t > 1.0:
        return [[] for _ in texts]
    of: dict[str, list[int]] = {}
    for o, p in examples:
        of.setdefault(p, []).append(o)
    anchors = Anchors(list(of))
    scores = [dict.fromkeys(anchors.find(x), 1.0) for x in texts]
    lower = _by_lower(of)
    if t == 1.0:  # only a phrase equal to the text has all its characters matched
        for x, score in zip(texts, scores, strict=True):
            if (low := x.lower()) in lower and not (best and score):
                score |= _similar(low, lambda q: [q], lower, set(score), t)
    else:
        contained = [set(s) for s in scores]
        phrases = sorted(lower, key=len)
        lows = [(i, x.lower()) for i, x in enumerate(texts) if not (best and contained[i])]
        for at in range(0, len(phrases), part):
            some = phrases[at:at + part]
            index = None
            for i, low in lows:
                # 2 min / (n + m) >= t holds for no phrase of the part
                if t > 0.0 and not (len(some[0]) * t / (2.0 - t) - 1 <= len(low) <= len(some[-1]) * (2.0 - t) / t + 1):
                    continue
                index = index or BigramIndex(some, t)
                scores[i] |= _similar(low, index.near, lower, contained[i], t)
    return [_scored(s, of, best) for s in scores]


def _normal(texts: DataFrame, text_col: str) -> DataFrame:
    return texts.select("transcript_id", collapse_ws(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("_norm"))


def _cells(own: DataFrame, examples: DataFrame, threshold: float, cell_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts by cell, phrases by cell, rows (_row, transcript_id)).
    Groups hold phrases of neighbouring lengths, so a text goes to the groups
    from the shortest phrases up to those it may resemble: as a rule one."""
    rows = write_table(own.withColumn("_row", F.monotonically_increasing_id()), "example-texts")
    n = F.length("phrase_norm").cast("long")
    # as many rows as there are different lengths
    sizes = examples.groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum(F.col("c") * (F.col("n") + 1)).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("before") + F.pmod(F.xxhash64("example_ord", "phrase_norm"), F.col("c")) * (F.col("n") + 1)
    parted = write_table(
        examples.withColumn("n", n).join(sizes.withColumn("before", before), "n")
        .select("example_ord", "phrase_norm", "n", F.floor(place / GROUP_CHARS).cast("int").alias("part")), "example-parts")
    ranges = parted.groupBy("part").agg(F.min("n").alias("n"), F.sum("n").alias("chars")).orderBy("n", "part").collect()  # three numbers a group
    parts, shortest = F.lit([r.part for r in ranges]).cast("array<int>"), F.lit([r.n for r in ranges]).cast("array<long>")
    t = float(threshold)
    reach = F.length("_norm") * F.lit((2.0 - t) / t) + 1 if t > 0.0 else F.lit(float("inf"))
    met = F.size(F.filter(shortest, lambda x: x <= reach))
    # every cell receives its group's phrases: no more of them in all than of the texts
    chars = rows.agg(F.sum(F.length("_norm"))).first()[0] or 0
    salts = max(1, -(-chars // max(cell_chars, *(r.chars for r in ranges), 1)))
    left = (rows.withColumn("part", F.explode(F.slice(parts, F.lit(1), met)))
            .select("part", F.pmod(F.xxhash64("_row"), F.lit(salts)).alias("salt"), "_row", "_norm"))
    right = parted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).select(
        F.col("part").alias("p"), F.col("salt").alias("s"), "example_ord", "phrase_norm")
    return left, right, rows.select("_row", "transcript_id")


def _dealt(own: DataFrame, examples: DataFrame, threshold: float, best: bool, part_examples: int,
           cell_chars: int) -> tuple[DataFrame, DataFrame]:
    """((_row, example_ord, similarity) by cells, rows (_row, transcript_id))."""
    left, right, rows = _cells(own, examples, threshold, cell_chars)
    t = float(threshold)

    def meet(texts: pa.Table, phrases: pa.Table) -> pa.Table:
        examples = list(zip(phrases["example_ord"].to_pylist(), phrases["phrase_norm"].to_pylist()))
        row, ords, sims = [], [], []
        for r, found in zip(texts["_row"].to_pylist(),
                            _cell_matches(texts["_norm"].to_pylist(), examples, t, best, part_examples), strict=True):
            for o, s in found:
                row.append(r)
                ords.append(o)
                sims.append(s)
        return pa.table({"_row": pa.array(row, pa.int64()), "example_ord": pa.array(ords, pa.int64()),
                         "similarity": pa.array(sims, pa.float64())})

    found = left.groupBy("part", "salt").cogroup(right.groupBy("p", "s")).applyInArrow(
        meet, "_row long, example_ord long, similarity double")
    return found, rows


def _matches(texts: DataFrame, examples: DataFrame, text_col: str, threshold: float, best: bool, local_examples: int,
             part_examples: int, cell_chars: int) -> DataFrame:
    """(transcript_id, example_ord, similarity and the example's columns)."""
    prepared, own = prepare_examples(examples), _normal(texts, text_col)
    some = prepared.limit(local_examples + 1).collect()  # at most so many rows
    if len(some) <= local_examples and sum(len(r.phrase_norm) for r in some) <= LOCAL_CHARS:
        matcher = ExampleMatcher([(r.example_ord, r.phrase_norm) for r in some], threshold, best)
        found = append_structs(own, "_norm", "_found", FIELDS, matcher).select("transcript_id", F.explode("_found").alias("_f"))
        known = F.broadcast(texts.sparkSession.createDataFrame(some, prepared.schema))
        return found.select("transcript_id", "_f.*").join(known, "example_ord")
    prepared = write_table(prepared, "examples")
    found, rows = _dealt(own, prepared.select("example_ord", "phrase_norm"), threshold, best, part_examples, cell_chars)
    if best:  # of the bests of a row's cells
        found = found.groupBy("_row").agg(F.max(F.struct("similarity", (-F.col("example_ord")).alias("neg"))).alias("b")).select(
            "_row", (-F.col("b.neg")).alias("example_ord"), "b.similarity")
    return found.join(rows, "_row").drop("_row").join(prepared, "example_ord")


def example_pairs(texts: DataFrame, examples: DataFrame, text_col: str = "transcript", threshold: float = THRESHOLD,
                  local_examples: int = LOCAL_EXAMPLES, part_examples: int = PART_EXAMPLES,
                  cell_chars: int = CELL_CHARS) -> DataFrame:
    """(transcript_id, example, similarity) for every pair scoring >= threshold."""
    return _matches(texts, examples, text_col, threshold, False, local_examples, part_examples, cell_chars)


def example_classify(texts: DataFrame, examples: DataFrame, text_col: str = "transcript", threshold: float = THRESHOLD,
                     local_examples: int = LOCAL_EXAMPLES, part_examples: int = PART_EXAMPLES,
                     cell_chars: int = CELL_CHARS) -> DataFrame:
    """Best example per text row (most similar, first on ties): confidence =
    example confidence x similarity. Rows without one are left out."""
    won = _matches(texts, examples, text_col, threshold, True, local_examples, part_examples, cell_chars)
    return won.select(
        "transcript_id", "category", "subcategory", "tertiary_category",
        (F.col("example_confidence") * F.col("similarity")).alias("confidence"),
        F.col("phrase").alias("matched_phrase"), "similarity", F.lit("user_example").alias("source"))


def example_stats(examples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Count, distinct categories, mean phrase length in words (1 place)."""
    ex = prepare_examples(examples)
    words = (F.when(F.col("phrase_norm") == "", F.lit(0))
             .otherwise(F.size(F.split("phrase_norm", " "))))
    return ex.agg(F.count(F.lit(1)).alias("total_examples"),
                  F.countDistinct("category").alias("unique_categories"),
                  F.coalesce(F.round(F.avg(words), 1), F.lit(0.0)).alias("avg_phrase_length"),
                  F.lit(threshold).alias("similarity_threshold"))
