"""Keyword-rule classification (term matching, scoring and argmax).

Semantics per (transcript, rule):
  * veto if any forbidden term occurs as a whole word;
  * for every keyword group, the first keyword (in group order) that occurs
    as a substring matches the group; at least one group must match;
  * base = matched / groups; with two or more matched groups a bonus for the
    mean gap between first occurrences (= (max-min)/(n-1));
  * minus 0.1 per matched keyword preceded within 50 characters by a
    negation word (at most 0.3); clamp to [0, 1]; keep if >= 0.4.
Per transcript the highest confidence wins (ties: lowest rule ordinal) and
the number of kept rules is reported.

Plan: the whole chain is map-side, without any exchange or written table.
  texts -> mapInArrow: one Aho-Corasick pass per text finds its terms; postings
        term -> (group, keyword) in flat arrays give, for many texts at once,
        the first keyword of each group, and segment reductions over rules give
        confidence, threshold, argmax and the number of kept rules
  -> one record per text: the winner with its rule's columns and keywords
Rows are never regrouped, so duplicate or null transcript ids do no harm.
"""

from __future__ import annotations

import functools
import re
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.functions import patterns as P
from callsift.operators.matching import Phrases, append_columns, append_structs

HIT_FIELDS = [("term_no", T.IntegerType()), ("pos", T.LongType()), ("neg", T.IntegerType()), ("wb", T.BooleanType())]
# What is known of a text's winning rule; all but the count are null when no rule is kept.
WINNER = T.StructType([T.StructField(n, t) for n, t in (
    ("num_rules_activated", T.IntegerType()), ("rule_ord", T.LongType()), ("confidence", T.DoubleType()),
    ("matched_groups", T.IntegerType()), ("rule_id", T.StringType()), ("category", T.StringType()),
    ("subcategory", T.StringType()), ("matched_keywords", T.StringType()))])
KEPT = T.StructType([T.StructField(n, t) for n, t in (
    ("rule_ord", T.LongType()), ("matched_groups", T.IntegerType()), ("confidence", T.DoubleType()))])
# Postings looked at together: bounds a task's memory.
BATCH_SLOTS, BATCH_TEXTS = 500_000, 1024


@functools.cache
def _variants() -> frozenset[str]:
    """Letters that a case-insensitive search takes for another lower-case letter."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.upper().lower() != c)


def _expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)


def _changes(a: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    return np.r_[np.ones(min(len(a), 1), bool), a[1:] != a[:-1]]


class Postings:
    """term -> entries, in flat arrays: the entries of term t are those from
    ``first[t]`` to ``first[t + 1]``."""

    def __init__(self, terms: int, entries: list[tuple[int, ...]], width: int):
        rows = np.array(sorted(entries), np.int64).reshape(len(entries), width)
        self.first = np.searchsorted(rows[:, 0], np.arange(terms + 1))
        self.columns = [np.ascontiguousarray(rows[:, k]) for k in range(1, width)]

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of each term, and for each the number of its term in ``terms``."""
        n = self.first[terms + 1] - self.first[terms]
        return _expand(self.first[terms], n), np.repeat(np.arange(len(terms)), n)


class Candidates(NamedTuple):
    """Kept rules of some texts, by text and rule, and their matched slots."""
    text: np.ndarray
    rule: np.ndarray
    matched: np.ndarray
    confidence: np.ndarray
    slot: np.ndarray   # entry of each matched group, by text, rule and group
    start: np.ndarray  # of each kept rule's slots


class KeywordMatcher:
    """A rule base compiled into an automaton over its terms and postings."""

    def __init__(self, rules: list[tuple]):
        """rules: (ordinal, rule id, category, subcategory, keyword groups, forbidden terms)."""
        rules = sorted(rules, key=lambda r: r[0])
        wanted = [(kw.lower(), r, g, k, kw) for r, rule in enumerate(rules) for g, group in enumerate(rule[4])
                  for k, kw in enumerate(group or []) if kw is not None]
        barred = [(t.lower(), r) for r, rule in enumerate(rules) for t in rule[5] if t is not None]
        self.phrases = Phrases([w[0] for w in wanted] + [t for t, _ in barred])
        number = {p: i for i, p in enumerate(self.phrases.phrases)}
        # groups are numbered through, rule by rule
        base = np.cumsum([0, *(len(rule[4]) for rule in rules)])
        spelling = {}
        entries = []
        for term, r, g, k, kw in wanted:
            entries.append((number[term], int(base[r]) + g, k))
            spelling[entries[-1]] = kw
        self.slots = Postings(len(number), entries, 3)
        self.keyword = [spelling[e] for e in sorted(entries)]
        self.vetoes = Postings(len(number), list({(number[t], r) for t, r in barred}), 2)
        self.rule_of = np.repeat(np.arange(len(rules)), np.diff(base))
        self.n_groups = np.diff(base)
        self.places = max((e[2] for e in entries), default=0) + 1
        self.columns = [[rule[k] for rule in rules] for k in range(4)]
        self.negation = re.compile(P.negation_regex_python(), re.IGNORECASE)
        self.whole: dict[int, re.Pattern] = {}
        # looked up once, on the driver: the letters are the same in every worker
        self.variants = _variants()
        self.odd_terms = {i for i, p in enumerate(self.terms) if not p or not self.variants.isdisjoint(p)}

    @property
    def terms(self) -> list[str]:
        return self.phrases.phrases

    def negated(self, text: str, pos: int) -> int:
        # a slice: a word cut by the window's start counts from there
        before = text[max(0, pos - P.NEGATION_WINDOW_CHARS):pos]
        return int(pos > 0 and self.negation.search(before) is not None)

    def whole_word(self, term_no: int, text: str) -> bool:
        """Whether the (lower-case) text holds the term as a whole word. Letters
        that fold into others are left to a case-insensitive search."""
        term, at = self.terms[term_no], -1
        if term_no not in self.odd_terms:
            head, tail = _is_word(term[0]), _is_word(term[-1])
            while (at := text.find(term, at + 1)) >= 0:
                end = at + len(term)
                if (at > 0 and _is_word(text[at - 1])) != head and (end < len(text) and _is_word(text[end])) != tail:
                    return True
            if text.isascii() or self.variants.isdisjoint(text):
                return False
        if term_no not in self.whole:
            self.whole[term_no] = re.compile(r"\b" + re.escape(term) + r"\b", re.IGNORECASE)
        return self.whole[term_no].search(text) is not None

    def hits(self, text: str) -> list[tuple]:
        """(term, first place, negated before it, whole word of a forbidden term) of each term."""
        barred = self.vetoes.first
        return [(i, pos, self.negated(text, pos), bool(barred[i + 1] > barred[i]) and self.whole_word(i, text))
                for i, pos in sorted(self.phrases.find(text).items())] if text else []

    def batches(self, texts: list[str | None]):
        """(first text, texts, hit arrays): texts in batches of a bounded number of postings."""
        at, slots, some, text, term, pos = 0, 0, [], [], [], []
        for t in texts:
            found = self.phrases.find(t) if t else {}
            own = np.fromiter(found, np.int64, len(found))
            text.append(np.full(len(found), len(some)))
            term.append(own)
            pos.append(np.fromiter(found.values(), np.int64, len(found)))
            some.append(t)
            slots += int((self.slots.first[own + 1] - self.slots.first[own]).sum())
            if slots > BATCH_SLOTS or len(some) == BATCH_TEXTS:
                yield at, some, np.concatenate(text), np.concatenate(term), np.concatenate(pos)
                at, slots, some, text, term, pos = at + len(some), 0, [], [], [], []
        if some:
            yield at, some, np.concatenate(text), np.concatenate(term), np.concatenate(pos)

    def candidates(self, texts: list[str | None], text: np.ndarray, term: np.ndarray, pos: np.ndarray) -> Candidates:
        """The rules of each text at or over the threshold, from the first
        places of the terms it contains."""
        entry, hit = self.slots.of(term)
        group, place = self.slots.columns
        # the first keyword of each group that occurs
        cell = (text[hit] * (len(self.rule_of) + 1) + group[entry]) * self.places + place[entry]
        order = np.argsort(cell, kind="stable")
        cell = cell[order] // self.places
        order = order[_changes(cell)]
        entry, hit = entry[order], hit[order]
        rules = len(self.n_groups)
        row = text[hit] * rules + self.rule_of[group[entry]]
        vetoed = self._vetoed(texts, text, term, row)
        if len(vetoed):
            stay = ~np.isin(row, vetoed)
            entry, hit, row = entry[stay], hit[stay], row[stay]
        if not len(row):
            none = np.zeros(0, np.int64)
            return Candidates(none, none, none, np.zeros(0), entry, none)
        negative = np.zeros(len(term), np.int64)
        negative[hit] = 1
        for h in np.flatnonzero(negative).tolist():
            negative[h] = self.negated(texts[text[h]], int(pos[h]))
        start = np.flatnonzero(_changes(row))
        matched = np.diff(np.r_[start, len(row)])
        at = pos[hit]
        gap = (np.maximum.reduceat(at, start) - np.minimum.reduceat(at, start)) / np.maximum(matched - 1, 1)
        bonus = np.select([matched < 2, *(gap < limit for limit, _ in P.PROXIMITY_BONUS)],
                          [0.0, *(value for _, value in P.PROXIMITY_BONUS)], P.PROXIMITY_BONUS_FAR)
        penalty = np.minimum(np.add.reduceat(negative[hit], start) * P.NEGATION_STEP, P.NEGATION_CAP)
        of, rule = row[start] // rules, row[start] % rules
        # the original's order of operations
        confidence = np.maximum(0.0, np.minimum(1.0, (matched / self.n_groups[rule] + bonus) - penalty))
        kept = confidence >= P.MIN_RULE_CONFIDENCE
        return Candidates(of[kept], rule[kept], matched[kept], confidence[kept], entry, start[kept])

    def _vetoed(self, texts: list, text: np.ndarray, term: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Those of the ascending rows (text and rule as one number) whose rule
        has a forbidden term in the text."""
        entry, hit = self.vetoes.of(term)
        row = text[hit] * len(self.n_groups) + self.vetoes.columns[0][entry]
        at = np.searchsorted(rows, row)
        asked = at < len(rows)
        asked[asked] = rows[at[asked]] == row[asked]
        row, hit = row[asked], hit[asked]
        found: dict[int, bool] = {}
        for h in hit.tolist():
            if h not in found:
                found[h] = self.whole_word(int(term[h]), texts[text[h]])
        return row[np.fromiter(map(found.__getitem__, hit.tolist()), bool, len(hit))]

    def winners(self, texts: list[str | None]) -> list[pa.Array]:
        """The columns of WINNER."""
        cols: list[list] = [[] for _ in WINNER]
        for _, some, *found in self.batches(texts):
            c = self.candidates(some, *found)
            count = np.bincount(c.text, minlength=len(some))
            best = np.full(len(some), -1)
            if len(c.text):
                # by text; in it the highest confidence, of equals the first rule
                order = np.lexsort((c.rule, -c.confidence, c.text))
                first = order[_changes(c.text[order])]
                best[c.text[first]] = first
            won = best >= 0
            rule = c.rule[best[won]]

            def put(k, values, kind):
                col = np.zeros(len(some), np.asarray(values).dtype)
                col[won] = values
                cols[k].append(pa.array(col, kind, mask=~won))

            cols[0].append(pa.array(count, pa.int32()))
            put(1, np.array(self.columns[0], np.int64)[rule], pa.int64())
            put(2, c.confidence[best[won]], pa.float64())
            put(3, c.matched[best[won]], pa.int32())
            at = np.full(len(some), len(self.n_groups))
            at[won] = rule
            for k, names in enumerate(self.columns[1:], 4):
                cols[k].append(pa.array([*names, None], pa.string()).take(pa.array(at)))
            words: list[str | None] = [None] * len(some)
            for i, b in zip(np.flatnonzero(won).tolist(), best[won].tolist(), strict=True):
                s = int(c.start[b])
                words[i] = " | ".join([self.keyword[e] for e in c.slot[s:s + int(c.matched[b])].tolist()])
            cols[7].append(pa.array(words, pa.string()))
        return [pa.concat_arrays(c) for c in cols]

    def kept(self, texts: list[str | None]) -> list[pa.Array]:
        """One column: the kept rules of each text, as a list of KEPT."""
        out = []
        for _, some, *found in self.batches(texts):
            c = self.candidates(some, *found)
            ends = np.r_[0, np.cumsum(np.bincount(c.text, minlength=len(some)))]
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(np.array(self.columns[0], np.int64)[c.rule]), pa.array(c.matched, pa.int32()), pa.array(c.confidence)],
                KEPT.names)))
        return [pa.concat_arrays(out)]


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class RuleBase:
    """Parsed keyword rules and their matcher. Rules are configuration: they
    are read once, and every text task receives them."""

    def __init__(self, parsed_rules: DataFrame):
        rows = parsed_rules.select("rule_ord", "rule_id", "category", "subcategory", "groups", "forbidden").collect()
        self.matcher = KeywordMatcher([tuple(r) for r in rows])


class _Hits:
    """The matcher's hits, as the callable that ``append_structs`` takes."""

    def __init__(self, matcher: KeywordMatcher):
        self.matcher = matcher

    def __call__(self, text: str) -> list[tuple]:
        return self.matcher.hits(text)


def keyword_hits(prepared: DataFrame, rb: RuleBase) -> DataFrame:
    """One row per (text, rule term it contains): the input's columns, term,
    pos (0-based first occurrence), neg (negation word in the 50 characters
    before it), wb (whole-word occurrence of a forbidden term)."""
    hits = append_structs(prepared, "norm_text", "_hits", HIT_FIELDS, _Hits(rb.matcher))
    terms = prepared.sparkSession.createDataFrame(
        list(enumerate(rb.matcher.terms)), "term_no int, term string")
    return (hits.select(*prepared.columns, F.explode("_hits").alias("_h")).select(*prepared.columns, "_h.*")
            .join(F.broadcast(terms), "term_no").select(*prepared.columns, "term", "pos", "neg", "wb"))


def rule_scores(prepared: DataFrame, rb: RuleBase) -> DataFrame:
    """One row per (text, kept rule): the input's columns but for norm_text,
    rule_ord, matched_groups, confidence."""
    own = [c for c in prepared.columns if c != "norm_text"]
    kept = append_columns(prepared, "norm_text", T.StructType([T.StructField("_kept", T.ArrayType(KEPT))]),
                          rb.matcher, "kept")
    return kept.select(*own, F.explode("_kept").alias("_k")).select(*own, "_k.*")


def score_texts(prepared: DataFrame, rb: RuleBase) -> DataFrame:
    """Every row of ``prepared`` (it needs ``norm_text``, which goes) with the
    winning rule (null when none is kept) and the number of kept rules."""
    return append_columns(prepared, "norm_text", WINNER, rb.matcher, "winners")
