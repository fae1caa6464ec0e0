"""Proximity rules: up to three terms chained by NEAR / AND / OR / NOT.

Semantics (tokens = lower-cased whitespace split of the text):
  * a term matches at token i when tokens[i:i+k] equals its k words;
  * one term: present -> 0.95;
  * otherwise Term1 must be present; each further term is checked with the
    operator before it (missing -> NEAR; unknown -> no match):
      NEAR: from some anchor p, the window tokens[p : p+d+k+5] joined by
            spaces *contains* the term text (d = WithinWords, else Proximity,
            else 5); the anchors then become the term's own exact positions
      AND: the term is present; OR: always; NOT: the term is absent;
  * two terms -> 0.90, three -> min(0.90 + 0.05, 0.98).
Per text the winner is the lowest rule ordinal among matches >= 0.95, else
the highest confidence with the lowest ordinal.

Plan: the rules are configuration (read once); one Arrow pass over the texts
appends each row's candidate rules, or its matches, as an array of structs.
  * Candidates come from an inverted index: a rule's key is the first word of
    Term1 when that is what Term1's tokens start with (a rule can only match
    when Term1 occurs), else the first words of all its terms.
  * A positional index of the text, made once: one automaton pass finds every
    place of every term of all rules; a term's sorted places as text, and as a
    phrase of whole tokens, are worked out when a rule first asks and shared by
    all candidate rules.
  * NEAR is interval arithmetic on token numbers: an occurrence from token s to
    token e lies in the window of anchor p if p <= s and e is before the
    window's end, and of all occurrences the first at or after p ends first.
    Anchors and occurrences are sorted, so any distance costs one linear pass.
Rows keep their order and columns; no token rows, no exchange.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsift.functions.patterns import WS
from callsift.functions.text import collapse_ws, normalize_text
from callsift.operators.matching import append_structs
from callsift.plans.dims import read_configuration

SINGLE, CHAINED, THIRD_TERM, MOST = 0.95, 0.90, 0.05, 0.98
DEFAULT_DISTANCE = 5
SLACK = 5
FIELDS = [("rule_ord", T.LongType()), ("confidence", T.DoubleType())]


def _norm_term(c: Column) -> Column:
    """``str(x).lower().strip()``."""
    return F.regexp_replace(F.lower(c.cast("string")), f"^{WS}+|{WS}+$", "")


def _words(term: Column) -> Column:
    """``term.split()``."""
    collapsed = collapse_ws(term)
    return F.when(collapsed == "", F.array().cast("array<string>")).otherwise(F.split(collapsed, " "))


def _key(term: Column) -> Column:
    """Index key of a term: its first word when it holds a space, else the
    whole term."""
    return F.when(F.instr(term, " ") > 0, _words(term)[0]).otherwise(term)


def parse_proximity_rules(rules: DataFrame) -> DataFrame:
    """Terms lower-cased and stripped (missing ones skipped), operators
    upper-cased, distances truncated to int; rows without any term dropped."""
    terms = F.filter(F.array(*[_norm_term(F.col(f"Term{i}")) for i in (1, 2, 3)]),
                     lambda x: x.isNotNull())
    ops = F.filter(F.array(*[F.upper(F.col(f"Operator{i}").cast("string")) for i in (1, 2)]),
                   lambda x: x.isNotNull())
    prox = F.coalesce(F.col("Proximity").cast("int"), F.lit(0))
    within = F.coalesce(F.col("WithinWords").cast("int"), F.lit(0))
    dist = F.when(within > 0, within).otherwise(prox)
    p = rules.select("rule_ord", F.col("Program").alias("program"),
                     F.col("CatNo").alias("cat_no"), terms.alias("terms"), ops.alias("operators"),
                     F.when(dist == 0, F.lit(DEFAULT_DISTANCE)).otherwise(dist).alias("max_distance"))
    p = p.filter(F.size("terms") > 0)
    first = F.try_element_at("terms", F.lit(1))
    return p.select(
        "*", F.transform("terms", _words).alias("words"),
        F.when(_key(first).eqNullSafe(F.try_element_at(_words(first), F.lit(1))), F.array(_key(first)))
         .otherwise(F.array_distinct(F.transform("terms", _key))).alias("index_keys"))


NOWHERE = np.zeros(0, np.int64)


class TermPlaces:
    """Every place of every term of a list in a text, by one automaton."""

    def __init__(self, terms: list[str]):
        self.terms = sorted({t for t in terms if t})
        self._automaton = None

    def __getstate__(self):
        return {"terms": self.terms, "_automaton": None}  # made by each worker

    def find(self, text: str) -> dict[str, np.ndarray]:
        """term -> its first characters' places, ascending."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, t in enumerate(self.terms):
                self._automaton.add_word(t, i)
            if self.terms:
                self._automaton.make_automaton()
        if not self.terms:
            return {}
        hits = np.array(list(self._automaton.iter(text)), np.int64).reshape(-1, 2)
        order = np.argsort(hits[:, 1], kind="stable")
        end, term = hits[order, 0], hits[order, 1]
        edge = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else NOWHERE
        return {self.terms[term[i]]: end[i:j] + 1 - len(self.terms[term[i]])
                for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(term)])}


class TextIndex:
    """A normalized text with the positions of the rules' terms in it."""

    def __init__(self, text: str, places: dict[str, np.ndarray]):
        self.text, self.places = text, places
        self.n = text.count(" ") + 1 if text else 0
        self._starts: np.ndarray | None = None
        self._phrases: dict[str, np.ndarray] = {}
        self._tokens: dict[str, np.ndarray] = {}

    def token_of(self, places: np.ndarray) -> np.ndarray:
        """Number of the token that holds each character."""
        if self._starts is None:
            spaces = np.flatnonzero(np.frombuffer(self.text.encode("utf-32-le"), np.uint32) == 32)
            self._starts = np.r_[0, spaces + 1]
        return np.searchsorted(self._starts, places, "right") - 1

    def tokens_of(self, term: str) -> np.ndarray:
        """The token in which each occurrence of the term, as text, begins."""
        if term not in self._tokens:
            self._tokens[term] = self.token_of(self.places.get(term, NOWHERE))
        return self._tokens[term]

    def phrase_starts(self, words: list[str]) -> np.ndarray:
        """Tokens at which the phrase starts (every one for no words)."""
        phrase = " ".join(words)
        if phrase not in self._phrases:
            if not words:
                found = np.arange(self.n + 1)
            else:
                text, size = self.text, len(phrase)
                whole = [p for p in self.places.get(phrase, NOWHERE).tolist()
                         if (p == 0 or text[p - 1] == " ") and (p + size == len(text) or text[p + size] == " ")]
                found = self.token_of(np.array(whole, np.int64))
            self._phrases[phrase] = found
        return self._phrases[phrase]

    def has(self, words: list[str]) -> bool:
        return not words or len(self.phrase_starts(words)) > 0

    def near(self, anchors: np.ndarray, term: str, window: int) -> bool:
        """Whether some anchor's window (tokens p to p + window, a slice whose
        negative end counts from the last token) joined by spaces holds term."""
        if not len(anchors) or term == "":
            return len(anchors) > 0
        starts = self.tokens_of(term)
        if not len(starts):
            return False
        end = np.minimum(anchors + window, self.n)
        end = np.where(end < 0, np.maximum(end + self.n, 0), end)
        at = np.searchsorted(starts, anchors)
        ok = at < len(starts)
        return bool((starts[at[ok]] + term.count(" ") < end[ok]).any())


class ProximityMatcher:
    """Candidate rules of a text (``verify`` off) or its matching rules."""

    def __init__(self, rules: list[tuple], verify: bool):
        """rules: (rule_ord, terms, words of the terms, operators, distance, index keys)."""
        self.rules, self.verify = rules, verify
        self.index: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for key in r[5]:
                self.index.setdefault(key, []).append(i)
        self.places = TermPlaces([t for r in rules for t in (*r[1], *(" ".join(w) for w in r[2]))])

    def __call__(self, text: str) -> list[tuple]:
        if not text:
            return []
        found = sorted({i for t in set(text.split(" ")) for i in self.index.get(t, ())})
        if not self.verify:
            return [(self.rules[i][0], 0.0) for i in found]
        if not found:
            return []
        own = TextIndex(text, self.places.find(text))
        return [(self.rules[i][0], c) for i in found if (c := self.confidence(own, i)) is not None]

    def confidence(self, text: TextIndex, i: int) -> float | None:
        _, terms, words, operators, distance, _ = self.rules[i]
        if not text.has(words[0]):
            return None
        anchor = words[0]  # the term whose places anchor the next NEAR
        for k in range(1, len(terms)):
            op = operators[k - 1] if k <= len(operators) else "NEAR"
            if op == "NEAR":
                if not text.near(text.phrase_starts(anchor), terms[k], distance + len(words[k]) + SLACK):
                    return None
                anchor = words[k]
            elif op not in ("AND", "OR", "NOT") or op != "OR" and text.has(words[k]) != (op == "AND"):
                return None
        if len(terms) == 1:
            return SINGLE
        return min(CHAINED + (THIRD_TERM if len(terms) > 2 else 0.0), MOST)


def _matched(texts: DataFrame, rules: DataFrame, program: str | None, text_col: str, verify: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with an array ``_found`` of (rule_ord, confidence), parsed rules
    as a driver-local relation)."""
    parsed = parse_proximity_rules(rules)
    if program:
        parsed = parsed.filter(F.col("program") == F.lit(program))
    rows = read_configuration(parsed, "proximity rules")
    matcher = ProximityMatcher([(r.rule_ord, r.terms, r.words, r.operators, r.max_distance, r.index_keys)
                                for r in rows], verify)
    own = texts.select("transcript_id", normalize_text(F.col(text_col)).alias("_norm"))
    found = append_structs(own, "_norm", "_found", FIELDS, matcher).drop("_norm")
    kind = parsed.schema["rule_ord"].dataType.simpleString()
    local = texts.sparkSession.createDataFrame(
        [(r.rule_ord, r.program, r.cat_no, r.terms) for r in rows],
        f"rule_ord {kind}, program string, cat_no string, terms array<string>")
    return found.withColumn("_found", F.col("_found").cast(
        f"array<struct<rule_ord:{kind},confidence:double>>")), F.broadcast(local)


def proximity_candidates(texts: DataFrame, rules: DataFrame, program: str | None = None,
                         text_col: str = "norm_text") -> DataFrame:
    """(transcript_id, rule columns): each rule an index key of which is a
    token of the text, once per (text, rule)."""
    found, local = _matched(texts, rules, program, text_col, verify=False)
    return (found.select("transcript_id", F.explode("_found.rule_ord").alias("rule_ord"))
            .join(local, "rule_ord"))


def proximity_matches(texts: DataFrame, rules: DataFrame, program: str | None = None,
                      text_col: str = "norm_text") -> DataFrame:
    """Every (transcript_id, rule) that matches, with its confidence."""
    found, local = _matched(texts, rules, program, text_col, verify=True)
    return (found.select("transcript_id", F.explode("_found").alias("_f"))
            .select("transcript_id", "_f.*").join(local, "rule_ord")
            .select("transcript_id", "rule_ord", "program", "cat_no", "terms", "confidence"))


def proximity_classify(texts: DataFrame, rules: DataFrame, program: str | None = None,
                       text_col: str = "norm_text") -> DataFrame:
    """Best proximity match per text row (rows without a match are left out):
    the first rule of at least 0.95, else the most confident, first on ties."""
    found, local = _matched(texts, rules, program, text_col, verify=True)
    rank = F.transform("_found", lambda m: F.struct(
        F.when(m["confidence"] >= F.lit(SINGLE), F.lit(1.0)).otherwise(m["confidence"]).alias("rank"),
        (-m["rule_ord"]).alias("neg_ord"), m["confidence"].alias("confidence")))
    best = found.select("transcript_id", F.array_max(rank).alias("b")).filter("b IS NOT NULL")
    return (best.select("transcript_id", (-F.col("b.neg_ord")).alias("rule_ord"), "b.confidence")
            .join(local, "rule_ord")
            .select("transcript_id", F.col("rule_ord").alias("rule_id"), "cat_no", "confidence",
                    F.array_join("terms", " | ").alias("matched_terms"), F.lit("proximity").alias("source")))


def proximity_stats(rules: DataFrame, program: str | None = None) -> DataFrame:
    """Rule counts: with a program, distinct words of its terms; without,
    distinct index keys (every term's first word) and programs."""
    parsed = parse_proximity_rules(rules)
    if program:
        p = parsed.filter(F.col("program") == F.lit(program))
        w = p.select("rule_ord", F.explode_outer(F.flatten(F.transform("terms", _words))).alias("w"))
        return w.agg(F.countDistinct("rule_ord").alias("total_rules"),
                     F.countDistinct("w").alias("unique_keywords")).withColumn("program", F.lit(program))
    first = F.transform("terms", lambda t: F.when(F.instr(t, " ") > 0, _words(t)[0]).otherwise(t))
    k = parsed.select("rule_ord", "program", F.explode(first).alias("k"))
    # A missing program is one more distinct value (a Python set holds None).
    return k.agg(F.countDistinct("rule_ord").alias("total_rules"),
                 F.coalesce(F.countDistinct("program") + F.max(F.col("program").isNull().cast("int")),
                            F.lit(0)).cast("long").alias("programs"),
                 F.countDistinct("k").alias("unique_keywords"))
