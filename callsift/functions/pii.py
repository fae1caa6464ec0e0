"""PII redaction as one chain of built-in ``regexp_replace`` expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from callsift.functions.patterns import PII_PATTERNS, to_java

PII_TYPES = [name for name, _ in PII_PATTERNS]
_JAVA = [(name, to_java(p)) for name, p in PII_PATTERNS]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def may_hold_pii(c) -> Column:
    """Exact pre-test: every pattern needs an '@' (EMAIL), 'http' (URL) or a
    digit (all others). Replacements insert none of these and never join
    text, so a text failing the test is left unchanged by the whole chain.
    Most texts fail it, and three plain scans are far cheaper than seven
    boundary-anchored regexes tried at every character."""
    x = _col(c)
    return (F.instr(x, "@") > 0) | (F.instr(x, "http") > 0) | x.rlike(r"\p{Nd}")


def redact(c, enabled: bool = True) -> Column:
    """Apply the seven patterns in order; each match -> ``<REDACTED_TYPE>``.

    Later patterns see the output of earlier ones (a card written with
    spaces is first caught by the 12-digit pattern). Null stays null.
    Pass a column reference (not a large expression): it is read by the
    pre-test and by the chain.
    """
    x = _col(c)
    if not enabled:
        return x
    chain = x
    for name, pat in _JAVA:
        chain = F.regexp_replace(chain, pat, f"<REDACTED_{name}>")
    return F.when(may_hold_pii(x), chain).otherwise(x)


def _stepped(df: DataFrame, text: Column) -> DataFrame:
    """``df`` in a struct ``_row``, ``_t`` (the redacted text, '' for null) and
    one ``bigint`` column per type: its matches, each counted on the text as
    redacted by the patterns before it (the order the redactor applies them).

    Each step is a column of its own, so the text is redacted once: the
    projections are kept apart by reading the step twice."""
    out = df.select(F.struct(*df.columns).alias("_row"), F.coalesce(text, F.lit("")).alias("_t"))
    out = out.select("_row", "_t", may_hold_pii("_t").alias("_may"))
    for name, pat in _JAVA:
        found = F.when(F.col("_may"), F.regexp_count("_t", F.lit(pat))).otherwise(0).cast("long")
        rest = [c for c in out.columns if c not in ("_t", "_may")]
        # the array holds count and rest of this step; reading both keeps one evaluation
        out = out.select(*rest, "_may", F.struct(found.alias("n"), F.when(
            F.col("_may"), F.regexp_replace("_t", pat, f"<REDACTED_{name}>")).otherwise(F.col("_t")).alias("t")).alias("_s"))
        out = out.select(*rest, "_may", F.col("_s.n").alias(name), F.col("_s.t").alias("_t"))
    return out


def pii_counts(df: DataFrame, text_col: str) -> DataFrame:
    """One ``bigint`` column per type with its matches, one row per text."""
    return _stepped(df.select(_col(text_col)), F.col(text_col)).select(*PII_TYPES)


class RedactionStats:
    """Counts of what redactions have replaced, taken while they run: no pass
    of their own over the texts."""

    def __init__(self):
        self._runs: list[Observation] = []

    def redact(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """``df`` with ``out_col``, the redacted text (null stays null). The
        first action over the result counts; a later one is not counted again."""
        run = Observation()
        self._runs.append(run)
        steps = _stepped(df, F.col(text_col)).observe(
            run, *(F.coalesce(F.sum(t), F.lit(0)).cast("long").alias(t) for t in PII_TYPES))
        rest = [F.col(f"_row.{c}").alias(c) for c in df.columns if c != out_col]
        return steps.select(*rest, F.when(F.col(f"_row.{text_col}").isNotNull(), F.col("_t")).alias(out_col))

    def snapshot(self) -> dict[str, int]:
        """Replaced matches by type over all runs since the last reset; waits
        for runs whose action has not ended."""
        found = [run.get for run in self._runs]
        return {t: sum(f[t] for f in found) for t in PII_TYPES}

    def reset(self) -> None:
        self._runs = []


def pii_stats(df: DataFrame, text_col: str = "transcript") -> DataFrame:
    """Hit count per PII type over a whole table: ``(pii_type, hits)``.

    One global aggregate (partial sums per task, one tiny final merge),
    unpivoted with ``stack``. Every run starts from zero, so no reset."""
    sums = pii_counts(df, text_col).agg(*[F.sum(t).cast("long").alias(t) for t in PII_TYPES])
    stack = ", ".join(f"'{t}', `{t}`" for t in PII_TYPES)
    return sums.select(
        F.expr(f"stack({len(PII_TYPES)}, {stack}) as (pii_type, hits)")
    ).select("pii_type", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
