"""Column-level text preparation (all built-in, JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsift.functions.patterns import SPEAKER_LABEL, WS, to_java

_SPEAKER_JAVA = to_java(SPEAKER_LABEL)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """``' '.join(s.split())``: whitespace runs -> one space, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), WS + "+", " "))


def clean_transcript(c) -> Column:
    """Drop ``[HH:MM:SS AGENT|CUSTOMER]:`` labels (upper-case only), collapse
    whitespace, lower-case. Null becomes '' (an empty transcript)."""
    x = F.coalesce(_col(c), F.lit(""))
    return F.lower(collapse_ws(F.regexp_replace(x, _SPEAKER_JAVA, " ")))


def normalize_text(c) -> Column:
    """Lower-case and collapse whitespace; null -> ''."""
    return collapse_ws(F.lower(F.coalesce(_col(c), F.lit(""))))


def tokenize(c) -> Column:
    """Whitespace tokens of the normalized text (empty text -> empty array)."""
    n = normalize_text(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def word_count(c) -> Column:
    """Number of whitespace-separated words (``len(str(x).split())``)."""
    return F.size(tokenize(c))


def estimate_tokens(c) -> Column:
    """Token estimate: characters // 4."""
    return F.floor(F.length(_col(c)) / F.lit(4)).cast("long")


def content_hash(c) -> Column:
    """Hex MD5 of the UTF-8 text (cache keys, prompt hashes)."""
    return F.md5(_col(c))


def truncate(c, n: int) -> Column:
    """First ``n`` characters (code points, as Python slicing)."""
    return F.substring(_col(c), 1, n)


def percent_display(c, digits: int = 1) -> Column:
    """``f"{x:.1%}"`` style display of a 0..1 ratio."""
    return F.format_string(f"%.{digits}f%%", _col(c) * F.lit(100.0))
