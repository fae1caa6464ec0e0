"""Fixed text patterns and their regex dialects.

The values under "FIXED VALUES" must stay equal to the behaviour we
reproduce (results depend on them, character for character). They are
written in Python ``re`` syntax, the dialect they were specified in;
``to_java`` / ``to_re2`` translate them for Spark (java.util.regex) and for
the DuckDB oracle (RE2) so that all three agree on word boundaries, digits
and whitespace.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference behaviour)
# ---------------------------------------------------------------------------

# Negation words looked for in the 50 characters before a matched keyword.
NEGATION_WORDS = [
    "not", "no", "never", "neither", "nobody", "nothing", "nowhere",
    "none", "cannot", "can't", "won't", "don't", "doesn't", "didn't",
    "isn't", "aren't", "wasn't", "weren't", "hasn't", "haven't", "hadn't",
]

# Speaker labels removed by transcript cleaning (upper-case labels only).
SPEAKER_LABEL = r"\[\d{2}:\d{2}:\d{2}\s+(AGENT|CUSTOMER)\]:\s*"

# PII patterns, applied in this order; each match becomes <REDACTED_TYPE>.
PII_PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE_US", r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("AADHAAR", r"\b\d{4}\s\d{4}\s\d{4}\b"),
    ("ACCOUNT", r"(?i)\b(?:account|acct)[\s#:]*(\d{6,})\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("URL", r"https?://[^\s]+"),
]

# Keyword-rule scoring constants.
# How an error of a custom query begins.
QUERY_ERROR = "Query execution failed"
MIN_RULE_CONFIDENCE = 0.4
NEGATION_WINDOW_CHARS = 50
NEGATION_STEP = 0.1
NEGATION_CAP = 0.3
# (upper bound of the mean gap between matched keywords, bonus)
PROXIMITY_BONUS = [(50, 0.2), (100, 0.15), (200, 0.1)]
PROXIMITY_BONUS_FAR = 0.05

# A fenced block with a JSON object, and the first brace object (nested once),
# looked for in model replies; and the texts that stand in for missing parts.
FENCED_JSON = r"```(?:json)?\s*(\{.*?\})\s*```"
BRACE_OBJECT = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
REPLY_KEYS = ("root_cause", "coaching_points", "sample_script")
REPLY_DEFAULTS = {"root_cause": "See raw response", "coaching_points": [], "sample_script": "N/A",
                  "kpi_recommendations": [], "strengths": [], "priority": "Medium"}
UNREADABLE = "Unable to parse response"
SEE_BELOW = "See raw response below"
CHECK_RAW = "Check raw response"
PARSING_ERROR = "Parsing error: "

# ---------------------------------------------------------------------------
# Dialect helpers
# ---------------------------------------------------------------------------

# Characters Python's str.split() treats as whitespace (Unicode White_Space
# plus the four ASCII separators 0x1C-0x1F), as a bracket-expression body
# valid in both java.util.regex and RE2.
WS_BODY = (
    r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = "[" + WS_BODY + "]"
# Python's Unicode \w.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
# Python's \b, spelled with look-arounds (java.util.regex only).
JAVA_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def _translate(pattern: str, boundary: str) -> str:
    out = []
    i = 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS_BODY if in_class else WS)
            elif nxt == "d":
                out.append(r"\p{Nd}")
            elif nxt == "b" and not in_class:
                out.append(boundary)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def to_java(pattern: str) -> str:
    """Python-dialect pattern -> java.util.regex with Python's Unicode classes."""
    return _translate(pattern, JAVA_BOUNDARY)


def to_re2(pattern: str) -> str:
    """Python-dialect pattern -> RE2 (DuckDB). RE2 has no look-around, so \\b
    stays RE2's ASCII boundary; the only divergence is a digit run glued to a
    non-ASCII letter."""
    return _translate(pattern, r"\b")


def negation_regex() -> str:
    """Negation words as whole words; valid in Java and RE2 alike.

    Every negation word starts and ends with a word character, so Python's
    ``\\b(w1|w2..)\\b`` equals "start or non-word, word, non-word or end"."""
    words = "|".join(NEGATION_WORDS)
    return f"(^|{NOT_WORD})({words})($|{NOT_WORD})"


def negation_regex_python() -> str:
    """Negation words as whole words, Python ``re`` (use with IGNORECASE)."""
    return r"\b(" + "|".join(NEGATION_WORDS) + r")\b"


def whole_word_regex_java(term: str) -> str:
    """Python ``\\b<escaped term>\\b`` with IGNORECASE for one literal term,
    in Java syntax."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return "(?iu)" + JAVA_BOUNDARY + quoted + JAVA_BOUNDARY


def whole_word_regex_re2(term: str) -> str:
    """Same test in RE2 syntax (case-insensitive, as the original's
    IGNORECASE); exact for terms that start and end with a word character."""
    import re

    escaped = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)
    return f"(?i)(^|{NOT_WORD}){escaped}($|{NOT_WORD})"
