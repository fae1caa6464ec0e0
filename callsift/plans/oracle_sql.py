"""DuckDB SQL statements of the same semantics, used as the independent
correctness oracle (the driver runs them next to the Spark queries).

The rule tables are rendered as inline VALUES from the same built-in rule
rows the Spark side loads; the JSON columns are decoded with Python's json
module (a malformed rule is left out, as the Spark parser quarantines it).
Regexes use the RE2 spellings of the shared patterns.
"""

from __future__ import annotations

import json

from callsift.functions import patterns as P
from callsift.sources import ruleset


def q(v) -> str:
    """SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ",\n    ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(VALUES\n    {body}\n) AS t({', '.join(cols)})"


def parsed_keyword_rules(rows=None):
    out = []
    for ordinal, (rid, cat, sub, groups, forb) in enumerate(ruleset.KEYWORD_RULES if rows is None else rows):
        try:
            g = json.loads(groups)
            f = json.loads(forb) if forb is not None else []
            if not isinstance(g, list) or not all(isinstance(x, list) for x in g) or not isinstance(f, list):
                continue
        except ValueError:
            continue
        out.append((ordinal, rid, cat, sub, g, f))
    return out


def re2(p: str) -> str:
    return P.to_re2(p)


def clean_sql(x: str) -> str:
    ws = P.WS + "+"
    return (f"lower(trim(regexp_replace(regexp_replace(coalesce({x}, ''), {q(re2(P.SPEAKER_LABEL))}, ' ', 'g'), "
            f"{q(ws)}, ' ', 'g')))")


def redact_sql(x: str) -> str:
    for name, pat in P.PII_PATTERNS:
        x = f"regexp_replace({x}, {q(re2(pat))}, '<REDACTED_{name}>', 'g')"
    return x


def normalize_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), {q(P.WS + '+')}, ' ', 'g'))"


def pii_count_sqls(x: str) -> list[tuple[str, str]]:
    out = []
    cur = f"coalesce({x}, '')"
    for name, pat in P.PII_PATTERNS:
        out.append((name, f"CAST(len(regexp_extract_all({cur}, {q(re2(pat))})) AS BIGINT)"))
        cur = f"regexp_replace({cur}, {q(re2(pat))}, '<REDACTED_{name}>', 'g')"
    return out


def documents_src() -> str:
    return ("SELECT doc_id AS transcript_id, text AS transcript, source AS agent_name, "
            "CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS TIMESTAMP) AS ts FROM documents")


def classified_ctes(src_sql: str | None = None, program: str = "CCRE", threshold: float = 0.4,
                    rules=None, hierarchy=None) -> str:
    """CTEs ending in ``classified`` (superset schema, text columns kept)."""
    src_sql = src_sql or documents_src()
    parsed = parsed_keyword_rules(rules)
    rule_rows = [(o, rid, cat, sub, len(g)) for o, rid, cat, sub, g, f in parsed]
    slot_rows = []
    for o, rid, cat, sub, g, f in parsed:
        for gi, grp in enumerate(g):
            for ki, kw in enumerate(grp):
                if kw is not None:
                    slot_rows.append((o, gi, ki, kw, None))
        for ki, kw in enumerate(f):
            if kw is not None:
                slot_rows.append((o, -1, ki, kw, P.whole_word_regex_re2(kw.lower())))
    hier = ruleset.HIERARCHY if hierarchy is None else hierarchy
    hier_rows = [(i, *r) for i, r in enumerate(hier)]
    neg = q(P.negation_regex())
    thr = f"CAST({float(threshold)!r} AS DOUBLE)"
    return f"""
rules AS (SELECT * FROM {values(rule_rows, ['rule_ord', 'rule_id', 'category', 'subcategory', 'n_groups'])}),
slots AS (SELECT rule_ord, group_no, kw_no, keyword, lower(keyword) AS term, wb_re
          FROM {values(slot_rows, ['rule_ord', 'group_no', 'kw_no', 'keyword', 'wb_re'])}),
terms AS (SELECT term, bool_or(group_no >= 0) AS is_required, bool_or(group_no < 0) AS is_forbidden,
                 max(wb_re) AS wb_re FROM slots GROUP BY term),
hier AS (SELECT * FROM {values(hier_rows, ['hier_ord', 'Program', 'CatNo', 'L1', 'L2', 'L3', 'L4'])}),
hier_last AS (SELECT Program, CatNo, L1, L2, L3, L4 FROM hier
              QUALIFY row_number() OVER (PARTITION BY Program, CatNo ORDER BY hier_ord DESC) = 1),
src AS ({src_sql}),
prep AS (SELECT *, {redact_sql(clean_sql('transcript'))} AS redacted_transcript FROM src),
prep2 AS (SELECT *, {normalize_sql('redacted_transcript')} AS norm_text FROM prep),
hits AS (
  SELECT p.transcript_id, t.term, CAST(instr(p.norm_text, t.term) - 1 AS BIGINT) AS pos,
         CASE WHEN instr(p.norm_text, t.term) > 1 AND regexp_matches(
              substring(p.norm_text, greatest(instr(p.norm_text, t.term) - 50, 1),
                        (instr(p.norm_text, t.term) - 1) - greatest(instr(p.norm_text, t.term) - 51, 0)),
              {neg}) THEN 1 ELSE 0 END AS neg,
         coalesce(t.is_forbidden AND regexp_matches(p.norm_text, t.wb_re), FALSE) AS wb
  FROM prep2 p JOIN terms t ON p.norm_text <> '' AND contains(p.norm_text, t.term)),
slot_hits AS (SELECT h.transcript_id, s.rule_ord, s.group_no, s.kw_no, h.pos, h.neg, h.wb
              FROM hits h JOIN slots s ON h.term = s.term WHERE s.group_no >= 0 OR h.wb),
first_kw AS (SELECT transcript_id, rule_ord, group_no, min(kw_no) AS kw_no FROM slot_hits WHERE group_no >= 0
              GROUP BY transcript_id, rule_ord, group_no),
matched AS (SELECT f.*, h.pos, h.neg, s.keyword FROM first_kw f
            JOIN slots s USING (rule_ord, group_no, kw_no) JOIN hits h ON h.transcript_id = f.transcript_id AND h.term = s.term),
vetoes AS (SELECT DISTINCT transcript_id, rule_ord FROM slot_hits WHERE group_no < 0),
per_rule AS (SELECT transcript_id, rule_ord, count(*) AS matched_groups, min(pos) AS min_pos, max(pos) AS max_pos,
               sum(neg) AS n_neg, string_agg(keyword, ' | ' ORDER BY group_no) AS matched_keywords
             FROM matched ANTI JOIN vetoes USING (transcript_id, rule_ord) GROUP BY transcript_id, rule_ord),
scored AS (
  SELECT r.transcript_id, r.rule_ord, r.matched_groups, r.matched_keywords,
    greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE),
      (r.matched_groups / u.n_groups
       + CASE WHEN r.matched_groups >= 2 THEN
           CASE WHEN (r.max_pos - r.min_pos) / (r.matched_groups - 1) < 50 THEN CAST(0.2 AS DOUBLE)
                WHEN (r.max_pos - r.min_pos) / (r.matched_groups - 1) < 100 THEN CAST(0.15 AS DOUBLE)
                WHEN (r.max_pos - r.min_pos) / (r.matched_groups - 1) < 200 THEN CAST(0.1 AS DOUBLE)
                ELSE CAST(0.05 AS DOUBLE) END
         ELSE CAST(0.0 AS DOUBLE) END)
      - least(CAST(r.n_neg AS DOUBLE) * CAST(0.1 AS DOUBLE), CAST(0.3 AS DOUBLE)))) AS confidence
  FROM per_rule r JOIN rules u ON r.rule_ord = u.rule_ord),
kept AS (SELECT * FROM scored WHERE confidence >= CAST(0.4 AS DOUBLE)),
best AS (SELECT k.*, count(*) OVER (PARTITION BY transcript_id) AS n_act FROM kept k
         QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY confidence DESC, rule_ord) = 1),
ccre AS (
  SELECT p.transcript_id, p.transcript, p.redacted_transcript, p.agent_name, p.call_id, p.ts,
         p.norm_text = '' AS is_empty, b.rule_ord, u.rule_id, b.confidence AS ccre_conf,
         b.matched_keywords AS ccre_kws, CAST(coalesce(b.n_act, 0) AS INTEGER) AS num_rules_activated,
         b.matched_groups
  FROM prep2 p LEFT JOIN best b ON p.transcript_id = b.transcript_id
  LEFT JOIN rules u ON b.rule_ord = u.rule_ord),
ccre_h AS (
  SELECT c.*, h.L1, h.L2, h.L3, h.L4,
    coalesce(c.rule_id IS NOT NULL AND c.ccre_conf >= {thr} AND h.CatNo IS NOT NULL
             AND NOT (h.L1 IS NOT DISTINCT FROM 'Unclassified'), FALSE) AND NOT c.is_empty AS ok
  FROM ccre c LEFT JOIN (SELECT * FROM hier_last WHERE Program = {q(program)}) h ON c.rule_id = h.CatNo),
classified AS (
  SELECT transcript_id, transcript, redacted_transcript, agent_name, call_id, ts, rule_id,
    CASE WHEN ok THEN L1 ELSE 'Unclassified' END AS category,
    CASE WHEN ok THEN L2 ELSE 'No Match' END AS subcategory,
    CASE WHEN ok THEN L3 ELSE '' END AS tertiary,
    CASE WHEN ok THEN L4 ELSE '' END AS quaternary,
    CASE WHEN ok THEN rule_id ELSE 'UNCLASS' END AS cat_no,
    CASE WHEN ok THEN ccre_conf ELSE CAST(0.0 AS DOUBLE) END AS confidence,
    CASE WHEN ok THEN ccre_kws ELSE '' END AS matched_keywords,
    num_rules_activated,
    CASE WHEN ok THEN 'Highest confidence rule (matched ' || CAST(matched_groups AS VARCHAR) || ' groups)'
         WHEN is_empty THEN 'Empty transcript' ELSE 'No rules matched above threshold' END AS resolve_reason,
    CASE WHEN ok THEN 'ccre' ELSE 'none' END AS source,
    CASE WHEN ok THEN {q(program)} ELSE '' END AS program
  FROM ccre_h)"""


def with_classified(select_sql: str, **kw) -> str:
    return "WITH " + classified_ctes(**kw).strip() + "\n" + select_sql


def parsed_proximity_rules(rows=None):
    """(rule_ord, program, cat_no, terms, operators, max_distance, index_key)."""
    out = []
    for ordinal, r in enumerate(ruleset.PROXIMITY_RULES if rows is None else rows):
        prog, cat, t1, o1, t2, o2, t3, prox, within, _sent = r
        terms = [str(t).lower().strip() for t in (t1, t2, t3) if t is not None]
        if not terms:
            continue
        ops = [str(o).upper() for o in (o1, o2) if o is not None]
        p = int(float(prox)) if prox is not None else 0
        w = int(float(within)) if within is not None else 0
        d = w if w > 0 else p
        d = 5 if d == 0 else d
        keys = [t.split()[0] if " " in t else t for t in terms]
        words1 = terms[0].split()
        # Term1's key alone when it is Term1's first word (Term1 must occur);
        # otherwise every term's key, as the index holds them all.
        index = [keys[0]] if words1 and keys[0] == words1[0] else list(dict.fromkeys(keys))
        out.append((ordinal, prog, cat, terms, ops, d, index))
    return out


def proximity_sql(text_sql: str, program: str | None = None, rule_rows=None) -> str:
    """Best proximity match per text; ``text_sql`` yields (transcript_id, t)."""
    rows = []
    for o, prog, cat, terms, ops, d, index in parsed_proximity_rules(rule_rows):
        if program and prog != program:
            continue
        ts = terms + [None] * (3 - len(terms))
        os_ = ops + [None] * (2 - len(ops))
        for key in index:
            rows.append((o, prog, cat, len(terms), *ts, *os_, d, key, " | ".join(terms)))
    cols = ["rule_ord", "program", "cat_no", "n_terms", "t1", "t2", "t3", "o1", "o2", "d",
            "index_key", "matched_terms"]

    def words(t):
        return (f"(CASE WHEN {t} IS NULL OR trim(regexp_replace({t}, {q(P.WS + '+')}, ' ', 'g')) = '' "
                f"THEN []::VARCHAR[] ELSE string_split(trim(regexp_replace({t}, {q(P.WS + '+')}, ' ', 'g')), ' ') END)")

    def positions(t):
        w = words(t)
        return (f"(CASE WHEN len({w}) = 0 THEN range(0, len(tok) + 1) WHEN len(tok) >= len({w}) THEN "
                f"list_filter(range(0, len(tok) - len({w}) + 1), lambda i: tok[i + 1 : i + len({w})] = {w}) "
                f"ELSE []::BIGINT[] END)")

    def step(t, o, anchors):
        # Window tokens[p : min(p + d + k + 5, n)] with Python slice ends: a
        # negative end counts from the end of the list.
        end = f"least(p + d + len({words(t)}) + 5, len(tok))"
        end = f"(CASE WHEN {end} < 0 THEN greatest({end} + len(tok), 0) ELSE {end} END)"
        near = (f"coalesce(list_bool_or(list_transform({anchors}, lambda p: contains(array_to_string("
                f"tok[p + 1 : greatest({end}, p)], ' '), {t}))), FALSE)")
        return (f"(CASE coalesce({o}, 'NEAR') WHEN 'NEAR' THEN {near} "
                f"WHEN 'AND' THEN len({positions(t)}) > 0 WHEN 'OR' THEN TRUE "
                f"WHEN 'NOT' THEN len({positions(t)}) = 0 ELSE FALSE END)")

    return f"""
prules AS (SELECT * FROM {values(rows, cols)}),
ptext AS (SELECT transcript_id, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(t, ' ') END AS tok
          FROM ({text_sql}) x),
pkeys AS (SELECT DISTINCT transcript_id, unnest(tok) AS index_key FROM ptext),
pcand AS (SELECT p.transcript_id, p.tok, r.* FROM
          (SELECT DISTINCT k.transcript_id, r.rule_ord FROM pkeys k JOIN prules r ON k.index_key = r.index_key) c
          JOIN (SELECT DISTINCT * EXCLUDE (index_key) FROM prules) r ON r.rule_ord = c.rule_ord
          JOIN ptext p ON p.transcript_id = c.transcript_id),
pc1 AS (SELECT *, {positions('t1')} AS a1 FROM pcand),
pc2 AS (SELECT *, CASE WHEN n_terms >= 2 THEN {step('t2', 'o1', 'a1')} ELSE TRUE END AS m2,
               CASE WHEN n_terms >= 2 AND coalesce(o1, 'NEAR') = 'NEAR' THEN {positions('t2')} ELSE a1 END AS a2
        FROM pc1),
pc3 AS (SELECT *, CASE WHEN n_terms >= 3 THEN {step('t3', 'o2', 'a2')} ELSE TRUE END AS m3 FROM pc2),
pmatch AS (SELECT transcript_id, rule_ord, cat_no, matched_terms,
             CASE WHEN n_terms = 1 THEN CAST(0.95 AS DOUBLE)
                  ELSE least(CAST(0.9 AS DOUBLE) + CASE WHEN n_terms >= 3 THEN CAST(0.05 AS DOUBLE)
                             ELSE CAST(0.0 AS DOUBLE) END, CAST(0.98 AS DOUBLE)) END AS confidence
           FROM pc3 WHERE len(a1) > 0 AND m2 AND m3),
pbest AS (SELECT transcript_id, rule_ord AS rule_id, cat_no, confidence, matched_terms,
                 'proximity' AS source FROM pmatch
          QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY (confidence >= CAST(0.95 AS DOUBLE)) DESC,
                  CASE WHEN confidence >= CAST(0.95 AS DOUBLE) THEN CAST(0.0 AS DOUBLE) ELSE confidence END DESC,
                  rule_ord) = 1)"""


def prepared_docs_sql() -> str:
    return (f"SELECT doc_id AS transcript_id, {normalize_sql(redact_sql(clean_sql('text')))} AS t "
            "FROM documents")
