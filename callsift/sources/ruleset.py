"""Built-in rule tables.

The reference loads its keyword rules, category hierarchy and proximity rules
from CSV files that are not published, so these are our own tables, written
for the synthetic test corpus (multilingual syllable text). They play the
role of the default CSVs: same columns, same JSON-in-string encoding. Every
query reads them next to the data tables; they are configuration, not data.

``large_keyword_rules(n)`` generates a rule base of any size from a
deterministic rule (for the benchmark, which the reference quotes at ~2,000
rules).
"""

from __future__ import annotations

import json

PROGRAM = "CCRE"

# rule_id, category, subcategory, required_groups (JSON), forbidden_terms (JSON or None)
KEYWORD_RULES = [
    ("R01", "Billing", "Refund Request", '[["refund", "money back"], ["bill"]]', None),
    ("R02", "Billing", "Invoice Question", '[["invoice", "bill"]]', '["manager"]'),
    ("R03", "Account", "Close Account", '[["close"], ["account"]]', None),
    ("R04", "Account", "Security", '[["token"], ["secret", "password", "key"]]', None),
    ("R05", "Legal", "License Terms", '[["license"]]', '["token"]'),
    ("R06", "General", "English Chatter", '[["the"], ["and"], ["that"]]', None),
    ("R07", "General", "English Narrative", '[["was"], ["for"], ["with"], ["from"]]', '["license"]'),
    ("R08", "General", "English Grammar", '[["ing th", "tion"], ["this", "are"]]', None),
    ("R09", "Language", "French", '[["eau"], ["aux", "elle"], ["ment"]]', None),
    ("R10", "Language", "German", '[["ein"], ["sch", "ung"], ["nicht"]]', None),
    ("R11", "Language", "Spanish", '[["ción"], ["los", "para"]]', '["token"]'),
    ("R12", "Language", "Spanish Negation", '[["no "], ["ción"], ["los"]]', None),
    ("R13", "Orphan", "Not In Hierarchy", '[["thor"], ["wh"], ["sh"]]', None),
    ("R14", "Technical", "Contact Details", '[["<redacted_email>", "<redacted_phone_us>"]]', None),
    ("R15", "Technical", "Card On File", '[["<redacted_credit_card>", "<redacted_aadhaar>"], ["card", "the"]]', None),
    ("R16", "General", "Short Words", '[["an"], ["in"], ["on"], ["of"], ["is"]]', '["was"]'),
    ("R17", "Complaint", "Repeated", '[["ere"], ["ent"], ["ion"], ["tha"]]', '["the"]'),
    ("R18", "Complaint", "Escalation", '[["que"], ["ier"], ["oi"]]', '["le", "la"]'),
    ("R19", "General", "Empty Keyword", '[[""], ["zzqx"]]', None),
    ("R20", "Malformed", "Broken JSON", '[["refund", ["bill"]', None),
    ("R21", "Language", "German Articles", '[["der"], ["die"], ["das"], ["und"]]', '["ein"]'),
    ("R22", "Language", "French Articles", '[["les"], ["des"], ["une"]]', None),
    ("R23", "Technical", "Network", '[["ip"], ["152."], ["###"]]', None),
    ("R24", "Account", "Duplicate Groups", '[["the"], ["the"], ["xqz"]]', None),
]

# Program, CatNo, L1, L2, L3, L4  (R05 appears twice: the later row wins;
# R13 is deliberately missing; the PNC rows exercise program filters)
HIERARCHY = [
    ("CCRE", "R01", "Billing", "Refunds", "Refund Request", "Full Refund"),
    ("CCRE", "R02", "Billing", "Invoices", "Invoice Question", "Line Items"),
    ("CCRE", "R03", "Account", "Lifecycle", "Close Account", "Voluntary"),
    ("CCRE", "R04", "Account", "Security", "Credentials", "Token Exposure"),
    ("CCRE", "R05", "Legal", "Licensing", "Old Terms", "Superseded"),
    ("CCRE", "R06", "General", "Chatter", "English", "Function Words"),
    ("CCRE", "R07", "General", "Narrative", "English", "Past Tense"),
    ("CCRE", "R08", "General", "Grammar", "English", "Suffixes"),
    ("CCRE", "R09", "Language", "Romance", "French", "Vowels"),
    ("CCRE", "R10", "Language", "Germanic", "German", "Clusters"),
    ("CCRE", "R11", "Language", "Romance", "Spanish", "Suffixes"),
    ("CCRE", "R12", "Language", "Romance", "Spanish", "Negation"),
    ("CCRE", "R14", "Technical", "Privacy", "Contact Details", "Redacted"),
    ("CCRE", "R15", "Technical", "Privacy", "Card On File", "Redacted"),
    ("CCRE", "R16", "General", "Chatter", "English", "Short Words"),
    ("CCRE", "R17", "Complaint", "Quality", "Repeated", "Fragments"),
    ("CCRE", "R18", "Complaint", "Quality", "Escalation", "Fragments"),
    ("CCRE", "R19", "General", "Chatter", "Empty", "Keyword"),
    ("CCRE", "R05", "Legal", "Licensing", "License Terms", "Current"),
    ("CCRE", "R21", "Language", "Germanic", "German", "Articles"),
    ("CCRE", "R22", "Language", "Romance", "French", "Articles"),
    ("CCRE", "R23", "Technical", "Network", "Addresses", "IPv4"),
    ("CCRE", "R24", "Account", "Lifecycle", "Duplicates", "Same Keyword"),
    ("PNC", "P01", "Billing", "Refunds", "Refund Request", "Partial"),
    ("PNC", "P02", "Account", "Security", "Fraud", "Card"),
    ("PNC", "P03", "Account", "Security", "Fraud", "Online"),
]

# Program, CatNo, Term1, Operator1, Term2, Operator2, Term3, Proximity, WithinWords, SentBy
PROXIMITY_RULES = [
    ("CCRE", "R06", "the", None, None, None, None, None, None, None),
    ("CCRE", "R07", "was", "NEAR", "for", None, None, None, 3.0, "AGENT"),
    ("CCRE", "R08", "and", "NEAR", "the", "NEAR", "of", 4.0, None, None),
    ("CCRE", "R16", "it is", "AND", "that", None, None, None, None, None),
    ("CCRE", "R09", "de", "NEAR", "la", None, None, 2.0, None, None),
    ("CCRE", "R09", "les", "OR", "des", None, None, None, None, None),
    ("CCRE", "R10", "die", "NOT", "der", None, None, None, None, None),
    ("CCRE", "R10", "der", "NEAR", "die", "AND", "und", None, 6.0, None),
    ("CCRE", "R11", "de", "NEAR", "los", None, None, None, None, None),
    ("CCRE", "R12", "no", "NEAR", "de", None, None, None, 1.0, None),
    ("CCRE", "R17", "of the", "NEAR", "and", None, None, None, 2.0, None),
    ("CCRE", "R18", "que", "XOR", "le", None, None, None, None, None),
    ("CCRE", "R22", "une", "NOT", "la", "NOT", "le", None, None, None),
    ("CCRE", "R23", "for", "AND", "from", "NEAR", "the", None, None, None),
    ("CCRE", "R21", " Und ", "NEAR", "Das", None, None, None, 5.0, None),
    ("CCRE", "R24", None, "NEAR", "the", None, None, None, None, None),
    ("PNC", "P01", "the", "NEAR", "and", None, None, None, None, None),
    ("PNC", "P02", "ein", None, None, None, None, None, None, None),
]

# example_phrase, category, subcategory, tertiary_category, confidence
USER_EXAMPLES = [
    ("that and onesen erblest", "General", "Chatter", "Phrase", None),
    ("the of", "General", "Chatter", "Bigram", 0.9),
    ("In nicht ü einachie.", "Language", "German", "Turn", None),
    ("Que la. Anéç équeellech.", "Language", "French", "Turn", 0.8),
    ("  Le   de  ", "Language", "French", "Articles", None),
    ("zzqx never appears", "None", None, None, None),
    ("in nicht u einachie", "Language", "German", "Near Turn", 0.9),
    ("que la anec equeellech", "Language", "French", "Near Turn", None),
    ("Et laouèelleê pa", "Language", "French", "Opening", None),
]


def large_keyword_rules(n: int, seed_words: list[str] | None = None) -> list[tuple]:
    """A deterministic rule base of ``n`` rules built from a syllable list.

    Rule i uses 1-4 groups of 1-3 keywords, each keyword a syllable or a pair
    of syllables, chosen by arithmetic on i, plus an occasional forbidden
    word. Frequencies span common to rare, as in a real rule base."""
    syl = seed_words or [
        "the", "and", "ing", "tion", "ent", "ere", "tha", "wh", "sh", "thor",
        "eau", "aux", "elle", "ment", "que", "ier", "oi", "ch", "ein", "sch",
        "ung", "ich", "ción", "los", "para", "ado", "ente", "der", "die", "das",
        "ou", "an", "en", "re", "le", "la", "de", "ti", "nd", "st",
    ]
    words = ["the", "and", "was", "for", "la", "le", "der", "die", "los", "de"]
    out = []
    m = len(syl)
    for i in range(n):
        n_groups = 1 + (i * 7) % 4
        groups = []
        for g in range(n_groups):
            kws = []
            for k in range(1 + (i + g) % 3):
                a = syl[(i * 13 + g * 5 + k * 3) % m]
                b = syl[(i * 17 + g * 11 + k * 7 + 1) % m]
                kws.append(a + b if (i + g + k) % 3 else a)
            groups.append(kws)
        forb = [words[i % len(words)]] if i % 5 == 0 else None
        out.append((
            f"G{i:05d}", f"Cat{i % 37:02d}", f"Sub{i % 101:03d}",
            json.dumps(groups), json.dumps(forb) if forb else None,
        ))
    return out


def large_hierarchy(rules: list[tuple]) -> list[tuple]:
    return [
        (PROGRAM, r[0], r[1], r[2], f"T{i % 7}", f"Q{i % 3}")
        for i, r in enumerate(rules)
    ]


def wide_keyword_rules(n: int, seed: int = 7) -> list[tuple]:
    """A rule base of ``n`` rules over thousands of distinct keywords, as a
    real rule base has: keywords are two or three consonant-vowel syllables
    drawn by a seeded generator (frequent to rare in the corpus), 1-4 groups
    of 1-3 keywords, an occasional forbidden keyword."""
    import random

    rnd = random.Random(seed)
    syl = [c + v for c in "bcdfghlmnprstv" for v in "aeiou"]

    def word():
        return "".join(rnd.choice(syl) for _ in range(rnd.choice((2, 2, 3))))

    out = []
    for i in range(n):
        groups = [[word() for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 4))]
        forb = [word()] if rnd.random() < 0.2 else None
        out.append((f"W{i:05d}", f"Cat{i % 37:02d}", f"Sub{i % 101:03d}",
                    json.dumps(groups), json.dumps(forb) if forb else None))
    return out
