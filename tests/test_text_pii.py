from pyspark.sql import functions as F

import model
from callsift.functions import pii, text


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("y")).first()["y"]


def test_clean_golden(spark):
    s = "[00:00:05 AGENT]: Hello  THERE [00:00:09 customer]: hi [0:00:01 AGENT]: x"
    assert one(spark, text.clean_transcript("x"), s) == \
        "hello there [00:00:09 customer]: hi [0:00:01 agent]: x"
    for v in (None, "", "   "):
        assert one(spark, text.clean_transcript("x"), v) == ""


PII_CASES = [
    ("card 4111 1111 1111 1111", "card <REDACTED_AADHAAR> 1111"),
    ("card 4111-1111-1111-1111", "card <REDACTED_CREDIT_CARD>"),
    ("card 4111111111111111", "card <REDACTED_CREDIT_CARD>"),
    ("acct #1234567890", "acct #<REDACTED_PHONE_US>"),
    ("acct 12345678", "<REDACTED_ACCOUNT>"),
    ("(555) 123-4567", "(<REDACTED_PHONE_US>"),
    ("+1 555 123 4567", "+<REDACTED_PHONE_US>"),
    ("123-45-6789", "<REDACTED_SSN>"),
]


def test_pii_golden(spark):
    for src, want in PII_CASES:
        assert one(spark, pii.redact("x"), src) == want, src
        assert model.redact(src) == want


def test_pii_url_after_email(spark):
    got = one(spark, pii.redact("x"), "http://a@b.com/x")
    assert got == model.redact("http://a@b.com/x")
    c = pii.pii_counts(spark.createDataFrame([("http://a@b.com/x",)], "x string"), "x").first()
    assert c["EMAIL"] == 1


def test_pii_matches_python_on_documents(spark):
    from paths import SF
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text",
                                                               pii.redact("text").alias("r")).collect()
    bad = [r.doc_id for r in d if model.redact(r.text) != r.r]
    assert not bad


def test_redaction_idempotent(spark):
    from paths import SF
    d = spark.read.parquet(f"{SF}/documents.parquet").select(pii.redact("text").alias("r"))
    assert d.filter(pii.redact("r") != F.col("r")).count() == 0


def test_pii_pretest_is_exact():
    """A text any pattern matches (at any stage of the chain) holds an '@',
    'http' or a decimal digit, so skipping texts without them is exact."""
    import random
    import re

    from callsift.functions.patterns import PII_PATTERNS
    rnd = random.Random(3)
    alphabet = list("ab@.-:/#() +") + ["http", "https://", "acct", "Account", "1", "9", "٣", "x.com"]
    pats = [re.compile(p) for _, p in PII_PATTERNS]
    hits = 0
    for _ in range(20000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        guard = "@" in s or "http" in s or any(ch.isdecimal() for ch in s)
        x = s
        for (name, _), p in zip(PII_PATTERNS, pats):
            if p.search(x):
                hits += 1
                assert guard, (name, s)
            x = p.sub(f"<REDACTED_{name}>", x)
        if not guard:
            assert x == s
    assert hits > 1000
