"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic-net
penalties, then temperature calibration.

Learning reads only text and language of the rows that the caller passes.
Document frequencies are counted over all of them. The weights are fitted on a
bounded sample: about SAMPLE_PER_LANG rows of each language, taken by hash
(whole texts); one sampled row in CALIBRATE sets the temperature instead.
Prediction reads whole texts.

Defined results: a null text, or one without any letter, is ``und`` with score
0; rows with a null language teach nothing; without any learned language every
text is ``und``; with one, it gets score 1; ties go to the language first in
order. Input columns named like an output are carried as ``<name>_input``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.textops import mix
from callsift.llm.work import lean, set_aside, slices

BITS = 15
ORDERS = (1, 2, 3)
SAMPLE_PER_LANG = 600
CALIBRATE = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-3
UNKNOWN = "und"
_P = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def char_ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of a text (lower case, white space as one
    space) and their counts."""
    c = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    count = np.zeros(1 << BITS, np.int64)
    for n in ORDERS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, np.uint64(n))
            for j in range(n):
                h += (c[j:len(c) - n + 1 + j] + np.uint64(1)) * _P[j]
            count += np.bincount((mix(h) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(count)
    return at, count[at]


def tf_idf(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    return x / np.linalg.norm(x)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # language x n-gram
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at, count = char_ngrams(text)
        return self.weights[:, at] @ tf_idf(at, count, self.idf) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(z.argmax())
        return self.languages[k], float(p[k] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, dims: int,
         seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after EPOCHS passes; rows: (places, values, class).
    The bias is a last, unpenalised coordinate of value 1."""
    z, n = np.zeros((classes, dims + 1)), np.zeros((classes, dims + 1))
    l1 = np.full(dims + 1, L1)
    l1[-1] = 0.0

    def solve(at):
        return -np.sign(z[:, at]) * np.maximum(np.abs(z[:, at]) - l1[at], 0) / ((BETA + np.sqrt(n[:, at])) / ALPHA + L2)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            at, x, k = rows[i]
            at, x = np.r_[at, dims], np.r_[x, 1.0]
            w = solve(at)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[k] -= 1.0
            g = p[:, None] * x
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    w = solve(np.arange(dims + 1))
    return w[:, :-1], w[:, -1]


def calibrate(logits: np.ndarray, k: np.ndarray) -> float:
    """The temperature of least log loss (golden-section search on its logarithm)."""
    if not len(k):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(k)), k]))

    low, high, r = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learn from (text, lang) rows; ``rows`` holds only what may be learned from."""
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        "text IS NOT NULL AND lang IS NOT NULL")
    dims = 1 << BITS

    def frequencies(batches):
        df = np.zeros(dims + 1, np.int64)  # the last counts documents
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                if has_letter(t):
                    df[char_ngrams(t)[0]] += 1
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int32()), "n": pa.array(df[at], pa.int64())})

    counts = (rows.select("text").mapInArrow(lean(frequencies), "place int, n long")
              .groupBy("place").agg(F.sum("n").alias("n")).collect())
    df = np.zeros(dims + 1)
    for r in counts:
        df[r["place"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((0, dims)), np.zeros(0), 1.0)

    # one row per language
    share = rows.sparkSession.createDataFrame(
        [(k, int(min(1.0, sample_per_lang / n) * (1 << 30))) for k, n in sizes.items()], "lang string, share long")
    order = F.pmod(F.xxhash64("text", "lang", F.monotonically_increasing_id()), F.lit(1 << 30))
    picked = rows.withColumn("o", order).join(F.broadcast(share), "lang").filter("o < share").select("lang", "text", "o")

    def places(batches):
        for b in batches:
            some = [char_ngrams(t) if has_letter(t) else (np.zeros(0, np.int64),) * 2 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "lang": b.column("lang"), "o": b.column("o"),
                "at": pa.array([a.astype("<i4").tobytes() for a, _ in some], pa.binary()),
                "n": pa.array([c.astype("<i4").tobytes() for _, c in some], pa.binary())})

    def train(p: pd.DataFrame) -> pd.DataFrame:
        p = p[p["at"].str.len() > 0].sort_values(["o", "lang"], kind="stable")
        data = []
        for lang, a, c in zip(p["lang"], p["at"], p["n"], strict=True):
            at = np.frombuffer(a, "<i4").astype(np.int64)
            data.append((at, tf_idf(at, np.frombuffer(c, "<i4"), idf), languages.index(lang)))
        held = data[::CALIBRATE]
        w, bias = ftrl([x for i, x in enumerate(data) if i % CALIBRATE] or data, len(languages), dims)
        z = np.array([w[:, at] @ x + bias for at, x, _ in held])
        return pd.DataFrame({"w": [w.tobytes()], "bias": [bias.tobytes()],
                             "t": [calibrate(z, np.array([k for *_, k in held], np.int64))]})

    got = (picked.mapInArrow(places, "lang string, o long, at binary, n binary").withColumn("one", F.lit(1))
           .groupBy("one").applyInPandas(lambda p: train(p.drop(columns="one")), "w binary, bias binary, t double").collect())
    if not got:
        return Model([], idf, np.zeros((0, dims)), np.zeros(0), 1.0)
    return Model(languages, idf, np.frombuffer(got[0]["w"]).reshape(len(languages), dims),
                 np.frombuffer(got[0]["bias"]), got[0]["t"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The input's columns with lang_pred and score."""
    docs = set_aside(docs, {"lang_pred", "score"})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches):
            got = [m.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                [*b.schema.names, "lang_pred", "score"])

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(lean(run), typed.withColumns(
        {"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
