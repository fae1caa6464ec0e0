"""Quality scores by positive-unlabelled learning.

A small network scores a document from properties of its whole text (bytes by
kind, words, repetitions, lines). It minimises the non-negative unbiased risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

with the logistic loss; where the second part turns negative, the step goes
against it (the usual correction that stops it from memorising the positives).
Trusted positives are documents labelled 1, the unlabelled ones have no label.
The class prior is the smoothed share of label 1 among the labels that may be
read. The fit uses a bounded sample, about POSITIVES and UNLABELLED documents
taken by hash (whole texts); scores come from whole texts of all documents.

Defined results: a null or empty text is scored by the properties of an empty
text; texts are read whole, whatever their length; rows with the same id teach once; repeated labels of a document count as
their smallest; without any
trusted positive every score is the prior's (0.5 with no label at all); without
unlabelled documents the positives' marginal stands in.
Input columns named like an output are carried as ``<name>_input``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.textops import gram_hashes, word_hashes, word_spans
from callsift.llm.work import set_aside

POSITIVES, UNLABELLED = 6000, 12000
HIDDEN = 24
STEPS, RATE, DECAY = 600, 0.01, 1e-4

# Kinds of bytes whose shares are properties of a text.
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",", b"!", b"?", b"|",
          b"*&%$#@^~<>{}[]\\/=+_", b":;'\"()-", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 160)), bytes(range(160, 192)),
          bytes(range(192, 256))]
_KIND = np.full(256, len(_KINDS), np.int64)
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k
_LETTER = np.zeros(256, bool)
_LETTER[list(_KINDS[0] + _KINDS[1]) + list(range(128, 256))] = True
_UPPER = _KIND == 0


def properties(text: str | None) -> np.ndarray:
    """About 30 numbers that describe a text, most of them shares."""
    data = (text or "").encode()
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=len(_KINDS) + 1) / max(1, len(raw))
    starts, ends = word_spans(data)
    n = len(starts)
    if not n:
        return np.r_[kinds, np.zeros(17)]
    words = word_hashes(data, starts, ends)
    size = ends - starts
    _, times = np.unique(words, return_counts=True)
    pairs, fives = gram_hashes(words, 2), gram_hashes(words, 5)
    last, first = raw[ends - 1], raw[starts]
    lines = [x for x in data.split(b"\n") if x.strip()]
    per_line = n / len(lines)
    return np.r_[kinds, [
        np.log1p(n), np.log1p(len(raw)), size.mean() / 10, size.std() / 10, (size > 20).mean(),
        len(times) / n, len(times) / np.sqrt(n) / 10, times.max() / n,
        (words[1:] == words[:-1]).mean() if n > 1 else 0.0,
        len(np.unique(pairs)) / len(pairs) if len(pairs) else 1.0,
        len(np.unique(fives)) / len(fives) if len(fives) else 1.0,
        _UPPER[first].mean(), (~_LETTER[last]).mean(), (~_LETTER[first]).mean(),
        len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(per_line)]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """One hidden layer over standardised properties."""

    def __init__(self, center: np.ndarray, spread: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.center, self.spread = center, spread
        self.p = [rng.normal(0, 1 / np.sqrt(len(center)), (len(center), HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip((x - self.center) / self.spread, -8, 8)
        return x, np.tanh(x @ self.p[0] + self.p[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.hidden(x)[1] @ self.p[2] + self.p[3][0])

    def gradient(self, x: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
        """Of sum(by * g(x))."""
        x, h = self.hidden(x)
        back = by[:, None] * self.p[2] * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ by, np.array([by.sum()])]


def train(pos: np.ndarray, unl: np.ndarray, prior: float) -> Network:
    """Adam on the non-negative risk, whole samples at once."""
    every = np.concatenate([pos, unl])
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-3)
    m, v = ([np.zeros_like(p) for p in net.p] for _ in range(2))
    for t in range(1, STEPS + 1):
        sp, su = net.score(pos), net.score(unl)
        # loss(g) = -log sigmoid(g); loss(-g) = -log(1 - sigmoid(g))
        negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        up = net.gradient(pos, -prior * (1 - sp) / len(pos))
        down = [a + b for a, b in zip(net.gradient(unl, su / len(unl)), net.gradient(pos, -prior * sp / len(pos)), strict=True)]
        grad = [a + b for a, b in zip(up, down, strict=True)] if negative >= 0 else [-b for b in down]
        for k, g in enumerate(grad):
            g = g + DECAY * net.p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            net.p[k] = net.p[k] - RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """(network or None, prior) from documents (doc_id, text) and labels
    (doc_id, quality); both hold only what may be learned from."""
    labels = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
              .agg(F.min("quality").alias("quality")))
    n = labels.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("p")).first()
    ones = n["p"] or 0
    prior = (ones + 1) / (n["n"] + 2)
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    free = ids.join(labels, "doc_id", "left_anti")
    n_free = free.count()
    if not ones:
        return None, prior if n["n"] else 0.5

    def some(df: DataFrame, total: int, want: int, pos: bool) -> DataFrame:
        share = int(min(1.0, want / max(1, total)) * (1 << 30))
        return df.select("doc_id", F.lit(pos).alias("pos")).filter(
            F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)

    # about ``positives`` + ``unlabelled`` ids
    picked = some(labels.filter("quality = 1"), ones, positives, True).unionByName(
        some(free if n_free else ids, n_free or ones, unlabelled, False)).distinct()

    def describe(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "pos": b.column("pos"),
                "x": pa.array([properties(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
            .mapInArrow(describe, f"doc_id {kind}, pos boolean, x binary").dropDuplicates(["doc_id", "pos"]))

    def learn(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["doc_id", "x"], kind="stable")
        x = np.frombuffer(b"".join(p["x"].tolist())).reshape(len(p), -1)
        pos = p["pos"].to_numpy(bool)
        if not pos.any() or pos.all():
            return pd.DataFrame({"part": pd.Series([], dtype="str"), "v": pd.Series([], dtype="object")})
        net = train(x[pos], x[~pos], prior)
        parts = [net.center, net.spread, *net.p]
        return pd.DataFrame({"part": [str(k) for k in range(len(parts))], "v": [np.ascontiguousarray(a).tobytes() for a in parts]})

    got = {r["part"]: np.frombuffer(r["v"]) for r in rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
        lambda p: learn(p.drop(columns="one")), "part string, v binary").collect()}
    if not got:
        return None, prior
    net = Network(got["0"], got["1"])
    net.p = [got["2"].reshape(-1, HIDDEN), got["3"], got["4"], got["5"]]
    return net, prior


def score(docs: DataFrame, model) -> DataFrame:
    """The input's columns with the score (0 to 1, higher: likelier good)."""
    docs = set_aside(docs, {"score"})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net, prior = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            got = net.score(np.array([properties(t) for t in texts])) if net and texts else np.full(len(texts), prior)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, "score"])

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(run, typed.withColumn("score", F.lit(0.0)).schema)
