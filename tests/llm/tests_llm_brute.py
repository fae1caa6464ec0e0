"""Brute-force versions that several tests share."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np

from callsift.llm.queries import tokenizer_path


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_repeats(rows, size):
    seen = defaultdict(list)
    texts = [words_of(r[1]) for r in rows]
    for d, ws in enumerate(texts):
        for p in range(len(ws) - size + 1):
            seen[tuple(ws[p:p + size])].append((d, p))
    gone = [np.zeros(len(ws), bool) for ws in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p:p + size] = True
    return [(r[0], len(ws), int(g.sum()), hashlib.sha256(" ".join(w for w, x in zip(ws, g) if not x).encode()).hexdigest())
            for r, ws, g in zip(rows, texts, gone)]


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


def brute_poisson(rate, u):
    n, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        n += 1
        p *= rate / n
        c += p
    return n
