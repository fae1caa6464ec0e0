import math

import numpy as np
import pytest

from callsift.llm import block_topk, spherical_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, seed, copies=30, d=12):
    """Clustered vectors with near and exact copies, ties and unusable rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 2 * rng.normal(size=(5, d))[rng.integers(0, 5, n)]
    for i in range(copies):
        x[n - 1 - i] = x[i % 7] + (0.0 if i % 3 == 0 else 0.08) * rng.normal(size=d)
    rows = [(i, [float(np.float32(v)) for v in r], int(i % 2)) for i, r in enumerate(x)]
    d0 = [0.0] * d
    rows += [(9001, None, 0), (9002, [], 0), (9003, d0, 1), (9004, [None] + d0[1:], 1),
             (9005, [math.nan] + d0[1:], 0), (9006, [math.inf] + d0[1:], 0), (9007, rows[0][1], None),
             (9050, [1.0, 2.0], 0), (None, rows[3][1], rows[3][2]), rows[4], (9008, [2 * v for v in rows[1][1]], 1)]
    return rows


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, every, k):
    """Every row is a candidate, also one equal to another; of each query row the k best."""
    rows = [(i, np.floor(256 * np.array(v, float))) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in rows:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_top_k_equals_brute_force(frame, shard_rows):
    rows = vectors(400, 3)
    got = [tuple(r) for r in block_topk.top_k(frame(rows, SCHEMA), every=10, shard_rows=shard_rows, block_rows=16).collect()]
    assert sorted(got) == brute_top(rows, 10, 5)


@pytest.mark.parametrize("shard_rows", [8192, 3])
def test_repeated_rows_are_candidates_each(frame, shard_rows):
    rows = [(i, [1.0 - i / 100, 0.5], 0) for i in range(1, 10)] + [(50, [1.0, 1.0], 0), (7, [9.0, 9.0], 0), (7, [9.0, 9.0], 1)]
    got = sorted(tuple(r) for r in block_topk.top_k(frame(rows, SCHEMA), shard_rows=shard_rows, block_rows=2).collect())
    assert got == brute_top(rows, 50, 5) and [r[2] for r in got][:3] == [7, 7, 1]


def test_top_k_of_few_rows(frame):
    rows = [(50, [1.0, 1.0], 0), (1, [0.5, -0.5], 0), (0, [0.25, 0.25], 1)]
    assert sorted(tuple(r) for r in block_topk.top_k(frame(rows, SCHEMA)).collect()) == brute_top(rows, 50, 5)
    assert block_topk.top_k(frame([], SCHEMA)).collect() == []


def brute_links(rows, t):
    ok = [(n, i, np.array(v, float), lab) for n, (i, v, lab) in enumerate(rows)
          if lab is not None and usable(v) and any(v)]
    near = {n: set() for n in range(len(rows))}
    for n, _, a, la in ok:
        for m, _, b, lb in ok:
            if n != m and la == lb and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= t:
                near[n].add(m)
    out = []
    for n, (i, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        low = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i, len(near[n]), low, i is not None and i == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell_nodes,block", [(4096, 1024), (40, 16), (15, 8)])
def test_near_duplicates_equal_brute_force(frame, cell_nodes, block):
    rows = vectors(220, 5, copies=60)
    got = spherical_dedup.near_duplicates(frame(rows, SCHEMA), cell_nodes=cell_nodes, block_rows=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_links(rows, 0.93)


def test_no_vectors(frame):
    assert spherical_dedup.near_duplicates(frame([], SCHEMA)).collect() == []
