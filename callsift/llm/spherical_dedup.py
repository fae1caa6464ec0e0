"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

1. Equal unit vectors of a label are one node with a multiplicity (a hot vector
   never meets itself).
2. Labels get k centroids (one for CELL_NODES nodes, two at least), fitted by
   spherical k-means on a bounded sample of their nodes. Every node is assigned
   to its nearest centroid. Labels of few nodes are one cell: up to LEAST_NODES,
   or what a MAX_CELLS-th of all nodes is (so the centroids stay few).
3. Two unit vectors with cosine >= t are at most c = sqrt(2 - 2t) apart. If
   they fall into different cells, the sum of their distances from the plane
   between the two centroids is at most c, so one of them is within c / 2 of
   it. A node therefore also visits each cell whose plane is that near, and no
   pair is lost (recall 1, whatever the centroids).
4. The members of a cell are cut into blocks; each pair of blocks is one small
   task that multiplies them. It returns counts per node and, for the groups,
   a spanning forest of its links, never the pairs.
5. Connected components of the forests; the smallest id of a group is kept.

Defined results: only equal, non-null labels are compared; vectors that are
null, empty, zero or hold null or non-finite components link with nothing (a
group of their own); vectors of different lengths do not link; rows with the
same id are separate rows; a null id is never the smallest unless it is alone
(component_id null, kept false); an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.components import components
from callsift.llm.vectors import stack, usable
from callsift.llm.work import Work

COSINE = 0.93
# Nodes that a cell should hold, nodes of a label that is not cut, cells of all
# labels together (about), sampled nodes per centroid, rows of a block.
CELL_NODES = 4096
LEAST_NODES = 32
MAX_CELLS = 4096
SAMPLE_PER_CELL = 32
BLOCK_ROWS = 1024


def unit_vectors(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v): v is the unit vector as float64 bytes, null if the
    row can link with nothing."""

    def run(batches):
        for b in batches:
            values, length, ok = usable(b.column("v"))
            ends = np.cumsum(length)
            lab = np.asarray(b.column("label").is_valid().to_numpy(zero_copy_only=False), bool)
            out: list[bytes | None] = []
            for r in range(b.num_rows):
                v = values[ends[r] - length[r]:ends[r]]
                big = np.abs(v).max() if ok[r] and lab[r] and len(v) else 0.0
                if not big:
                    out.append(None)
                    continue
                v = v / big if not 1e-100 < big < 1e100 else v  # squares stay in range
                # + 0.0: a negative zero would make equal vectors differ in bytes
                out.append((v / math.sqrt(float(v @ v)) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "v"])

    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"),
                         F.col(vector).cast("array<double>").alias("v"))
    kinds = dict(src.dtypes)
    return src.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary")


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit rows x; starts from rows spread over the sample."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return np.unique(c, axis=0)


def _forest(links: np.ndarray) -> np.ndarray:
    """For each node of a boolean link matrix (symmetric), the smallest index
    of its group."""
    root = np.arange(len(links))
    r, c = np.nonzero(links)
    while len(r):
        new = root.copy()
        np.minimum.at(new, r, root[c])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def links(nodes: DataFrame, cosine: float, work: Work, cell_nodes: int = CELL_NODES,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v, n): v null and n links of node u counted in one pair of blocks,
    or n null and an edge (u, v) of a spanning forest. ``nodes``: node, label,
    dim, mult, v."""
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    total = nodes.count()
    cell = max(cell_nodes, -(-total // MAX_CELLS))
    k = F.greatest(F.ceil(F.col("n") / cell), F.lit(2)).cast("int")
    # at most MAX_CELLS labels, so about three times as many centroids
    wide = sizes.filter(F.col("n") > max(min(LEAST_NODES, cell_nodes), -(-total // MAX_CELLS))).withColumn("k", k)
    centroids: dict[tuple, np.ndarray] = {}
    if not wide.isEmpty():
        kinds = dict(nodes.dtypes)

        def fit(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            x = stack(p.sort_values("node")["v"].tolist(), "<f8")
            c = spherical_kmeans(x, int(p["k"].iloc[0]))
            return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "c": [c.tobytes()]})

        picked = nodes.join(F.broadcast(wide), ["label", "dim"]).filter(
            F.pmod(F.xxhash64("node"), F.lit(1 << 20)) <= F.col("k") * SAMPLE_PER_CELL / F.col("n") * (1 << 20))
        for r in picked.groupBy("label", "dim").applyInPandas(
                fit, f"label {kinds['label']}, dim int, c binary").collect():
            centroids[(r["label"], r["dim"])] = np.frombuffer(r["c"], "<f8").reshape(-1, r["dim"])
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)
    margin = math.sqrt(2 - 2 * cosine) / 2 * (1 + 1e-9) + 1e-9

    def assign(batches):
        for b in batches:
            lab, dim = b.column("label").to_pylist(), b.column("dim").to_pylist()
            v = b.column("v").to_pylist()
            by: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(lab, dim, strict=True)):
                by.setdefault(key, []).append(i)
            row, at, home, seen = [], [], [], []
            for key, own in by.items():
                c = shared.value.get(key)
                if c is None or len(c) < 2:
                    row += own
                    at += [0] * len(own)
                    home += [0] * len(own)
                    seen += [[0]] * len(own)
                    continue
                apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-24))
                sims = stack([v[i] for i in own], "<f8") @ c.T
                first = sims.argmax(axis=1)
                far = (sims[np.arange(len(own)), first][:, None] - sims) / apart[first]
                visit = far <= margin
                visit[np.arange(len(own)), first] = True
                for i, f, cells in zip(own, first.tolist(), map(np.flatnonzero, visit), strict=True):
                    cells = cells.tolist()
                    row += [i] * len(cells)
                    at += cells
                    home += [f] * len(cells)
                    seen += [cells] * len(cells)
            t = pa.Table.from_batches([b]).take(pa.array(row, pa.int64()))
            t = t.append_column("cell", pa.array(at, pa.int32())).append_column("home", pa.array(home, pa.int32()))
            yield from t.append_column("seen", pa.array(seen, pa.list_(pa.int32()))).to_batches()

    kinds = dict(nodes.dtypes)
    members = work.table(nodes.select("node", "label", "dim", "mult", "v").mapInArrow(
        assign, f"node long, label {kinds['label']}, dim int, mult long, v binary, cell int, home int, seen array<int>"),
        "members")
    # one row per cell, at most MAX_CELLS plus one per label
    blocks = members.groupBy("label", "dim", "cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    dealt = (members.join(blocks, ["label", "dim", "cell"])
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "dim", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "node", "mult", "v", "home", "seen"))

    def meet(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = key[2], key[3], key[4]
        p = p.sort_values(["own", "node"], kind="stable")
        own, node, mult = (p[c].to_numpy() for c in ("own", "node", "mult"))
        x = stack(p["v"].tolist(), "<f8")
        link = x @ x.T >= cosine
        link = link | link.T
        np.fill_diagonal(link, False)
        if i != j:  # within a block: the task (i, i) counts it
            link &= own[:, None] != own[None, :]
        home = p["home"].to_numpy()
        link &= (home[:, None] == cell) | (home[None, :] == cell)
        # a pair that meets in both its cells is counted in the smaller
        r, c = np.nonzero(link & (home[:, None] == cell) & (home[None, :] != cell))
        seen = [set(s.tolist()) for s in p["seen"]]
        for a, b in zip(r.tolist(), c.tolist(), strict=True):
            if home[b] < cell and home[b] in seen[a]:
                link[a, b] = link[b, a] = False
        n = link @ mult
        root = _forest(link)
        has, off = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({
            "u": np.r_[node[has], node[off]], "v": pd.array([None] * len(has) + node[root[off]].tolist(), "Int64"),
            "n": pd.array(n[has].tolist() + [None] * len(off), "Int64")})

    return dealt.groupBy("label", "dim", "cell", "i", "j").applyInPandas(meet, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector: str = "embedding",
                    label: str = "label", cell_nodes: int = CELL_NODES, block_rows: int = BLOCK_ROWS,
                    work: Work | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    work = work or Work(vectors.sparkSession, "spherical-dedup")
    rows = work.table(unit_vectors(vectors, id_col, vector, label), "rows")
    nodes = work.table(
        rows.filter("v IS NOT NULL").groupBy("label", "v")
        .agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("low"))
        .withColumn("dim", (F.length("v") / 8).cast("int")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = work.table(links(nodes, cosine, work, cell_nodes, block_rows), "links")
    counts = found.filter("n IS NOT NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("far"))
    group = components(found.filter("v IS NOT NULL").select("u", "v"), work)
    low = (group.join(nodes.select(F.col("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("component"))
           .join(group, "root").select("node", "component"))
    known = (nodes.join(counts, "node", "left").join(low, "node", "left")
             .select("label", "v", (F.col("mult") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "low").alias("component")))
    return work.finish(rows.join(known, ["label", "v"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
