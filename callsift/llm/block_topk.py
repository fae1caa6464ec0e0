"""Exact top-k search by inner product, block at a time.

Each vector component x becomes the integer floor(256 x). Vectors are ordered
by their nearest pivot (a bounded sample) and cut into shards of document-range
blocks. A block keeps its forward index (the integer rows) and, per component
("term"), its largest and smallest value; the sum over terms of the larger of
q*largest and q*smallest bounds every score in the block. A query takes blocks
in descending order of that bound and stops when the bound falls below its
k-th best score.

1. shards: range-partitioned rows, one row per shard; the queries among a
   shard's own rows are searched there first, which gives each a threshold.
2. bounds: every batch of queries against every shard's block maxima (not its
   rows); only shards with a block that can reach some threshold stay.
3. search: the surviving batches meet the shards' forward indexes.

Queries (a stated set of rows) meet all rows in blocks; nothing is sampled or
capped. Defined results: rows with a null id, a null vector or null or
non-finite components take no part; repeated rows are candidates, and queries,
each by itself; a row is no candidate of a query with its own id; vectors of another length than the
query's are no candidates; empty vectors score 0; an empty table gives no rows.
Components beyond 2**26 after scaling raise an error (scores could leave the
range of a long).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsift.llm.vectors import stack, usable
from callsift.llm.work import Work

SHARD_ROWS = 8192
BLOCK_ROWS = 256
PIVOTS = 64
NONE = -(1 << 62)  # below every score; can be negated


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, dim, q): q holds floor(scale * x) as little-endian int32."""

    def run(batches):
        for b in batches:
            values, length, ok = usable(b.column("v"))
            ends = np.cumsum(length)
            q = np.floor(scale * values)
            ids = b.column("vec_id")
            rows = np.flatnonzero(ok & np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool))
            out = []
            for r in rows.tolist():
                part = q[ends[r] - length[r]:ends[r]]
                if len(part) and np.abs(part).max() > 1 << 26:
                    raise ValueError("a component is too large for integer scores")
                out.append(part.astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids.take(pa.array(rows, pa.int64())), "dim": pa.array(length[rows], pa.int32()),
                "q": pa.array(out, pa.binary())})

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector).cast("array<double>").alias("v")).mapInArrow(
        run, "vec_id long, dim int, q binary")


def scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products (in floating point only where it is exact)."""
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), np.int64)
    if int(np.abs(q).max()) * int(np.abs(d).max()) * q.shape[1] < 1 << 53:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ d.astype(np.int64).T


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima of each (query, block)."""
    return scores(np.maximum(q, 0), high) + scores(np.minimum(q, 0), low)


def search(qid: np.ndarray, q: np.ndarray, kth: np.ndarray, ids: np.ndarray, rows: np.ndarray,
           high: np.ndarray, low: np.ndarray, k: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The best k of these blocks for each query, as (scores, ids), without
    those that fall below ``kth``, the query's k-th best score so far."""
    best = np.full((len(qid), k), NONE, np.int64)
    who = np.full((len(qid), k), np.iinfo(np.int64).max, np.int64)
    kth = kth.copy()
    bound = bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    for r in range(bound.shape[1]):
        block = order[:, r]
        live = np.flatnonzero(bound[np.arange(len(qid)), block] >= kth)
        if not len(live):
            break
        for b in np.unique(block[live]).tolist():
            own = live[block[live] == b]
            at = slice(b * block_rows, (b + 1) * block_rows)
            got = scores(q[own], rows[at])
            got = np.where((ids[at][None, :] == qid[own][:, None]) | (got < kth[own][:, None]), NONE, got)
            some = got.max(axis=1) > NONE
            if not some.any():
                continue
            own, got = own[some], got[some]
            all_s = np.concatenate([best[own], got], axis=1)
            all_i = np.concatenate([who[own], np.broadcast_to(ids[at], got.shape)], axis=1)
            pick = np.lexsort((all_i, -all_s), axis=-1)[:, :k]
            best[own] = np.take_along_axis(all_s, pick, axis=1)
            who[own] = np.take_along_axis(all_i, pick, axis=1)
            kth[own] = np.maximum(kth[own], best[own][:, k - 1])
    return best, who


def _hits(shard: int, number: np.ndarray, qid: np.ndarray, best: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
    r, c = np.nonzero(best > NONE)
    return pa.RecordBatch.from_pydict({
        "qshard": pa.array(np.full(len(r), shard), pa.int64()), "number": pa.array(number[r], pa.int64()),
        "query_id": pa.array(qid[r], pa.int64()), "vec_id": pa.array(who[r, c], pa.int64()),
        "score": pa.array(best[r, c], pa.int64())})


HITS = "qshard long, number long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
          work: Work | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of every query: rows whose
    id is divisible by ``every``. Ties go to the smaller id."""
    spark = vectors.sparkSession
    work = work or Work(spark, "block-topk")
    rows = work.table(quantise(vectors, id_col, vector), "rows")
    n = rows.count()
    pivots = [(r["dim"], r["q"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()]

    def near(batches):
        by_dim: dict[int, np.ndarray] = {}
        for d in {d for d, _ in pivots}:
            by_dim[d] = stack([q for x, q in pivots if x == d], "<i4").astype(np.float64)
        for b in batches:
            dim = b.column("dim").to_numpy()
            q = b.column("q").to_pylist()
            pivot = np.zeros(len(dim), np.int32)
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                if d in by_dim and d:
                    pivot[own] = (stack([q[i] for i in own.tolist()], "<i4") @ by_dim[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot, pa.int32())], ["vec_id", "dim", "q", "place", "pivot"])

    def shard(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        all_dims, all_ids, all_q = (t.column(c).to_pylist() for c in ("dim", "vec_id", "q"))
        for d in sorted(set(all_dims)):
            own = [i for i, x in enumerate(all_dims) if x == d]
            ids = np.array([all_ids[i] for i in own], np.int64)
            m = stack([all_q[i] for i in own], "<i4") if d else np.zeros((len(own), 0), "<i4")
            at = np.arange(0, len(own), block_rows)
            high, low = (f.reduceat(m, at, axis=0).astype("<i4") if d else np.zeros((len(at), 0), "<i4")
                         for f in (np.maximum, np.minimum))
            ask = np.flatnonzero(ids % every == 0)
            best, who = search(ids[ask], m[ask], np.full(len(ask), NONE), ids, m, high, low, k, block_rows)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "dim": pa.array([d], pa.int32()),
                "ids": [ids.tobytes()], "rows": [m.tobytes()], "high": [high.tobytes()], "low": [low.tobytes()],
                "qid": [ids[ask].tobytes()], "q": [m[ask].tobytes()], "kth": [best[:, k - 1].tobytes()],
                "best": [best.tobytes()], "who": [who.tobytes()]})

    parts = max(1, -(-n // shard_rows))
    # the place in the stored table lets the rows of one id be split
    ordered = (rows.select("vec_id", "dim", "q", F.monotonically_increasing_id().alias("place"))
               .mapInArrow(near, "vec_id long, dim int, q binary, place long, pivot int")
               .repartitionByRange(parts, "dim", "pivot", "vec_id", "place").sortWithinPartitions("dim", "pivot", "vec_id", "place"))
    shards = work.table(ordered.mapInArrow(
        shard, "shard long, dim int, ids binary, rows binary, high binary, low binary, qid binary, q binary, "
               "kth binary, best binary, who binary"), "shards")
    work.drop("rows")
    count = (shards.agg(F.max("shard")).first()[0] or 0) + 1

    def own_hits(batches):
        for b in batches:
            for r in b.to_pylist():
                qid, best, who = (np.frombuffer(r[c], np.int64) for c in ("qid", "best", "who"))
                yield _hits(r["qshard"], np.arange(len(qid)), qid, best.reshape(-1, k), who.reshape(-1, k))

    def reach(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                d = r["dim"]
                q, kth = np.frombuffer(r["q"], "<i4"), np.frombuffer(r["kth"], np.int64)
                q = q.reshape(len(kth), d)
                high, low = (np.frombuffer(r[c], "<i4") for c in ("high", "low"))
                blocks = r["n_blocks"]
                live = (bounds(q, high.reshape(blocks, d), low.reshape(blocks, d)) >= kth[:, None]).any(axis=1)
                if live.any():
                    out.append((r["qshard"], d, r["shard"], np.flatnonzero(live).astype(np.int64).tobytes()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                ["qshard", "dim", "shard", "live"])

    def meet(batches):
        for b in batches:
            for r in b.to_pylist():
                d, live = r["dim"], np.frombuffer(r["live"], np.int64)
                qid, kth = (np.frombuffer(r[c], np.int64)[live] for c in ("qid", "kth"))
                q = np.frombuffer(r["q"], "<i4").reshape(-1, d)[live] if d else np.zeros((len(live), 0), "<i4")
                ids = np.frombuffer(r["ids"], np.int64)
                m, high, low = (np.frombuffer(r[c], "<i4").reshape(-1, d) if d else np.zeros((x, 0), "<i4")
                                for c, x in (("rows", len(ids)), ("high", r["n_blocks"]), ("low", r["n_blocks"])))
                best, who = search(qid, q, kth, ids, m, high, low, k, block_rows)
                yield _hits(r["qshard"], live, qid, best, who)

    asks = shards.filter(F.length("qid") > 0).select(F.col("shard").alias("qshard"), "dim", "qid", "q", "kth")
    n_blocks = F.ceil(F.length("ids") / F.lit(8 * block_rows)).cast("int").alias("n_blocks")
    cells = (asks.drop("qid").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>")))
             .filter("shard <> qshard").join(shards.select("shard", "dim", "high", "low", n_blocks), ["shard", "dim"])
             .mapInArrow(reach, "qshard long, dim int, shard long, live binary"))
    far = (cells.join(asks, ["qshard", "dim"])
           .join(shards.select("shard", "dim", "ids", "rows", "high", "low", n_blocks), ["shard", "dim"])
           .mapInArrow(meet, HITS))
    near_hits = shards.select(F.col("shard").alias("qshard"), "qid", "best", "who").mapInArrow(own_hits, HITS)
    w = Window.partitionBy("qshard", "query_id", "number").orderBy(F.desc("score"), "vec_id")
    return work.finish(near_hits.unionByName(far).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
