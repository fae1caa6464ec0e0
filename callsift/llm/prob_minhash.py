"""Near-duplicate documents by ProbMinHash.

Similarity: the probability Jaccard of weighted five-word shingles (weight =
count in the document), sum over common shingles i of
1 / sum_j max(x_j / x_i, y_j / y_i). With equal weights it is the Jaccard of
the shingle sets.

1. Signature: each shingle is a Poisson process whose rate is its weight. Its
   arrivals go to registers chosen by hash; a register keeps the shingle that
   arrived first. A shingle whose next arrival is later than every register's
   is done (early termination). The chance that two documents agree in a
   register is their probability Jaccard.
2. Exact copies are one node. Registers are banded; nodes that share a band are
   candidates.
3. Verification of candidates on the exact shingles, in rounds that follow the
   groups found so far, so a bucket of thousands of copies never emits its
   pairs: first each node with one pivot per bucket; then, in buckets that
   still span several groups, the nodes outside the largest group (strays)
   with their most similar others; at last every stray with all its other
   candidates whose signatures agree enough. That last round keeps candidates
   as lists and tests them in blocks of one group's texts; it returns at most
   one link for a stray and a block.
4. Connected components of the verified links; the smallest id of a component
   is kept.

A pair at similarity 0.8 shares no band with chance 7e-6 and falls below the
signature bound (five standard deviations) with chance 3e-7.

Defined results: texts without words (null, empty, white space) belong to no
group and are kept; texts of fewer than five words are one shingle; repeated
rows (same id and text) have the same result; a null id is never the smallest
of a group unless it is alone; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.components import components
from callsift.llm.textops import mix, shingles, step
from callsift.llm.work import Work, free_names, lean, slices

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
STRAYS, MEMBERS = 256, 1024  # rows of the two sides of a compared block
BEST = 2
# Rows and lists that a call over many small blocks takes, on average.
CELL_ROWS, CELL_LISTS = 20_000, 500
MAX_BLOCK = 64  # arrivals drawn at once for a shingle


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """The winning shingle of each of m registers, one row per document
    (distinct shingle hashes, weights); documents need a shingle each."""
    n = np.array([len(h) for h, _ in docs])
    seed = np.concatenate([h for h, _ in docs])
    rate = np.concatenate([w for _, w in docs]).astype(np.float64)
    doc = np.repeat(np.arange(len(docs)), n)
    best = np.full(len(docs) * m, np.inf)
    who = np.zeros(len(docs) * m, np.uint64)
    clock = np.zeros(len(seed))
    drawn, block = 0, 1
    while len(seed):
        number = np.arange(drawn + 1, drawn + block + 1)
        r = step(seed[:, None], number[None, :])
        at = clock[:, None] - np.cumsum(np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53), axis=1) \
            / rate[:, None]
        register = ((mix(r ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        place = (register + doc[:, None] * m).ravel()
        time, owner = at.ravel(), np.repeat(seed, block)
        early = np.flatnonzero(time < best[place])
        place, time, owner = place[early], time[early], owner[early]
        np.minimum.at(best, place, time)
        won = time == best[place]
        who[place[won]] = owner[won]
        clock = at[:, -1]
        go = clock < best.reshape(-1, m).max(axis=1)[doc]
        seed, rate, doc, clock = seed[go], rate[go], doc[go], clock[go]
        drawn += block
        if drawn > 2:
            block = min(2 * block, MAX_BLOCK)
    return who.reshape(-1, m)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted shingle sets."""
    (hx, wx), (hy, wy) = x, y
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = wx[i].astype(np.float64), wy[j].astype(np.float64)
    only_x, only_y = wx.sum() - a.sum(), wy.sum() - b.sum()
    total = 0.0
    ratio, which = np.unique(b / a, return_inverse=True)
    for k, t in enumerate(ratio.tolist()):
        total += a[which == k].sum() / (np.maximum(a, b / t).sum() + only_x + only_y / t)
    return total


def digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def sign(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, bands, sig): band keys, and 16 bits of each register;
    both null for a text without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    m = bands * rows

    def run(batches):
        for b in slices(batches, 2048):
            texts = b.column("text")
            keys: list[bytes | None] = []
            sigs: list[bytes | None] = []
            for at in range(0, b.num_rows, 64):
                some = [shingles(t, words) for t in texts.slice(at, 64).to_pylist()]
                has = [k for k, s in enumerate(some) if len(s[0])]
                key: list[list[int] | None] = [None] * len(some)
                sig: list[bytes | None] = [None] * len(some)
                if has:
                    who = signatures([some[k] for k in has], m)
                    band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(has), bands)) + np.uint64(1)
                    for r in range(rows):
                        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + who[:, r::rows])
                    low = (mix(who) & np.uint64(0xFFFF)).astype("<u2")
                    for row, k in enumerate(has):
                        key[k], sig[k] = band[row].view(np.int64).tolist(), low[row].tobytes()
                keys += key
                sigs += sig
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "digest": b.column("digest"), "bands": pa.array(keys, pa.list_(pa.int64())),
                "sig": pa.array(sigs, pa.binary())})

    return docs.select("doc_id", digest().alias("digest"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), f"doc_id {kind}, digest binary, bands array<bigint>, sig binary")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose exact similarity is at least ``least``."""
    def run(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            out = []
            for u, v, tu, tv in zip(*(b.column(c).to_pylist() for c in ("u", "v", "tu", "tv")), strict=True):
                if len(held) > 64:
                    held.clear()
                for k, t in ((u, tu), (v, tv)):
                    if k not in held:
                        held[k] = shingles(t, words)
                if similarity(held[u], held[v]) >= least:
                    out.append((u, v))
            yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in out], pa.int64()),
                                              "v": pa.array([x for _, x in out], pa.int64())})

    return (pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
            .join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
            .select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long"))


def _alike(pairs: DataFrame, nodes: DataFrame, least: float, m: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``least`` of the registers."""
    def run(batches):
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), "<u2").reshape(-1, m) for x in ("su", "sv"))
            ok = pa.array(np.flatnonzero((a == c).mean(axis=1) >= least))
            yield pa.RecordBatch.from_arrays([b.column("u").take(ok), b.column("v").take(ok)], ["u", "v"])

    return (pairs.join(nodes.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u")
            .join(nodes.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")
            .select("u", "v", "su", "sv").mapInArrow(run, "u long, v long"))


def _strays(members: DataFrame, group: DataFrame, nodes: DataFrame, least: float, m: int, best: int | None) -> DataFrame:
    """(s, root, found): for the nodes outside their bucket's largest group,
    the nodes of other groups (by root) that share the bucket and agree in
    ``least`` of the registers: the ``best`` ones of a block, or all. A pair
    that shares several buckets is found in its first."""
    now = (members.join(group, "node", "left")
           .select("key", "node", F.coalesce("root", "node").alias("root")))
    per = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"),
                                  F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    main = main.select("key", F.col("top.root").alias("main"),
                       F.ceil((F.col("all") - F.col("top.n")) / STRAYS).cast("int").alias("s_blocks"),
                       F.ceil(F.col("all") / MEMBERS).cast("int").alias("m_blocks"))
    rows = now.join(main, "key").join(nodes.select("node", "sig", "bands"), "node")
    spread = F.xxhash64("node")
    own = ["key", "node", "root", "sig", "bands"]
    stray = (rows.filter("root <> main")
             .select(*own, F.pmod(spread, "s_blocks").cast("int").alias("s"),
                     F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("t"), F.lit(True).alias("stray")))
    other = rows.select(*own, F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1)).alias("s"),
                        F.pmod(spread, "m_blocks").cast("int").alias("t"), F.lit(False).alias("stray"))

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["key", "s", "t"], kind="stable")
        sig = np.frombuffer(b"".join(p["sig"].tolist()), "<u2").reshape(-1, m)
        bands = np.stack(p["bands"].tolist())
        keys, node, root, is_stray = (p[c].to_numpy() for c in ("key", "node", "root", "stray"))
        out: dict[str, list] = {"s": [], "root": [], "found": []}
        for first, last in _runs_of(p, ["key", "s", "t"]):
            here = np.arange(first, last)
            right = here[~is_stray[here]]
            for i in here[is_stray[here]].tolist():
                same = (sig[i] == sig[right]).sum(axis=1)
                shared = (bands[i] == bands[right]).argmax(axis=1)
                at = right[(same >= least * m) & (root[right] != root[i]) & (bands[i][shared] == keys[i])]
                if best is not None and len(at) > best:
                    at = at[np.argsort(-(sig[i] == sig[at]).sum(axis=1), kind="stable")[:best]]
                for r in np.unique(root[at]).tolist():
                    out["s"].append(int(node[i]))
                    out["root"].append(r)
                    out["found"].append(node[at][root[at] == r])
        return pd.DataFrame({"s": pd.Series(out["s"], dtype="int64"), "root": pd.Series(out["root"], dtype="int64"),
                             "found": pd.Series(out["found"], dtype="object")})

    # a cell (key, s, t) is bounded; a task's call takes many small ones
    chunk = F.pmod(F.xxhash64("key", "s", "t"), F.lit(max(1, -(-members.count() // CELL_ROWS))))
    return (stray.unionByName(other).withColumn("chunk", chunk).groupBy("chunk")
            .applyInPandas(lambda p: meet(p), "s long, root long, found array<bigint>"))


def _runs_of(p: pd.DataFrame, columns: list[str]):
    """(first, last + 1) of each run of equal values in a sorted frame."""
    values = p[columns].to_numpy()
    edge = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
    yield from zip([0, *edge.tolist()], [*edge.tolist(), len(values)], strict=True)


def _tested_in_blocks(lists: DataFrame, group: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links (u, v) between strays and the nodes in their lists: the texts of a
    group and its strays meet in blocks; one link per list and block suffices,
    as a group's nodes are connected already."""
    asked = lists.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / STRAYS).cast("int").alias("s_blocks"))
    of = texts.join(group, "node", "left").select("node", "text", F.coalesce("root", "node").alias("root"))
    sizes = of.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("m_blocks"))
    blocks = asked.join(sizes, "root")
    stray = (lists.join(blocks, "root").join(texts.select(F.col("node").alias("s"), "text"), "s")
             .select("root", F.pmod(F.xxhash64("s", "found"), "s_blocks").cast("int").alias("sb"),
                     F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("mb"),
                     F.col("s").alias("node"), "text", "found"))
    member = (of.join(blocks, "root")
              .select("root", F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1)).alias("sb"),
                      F.pmod(F.xxhash64("node"), "m_blocks").cast("int").alias("mb"), "node", "text",
                      F.lit(None).cast("array<bigint>").alias("found")))

    def test(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["root", "sb", "mb"], kind="stable")
        out: list[tuple[int, int]] = []
        for first, last in _runs_of(p, ["root", "sb", "mb"]):
            out += _links(p.iloc[first:last], words, least)
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    chunk = F.pmod(F.xxhash64("root", "sb", "mb"), F.lit(max(1, -(-lists.count() // CELL_LISTS))))
    return (stray.unionByName(member).withColumn("chunk", chunk).groupBy("chunk")
            .applyInPandas(lambda p: test(p), "u long, v long"))


def _links(cell: pd.DataFrame, words: int, least: float) -> list[tuple[int, int]]:
    """One link for each list of a cell, if it has any: rows with a list are
    strays, the others the texts of one group."""
    is_member = cell["found"].isna().to_numpy()
    right, left = cell[is_member], cell[~is_member]
    ids = right["node"].to_numpy()
    if not len(left) or not len(ids):
        return []
    sets = [shingles(t, words) for t in right["text"]]
    size = np.array([len(h) for h, _ in sets])
    plain = np.array([bool((w == 1).all()) for _, w in sets], bool)
    every, owner = np.concatenate([h for h, _ in sets]), np.repeat(np.arange(len(sets)), size)
    out = []
    for node, text, found in zip(left["node"].tolist(), left["text"].tolist(), left["found"].tolist(), strict=True):
        at = np.flatnonzero(np.isin(ids, found))
        if not len(at):
            continue
        h, w = shingles(text, words)
        hit = h[np.minimum(np.searchsorted(h, every), len(h) - 1)] == every
        both = np.bincount(owner[hit], minlength=len(sets))
        # with weights of 1 the similarity is the Jaccard of the sets
        exact = plain & bool((w == 1).all())
        jaccard = both / np.maximum(len(h) + size - both, 1)
        for i in at[np.argsort(-jaccard[at], kind="stable")].tolist():
            if (jaccard[i] if exact[i] else similarity((h, w), sets[i])) >= least:
                out.append((node, int(ids[i])))
                break
    return out


def _grown(group: DataFrame | None, links: DataFrame, work: Work, n: int) -> DataFrame:
    """The groups (node, root) after more links; the known groups enter as
    stars, so few rounds are needed."""
    links = work.table(links, f"links-{n}")
    if group is not None:
        if links.isEmpty():
            return group
        links = links.unionByName(group.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return work.table(components(links, work, f"star-{n}"), f"group-{n}")


def near_duplicates(docs: DataFrame, similar: float = SIMILARITY, words: int = WORDS, bands: int = BANDS,
                    rows: int = ROWS, work: Work | None = None) -> DataFrame:
    """(doc_id, digest, component_id, n_copies, kept), one row per document:
    digest is the md5 of the text, component_id the smallest id of the group,
    n_copies the rows with the same text."""
    work = work or Work(docs.sparkSession, "prob-minhash")
    m = bands * rows
    floor = similar - 5 * math.sqrt(similar * (1 - similar) / m)
    signed = work.table(sign(docs, words, bands, rows), "signed")
    nodes = work.table(
        signed.filter("sig IS NOT NULL").groupBy("digest")
        .agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("mult"), F.first("bands").alias("bands"),
             F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("key"))
    shared = (spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node"), "node")).alias("p"))
              .filter("n > 1").select("key", F.col("p.node").alias("pivot")))
    members = work.table(spread.join(shared, "key"), "members")
    texts = work.table(
        nodes.join(members.select("node").distinct(), "node").select("node", "digest", "low")
        .join(docs.select(F.col("doc_id"), digest().alias("d"), F.col("text").cast("string").alias("text")),
              (F.col("digest") == F.col("d")) & F.col("low").eqNullSafe(F.col("doc_id")))
        .select("node", "text").dropDuplicates(["node"]), "texts")

    pairs = members.filter("node <> pivot").select(
        F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
    tested = work.table(_alike(pairs, nodes, floor, m), "tested-0")
    group = _grown(None, _verified(tested, texts, words, similar), work, 0)
    # strays with their most similar others, as pairs
    few = _strays(members, group, nodes, floor, m, BEST).select("s", F.explode("found").alias("f"))
    pairs = few.select(F.least("s", "f").alias("u"), F.greatest("s", "f").alias("v")).distinct()
    group = _grown(group, _verified(pairs.join(tested, ["u", "v"], "left_anti"), texts, words, similar), work, 1)
    # and with all others, in blocks
    lists = work.table(_strays(members, group, nodes, floor, m, None), "lists")
    group = _grown(group, _tested_in_blocks(lists, group, texts, words, similar), work, 2)

    low = (group.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component"))
           .join(group, "root").select("node", "component"))
    known = nodes.join(low, "node", "left").select("digest", "mult", F.coalesce("component", "low").alias("component"))
    plain = F.col("sig").isNull()
    return work.finish(signed.select("doc_id", "digest", "sig").join(known, "digest", "left")
            .select("doc_id", "digest", F.when(plain, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
                    F.coalesce("mult", F.lit(1)).alias("n_copies"), plain.alias("plain"))
            .withColumn("kept", F.col("plain") | F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("plain"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their columns: one of each group, and all
    texts without words. Of repeated rows of a kept document one stays."""
    its_id, its_digest, key, row = free_names(docs, "_kept_id", "_kept_digest", "_digest", "_row")
    kept = (near_duplicates(docs, **options).filter("kept")
            .select(F.col("doc_id").alias(its_id), F.col("digest").alias(its_digest)).distinct())
    with_key = docs.withColumn(key, digest())
    left = with_key.join(kept, (F.col(key) == F.col(its_digest)) & F.col("doc_id").eqNullSafe(F.col(its_id)), "left_semi")
    wordless = F.length(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    once = left.withColumn(row, F.when(wordless, F.monotonically_increasing_id()))
    return once.dropDuplicates(["doc_id", key, row]).select(*docs.columns)
