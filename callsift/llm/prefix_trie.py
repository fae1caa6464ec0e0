"""Prefix trie of conversations by van Emde Boas recursion.

A sequence of turns is cut at half of the trie's depth. The cut prefixes are
named; their turns build the upper trie, and what follows a cut builds, under
the prefix's name, a trie of the lower forest. Both halves recurse in the same
job, so a depth of D takes log2 D rounds. Equal sequences of a trie are merged
before every round, with the number of their conversations and the smallest id:
copies are one row from the start, and a hot prefix is as small as any other.
At length one a row is a node: its trie is its parent.

Totals are grafted upward through the same cuts, the shortest first: what the
lower trie below a cut prefix adds up to goes to the prefix's ancestors inside
its upper trie (those of one half, so N log D additions in all).

A prefix is named by the 128-bit digest of its parent's name and its last turn,
so names agree between rounds. Tables between rounds are written; no part of
the trie reaches the driver.

Defined results: turns are ordered by number, null first, and those with equal
numbers by the digest of role and text; a null role or text is empty; repeated rows are turns of their own;
rows without a conversation id take no part; a conversation of any length is one
row of 24 bytes a turn; an empty table has no members and so no nodes; columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.work import Work

ROOT = "unhex('')"
# Bytes of the id list that a step of the end digests holds.
CHUNK_BYTES = 1 << 20


def digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): the turns of each conversation in order, each as its
    digest (key) and the number of words of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    one = one.select("conv_id", F.struct(
        "turn", digest(F.length("role").cast("string").cast("binary"), F.lit(b" "), F.col("role").cast("binary"),
                       F.col("text").cast("binary")).alias("key"),
        F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("words")).alias("t"))
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.transform("ts", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("seq"))


def rebuilt(seqs: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation
    c - c % family, h = crc32(decimal c) % (most + 1), and goes on with its own
    turns after its first h."""
    base = seqs.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("seq", 1, most).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h)
    none = F.slice("seq", 1, 0)
    return own.join(base, "base", "left").select("conv_id", F.concat(
        F.coalesce(F.slice("first", F.lit(1), F.col("h")), none),
        F.when(F.size("seq") > F.col("h"), F.slice("seq", F.col("h") + 1, F.size("seq"))).otherwise(none)).alias("seq"))


def _above(prefixes: DataFrame) -> DataFrame:
    """(name, above) of (tree, keys): the names of a sequence's prefixes under
    the node ``tree``, in order, and the last of them."""
    def run(batches):
        for b in batches:
            last, above = [], []
            for name, keys in zip(b.column("tree").to_pylist(), b.column("keys").to_pylist(), strict=True):
                own = []
                for k in keys:
                    name = hashlib.md5(name + k).digest()
                    own.append(name)
                last.append(name)
                above.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(last, pa.binary()), pa.array(above, pa.list_(pa.binary()))], ["name", "above"])

    return prefixes.mapInArrow(run, "name binary, above array<binary>")


def _name(tree: Column, seq: Column) -> Column:
    return F.reduce(seq, tree, lambda got, t: digest(got, t["key"]))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tree", "base", "seq").agg(F.sum("n").alias("n"), F.min("low").alias("low"))


def _halves(rows: DataFrame, half: int) -> DataFrame:
    """Each sequence as its upper part, under the same trie, and its lower
    part, under the name of the cut prefix."""
    upper = F.slice("seq", 1, half)
    long = F.size("seq") > half
    cut = F.when(long, _name(F.col("tree"), upper))
    lower = F.slice("seq", half + 1, half)
    parts = F.array(F.struct(F.col("tree"), F.col("base"), upper.alias("seq")),
                    F.when(long, F.struct(F.col("cut").alias("tree"), (F.col("base") + half).alias("base"), lower.alias("seq"))))
    return (rows.withColumn("cut", cut).select(F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p"), "n", "low")
            .select("p.*", "n", "low"))


def build(seqs: DataFrame, work: Work) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The nodes below the root (name, parent, depth, words, n, low), and for
    each half length the cut prefixes (name, above: the names of its ancestors
    in its upper trie, itself included)."""
    rows = work.table(_merged(seqs.filter(F.size("seq") > 0).select(
        F.expr(ROOT).alias("tree"), F.lit(0).cast("long").alias("base"), "seq",
        F.lit(1).cast("long").alias("n"), F.col("conv_id").alias("low"))), "rows")
    longest = rows.agg(F.max(F.size("seq"))).first()[0] or 1
    half, cuts = 1, []
    while 2 * half < longest:
        half *= 2
    while longest > 1 and half:
        cuts.append((half, _above(rows.filter(F.size("seq") > half)
                                  .select("tree", F.slice("seq.key", 1, half).alias("keys")).distinct())))
        rows = work.table(_merged(_halves(rows, half)), f"rows-{half}")
        half //= 2
    first = F.element_at("seq", 1)
    nodes = work.table(rows.select(
        digest(F.col("tree"), first["key"]).alias("name"), F.col("tree").alias("parent"), (F.col("base") + 1).alias("depth"),
        first["words"].alias("words"), "n", "low"), "nodes")
    return nodes, cuts[::-1]


def totals(nodes: DataFrame, cuts: list[tuple[int, DataFrame]], children: DataFrame, work: Work) -> DataFrame:
    """(name, leaves, saved) summed over the subtree of every node and of the root."""
    own = nodes.join(children.select(F.col("parent").alias("name"), "n_children"), "name", "left").select(
        "name", "parent", "depth", F.col("n_children").isNull().cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.col("words")).alias("saved"))
    sums = (F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    at = work.table(own, "totals-0")
    for half, cut in cuts:
        below = (at.filter((F.col("depth") - 1) % (2 * half) == half).groupBy(F.col("parent").alias("name")).agg(*sums)
                 .join(cut, "name").select(F.explode("above").alias("name"), "leaves", "saved").groupBy("name").agg(*sums))
        grown = at.join(below.select("name", F.col("leaves").alias("l"), F.col("saved").alias("s")), "name", "left").select(
            "name", "parent", "depth", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        at = work.table(grown, f"totals-{half}")
    top = at.filter("depth = 1").agg(*sums).select(F.expr(ROOT).alias("name"), "leaves", "saved")
    return at.select("name", "leaves", "saved").unionByName(top)


def end_digests(seqs: DataFrame, work: Work) -> DataFrame:
    """(name, ends_sha256): for every node where conversations end, the digest
    of their ids in ascending order, joined by commas.

    The ids are sorted over range partitions, a hot node's over many, and
    joined there into chunks. A digest runs over its chunks in order: a node's
    chunks pass one task as a stream, which holds one of them."""
    ends = work.table(seqs.select(_name(F.expr(ROOT), F.col("seq")).alias("name"), "conv_id"), "ends")
    spark = seqs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = "name binary, low long, ids string"

    def join(batches):
        name, low, ids, size = None, None, [], 0
        for b in batches:
            out = []
            for n, c in zip(b.column("name").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if ids and (n != name or size > CHUNK_BYTES):
                    out.append((name, low, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    name, low = n, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _batch(out, kinds)
        if ids:
            yield _batch([(name, low, ",".join(ids))], kinds)

    def hash_(batches):
        name, sha = None, None
        for b in batches:
            out = []
            for n, ids in zip(b.column("name").to_pylist(), b.column("ids"), strict=True):
                if n != name:
                    if sha:
                        out.append((name, sha.hexdigest()))
                    name, sha = n, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.as_py().encode())
            yield _batch(out, "name binary, ends_sha256 string")
        if sha:
            yield _batch([(name, sha.hexdigest())], "name binary, ends_sha256 string")

    chunks = ends.repartitionByRange(parts, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(join, kinds)
    return (chunks.repartition(parts, "name").sortWithinPartitions("name", "low").select("name", "ids")
            .mapInArrow(hash_, "name binary, ends_sha256 string"))


_ARROW = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    fields = [f.split() for f in kinds.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(cols, fields, strict=True)],
                                      [n for n, _ in fields])


def trie(seqs: DataFrame, work: Work | None = None) -> DataFrame:
    """One row per node of the trie over (conv_id, seq): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the members that end there)."""
    work = work or Work(seqs.sparkSession, "prefix-trie")
    seqs = work.table(seqs, "sequences")
    nodes, cuts = build(seqs, work)
    children = work.table(nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")), "children")
    root = seqs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low")).filter("n > 0").select(
        F.expr(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "n", "low")
    every = work.table(nodes.select("name", "parent", "depth", "n", "low").unionByName(root), "every")
    summed = work.table(totals(nodes, cuts, children, work), "summed")
    ends = work.table(end_digests(seqs, work), "end-digests")
    out = (every.join(summed, "name", "left")
           .join(children.withColumnRenamed("parent", "name"), "name", "left")
           .join(ends, "name", "left")
           .join(every.select(F.col("name").alias("parent"), F.col("low").alias("parent_conv_id")), "parent", "left"))
    return work.finish(out.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"),  # a root alone is a leaf
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
