"""Token-id files: frequency-ranked ids, byte-aligned, with control bytes apart.

1. Whole texts become ids (a public byte-level vocabulary) and an end id, kept
   as a table. A text is cut where the vocabulary always splits; each distinct
   chunk is encoded once per worker and remembered.
2. Ids are counted over all documents; an id's rank in that count is its code,
   so most codes take one byte. The ranks are as many as the vocabulary.
3. Documents are sorted by id over range partitions (shards) and written as
   blocks: a head, the documents' ids and counts, the control bytes (two bits a
   code: its bytes less one) and the code bytes. Spark's own text writer writes
   the raw blocks, one a record, so any store and a lost task are handled by
   its commit protocol.
4. Reading: files are read whole (they are bounded), blocks are checked against
   their checksum, and codes are decoded by table look-up: control byte -> four
   lengths, code -> id. ``start`` adds up the blocks' counts in file order.

Defined results: a null text is empty (the end id alone); a null doc_id comes
first; rows with equal doc_id are separate documents, next to each other in the
order of the stored table; a very long text is one document in one block; other
columns are not read; an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import functools
import re
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsift.llm.bytepairs import Known, pieces
from callsift.llm.work import Work, lean, slices

END_ID = 2
# Chunks of text whose ids a worker remembers (about 200 bytes each).
CACHE_CHUNKS = 1_200_000
# Documents fill a block up to this many codes (one of more is a block by itself).
BLOCK_CODES = 1 << 18
BLOCKS_PER_FILE = 16
# Codes of a shard: at most, and at least where there are fewer shards than shuffle partitions.
SHARD_CODES, LEAST_CODES = 1 << 26, 1 << 20
MAGIC = b"RKC1"
HEAD = struct.Struct("<4sIIIQQ")  # magic, shard, block, documents, codes, code bytes

# White space as the vocabulary's own splitting knows it.
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE = re.compile(r"[\t\x0b\x0c\r\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def chunks(text: str) -> list[str]:
    """The text in pieces that its tokens never cross: words with the space
    before them, and white space."""
    if (not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text
            or "\n " in text or _RARE.search(text)):
        return _CHUNK.findall(text)
    return text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f")


class ByteTokenizer:
    """Ids of whole texts, equal to the tokenizer's own. Texts that hold a
    special token's opening go to the tokenizer whole."""

    def __init__(self, path: str):
        self.pieces = pieces(path)
        self.known = Known(self._chunk, CACHE_CHUNKS)

    def _chunk(self, c: str) -> bytes:
        """A word of letters, with the space before it, is not split; the
        punctuation after its last letter is split off."""
        if c[c[0] == " ":].isalpha():
            return self.pieces.word(c)
        body = c.rstrip(string.punctuation)
        if len(body) < len(c) and body[body[:1] == " ":].isalpha():
            return self.known[body] + self.known[c[len(body):]]
        return self.pieces.alone(c)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, get = [], self.known.__getitem__
        for t in texts:
            self.known.turn()
            out.append(self.pieces.alone(t) if t and "<|" in t else b"".join(map(get, chunks(t))) if t else b"")
        return out


@functools.cache
def tokenizer(path: str) -> ByteTokenizer:
    """A worker's tasks share what the memory of chunks holds."""
    return ByteTokenizer(path)


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, ids): little-endian ids with the end id, of two bytes each
    if the vocabulary fits (see ``id_type``)."""
    def run(batches):
        tok = tokenizer(tokenizer_path)
        end, kind = np.array([end_id], "<u4").tobytes(), id_type(tok.pieces.vocabulary, end_id)
        for b in slices(batches):
            ids = [np.frombuffer(body + end, "<u4").astype(kind).tobytes() for body in tok.encode(b.column("text").to_pylist())]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), "doc_id long, n long, ids binary")


def id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def frequency_ranks(tokens: DataFrame, kind: str) -> np.ndarray:
    """The distinct ids, the most frequent first (ties: the smaller id). Tasks
    count for themselves; what meets is at most a row for each id and task."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in slices(batches, 4096):
            own = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), kind))
            if len(own) > len(total):
                own, total = total, own
            total[:len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    return ids[np.lexsort((ids, -n))].astype("<u4")


def pack_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (four two-bit lengths each, the first in the low bits) and
    code bytes (little-endian, without leading zeros but one)."""
    codes = codes.astype("<u4")
    size = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    slots = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    slots[:len(codes)] = size - 1
    four = slots.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    data = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    data[at] = codes & np.uint32(0xFF)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        data[at[more] + k] = codes[more] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


# Control byte -> the lengths of its four codes.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.int64) + 1


def unpack_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    end = np.cumsum(size)
    if n and end[-1] != len(data):
        raise ValueError("control bytes and code bytes do not match")
    own, at = np.frombuffer(data, np.uint8), end - size
    out = own[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= own[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(shard: int, number: int, doc_ids: list[int | None], counts: list[int], codes: np.ndarray) -> bytes:
    control, data = pack_codes(codes)
    body = b"".join((
        HEAD.pack(MAGIC, shard, number, len(doc_ids), len(codes), len(data)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(counts, "<u4").tobytes(), control, data))
    return body + struct.pack("<I", zlib.crc32(body))


def blocks_of(content: bytes):
    """(shard, block, doc_ids, counts, codes) of each block of a file, in order."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic, shard, number, docs, codes, size = HEAD.unpack_from(view, at)
        control = -(-codes // 4)
        end = at + HEAD.size + 13 * docs + control + size
        if magic != MAGIC or len(view) < end + 5 or struct.unpack_from("<I", view, end)[0] != zlib.crc32(view[at:end]):
            raise ValueError(f"the block at byte {at} is damaged")
        at += HEAD.size
        ids = np.frombuffer(view, "<i8", docs, at)
        null = np.frombuffer(view, np.uint8, docs, at + 8 * docs).astype(bool)
        counts = np.frombuffer(view, "<u4", docs, at + 9 * docs).astype(np.int64)
        at += 13 * docs
        yield shard, number, pa.array(ids, mask=null), counts, unpack_codes(view[at:at + control], view[at + control:end], codes)
        at = end + 5  # checksum and the line end after a record


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, block_codes: int = BLOCK_CODES,
              shard_codes: int = SHARD_CODES, least_codes: int = LEAST_CODES, work: Work | None = None) -> None:
    """Writes ``path``/blocks (the block files) and ``path``/ranks (the ids by
    rank, one record of little-endian uint32)."""
    spark = docs.sparkSession
    work = work or Work(spark, "rank-codec")
    kind = id_type(pieces(tokenizer_path).vocabulary, end_id)
    tokens = work.table(token_ids(docs, tokenizer_path, end_id), "tokens", "zstd")
    by_rank = frequency_ranks(tokens, kind)
    _write_raw(spark.createDataFrame([(by_rank.tobytes(),)], "value binary"), f"{path}/ranks")

    total = tokens.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_codes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // least_codes)))
    # the place in the stored table ends ties, so one id's rows may lie in several shards
    ordered = (tokens.withColumn("place", F.monotonically_increasing_id())
               .repartitionByRange(shards, "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "n", "ids"))

    def run(batches):
        rank = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        shard, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        counts: list[int] = []
        held: list[bytes] = []

        def out():
            nonlocal number
            codes = rank[np.frombuffer(b"".join(held), kind)]
            got = pa.RecordBatch.from_arrays([pa.array([block(shard, number, ids, counts, codes)], pa.binary())], ["value"])
            number += 1
            ids.clear(), counts.clear(), held.clear()
            return got

        full = 0
        for b in batches:
            for d, n, own in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True):
                if ids and full + n > block_codes:
                    yield out()
                    full = 0
                ids.append(d)
                counts.append(n)
                held.append(own.as_py())
                full += n
        if ids:
            yield out()

    _write_raw(ordered.mapInArrow(run, "value binary"), f"{path}/blocks")
    work.drop("tokens")


def _write_raw(values: DataFrame, path: str) -> None:
    (values.select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path))


def read_ids(spark: SparkSession, path: str, with_ids: bool = True, work: Work | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the
    files; ``ids`` are little-endian uint32."""
    work = work or Work(spark, "rank-codec")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
    ranks = files.load(f"{path}/ranks").select("content").collect()
    by_rank = np.frombuffer(b"".join(bytes(r.content)[:-1] for r in ranks), "<u4")

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                for shard, number, doc_ids, counts, codes in blocks_of(content.as_buffer()):
                    ids = by_rank[codes].tobytes()
                    end = np.cumsum(counts)
                    parts = [ids[4 * (e - n):4 * e] for e, n in zip(end.tolist(), counts.tolist(), strict=True)]
                    cols = {"shard": pa.array(np.full(len(counts), shard, np.int64)), "block": pa.array(np.full(len(counts), number, np.int64)),
                            "doc_id": doc_ids, "within": pa.array(end - counts), "n_tokens": pa.array(counts),
                            "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array(parts, pa.binary())
                    yield pa.RecordBatch.from_pydict(cols)

    own = "shard long, block long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    read = work.table(files.load(f"{path}/blocks").select("content").mapInArrow(run, own), "read")
    sizes = read.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as shards meet in one place, and as many as a shard's blocks
    of_shard = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", before(Window.orderBy("shard")).alias("shard_start"))
    of_block = sizes.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("block_start"))
    starts = of_block.join(of_shard, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("first"))
    return read.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
