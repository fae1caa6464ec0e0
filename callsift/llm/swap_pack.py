"""Best-fit packing improved by swap-based local search.

Documents become token ids (a public tokenizer, then an end id); only those
longer than a sequence are cut. Full pieces are sequences by themselves. The
others are dealt at random into groups of a bounded number of pieces; each
group is packed best-fit-decreasing, then a local search moves and exchanges
pieces between underfull bins, always raising the sum of squared fills, until
no bin has an improving step or no packing can have fewer. A group wastes less
than one bin against its own lower bound in the usual case, so the loss of
packing groups apart is at most about one bin per group.

Defined results: a null text is empty (the end id alone); rows with the same
doc_id are separate documents; a null doc_id is carried; an empty table gives
no pieces.
"""

from __future__ import annotations

import functools
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.bytepairs import Known, pieces
from callsift.llm.work import Work, lean

CAPACITY = 4096
END_ID = 1
# Pieces packed together in one task: bounds its memory and time.
GROUP_PIECES = 32_768
# Words and parts of words whose ids a worker remembers.
CACHE_WORDS = 800_000
# Bytes of text encoded together (a longer text is encoded by itself).
BATCH_BYTES = 4 << 20


class WordTokenizer:
    """Ids of a text as little-endian uint32 bytes, equal to the tokenizer's
    own for vocabularies that drop white space and never merge across it.

    Text is cut at ASCII white space; the distinct words of a batch are looked
    up together, each is encoded once and remembered. A tail of ASCII punctuation after a letter is encoded apart
    (the tokenizer splits there) and an ASCII word in lower case (it lowers
    case). Texts that hold a special token's opening go to the tokenizer
    whole."""

    def __init__(self, path: str):
        self.pieces = pieces(path)
        self.known = Known(self._word, CACHE_WORDS)

    def _normal(self, text: str) -> str:
        # below U+0300 nothing composes, and lower case goes letter by letter
        return text.lower() if text and max(text) < "\u0300" else self.pieces.tok.normalizer.normalize_str(text)

    def _word(self, s: str) -> bytes:
        body = s.rstrip(string.punctuation)
        # a last letter may become a letter and a mark
        if body and body != s and not (body if body.isascii() else self._normal(body))[-1:].isalpha():
            body = s
        if body and body != s:
            return self.known[body] + self.known[s[len(body):]]
        low = s.lower() if s.isascii() else s
        return self._part(s) if low == s else self.known[low]

    def _part(self, part: str) -> bytes:
        """A part of letters is not split; of letters beyond ASCII, after the
        tokenizer's own normalization."""
        if part.isascii():
            return self.pieces.word(part) if part.isalpha() else self.pieces.alone(part)
        plain = self._normal(part)
        return self.pieces.word(plain) if plain.isalpha() else self.pieces.alone(part)

    def encode(self, texts: pa.Array) -> list[bytes]:
        self.known.turn()
        texts = texts.fill_null("")
        whole = pc.match_substring(texts, "<|")
        words = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        place = words.values.dictionary_encode()
        ids = list(map(self.known.__getitem__, place.dictionary.to_numpy(zero_copy_only=False).tolist()))
        pool = np.frombuffer(b"".join(ids), "<u4")
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, at = np.cumsum(n) - n, place.indices.to_numpy()
        n = n[at]
        ends = np.r_[0, np.cumsum(n)]
        ids = pool[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        ends = 4 * ends[words.offsets.to_numpy()]
        return [self.pieces.alone(t.as_py()) if w else ids[a:b]
                for t, w, a, b in zip(texts, whole.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """A worker's tasks share what the memory of words holds."""
    return WordTokenizer(path)


def text_slices(batches, size: int = BATCH_BYTES):
    """The batches in pieces of at most ``size`` bytes of text, or of one row.
    Pieces are copies: some array functions go wrong on a part of an array."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield b.take(pa.array(range(at, to), pa.int64()))
            at, done = to, int(ends[to - 1])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document;
    ``ids`` holds the piece's little-endian uint32 ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tok = tokenizer(tokenizer_path)
        for b in text_slices(batches):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, body in enumerate(tok.encode(b.column("text"))):
                body += end
                for k, s in enumerate(range(0, len(body), 4 * capacity)):
                    part = body[s:s + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = {"doc_id": b.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Bins:
    """Bins of one group: item sizes, the bin of each item, the fill of each bin."""

    def __init__(self, size: np.ndarray, capacity: int):
        self.size, self.capacity = size.astype(np.int64), capacity
        self.bin = np.full(len(size), -1, np.int64)
        self.fill = np.zeros(0, np.int64)

    def best_fit(self) -> None:
        """Largest first, each into the fullest bin that still holds it. Bins
        are found by their room: bit r of ``open_`` says that some bin has r left."""
        rooms: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        fill: list[int] = []
        open_ = 0
        for i in np.argsort(-self.size, kind="stable").tolist():
            n = int(self.size[i])
            fits = open_ >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    open_ &= ~(1 << room)
            else:
                room, b = self.capacity, len(fill)
                fill.append(0)
            fill[b] += n
            self.bin[i] = b
            left = room - n
            if left:
                rooms[left].append(b)
                open_ |= 1 << left
        self.fill = np.array(fill, np.int64)

    def surplus(self) -> int:
        """Whole bins that the free room adds up to; at 0 no packing has fewer."""
        used = self.fill > 0
        return int(((self.capacity - self.fill[used]).sum()) // self.capacity)

    def _gain(self, donor: int, put: int, least: int = 0) -> tuple[int, int] | None:
        """Best exchange of ``put`` tokens of the donor for one item of another
        bin (least < its size < put): the item and the growth of its bin."""
        room = self.capacity - self.fill[self.bin]
        grow = put - self.size
        ok = (grow > 0) & (grow <= room) & (self.bin != donor) & (self.size > least)
        ok &= self.fill[self.bin] + grow > self.fill[donor]
        if not ok.any():
            return None
        i = int(np.where(ok, grow, -1).argmax())
        return i, int(grow[i])

    def _step(self, donor: int) -> bool:
        """One improving move of the donor's items, each raising the sum of
        squared fills: move one, else exchange one for one, else two for one."""
        own = np.flatnonzero(self.bin == donor)
        own = own[np.argsort(-self.size[own], kind="stable")]
        room = np.where(self.fill > 0, self.capacity - self.fill, -1)
        room[donor] = -1
        for i in own.tolist():
            n = int(self.size[i])
            fits = np.where((room >= n) & (self.fill + n > self.fill[donor]), room, self.capacity + 1)
            if len(fits) and fits.min() <= self.capacity:
                to = int(fits.argmin())
                self.bin[i] = to
                self.fill[to] += n
                self.fill[donor] -= n
                return True
        tried = set()
        for i in own.tolist():
            n = int(self.size[i])
            if n in tried:
                continue
            tried.add(n)
            if got := self._gain(donor, n):
                self._swap(donor, [i], *got)
                return True
        # items of one size are alike: the first two of each stand for all
        alike: dict[int, list[int]] = {}
        for i in own.tolist():
            alike.setdefault(int(self.size[i]), []).append(i)
        stand = [i for group in alike.values() for i in group[:2]]
        sums: dict[int, tuple[int, int]] = {}
        for x, i in enumerate(stand):
            for j in stand[x + 1:]:
                sums.setdefault(int(self.size[i] + self.size[j]), (i, j))
        for n, pair in sorted(sums.items(), reverse=True):
            if n <= 2 * self.capacity and (got := self._gain(donor, n)):
                self._swap(donor, list(pair), *got)
                return True
        return False

    def _swap(self, donor: int, give: list[int], take: int, grow: int) -> None:
        other = int(self.bin[take])
        self.bin[give] = other
        self.bin[take] = donor
        self.fill[other] += grow
        self.fill[donor] -= grow

    def _hopeful(self) -> np.ndarray:
        """Whether a bin may have an improving step; no other bin has one.

        ``put`` tokens in place of an item of size s, or of none (s = 0), in a
        bin of room r need s < put <= s + r and raise the squares only if
        s + r - put is under the donor's room."""
        room = np.where(self.fill > 0, self.capacity - self.fill, 0)
        n, own = self.capacity + 1, room[self.bin]
        ends = np.unique(np.r_[room[room > 0], self.size[own > 0] * n + own[own > 0]])
        s, r = ends // n, ends % n
        excess = np.full(n, n)
        for e, low in sorted(zip((s + r).tolist(), s.tolist(), strict=True), reverse=True):
            excess[low + 1:e + 1] = e
        excess -= np.arange(n)
        may = np.zeros(len(self.fill), bool)
        may[self.bin[excess[self.size] < own]] = True
        rest = np.flatnonzero((own > 0) & ~may[self.bin])
        rest = rest[np.argsort(self.bin[rest], kind="stable")]
        size, at = self.size[rest], self.bin[rest]
        for d in range(1, len(rest)):  # pairs of a bin, d places apart
            pair = np.flatnonzero(at[d:] == at[:-d])
            if not len(pair):
                break
            good = excess[size[pair] + size[pair + d]] < room[at[pair]]
            may[at[pair[good]]] = True
        return may

    def improve(self) -> None:
        """Empty the least filled bins, one after the other, while the free
        room still adds up to a bin: rounds over all bins until a whole round
        has no improving step."""
        moved = True
        while moved and self.surplus():
            moved, may = False, self._hopeful()
            while may.any() and self.surplus():
                left = np.flatnonzero(may)
                donor = int(left[self.fill[left].argmin()])
                may[donor] = False
                while self.fill[donor] > 0 and self._step(donor):
                    moved = True

    def offsets(self) -> np.ndarray:
        order = np.argsort(self.bin, kind="stable")
        size = self.size[order]
        before = np.cumsum(size) - size
        first = np.r_[True, self.bin[order][1:] != self.bin[order][:-1]]
        at = before - np.maximum.accumulate(np.where(first, before, 0))
        out = np.empty(len(size), np.int64)
        out[order] = at
        return out


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length (1 to capacity)."""
    b = Bins(np.asarray(lengths), capacity)
    if not len(b.size):
        return b.bin, b.bin
    b.best_fit()
    b.improve()
    return b.bin, b.offsets()


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         group_pieces: int = GROUP_PIECES, work: Work | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row
    per piece. sequence_id: group * 2**32 + bin; full pieces have negative ones."""
    work = work or Work(docs.sparkSession, "swap-pack")
    pieces = work.table(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    whole = pieces.filter(F.col("length") == capacity).select(
        "*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    # dealt by the row's place in the written table, so repeated rows spread too
    dealt = rest.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(p: pa.Table) -> pa.Table:
        bins, offset = pack_lengths(p.column("length").to_numpy(), capacity)
        seq = p.column("g").to_numpy() * (1 << 32) + bins
        return (p.drop_columns("g").append_column("sequence_id", pa.array(seq, pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    packed = dealt.groupBy("g").applyInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return whole.unionByName(packed)
