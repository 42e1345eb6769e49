"""Best-fit packing of token sequences by exact complements.

Lengths are at most ``size``, so the whole corpus is one histogram of lengths, and the plan is made on
that histogram alone: which lengths go together, and how often. For a length the index of available
lengths (a bit per length) is asked for a single, a pair or a triple that fills the gap exactly; a
combination is consumed as often as all its lengths allow. What has no exact complement is packed best
fit: the longest length that fits goes in, and after every placement the exact index is asked again.
The plan has a few entries per length, whatever the number of pieces. Pieces then find their place
on their own: a piece is the r-th of its length, and r lies in one entry of the plan.

Defined cases: null and empty texts are the end id alone; longer ones are cut into ``size`` ids; rows
that repeat a doc_id are separate documents; null ids stay null; an empty table gives no pieces; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import written

CACHED_WORDS = 800_000


# Letters that stay single letters when composed and lower-cased: ASCII, Latin-1 and Latin Extended-A without U+0130.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)([.,]?)")


class WordIds(dict):
    """Token ids of texts as little-endian bytes. Blanks and line breaks always end a word of this
    vocabulary, so the ids of a text are those of its words, and words repeat: this is their cache.
    A plain word, with a stop or comma at most, goes to the vocabulary's merges directly; any other
    goes through the whole tokenizer."""

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
        others = iter(range(256, 512))
        self.byte_letters = [chr(b if b in printable else next(others)) for b in range(256)]

    def __missing__(self, word: str) -> bytes:
        if m := PLAIN.fullmatch(word):
            letters, stop = m.groups()
            low = letters.lower()
            if stop or low != letters:
                out = self[low] + self[stop]
            else:
                spelled = "".join([self.byte_letters[b] for b in low.encode()])
                out = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        else:
            out = self.encoded(word)
        if len(self) < CACHED_WORDS and len(word) <= 40:
            self[word] = out
        return out

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its number among the pieces of its length in its task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = ids.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(own), 4 * size)):
                    part = own[at: at + 4 * size]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            doc, piece, start, length, crc = (list(c) for c in zip(*rows)) if rows else ([],) * 5
            wide = np.array(length, np.int64)
            order = np.argsort(wide, kind="stable")
            counts = np.bincount(wide, minlength=size + 1)
            nth = np.empty(len(wide), np.int64)
            nth[order] = np.arange(len(wide)) - np.repeat(np.cumsum(counts) - counts, counts)
            nth += seen[wide]
            seen += counts
            yield pa.RecordBatch.from_arrays([
                pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(wide),
                pa.array(crc, pa.int64()), pa.array(np.full(len(wide), task, np.int32)), pa.array(nth)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


class Stock:
    """How many pieces of each length are left, as counts and as an index with a bit per length."""

    def __init__(self, counts: list[int]):
        self.counts, self.size = counts, len(counts) - 1
        self.bits = self.mirror = 0
        for length, n in enumerate(counts):
            if n:
                self._flip(length)

    def _flip(self, length: int) -> None:
        self.bits ^= 1 << length
        self.mirror ^= 1 << (self.size - length)

    def add(self, length: int, n: int) -> None:
        before = self.counts[length]
        self.counts[length] += n
        if (before > 0) != (self.counts[length] > 0):
            self._flip(length)

    def longest(self, most: int) -> int:
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, as even as can be."""
        if total < 2:
            return None
        found = self.bits & (self.mirror >> (self.size - total))
        half = (total + 1) // 2
        if total % 2 == 0 and self.counts[half] == 1:
            found &= ~(1 << half)
        found >>= half
        if not found:
            return None
        a = half + (found & -found).bit_length() - 1
        return (a, total - a)

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.counts[gap]:
            return (gap,)
        if two := self.pair(gap):
            return two
        a = self.longest(gap - 2) if gap >= 3 else 0
        while a > 0 and 3 * a >= gap:
            self.add(a, -1)
            two = self.pair(gap - a)
            self.add(a, 1)
            if two:
                return (a, *two)
            a = self.longest(a - 1)
        return None


def packed(histogram: list[int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how many such sequences)] for histogram[length] pieces of each length."""
    stock, plan = Stock(list(histogram)), []

    def consume(own: list[int]) -> None:
        """``own`` is taken out of the stock once already; take it as often as it goes."""
        more = min(stock.counts[x] // own.count(x) for x in set(own))
        for x in own:
            stock.add(x, -more)
        plan.append((tuple(own), more + 1))

    for length in range(size, 0, -1):  # exact combinations, longest first
        while stock.counts[length]:
            stock.add(length, -1)
            rest = stock.complement(size - length) if length < size else ()
            if rest is None:
                stock.add(length, 1)
                break
            for x in rest:
                stock.add(x, -1)
            consume([length, *rest])
    while stock.bits:  # what is left: best fit, with an exact end wherever there is one
        own, gap = [], size
        while gap and (x := stock.longest(gap)) > 0:
            rest = stock.complement(gap) if own else None
            for y in rest or (x,):
                stock.add(y, -1)
                own.append(y)
                gap -= y
        consume(own)
    return plan


def places(plan: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, np.ndarray]:
    """length -> rows (first rank, sequence of that rank, offset), by first rank."""
    used, out, sequence = [0] * (size + 1), {}, 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: np.array(v, np.int64) for x, v in out.items()}


def best_fit_packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, size: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = written(pieces(docs, tokenizer, end_id, size))
    counts = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    histogram = [0] * (size + 1)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        histogram[length] = n
    shared = rows.sparkSession.sparkContext.broadcast(places(packed(histogram, size), size))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                entries = table[int(length[own[0]])]
                at = np.searchsorted(entries[:, 0], rank[own], "right") - 1
                sequence[own] = entries[at, 1] + rank[own] - entries[at, 0]
                offset[own] = entries[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = rows.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, out)
