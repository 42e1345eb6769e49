"""Removal of repeated substrings by merging Burrows-Wheeler transforms.

Every byte covered by a ``WINDOW``-byte string that also starts in a document with a smaller doc_id is
removed. Strings of that length are dealt out by their minimiser, the least hash among their
``GRAM``-byte grams, so equal strings meet in one place; neighbouring strings with the same minimiser
travel as one short text. Three steps:

1. Minimisers that occur in one document only are ruled out. Their hashes are exchanged as sorted
   blocks, an often repeated one twice a slice at most, and the others set bits in a filter of fixed
   size, which lets more through when it fills up, but never less.
2. Texts around the other minimisers are exchanged. Of equal texts within a task only the one of the
   smallest document travels; the rest are settled, for they have a smaller document.
3. Where a minimiser has several different texts, these form shards. Each shard's Burrows-Wheeler
   transform is built on its own, and the transforms are merged by refining their interleave: a pass
   sorts all rows by one more byte using the transforms alone, suffixes are not sorted again. The pass
   at which two neighbours part is their common prefix; rows never parted are a repeated interval, and
   the smallest document of an interval keeps its string.

Whole copies are found beforehand by a hash of the text and take no part in steps 2 and 3.

Defined cases: null texts are empty; texts shorter than the window lose nothing; rows that repeat a
doc_id are judged one by one and never against each other; rows with a null doc_id lose nothing and
count for nothing; an empty table gives an empty result; further columns are kept by ``deduplicated``
and ignored by ``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_views, having, id_filter, mix64, narrowed, parted, passes, stream, written
from .words import byte_slices, prefix_hash, span_hash

WINDOW, GRAM = 50, 20
REACH = WINDOW - GRAM + 1  # grams in a window
FILTER_BITS = 28  # 32 MiB at most; less text has a smaller one, of a bit or two a byte
LEAST_BITS = 20
BLOCK_BYTES = 8 << 20  # of text a hash block stands for
HELD_ROWS = 60_000
SCAN_BYTES = 256 << 10
SHARD_BYTES, SHARDS = 256 << 10, 4
RAW, RAW_TOO = stream(41, 256), stream(42, 256)


def runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, starts, minimiser hash): neighbouring windows of a document with one minimiser."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < WINDOW:
        return empty, empty, empty, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        at = np.arange(n - GRAM + 1)
        gram = mix64(span_hash(prefix_hash(data, RAW), at, at + GRAM))
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties to the left
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[REACH - width:][: n - WINDOW + 1])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = doc[: n - WINDOW + 1] == doc[WINDOW - 1:]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1: n - WINDOW + 1] != doc[: n - WINDOW])
    first = np.flatnonzero(new)
    total = np.cumsum(inside)
    count = np.diff(np.append(total[first] - 1, total[-1] if len(total) else 0))
    return doc[first], first, count, mix64(gram[anchor[first]])  # least hashes are small: mixed again they spread evenly


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), two more hashes of it, n_bytes, sha256."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("key"), F.xxhash64(text, F.lit(1)).alias("more"),
                       F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha256"))


def filter_bits(total_bytes: int) -> int:
    """The filter has 2**bits bits: the driver holds and sends no more of it than the text asks for."""
    return min(max(LEAST_BITS, int(total_bytes).bit_length()), FILTER_BITS)


def block_bits(total_bytes: int) -> int:
    """Work is dealt to 2**bits blocks, each for about BLOCK_BYTES of text."""
    return min(max(6, int(total_bytes // BLOCK_BYTES).bit_length()), filter_bits(total_bytes) - 3)


def repeated_minimisers(docs: DataFrame, total_bytes: int) -> np.ndarray:
    """The filter: bit ``hash >> (64 - filter_bits)`` is set for every minimiser that two documents have."""
    bits, size = block_bits(total_bytes), filter_bits(total_bytes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, offsets, data in byte_slices(batch.column(1), SCAN_BYTES):
                doc, _, _, gram = runs(offsets, data)
                if not len(gram):
                    continue
                order = np.lexsort((doc, gram))
                gram, doc = gram[order], doc[order]
                once = np.concatenate([[True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])])
                gram = gram[once]
                third = np.concatenate([[False, False], gram[2:] == gram[:-2]])[: len(gram)]
                gram = gram[~third]
                block = (gram >> np.uint64(64 - bits)).astype(np.int64)
                value = ((gram << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                edge = np.searchsorted(block, np.arange((1 << bits) + 1))
                full = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)),
                                                  binary_views(np.append(edge[full], len(value)) * 4, value.view(np.uint8))],
                                                 ["block", "hashes"])

    rest = size - bits  # bits of the filter within a block

    def repeated(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        value = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in part["hashes"]]))
        twice = value[1:][value[1:] == value[:-1]]
        own = np.zeros(1 << rest, bool)
        own[(twice >> np.uint32(32 - rest)).astype(np.int64)] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(own).tobytes()]})

    out = np.zeros(1 << (size - 3), np.uint8)
    wide = 1 << (rest - 3)
    blocks = docs.mapInArrow(hashed, "block int, hashes binary").groupBy("block").applyInPandas(repeated, "block int, bits binary")
    for r in blocks.toLocalIterator():  # the filter in all
        out[r["block"] * wide: (r["block"] + 1) * wide] = np.frombuffer(r["bits"], np.uint8)
    return out


SETTLED_SQL = "doc_id long, key long, first long, mask long"


@dataclass
class Texts:
    """Texts around minimisers, as columns; a settled one has no bytes any more, all its starts go."""

    gram: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    size: np.ndarray  # bytes of each text, 0 when settled
    data: np.ndarray

    COLUMNS = (("gram", np.uint32), ("doc", np.int64), ("key", np.int64), ("first", np.int64), ("starts", np.uint8), ("size", np.uint8))

    @classmethod
    def joined(cls, parts: list[Texts]) -> Texts:
        return cls(*(np.concatenate([getattr(p, n) for p in parts]) for n in (*(c for c, _ in cls.COLUMNS), "data")))

    @property
    def begin(self) -> np.ndarray:
        return np.cumsum(self.size, dtype=np.int64) - self.size

    def taken(self, at: np.ndarray) -> Texts:
        size = self.size[at].astype(np.int64)
        where = np.repeat(self.begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Texts(*(getattr(self, n)[at] for n, _ in self.COLUMNS), self.data[where])

    def packed(self) -> bytes:
        """Sorted by gram, so that neighbours are alike, and compressed column by column."""
        columns = [getattr(self, n).astype(kind) for n, kind in self.COLUMNS]
        columns[0] = np.diff(columns[0], prepend=np.uint32(0))
        raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
        return len(self.gram).to_bytes(4, "little") + zstandard.compress(raw + self.data.tobytes(), 1)

    @classmethod
    def unpacked(cls, blob: bytes) -> Texts:
        n, raw = int.from_bytes(blob[:4], "little"), zstandard.decompress(blob[4:])
        at, columns = 0, []
        for _, kind in cls.COLUMNS:
            wide = np.dtype(kind).itemsize
            columns.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).reshape(-1))
            at += n * wide
        columns[0] = np.cumsum(columns[0], dtype=np.uint32)
        return cls(*columns, np.frombuffer(raw, np.uint8, -1, at))


def folded(texts: Texts, one: np.ndarray, two: np.ndarray) -> Texts:
    """Of equal texts (by their two hashes) only those of the smallest document keep their bytes. Sorted by gram."""
    order = np.lexsort((texts.doc, two, one))
    same = np.zeros(len(order), bool)
    same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    settled = np.zeros(len(order), bool)
    settled[order] = same & (texts.doc[order] > texts.doc[order][lead])
    keep = np.repeat(~settled, texts.size)
    with np.errstate(over="ignore"):
        spread = (mix64(texts.first.view(np.uint64) * np.uint64(31) + texts.doc.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    out = Texts(np.where(settled, spread, texts.gram), texts.doc, texts.key, texts.first, texts.starts,
                np.where(settled, 0, texts.size).astype(np.uint8), texts.data[keep])
    return out.taken(np.argsort(out.gram, kind="stable"))


def travelling(reps: DataFrame, shared, blocks: int, skipped=None) -> DataFrame:
    """(block, texts): the texts around minimisers that may be repeated, dealt by minimiser to 2**blocks blocks.
    Rows that the row filter ``skipped`` lets through are left out."""
    def told(held: list[tuple]) -> pa.RecordBatch:
        texts = folded(Texts.joined([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        block = (texts.gram >> np.uint32(32 - blocks)).astype(np.int64)
        edge = np.searchsorted(block, np.arange((1 << blocks) + 1))
        full = np.flatnonzero(np.diff(edge))
        blobs = [texts.taken(np.arange(edge[k], edge[k + 1])).packed() for k in full]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["block", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, rows = shared.value, [], 0
        shift = np.uint64(64 - (8 * len(bits) - 1).bit_length())
        for batch in batches:
            if skipped is not None:
                batch = batch.filter(pa.array(~passes(skipped.value, batch.column(0).to_numpy(zero_copy_only=False))))
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for at, offsets, data in byte_slices(batch.column(1), SCAN_BYTES):
                doc, first, starts, gram = runs(offsets, data)
                slot = gram >> shift
                maybe = (bits[(slot >> np.uint64(3)).astype(np.int64)] << (slot & np.uint64(7)).astype(np.uint8)) & 128 != 0
                doc, first, starts, gram = doc[maybe], first[maybe], starts[maybe], gram[maybe]
                if not len(doc):
                    continue
                size = starts + WINDOW - 1
                with np.errstate(over="ignore"):
                    one = span_hash(prefix_hash(data, RAW), first, first + size)
                    two = span_hash(prefix_hash(data, RAW_TOO), first, first + size) + size.astype(np.uint64)
                take = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                held.append((Texts((gram >> np.uint64(32)).astype(np.uint32), ids[at + doc], keys[at + doc], first - offsets[doc],
                                   starts.astype(np.uint8), size.astype(np.uint8), data[take]), one, two))
                rows += len(doc)
                if rows >= HELD_ROWS:
                    yield told(held)
                    held, rows = [], 0
        if held:
            yield told(held)

    return reps.mapInArrow(run, "block int, texts binary")


def transform(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, text number, offset) of a shard's suffixes in order; symbol 0 ends a text, bytes count from 1."""
    size = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(size) - size
    n = int(size.sum())
    symbols = np.zeros(n, np.uint8)
    inner = np.ones(n, bool)
    inner[begin + size - 1] = False
    symbols[inner] = np.concatenate(texts) + 1
    owner = np.repeat(np.arange(len(texts)), size)
    offset = np.arange(n) - begin[owner]
    left = size[owner] - offset - 1  # bytes before the end
    # First eight bytes as one number, then ranks of twice the length, until no two are alike.
    wide = np.concatenate([symbols, np.zeros(8, np.uint8)])
    number = np.zeros(n, np.uint64)
    for j in range(8):
        number = (number << np.uint64(8)) | np.where(left >= j, wide[j: n + j], 0).astype(np.uint64)
    order = np.argsort(number)
    step = 8
    rank = np.empty(n, np.int64)
    while True:
        sorted_ = number[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        if step > size.max():
            break
        # a suffix that ends within ``step`` bytes is ordered by its text's number
        later = np.where(left >= step, rank[np.minimum(np.arange(n) + step, n - 1)] + len(texts), owner)
        number = rank.astype(np.uint64) * np.uint64(n + len(texts) + 1) + later.astype(np.uint64)
        order = np.argsort(number)
        step *= 2
    before = np.where(offset[order] > 0, symbols[np.maximum(order - 1, 0)], 0).astype(np.uint8)
    return before, owner[order], offset[order]


def merged(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each row, common prefix with the row before) after ``depth`` refinements of the interleave;
    a common prefix of ``depth`` means that many bytes or more."""
    symbols = np.concatenate([s[0] for s in shards])
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s[0]) for s in shards])
    ends = np.concatenate([np.full((s[0] == 0).sum(), k, np.uint8) for k, s in enumerate(shards)])  # rows of the empty suffixes
    group = np.zeros(len(z), np.int32)
    common = np.full(len(z), depth, np.uint8)
    common[0] = 0
    place = np.empty(len(z), np.uint8)
    for k in range(depth):
        place[np.argsort(z, kind="stable")] = symbols  # each shard's transform, in the order of its own rows
        order = np.argsort(place, kind="stable")[len(ends):]
        z = np.concatenate([ends, z[order]])
        letters, old = place[order], group[order]
        parted = np.ones(len(z), bool)
        parted[len(ends) + 1:] = (letters[1:] != letters[:-1]) | (old[1:] != old[:-1])
        common[parted & (common == depth)] = k
        common[0] = 0
        group = np.cumsum(parted, dtype=np.int32)
        if parted.all():
            break
    return z, common


def interval_documents(texts: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
    """For each text and each window start in it, the smallest document among all texts with that window."""
    cuts, size, start = [], 0, 0
    most = max(SHARD_BYTES, sum(map(len, texts)) // 200)
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most or i == len(texts) - 1:
            cuts.append((start, i + 1))
            start, size = i + 1, 0
    if len(cuts) == 1 and len(texts) > 1:
        half = len(texts) // 2
        cuts = [(0, half), (half, len(texts))]
    shards = [transform(texts[a:b]) for a, b in cuts]
    z, common = merged(shards, WINDOW)
    row = np.argsort(z, kind="stable")
    text, offset = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    text[row] = np.concatenate([s[1] + a for s, (a, _) in zip(shards, cuts)])
    offset[row] = np.concatenate([s[2] for s in shards])
    begins = np.flatnonzero(common < WINDOW)
    low = np.repeat(np.minimum.reduceat(docs[text], begins), np.diff(np.append(begins, len(z))))
    starts = np.array([len(t) - WINDOW + 1 for t in texts])
    base = np.cumsum(starts) - starts
    out = np.empty(starts.sum(), np.int64)
    own = offset < starts[text]
    out[base[text[own]] + offset[own]] = low[own]
    return np.split(out, base[1:])


def decided(rows: DataFrame) -> DataFrame:
    """doc_id, key, first, mask: bit i says that the window at first + i is to go. A block has a bounded share of the text."""
    def settle(part: pd.DataFrame) -> pd.DataFrame:
        texts = Texts.joined([Texts.unpacked(x) for x in part["texts"]])
        settled = texts.size == 0
        mask = np.where(settled, (np.uint64(1) << texts.starts.astype(np.uint64)) - np.uint64(1), np.uint64(0))
        place = texts.begin
        with np.errstate(over="ignore"):
            live = np.flatnonzero(~settled)
            end = place[live] + texts.size[live]
            one, two = (span_hash_long(texts.data, value, place[live], end) for value in (RAW, RAW_TOO))
        order = np.lexsort((texts.doc[live], two, one, texts.gram[live]))
        live, one, two = live[order], one[order], two[order]
        g, d = texts.gram[live], texts.doc[live]
        if len(live):
            new_gram = np.concatenate([[True], g[1:] != g[:-1]])
            new_text = new_gram | np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            lead = np.maximum.accumulate(np.where(new_text, np.arange(len(live)), 0))
            full = (np.uint64(1) << texts.starts[live].astype(np.uint64)) - np.uint64(1)
            number = np.cumsum(new_gram) - 1
            several = np.flatnonzero(new_text & (np.bincount(number, weights=new_text)[number] > 1))
            low = np.zeros(len(live), np.uint64)
            begin = 0
            while begin < len(several):  # whole minimisers, about SHARDS shards at a time
                end = min(len(several), begin + SHARDS * SHARD_BYTES // 66)
                while end < len(several) and number[several[end]] == number[several[end - 1]]:
                    end += 1
                some = several[begin:end]
                found = interval_documents([texts.data[place[i]: place[i] + texts.size[i]] for i in live[some]], d[some])
                for i, x, own in zip(some.tolist(), found, d[some].tolist()):
                    hit = np.flatnonzero(x < own)
                    if len(hit):
                        low[i] = np.bitwise_or.reduce(np.uint64(1) << hit.astype(np.uint64))
                begin = end
            mask[live] = np.where(d > d[lead], full, low[lead])  # rows of the leading document share its answer
        keep = mask != 0
        return pd.DataFrame({"doc_id": texts.doc[keep], "key": texts.key[keep], "first": texts.first[keep],
                             "mask": mask[keep].view(np.int64)})

    return rows.groupBy("block").applyInPandas(settle, SETTLED_SQL)


def span_hash_long(data: np.ndarray, value: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """``span_hash`` over a long buffer, some megabytes at a time; spans follow each other."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + most, "right")))
        own = data[start[at]: end[to - 1]]
        out[at:to] = span_hash(prefix_hash(own, value), start[at:to] - start[at], end[at:to] - start[at])
        at = to
    return out


def spans_of(marks: DataFrame) -> DataFrame:
    """doc_id, key, spans: removed runs of bytes as first and end byte, in turn."""
    ordered = marks.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spans = None, []
        for batch in batches:
            doc, key, first, mask = (batch.column(i).to_numpy() for i in range(4))
            bit = (mask.view(np.uint64)[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1) != 0
            row, at = np.nonzero(bit)
            start = first[row] + at
            d, k = doc[row], key[row]
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (start[1:] > start[:-1] + WINDOW)])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(start)) - 1
            out = []
            for a, e in zip(begin.tolist(), end.tolist()):
                own = (int(d[a]), int(k[a]))
                if own != now:
                    if now:
                        out.append((*now, spans))
                    now, spans = own, []
                if spans and start[a] <= spans[-1]:
                    spans[-1] = max(spans[-1], int(start[e]) + WINDOW)
                else:
                    spans += [int(start[a]), int(start[e]) + WINDOW]
            yield _span_rows(out)
        if now:
            yield _span_rows([(*now, spans)])

    return ordered.mapInArrow(run, "doc_id long, key long, spans array<long>")


def _span_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(
        (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["doc_id", "key", "spans"])


def without(text: bytes, spans: list[int]) -> bytes:
    at, kept = 0, []
    for a, b in zip(spans[::2], spans[1::2]):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries with column ``copy``: a document of smaller id has the whole text; spans of the other documents)."""
    rows = written(summaries(docs))
    lowest = rows.where("doc_id IS NOT NULL").groupBy("key", "more", "n_bytes").agg(F.min("doc_id").alias("low"))
    rows = written(rows.join(lowest, ["key", "more", "n_bytes"], "left").withColumn(
        "copy", F.coalesce((F.col("doc_id") > F.col("low")) & (F.col("n_bytes") >= WINDOW), F.lit(False))).drop("low"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    texts = docs.where("doc_id IS NOT NULL").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    shared = docs.sparkSession.sparkContext.broadcast(repeated_minimisers(texts, total))
    copies = rows.where("copy").select(F.col("doc_id").alias("copy_id"), F.col("key").alias("copy_key")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(copies, "copy_id"))
    first = having(texts, "doc_id", bits, True).join(
        copies, (F.col("doc_id") == F.col("copy_id")) & (F.col("key") == F.col("copy_key")), "left_anti")
    blocks = block_bits(total)
    rows_of = travelling(texts, shared, blocks, bits).unionByName(travelling(first, shared, blocks))
    return rows, written(spans_of(decided(rows_of)))


def own_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first and end byte of removed runs)."""
    docs = own_columns(docs)
    rows, spans = repeated_spans(docs)
    keyed = narrowed(docs, "doc_id", spans, "doc_id").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = keyed.join(spans, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [hashlib.sha256(without(t.encode(), s)).hexdigest() for t, s in zip(
                batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string()), batch.column(3)],
                                             ["doc_id", "key", "kept", "spans"])

    cut = texts.mapInArrow(run, "doc_id long, key long, kept string, spans array<long>")
    removed = F.aggregate(F.sequence(F.lit(1), F.size("spans") - 1, F.lit(2)), F.lit(0).cast("long"),
                          lambda n, i: n + F.get("spans", i) - F.get("spans", i - 1))
    spans = F.when(F.col("copy"), F.array(F.lit(0).cast("long"), "n_bytes")).otherwise(F.coalesce("spans", F.array().cast("array<long>")))
    kept = F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha256"))
    return rows.join(cut, ["doc_id", "key"], "left").withColumn("spans", spans).select(
        "doc_id", "n_bytes", F.when(F.size("spans") > 0, removed).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"), kept.alias("kept_sha256"), "spans")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, repeated bytes cut from the texts; a character cut in two goes whole.
    Documents of which nothing is left are dropped; those that lose nothing stay as they are."""
    names = docs.columns
    rows, spans = repeated_spans(own_columns(docs))
    whole = rows.where("copy").select("doc_id", "key", F.array(F.lit(0).cast("long"), "n_bytes").alias("spans")).distinct()
    spans = spans.unionByName(whole).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    rest, maybe = parted(docs, "doc_id", spans, "_doc")
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if s is None else without(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(
                batch.column(text).to_pylist(), batch.column(len(names)).to_pylist())]
            left = [t != "" or s is None for t, s in zip(texts, batch.column(len(names)).to_pylist())]
            columns = list(batch.columns[:-1])
            columns[text] = pa.array(texts, columns[text].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(left, pa.bool_()))

    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    cut = maybe.withColumn("_own", key).join(spans, (F.col("doc_id") == F.col("_doc")) & (F.col("_own") == F.col("_key")), "left").select(
        *names, "_spans").mapInArrow(run, docs.schema)
    return rest.unionByName(cut)
