"""Cross-entropy difference: a target and a background bigram model score every document.

Both models count all words and all bigrams of the corpus, each word by its 64-bit hash. The background
counts every document, the target those of ``target``. Each model comes in two folds, a document being
scored by the fold that has not counted it, so that no text is praised for its own memory. A token's
probability after its predecessor is smoothed with the model's unigrams, and these with one count for
each distinct word of the corpus, so that they sum to one; a document's score is the mean over its
tokens of target loss less background loss, in nats: the lower, the closer to the target.

A token's loss is the logarithm of its context's count less one that depends on word and bigram, so
losses are summed where the counts are: a task sends each of its bigrams with the documents that have it
to the part of the bigram, which counts, and answers each block of documents that a task sent with one row
of sums per document, at most one for each distinct bigram sent; the block adds them up. Bigrams of a word outside
the ``FREQUENT`` most frequent meet at the word, which gives its count as well; counts of frequent words,
and of bigrams between the ``HOT`` most frequent ones, which many documents have, are broadcast. These two
sizes only decide where a count is taken, the result is the same. The number of parts grows with the tokens.

Defined cases: null, empty and blank texts have no tokens, and null losses and score; target rows whose
doc_id is null or not in the corpus count for nothing; rows that repeat a doc_id are scored one by one
and each counts; without target documents the target is uniform; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix64, parted, written
from .words import NOT_SPACE, slices

KNOWN = None  # words with counts of their own: all
BEGIN = -1  # the context of a first token
SMOOTHING = 16.0
FREQUENT, HOT = 1 << 16, 1 << 10
BEGIN_HASH = np.uint64(0x6A09E667F3BCC909)
PART_TOKENS = 1 << 21  # per part
PIECES = 8  # of a part, in memory one after the other
MOST_TOKENS, MOST_DOCS = 1 << 19, 50_000  # a task passes its bigrams on beyond these
MOST_HELD = 500_000  # distinct words a task holds before it passes its sums on
KINDS = ["n0", "n1", "n2", "n3"]  # counts in fold 0 and 1, outside and inside of the target: 2 * fold + inside


def kinds_of(ids: pa.Array, chosen: pa.Array) -> np.ndarray:
    return 2 * fold_of(ids) + chosen.to_numpy(zero_copy_only=False)


def by_model(counts: np.ndarray) -> np.ndarray:
    """[model, fold, ...] from [..., kind]; model 0 is the target, 1 the background."""
    return np.stack([[counts[..., 1], counts[..., 3]], [counts[..., 0] + counts[..., 1], counts[..., 2] + counts[..., 3]]])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begins], np.add.reduceat(counts[order], begins)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n0..n3) of docs (doc_id, text, chosen)."""
    def row(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(c) for c in counts.T.copy())], ["word", *KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            kinds = kinds_of(batch.column(0), batch.column(2))
            for part in slices(batch.column(1), NOT_SPACE):
                own, at = np.unique(part.hashes, return_inverse=True)
                kind = np.repeat(kinds[part.first: part.first + len(part.counts)], part.counts)
                held.append((own, np.bincount(at * 4 + kind, minlength=4 * len(own)).reshape(-1, 4)))
                size += len(own)
                if size > MOST_HELD:
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > MOST_HELD // 2:
                        yield row(*held[0])
                        held, size = [], 0
        if held:
            yield row(*summed(*map(np.concatenate, zip(*held))))

    return docs.mapInArrow(run, "word long, " + ", ".join(f"{k} long" for k in KINDS)).groupBy("word").agg(*(F.sum(k).alias(k) for k in KINDS))


def numbered(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each word among the known, or -1."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def fold_of(ids: pa.Array) -> np.ndarray:
    """0 or 1 for every document."""
    return (mix64(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(63)).astype(np.int64)


def shifted(values: np.ndarray, counts: np.ndarray, begin) -> np.ndarray:
    """What stands before every token; ``begin`` before the first of a document."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = begin
    return before


def flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """docs with ``chosen``: whether the document is in ``target``. Only texts that may be in it are shuffled."""
    outside, maybe = parted(docs, "doc_id", target, "target_id")
    inside = maybe.join(target, F.col("doc_id") == F.col("target_id"), "left").select(
        "doc_id", "text", F.col("target_id").isNotNull().alias("chosen"))
    return outside.select("doc_id", "text", F.lit(False).alias("chosen")).unionByName(written(inside))


def broadcast_counts(docs: DataFrame, known, hot) -> tuple[np.ndarray, np.ndarray]:
    """Counts per kind of the known words as contexts, the beginning being last, and of bigrams between hot words, the
    beginning being the last context."""
    n, h = len(known.value), HOT
    contexts = (n + 1) * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(contexts + (h + 1) * h * 4, np.int64)
        for batch in batches:
            kinds = kinds_of(batch.column(0), batch.column(2))
            for part in slices(batch.column(1), NOT_SPACE):
                kind = np.repeat(kinds[part.first: part.first + len(part.counts)], part.counts)
                at = numbered(part.hashes, known.value)
                before, word = shifted(at, part.counts, n), hot.value[at]
                first, both = hot.value[before], before >= 0
                own = [before[both] * 4 + kind[both]]
                both = (first >= 0) & (word >= 0)
                own.append(contexts + (first[both] * h + word[both]) * 4 + kind[both])
                own, count = np.unique(np.concatenate(own), return_counts=True)
                total[own] += count
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    found = docs.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(contexts + (h + 1) * h * 4, np.int64)
    total[found["at"].to_numpy()] = found["n"].to_numpy()
    return total[:contexts].reshape(-1, 4), total[contexts:].reshape(-1, 4)


def packed(*columns: np.ndarray) -> bytes:
    """Each byte place of each column on its own: where numbers are small, most places are empty."""
    squeeze, sizes, out = zstandard.ZstdCompressor(level=1), [len(c) for c in columns], []
    for c in columns:
        for place in np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T:
            out.append(squeeze.compress(place.tobytes()) if place.any() else b"")
            sizes.append(len(out[-1]))
    return b"".join([np.array(sizes, np.int32).tobytes(), *out])


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    places = sum(k.itemsize for k in kinds)
    sizes = np.frombuffer(data, np.int32, len(kinds) + places).tolist()
    loosen, at, lengths, out = zstandard.ZstdDecompressor(), 4 * len(sizes), iter(sizes[len(kinds):]), []
    for n, kind in zip(sizes, kinds):
        own = np.zeros((n, kind.itemsize), np.uint8)
        for i in range(kind.itemsize):
            size = next(lengths)
            if size:
                own[:, i] = np.frombuffer(loosen.decompress(data[at: at + size]), np.uint8)
            at += size
        out.append(own.reshape(-1).view(kind))
    return out


FREQUENT_WORD, RARE_WORD, RARE_CONTEXT, DOCUMENTS, ANSWER = range(5)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def sections(kind: int, group: np.ndarray, key: np.ndarray, more: np.ndarray, code: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, kind, data): each distinct (group, key) once, with the documents that have it; ``group`` decides the part.
    Tokens come in the order of the documents."""
    order = np.argsort(group, kind="stable") if kind != RARE_WORD else np.lexsort((key, group))
    group, key, more, code = group[order], key[order], more[order], code[order]
    if not len(key):
        return
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    item = np.flatnonzero(new | np.concatenate([[True], code[1:] != code[:-1]]))
    times = np.diff(np.append(item, len(key))).astype(np.uint32)
    entry = np.flatnonzero(new[item])  # place among the items
    has = np.diff(np.append(entry, len(item))).astype(np.uint32)
    group, key, more, code = group[item[entry]], key[item[entry]], more[item[entry]], code[item]
    edges = np.searchsorted(part_of(group, parts), np.arange(parts + 1))
    ends = np.append(entry, len(item))
    for p in np.flatnonzero(np.diff(edges)):
        a, b = edges[p], edges[p + 1]
        i, j = ends[a], ends[b]
        yield int(p), kind, packed(np.diff(group[a:b], prepend=np.uint64(0)), key[a:b] if kind == RARE_WORD else key[:0], more[a:b] if kind == FREQUENT_WORD else more[:0],
                                   has[a:b], code[i:j], times[i:j])


def combined(row: np.ndarray, loss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The summands of each row as one."""
    row, at = np.unique(row, return_inverse=True)
    return row, np.stack([np.bincount(at, x, len(row)) for x in loss])


def answers(kind: int, blocks: list[tuple[int, bytes]], prior: np.ndarray, tokens: np.ndarray, vocabulary: int, part: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, loss[model, row]) for the blocks (first row, data) of a part, a piece of its hashes after the other."""
    read = [(first, *unpacked(data, np.uint64, np.uint64, np.uint16, np.uint32, np.uint32, np.uint32)) for first, data in blocks]
    read = [(first, np.cumsum(group), *others) for first, group, *others in read]
    items = [np.concatenate([[0], np.cumsum(r[4], dtype=np.int64)]) for r in read]
    edges = [np.searchsorted(part_of(r[1], parts * PIECES), part * PIECES + np.arange(PIECES + 1)) for r in read]
    for i in range(PIECES):
        some = []
        for (first, group, key, more, has, code, times), item, edge in zip(read, items, edges):
            own, of = slice(edge[i], edge[i + 1]), slice(item[edge[i]], item[edge[i + 1]])
            some.append((np.full(of.stop - of.start, first), group[own], key[own], more[own], has[own], code[of], times[of]))
        if sum(len(x[1]) for x in some):
            yield combined(*answer(kind, *map(np.concatenate, zip(*some)), prior, tokens, vocabulary))


def answer(kind: int, first, group, key, more, has, code, times, prior: np.ndarray, tokens: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    row = first + (code & np.uint32((1 << 30) - 1))
    dealt, of = (code >> np.uint32(30)).astype(np.int64), np.repeat(np.arange(len(has)), has)
    distinct, group = np.unique(group, return_inverse=True)

    def counts(at: np.ndarray, n: int) -> np.ndarray:
        return by_model(np.bincount(at[of] * 4 + dealt, weights=times, minlength=4 * n).reshape(-1, 4))

    whole = counts(group, len(distinct))
    if kind == RARE_CONTEXT:
        at, value = group, np.log(whole + SMOOTHING)
    elif kind == FREQUENT_WORD:
        word = np.zeros(len(distinct), np.int64)
        word[group] = more
        at, value = group, -np.log(whole + SMOOTHING * prior[:, :, word])
    else:
        order = np.lexsort((key, group))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (group[order][1:] != group[order][:-1])])
        at = np.empty(len(key), np.int64)
        at[order] = np.cumsum(new) - 1
        word = group[order][new]
        value = -np.log(counts(at, len(word)) + SMOOTHING * ((whole + 1) / (tokens[:, :, None] + vocabulary))[:, :, word])
    return row, value[:, 1 - (dealt >> 1), at[of]] * times


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score (their difference, per token).
    ``target`` lists in doc_id the documents of the target domain."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = target.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id IS NOT NULL").distinct()
    context = docs.sparkSession.sparkContext
    docs = flagged(docs, target)
    words = written(word_counts(docs))
    vocabulary, *found = words.agg(F.count("*"), *(F.sum(k) for k in KINDS)).first()
    tokens = by_model(np.array([x or 0 for x in found]))
    parts = max(8, int(-(-tokens[1].sum() // PART_TOKENS)))
    top = words.orderBy((F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")).desc(), "word").limit(FREQUENT).toArrow()
    found = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    n = len(found)
    place = np.full(n + 2, -1)  # of a known word among the hot; of the beginning; of other words
    place[:n][order < HOT] = order[order < HOT]
    place[n] = HOT
    known, hot = context.broadcast(found[order]), context.broadcast(place)
    counts = np.stack([top[k].to_numpy() for k in KINDS], -1)
    one = (by_model(counts) + 1) / (tokens[:, :, None] + max(1, vocabulary))  # the most frequent first
    contexts, bigrams = broadcast_counts(docs, known, hot)
    word = np.minimum(np.arange(len(bigrams)) % HOT, max(0, n - 1))
    pair = -np.log(by_model(bigrams) + SMOOTHING * one[:, :, word]) if n else np.zeros((2, 2, len(bigrams)))
    prior = context.broadcast(one[:, :, order])
    local = context.broadcast((np.log(by_model(contexts) + SMOOTHING), pair.astype(np.float32)))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held = TaskContext.get().partitionId() << 40, []

        def passed() -> pa.RecordBatch:
            hashes, counts, kinds, ids = (np.concatenate([h[i] for h in held]) for i in range(4))
            valid = np.concatenate([h[4] for h in held])
            doc = np.repeat(np.arange(len(counts)), counts)
            at, first = numbered(hashes, known.value), shifted(hashes, counts, BEGIN_HASH)
            before = shifted(at, counts, n)
            code = (doc | kinds[doc] << 30).astype(np.uint32)
            other, heads = 1 - (kinds[doc] >> 1), hot.value[before]
            near = hot.value[at]
            seen, both = before >= 0, (heads >= 0) & (near >= 0)
            loss = [np.bincount(doc[seen], m[other[seen], before[seen]], len(counts))
                    + np.bincount(doc[both], pairs[other[both], heads[both] * HOT + near[both]], len(counts))
                    for m, pairs in zip(*local.value)]
            with np.errstate(over="ignore"):
                key = mix64(first * np.uint64(0x9E3779B97F4A7C15) + mix64(hashes))
                group = mix64(hashes)
            none = np.zeros(len(doc), np.uint16)
            out = [(row // MOST_DOCS % parts, DOCUMENTS, packed(ids, valid, counts, *loss))]
            for kind, own, g, more in ((FREQUENT_WORD, (at >= 0) & ~both, key, at.astype(np.uint16)), (RARE_WORD, at < 0, group, none),
                                       (RARE_CONTEXT, ~seen, mix64(first), none)):
                k = key if kind == RARE_WORD else g
                out.extend(sections(kind, g[own], k[own], more[own], code[own], parts))
            part, kind, data = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array([row] * len(out), pa.int64()),
                                               pa.array(data, pa.binary())], ["part", "kind", "first", "data"])

        for batch in batches:
            kinds = kinds_of(batch.column(0), batch.column(2))
            ids, valid = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for piece in slices(batch.column(1), NOT_SPACE):
                own = slice(piece.first, piece.first + len(piece.counts))
                held.append((piece.hashes, piece.counts, kinds[own], ids[own], valid[own]))
                if sum(len(h[0]) for h in held) > MOST_TOKENS or sum(len(h[1]) for h in held) > MOST_DOCS:
                    yield passed()
                    row, held = row + sum(len(h[1]) for h in held), []
        if held:
            yield passed()

    def answered(own: pd.DataFrame) -> pd.DataFrame:
        part, firsts = int(own["part"].iloc[0]), np.sort(own["first"].unique())
        rows, losses = [], []
        for kind, some in own.loc[own["kind"] != DOCUMENTS].groupby("kind"):
            for row, loss in answers(kind, list(zip(some["first"].tolist(), some["data"].tolist())), prior.value, tokens, vocabulary, part, parts):
                rows.append(row)
                losses.append(loss)
        out = own.loc[own["kind"] == DOCUMENTS, ["first", "part", "kind", "data"]]
        if not rows:
            return out
        row, loss = combined(np.concatenate(rows), np.concatenate(losses, 1))
        edges = np.append(np.searchsorted(row, firsts), len(row))
        told = [(first, part, ANSWER, packed(np.diff(row[i:j] - first, prepend=0).astype(np.uint32), *loss[:, i:j]))
                for first, i, j in zip(firsts.tolist(), edges, edges[1:]) if i < j]
        return pd.concat([out, pd.DataFrame(told, columns=out.columns)])

    def whole(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["kind", "part"])  # always the same sum
        ids, valid, counts, *loss = unpacked(own.loc[own["kind"] == DOCUMENTS, "data"].iloc[0], np.int64, bool, np.int64, np.float64, np.float64)
        for data in own.loc[own["kind"] == ANSWER, "data"]:
            row, *more = unpacked(data, np.uint32, np.float64, np.float64)
            for total, x in zip(loss, more):
                total[np.cumsum(row, dtype=np.int64)] += x
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_tokens": counts, "t": loss[0], "b": loss[1]})
        out.loc[~valid, "doc_id"] = pd.NA
        return out

    sums = docs.mapInArrow(sent, "part int, kind int, first long, data binary").groupBy("part").applyInPandas(
        answered, "first long, part int, kind int, data binary").groupBy("first").applyInPandas(
        whole, "doc_id long, n_tokens long, t double, b double")
    mean = {c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")) for c in "tb"}
    return sums.select("doc_id", "n_tokens", mean["t"].alias("target_loss"), mean["b"].alias("background_loss"),
                       (mean["t"] - mean["b"]).alias("score"))
