"""Benchmark decontamination with a generalised suffix automaton over the test items.

Items are normalised to words; their automaton knows every run of words that any item contains. A
document's words stream through it, tracking the longest match that ends at each word: a match of
``window`` words or more marks the last ``window`` words as hit, and its state tells which items hold
them. An item shorter than the window counts when it occurs whole. Words that no item has cannot take
part, so only stretches whose word pairs all occur in items reach the automaton.

Items are dealt to shards of a bounded number of words, so an automaton that is broadcast has a fixed
largest size; documents pass ``SHARDS_A_PASS`` of them in one Python step and further steps follow
without a shuffle in between.

Defined cases: null and empty texts have no words; items without words never occur; equal items are
all reported; items that repeat an item_id are one item; items with a null id are left out; an empty
benchmark hits nothing; rows that repeat a doc_id are judged one by one; further columns are kept by
``decontaminated`` and ignored by ``matched``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mix64
from .words import ALNUM, slices

SHARD_WORDS = 100_000
SHARDS_A_PASS = 8
LUT_BITS = 22


@dataclass
class Automaton:
    """Generalised suffix automaton. ``ending``: for the state of a short item's whole text, (words, item)."""

    window: int
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    holds: list[set[int]] = field(default_factory=lambda: [set()])
    ending: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    pairs: set[tuple[int, int]] = field(default_factory=set)
    short: dict[int, set[int]] = field(default_factory=dict)  # words of a short item -> hashes of such items

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.holds.append(set())
        self.ending.append([])
        return len(self.link) - 1

    def _split(self, origin: int, word: int, target: int) -> int:
        """The part of ``target`` that is one word longer than ``origin``, as a state of its own."""
        part = self._state(self.length[origin] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = part
        while origin >= 0 and self.step[origin].get(word) == target:
            self.step[origin][word] = part
            origin = self.link[origin]
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:  # another item has been here
            target = self.step[last][word]
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.step[last][word]
            self.link[new] = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        return new

    def add(self, item: int, words: list[int]) -> None:
        at, path = 0, []
        for w in words:
            at = self._extend(at, w)
            path.append(at)
        if self.window == 1:  # a window is a word, and no pair leads to it
            self.short.setdefault(1, set()).update(run_hash([w]) for w in words)
        elif 0 < len(words) < self.window:
            self.short.setdefault(len(words), set()).add(run_hash(words))
        else:
            self.pairs.update(zip(words, words[1:]))

    def finish(self, items: list[tuple[int, list[int]]]) -> None:
        """Mark, per item, the states of its windows; splits are over now."""
        for item, words in items:
            at, matched = 0, 0
            for w in words:
                at, matched = self.move(at, matched, w)
                if matched >= self.window:
                    self.holds[self.of_window(at)].add(item)
            if 0 < len(words) < self.window:
                self.ending[at].append((len(words), item))

    def move(self, at: int, matched: int, word: int) -> tuple[int, int]:
        while at and word not in self.step[at]:
            at = self.link[at]
            matched = self.length[at]
        if word in self.step[at]:
            return self.step[at][word], matched + 1
        return 0, 0

    def of_window(self, at: int) -> int:
        """The state of the last ``window`` words of a match that is at least so long."""
        while self.length[self.link[at]] >= self.window:
            at = self.link[at]
        return at

    def scan(self, words: list[int], hit: np.ndarray, items: set[int]) -> int:
        """Mark hit words and add the items; the longest match in words."""
        at = matched = longest = 0
        for i, w in enumerate(words):
            at, matched = self.move(at, matched, w)
            longest = max(longest, matched)
            if matched >= self.window:
                hit[i + 1 - self.window: i + 1] = True
                items |= self.holds[self.of_window(at)]
            if self.short:
                s = at
                while s > 0:
                    for n, item in self.ending[s]:
                        if n <= matched:
                            hit[i + 1 - n: i + 1] = True
                            items.add(item)
                    s = self.link[s]
        return longest


def run_hash(words: list[int]) -> int:
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for w in words:
            total = total * np.uint64(0x9E3779B97F4A7C15) + np.uint64(w)
    return int(total)


class Scanner:
    """An automaton and the tables that tell which stretches of a document it has to see."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.automaton = Automaton(window)
        for item, words in items:
            self.automaton.add(item, words)
        self.automaton.finish(items)
        self.pair_table = np.zeros(1 << LUT_BITS, bool)
        pairs = np.array(sorted(self.automaton.pairs), np.uint64).reshape(-1, 2)
        self.pair_table[self._slot(pairs[:, 0], pairs[:, 1])] = True
        self.short = {n: np.array(sorted(v), np.uint64) for n, v in self.automaton.short.items()}

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(a * np.uint64(3) + b) >> np.uint64(64 - LUT_BITS)).astype(np.int64)

    def stretches(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Disjoint runs of words, each of one document, outside which nothing can occur."""
        n, w = len(h), self.automaton.window
        open_ = np.zeros(n + 1, np.int32)
        if n > 1 or w == 1:
            ok = np.zeros(n + 1, bool)
            if w > 1:
                ok[1:n] = self.pair_table[self._slot(h[:-1], h[1:])] & (doc[1:] == doc[:-1])
            edge = np.flatnonzero(np.diff(ok.astype(np.int8)))
            begin, end = edge[::2], edge[1::2]  # words begin .. end inclusive are joined by pairs of items
            long = end - begin + 1 >= w
            np.add.at(open_, begin[long], 1)
            np.add.at(open_, end[long] + 1, -1)
        for size, known in self.short.items():
            if n < size:
                continue
            total = np.zeros(n - size + 1, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(size):
                    total = total * np.uint64(0x9E3779B97F4A7C15) + h[j: n - size + 1 + j]
            place = np.minimum(np.searchsorted(known, total), len(known) - 1)
            at = np.flatnonzero((known[place] == total) & (doc[: n - size + 1] == doc[size - 1:]))
            np.add.at(open_, at, 1)
            np.add.at(open_, at + size, -1)
        inside = np.cumsum(open_[:n]) > 0
        cut = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        out = []
        for a, b in zip(cut[::2].tolist(), cut[1::2].tolist()):
            borders = [a, *(np.flatnonzero(doc[a + 1: b] != doc[a: b - 1]) + a + 1).tolist(), b]
            out += zip(borders[:-1], borders[1:])
        return out


def scanners(items: DataFrame, window: int) -> list[Scanner]:
    """Automata of all items, each over a bounded number of words."""
    shape = ("item long, hashes array<long>", pa.schema([("item", pa.int64()), ("hashes", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), ALNUM):
                lists = pa.ListArray.from_arrays(pa.array(part.bounds.astype(np.int32)), pa.array(part.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part.counts)), lists], schema=shape[1])

    hashed = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(
        "item_id IS NOT NULL").mapInArrow(run, shape[0]).where("size(hashes) > 0")
    total = hashed.agg(F.sum(F.size("hashes"))).first()[0] or 0
    shards = -(-total // SHARD_WORDS)
    out = []
    for shard in range(shards):  # dealt by a hash of the text: a shard's expected size is its bound
        own = hashed.where(F.pmod(F.xxhash64("hashes"), F.lit(shards)) == shard).toPandas()
        out.append(Scanner([(int(i), np.array(h, np.int64).view(np.uint64).tolist()) for i, h in zip(own["item"], own["hashes"])], window))
    return out


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("longest", T.LongType()),
                     T.StructField("hit", T.ArrayType(T.LongType())),  # first and end word of each hit run, in turn
                     T.StructField("items", T.ArrayType(T.LongType()))])


def marked(docs: DataFrame, text: str, items: DataFrame, window: int, remove: bool = False) -> DataFrame:
    """``docs`` with column _hits: words, longest match, hit runs, items. With ``remove``, hit words are cut from the text."""
    if window < 1:
        raise ValueError("a window has at least one word")
    spark, automata = docs.sparkSession, scanners(items, window)
    groups = [automata[i: i + SHARDS_A_PASS] for i in range(0, len(automata), SHARDS_A_PASS)] or [[]]
    out = docs.withColumn("_hits", F.lit(None).cast(HITS))
    place, names = docs.columns.index(text), out.columns
    for g, group in enumerate(groups):
        shared = [spark.sparkContext.broadcast(a) for a in group]
        out = out.mapInArrow(_step(shared, place, names, remove and g == len(groups) - 1), out.schema)
    return out


def _step(shared, place: int, names: list[str], remove: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(len(names) - 1).to_pylist()
            for part in slices(batch.column(place), ALNUM):
                rows = len(part.counts)
                bounds, doc = part.bounds, part.doc
                found = [set(k["items"]) if k else set() for k in known[part.first: part.first + rows]]
                longest = np.array([k["longest"] if k else 0 for k in known[part.first: part.first + rows]], np.int64)
                hit = np.zeros(len(doc), bool)
                for d, k in enumerate(known[part.first: part.first + rows]):
                    for a, b in zip(k["hit"][::2], k["hit"][1::2]) if k else ():
                        hit[bounds[d] + a: bounds[d] + b] = True
                for s in shared:
                    scanner = s.value
                    for a, b in scanner.stretches(part.hashes, doc):
                        d = int(doc[a])
                        longest[d] = max(longest[d], scanner.automaton.scan(part.hashes[a:b].tolist(), hit[a:b], found[d]))
                runs = [runs_of(hit[bounds[d]: bounds[d + 1]]) for d in range(rows)]
                hits = pa.array([{"n_words": int(part.counts[d]), "longest": int(longest[d]), "hit": runs[d],
                                  "items": sorted(found[d])} for d in range(rows)],
                                pa.struct([("n_words", pa.int64()), ("longest", pa.int64()), ("hit", pa.list_(pa.int64())),
                                           ("items", pa.list_(pa.int64()))]))
                columns = [c.slice(part.first, rows) for c in batch.columns[:-1]]
                if remove and hit.any():
                    texts = columns[place].to_pylist()
                    for d in range(rows):
                        if runs[d]:
                            texts[d] = without(part, d, runs[d])
                    columns[place] = pa.array(texts, columns[place].type)
                yield pa.RecordBatch.from_arrays([*columns, hits], names)

    return run


def runs_of(hit: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist() if hit.any() else []


def without(part, d: int, runs: list[int]) -> str:
    """The text of document d of a slice, the bytes of its hit runs cut out."""
    at, kept, first = int(part.offsets[d]), [], int(part.bounds[d])
    for a, b in zip(runs[::2], runs[1::2]):
        kept.append(part.data[at: part.start[first + a]].tobytes())
        at = int(part.end[first + b - 1])
    kept.append(part.data[at: part.offsets[d + 1]].tobytes())
    return b"".join(kept).decode("utf-8")


def matched(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, longest_match, spans (first and end word), item_ids."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = marked(own, "text", items, window).select("doc_id", "_hits.*")
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size("hit") - 1, F.lit(2)), F.lit(0).cast("long"),
                        lambda n, i: n + F.get("hit", i) - F.get("hit", i - 1))
    return hits.select("doc_id", "n_words", F.when(F.size("hit") > 0, n_hit).otherwise(F.lit(0).cast("long")).alias("n_hit"),
                       F.col("longest").alias("longest_match"), F.col("hit").alias("spans"), F.col("items").alias("item_ids"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.8) -> DataFrame:
    """The columns of ``docs``: hit runs are cut from the text; documents whose hit words are more than
    ``most_coverage`` of all are dropped. A text without hits stays as it is."""
    out = marked(docs, "text", items, window, remove=True)
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size("_hits.hit") - 1, F.lit(2)), F.lit(0).cast("long"),
                        lambda n, i: n + F.get("_hits.hit", i) - F.get("_hits.hit", i - 1))
    share = F.when(F.size("_hits.hit") > 0, n_hit / F.col("_hits.n_words")).otherwise(F.lit(0.0))
    return out.where(share <= most_coverage).drop("_hits")
