"""Which sources of a language speak differently: shares of all frequent terms, compared exactly.

Terms are counted in packed form. A term of up to 8 bytes is one big-endian 64-bit word, one of up to 16 bytes
two, so words sort as their bytes do; they are radix-sorted, 16 bits a pass, together with their document, and
counted as runs. Longer terms go to buckets of their own, one for each power of two of the length, sorted
there as bytes. A task passes on its sums of (language, source, term) whenever it holds ``MOST_HELD``, and Spark
adds them up. From then on a term is three columns: two words and the rest of its bytes.

A source's distance from another is a sum over all kept terms of their language. Terms that neither has all
weigh the same, so only occurrences are looked at: entries meet in parts of the terms, for each two tiles of at
most ``TILE`` sources, and a part's occurrences times a tile's sources are worked off in one numpy pass. Memory
follows the part and the tile, not the vocabulary nor the number of sources.

All numbers are integers: p = 1 + floor(10^9 (count + 1) / (N + V)) by long division in steps of 1000, and
f = floor((p - q)^2 / q), with p at most 10^9 + 1. A sum of f over the terms of a language stays below
(10^9 + V)^2, so it fits a long for V up to 2 * 10^9.

Defined cases: null text, lang and source are empty strings; every group that occurs has its pairs, without kept
terms all of value 0; a source alone in its language has no pairs; repeated rows are separate documents; ties
go by the bytes of the item; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .words import LOWER, byte_slices, word_spans

LETTER = np.ones(256, bool)  # ASCII letters and every byte of a longer character
LETTER[:0x41] = LETTER[0x5B:0x61] = LETTER[0x7B:0x80] = False
SLICE = 1 << 20
MOST_HELD = 400_000  # sums a task holds before it passes them on
PART_ENTRIES = 200_000  # occurrences (term, source) a part of the comparison has, about
TILE = 256
TERM = ["w0", "w1", "rest"]
UNSIGNED = -(1 << 63)
SPREAD = 64


def radix_order(*digits: np.ndarray) -> np.ndarray:
    """Stable order by unsigned columns, the most important last: 16 bits a pass, places that are all equal skipped."""
    order = np.arange(len(digits[0]))
    for column in digits:
        column = column.astype(np.uint64, copy=False)
        differ = int(np.bitwise_or.reduce(column ^ column[:1])) if len(column) else 0
        for shift in range(0, 64, 16):
            if differ >> shift & 0xFFFF:
                place = (column >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(place[order], kind="stable")]
    return order


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def totals(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if len(begins) else values[:0]


def words_at(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each start as one big-endian word, zeros behind the end. ``data`` has 8 bytes to spare."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    word = view[np.minimum(start, len(data) - 8)].reshape(-1).view(">u8").astype(np.uint64)
    spare = (8 * (8 - np.clip(length, 0, 8))).astype(np.uint64)
    return np.where(length > 0, word >> np.minimum(spare, np.uint64(63)) << np.minimum(spare, np.uint64(63)), np.uint64(0))


def counted(keys: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(keys, group, occurrences, documents) of each run of term and group, from rows sorted by keys, group, document."""
    one = runs(*keys, group, doc)
    times = np.diff(np.append(one, len(group)))
    keys, group = [k[one] for k in keys], group[one]
    begins = runs(*keys, group)
    return [k[begins] for k in keys], group[begins], totals(times, begins), np.diff(np.append(begins, len(group)))


def short_terms(data, start, length, group, doc) -> tuple:
    keys = [words_at(data, start, length), words_at(data, start + 8, length - 8)]
    order = radix_order(doc, group, keys[1], keys[0])
    (w0, w1), group, times, docs = counted([k[order] for k in keys], group[order], doc[order])
    return w0, w1, None, group, times, docs


def long_terms(data, start, length, group, doc) -> Iterator[tuple]:
    """A bucket for each power of two: rows of bytes of equal width, sorted as such."""
    bucket = np.ceil(np.log2(length)).astype(np.int64)
    for b in np.unique(bucket):
        own = np.flatnonzero(bucket == b)
        width = 1 << int(b)
        step = max(1, (8 << 20) // width)
        for at in range(0, len(own), step):  # very long terms a few at a time
            some = own[at: at + step]
            table = np.zeros((len(some), width), np.uint8)
            for row, (begin, size) in enumerate(zip(start[some].tolist(), length[some].tolist())):
                table[row, :size] = data[begin: begin + size]
            text = table.view(f"S{width}").reshape(-1)
            order = radix_order(doc[some], group[some])
            order = order[np.argsort(text[order], kind="stable")]
            (text,), g, times, docs = counted([text[order]], group[some][order], doc[some][order])
            table = np.frombuffer(text.tobytes(), np.uint8).reshape(-1, width)
            w0, w1 = (np.ascontiguousarray(table[:, i: i + 8]).reshape(-1).view(">u8").astype(np.uint64) for i in (0, 8))
            yield w0, w1, [t[16:] for t in text.tolist()], g, times, docs


def term_counts(docs: DataFrame, most_held: int = MOST_HELD) -> DataFrame:
    """(lang, source, w0, w1, rest, n, d): occurrences, and documents with the term, of docs (lang, source, text). The empty
    term stands for the group itself, with no documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple, int] = {}
        held: list[tuple] = []

        def row(w0, w1, rest, group, times, docs) -> pa.RecordBatch:
            names = list(number)
            lang, source = (pa.array([n[i] for n in names], pa.string()).take(pa.array(group)) for i in (0, 1))
            rest = pa.array(rest, pa.binary()) if rest is not None else pa.array([b""], pa.binary()).take(pa.array(np.zeros(len(w0), np.int64)))
            return pa.RecordBatch.from_arrays([lang, source, pa.array(w0.view(np.int64)), pa.array(w1.view(np.int64)), rest, pa.array(times),
                                               pa.array(docs)], ["lang", "source", *TERM, "n", "d"])

        def folded() -> tuple:
            w0, w1, group, times, docs = (np.concatenate(c) for c in zip(*held))
            order = radix_order(group, w1, w0)
            w0, w1, group = w0[order], w1[order], group[order]
            begins = runs(w0, w1, group)
            return w0[begins], w1[begins], group[begins], totals(times[order], begins), totals(docs[order], begins)

        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            seen = len(number)
            group_of = np.array([number.setdefault(p, len(number)) for p in pairs], np.int64)
            if len(number) > seen:
                new = np.arange(seen, len(number))
                zero = np.zeros(len(new), np.int64)
                yield row(zero.view(np.uint64), zero.view(np.uint64), None, new, zero, zero)
            for first, offsets, raw in byte_slices(batch.column(2), SLICE):
                data = LOWER[raw]
                start, end, each = word_spans(offsets, data, LETTER)
                data, length = np.append(data, np.zeros(8, np.uint8)), end - start
                doc = np.repeat(np.arange(len(each)), each)
                group = group_of[first + doc]
                short = length <= 16
                w0, w1, _, *sums = short_terms(data, start[short], length[short], group[short], doc[short])
                held.append((w0, w1, *sums))
                if not short.all():
                    for found in long_terms(data, start[~short], length[~short], group[~short], doc[~short]):
                        yield row(*found)
                if sum(len(h[0]) for h in held) > 2 * most_held:
                    held[:] = [folded()]
                    if len(held[0][0]) > most_held:
                        w0, w1, *sums = held.pop()
                        yield row(w0, w1, None, *sums)
        if held:
            w0, w1, *sums = folded()
            yield row(w0, w1, None, *sums)

    parts = docs.mapInArrow(run, "lang string, source string, w0 long, w1 long, rest binary, n long, d long")
    return parts.groupBy("lang", "source", *TERM).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 (count + 1) / whole), without a number above 1000 * whole."""
    part, out = count + 1, F.lit(1).cast("long")
    for weight in (1_000_000, 1_000, 1):
        part = part * 1000
        out = out + F.call_function("div", part, whole) * weight
        part = part % whole
    return out


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    part, out = count + 1, np.ones(np.broadcast_shapes(np.shape(count), np.shape(whole)), np.int64)
    for weight in (1_000_000, 1_000, 1):
        part = part * 1000
        out += part // whole * weight
        part = part % whole
    return out


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def compared(entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of a part for each source of one tile and each of another, but for terms that neither has."""
    a, b = int(groups["ta"].iloc[0]), int(groups["tb"].iloc[0])
    left, right = (groups[groups["within"] == t].sort_values("spot") for t in (a, b))
    own = entries.groupby(TERM, sort=False).ngroup().to_numpy() if len(entries) else np.zeros(0, np.int64)
    n, tile, place = (entries[c].to_numpy(np.int64) for c in ("n", "tile", "place"))
    terms = int(own.max()) + 1 if len(own) else 0

    def table(side: pd.DataFrame, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each term and source of a tile, and what N and V add up to for each source."""
        counts = np.zeros((terms, len(side)), np.int64)
        mine = tile == t
        counts[own[mine], place[mine] - side["spot"].iloc[0]] = n[mine]
        return counts, np.maximum(1, side["whole"].to_numpy(np.int64))

    (ca, wa), (cb, wb) = table(left, a), table(right, b)
    value, both = np.zeros((len(left), len(right)), np.int64), np.zeros((len(left), len(right)), np.int64)
    for i in range(len(left)):
        has = np.flatnonzero(ca[:, i])
        q = cb[has]
        both[i] = (q > 0).sum(0)
        value[i] += distances(shares(ca[has, i: i + 1], wa[i]), shares(q, wb)).sum(0)
    none = shares(np.zeros(len(left), np.int64), wa)
    for j in range(len(right)):
        has = np.flatnonzero(cb[:, j])
        q = shares(cb[has, j: j + 1], wb[j])
        value[:, j] += np.where(ca[has] == 0, distances(none, q), 0).sum(0)
    return pd.DataFrame({"lang": groups["of"].iloc[0], "ga": np.repeat(left["spot"].to_numpy(), len(right)),
                         "gb": np.tile(right["spot"].to_numpy(), len(left)), "value": value.reshape(-1), "both": both.reshape(-1)})


def term_text() -> Column:
    """The term as a string, from its words and the rest."""
    word = lambda c: F.when(F.col(c) != 0, F.unhex(F.hex(c))).otherwise(F.lit(b""))
    return F.replace(F.concat(word("w0"), word("w1"), "rest").cast("string"), F.lit("\0"), F.lit(""))


def divergence_audit(docs: DataFrame, least_docs: int = 3, top: int = 200, most_held: int = MOST_HELD) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other source of the language, by distance; part ``term``:
    the ``top`` terms that the source has more of than its language."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string"))
    counts = written(term_counts(docs, most_held))
    term = Window.partitionBy("lang", *TERM)
    kept = written(counts.where("d > 0").withColumns({
        "docs": F.sum("d").over(term), "whole": F.sum("n").over(term), "head": F.min("source").over(term)})
        .where(F.col("docs") >= least_docs).select("lang", "source", *TERM, "n", "whole", (F.col("head") == F.col("source")).alias("head")))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("has"), F.sum(F.col("head").cast("long")).alias("v"))
    lang = Window.partitionBy("lang")
    groups = written(
        counts.where("w0 = 0").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["n", "has", "v"])
        .withColumns({"ln": F.sum("n").over(lang), "v": F.sum("v").over(lang), "place": F.row_number().over(lang.orderBy("source")) - 1, "last": F.floor((F.count("*").over(lang) - 1) / TILE).cast("int")})
        .select("lang", "source", "has", "v", "place", "last", F.floor(F.col("place") / TILE).cast("int").alias("tile"),
                (F.col("n") + F.col("v")).alias("gn"), (F.col("ln") + F.col("v")).alias("ln")))
    return pairs(kept, groups).unionByName(terms(kept, groups, top))


def terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    own = kept.join(groups.select("lang", "source", "gn", "ln"), ["lang", "source"]).select(
        "lang", "source", *TERM, share(F.col("n"), F.col("gn")).alias("p"), share(F.col("whole"), F.col("ln")).alias("q"))
    own = own.where("p > q").select("lang", "source", *TERM, F.expr("(p - q) * (p - q) div q").alias("value"))
    order = [F.desc("value"), F.col("w0").bitwiseXOR(F.lit(UNSIGNED)), F.col("w1").bitwiseXOR(F.lit(UNSIGNED)), "rest"]
    some = own.withColumn("deal", F.pmod(F.xxhash64(*TERM), F.lit(SPREAD)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "deal").orderBy(*order))).where(F.col("rank") <= top)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("lang", "source", F.lit("term").alias("part"), term_text().alias("item"), "value", "rank")


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    parts = max(1, -(-(groups.agg(F.sum("has")).first()[0] or 0) // PART_ENTRIES))
    deal = F.pmod(F.xxhash64(*TERM), F.lit(parts)).cast("int").alias("deal")
    entry = kept.join(groups.select("lang", "source", "place", "tile", "last"), ["lang", "source"]).select(
        "lang", *TERM, "n", "place", "tile", "last", deal)
    every = F.sequence(F.lit(0), F.col("last"))
    meet = F.array_distinct(F.flatten(F.transform(every, lambda t: F.array(
        F.struct(F.col("tile").alias("ta"), t.alias("tb")), F.struct(t.alias("ta"), F.col("tile").alias("tb"))))))
    entry = entry.withColumn("meet", F.explode(meet)).select("*", "meet.*").drop("meet")
    side = groups.select(F.col("lang").alias("of"), F.col("gn").alias("whole"), F.col("place").alias("spot"), F.col("tile").alias("within"),
                         F.explode(meet).alias("meet")).select("of", "whole", "spot", "within", "meet.*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("deal"))
    found = entry.groupBy("lang", "deal", "ta", "tb").cogroup(side.groupBy("of", "deal", "ta", "tb")).applyInPandas(compared, "lang string, ga int, gb int, value long, both long")
    found = found.where("ga <> gb").groupBy("lang", "ga", "gb").agg(F.sum("value").alias("value"), F.sum("both").alias("both"))
    named = lambda side: groups.select("lang", F.col("place").alias(f"g{side}"), F.col("source").alias(f"s{side}"), F.col("has").alias(f"h{side}"),
                                       F.greatest("gn", F.lit(1)).alias(f"w{side}"), F.col("v").alias(f"v{side}"))
    zero = F.lit(0).cast("long")
    both = found.join(named("a"), ["lang", "ga"]).join(named("b"), ["lang", "gb"]).withColumns({
        "p": share(zero, F.col("wa")), "q": share(zero, F.col("wb")), "rest": F.col("va") - F.col("ha") - F.col("hb") + F.col("both")})
    both = both.select("lang", F.col("sa").alias("source"), F.lit("pair").alias("part"), F.col("sb").alias("item"),
                       F.expr("value + rest * ((p - q) * (p - q) div q)").alias("value"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3
), v AS (
  SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL
), gn AS (
  SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(gn.n, 0) + v.v) AS p,
         1 + 1000000000 * (k.n + 1) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON (f.lang, f.source, f.item) = (a.lang, a.source, b.source)
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
