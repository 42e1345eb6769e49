"""Near-duplicate documents: MinHash signatures met by a multi-index Hamming join.

A document's signature is ``PARTS`` b-bit minima. It is cut into ``CHUNKS`` chunks. By the pigeonhole
principle two signatures that differ in at most ``CHUNKS * 2 - 1`` minima have a chunk that differs in
one at most, so every chunk is indexed once per place the error may have: the chunk without that
minimum is the key. All pairs under that distance therefore meet; pairs above it may meet too, and
every pair that meets and is not ruled out by its signatures is confirmed on the full shingle sets.
A pair at similarity 0.8 stays apart with a chance under 2e-6, at 0.85 under 2e-8.

Documents with equal shingle sets are one class and enter the search once. Classes of one bucket are
not all paired: a star compares each member with the bucket's leader and merges what is confirmed;
only members of a bucket that still lie in different components are then compared with each other, in
blocks of bounded size, and of the links found there a spanning forest leaves the task. Each step is a
minimum per key, a join or a block, so a bucket or a group of copies of any size is spread over tasks.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; fewer words
than a shingle give one shingle, the whole sequence; rows that repeat a doc_id count as one document
that is linked when any of its texts is; rows with a null doc_id are left out; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_views, components, mix64, narrowed, parted, stream, written
from .words import NOT_SPACE, Slice, slices

CHUNKS, WIDTH, BITS = 10, 5, 14
PARTS = CHUNKS * WIDTH
MOST_ERRORS = 26  # of 50 minima: beyond it, similarity 0.8 has a chance under 1e-6
BLOCK = 1024
SEEDS, FACTORS = stream(21, PARTS), stream(22, PARTS) | np.uint64(1)
PLACE = stream(23, 64) | np.uint64(1)


def shingles(part: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes document by document, the count of each document)."""
    bounds, h = part.bounds, part.hashes
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(part.counts), np.int64)
    with np.errstate(over="ignore"):
        rolled = h * PLACE[0]
        for j in range(1, min(k, n)):
            rolled[: n - j] += h[j:] * PLACE[j]
        rolled = mix64(rolled)
        out, sizes = [], np.zeros(len(part.counts), np.int64)
        for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if b - a >= k:
                own = np.sort(rolled[a: b - k + 1])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                own = mix64(np.array([(h[a:b] * PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                continue
            sizes[d] = len(own)
            out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two set hashes, b-bit minima) of each non-empty set."""
    begins = (np.cumsum(sizes) - sizes)[sizes > 0]
    minima = np.empty((len(begins), PARTS), np.uint16)
    with np.errstate(over="ignore"):
        one, two = np.add.reduceat(mix64(sets), begins), np.add.reduceat(mix64(sets ^ SEEDS[0]), begins)
        for j in range(PARTS):
            value = (sets ^ SEEDS[j]) * FACTORS[j]
            value ^= value >> np.uint64(32)
            value *= FACTORS[-1 - j]
            minima[:, j] = np.minimum.reduceat(value, begins) & np.uint64((1 << BITS) - 1)
    return one, two, minima


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, sig binary"


def signed(docs: DataFrame, k: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()),
                        ("set_b", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part in slices(batch.column(1), NOT_SPACE):
                sets, sizes = shingles(part, k)
                full = sizes > 0
                a, b = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                sig = np.zeros((len(sizes), PARTS), np.uint16)
                if full.any():
                    one, two, minima = signatures(sets, sizes)
                    a[full], b[full], sig[full] = one.view(np.int64), two.view(np.int64), minima
                views = binary_views(np.arange(len(sizes) + 1) * PARTS * 2, sig.reshape(-1).view(np.uint8))
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, len(sizes)), pa.array(sizes), pa.array(a),
                                                  pa.array(b), views], schema=schema)

    return docs.mapInArrow(run, SIGNED)


def chunk_keys(minima: np.ndarray) -> np.ndarray:
    """All index keys of each signature: chunk, place of the allowed error, the other minima."""
    keys = np.empty((len(minima), CHUNKS * WIDTH), np.uint64)
    wide = minima.astype(np.uint64)
    for c in range(CHUNKS):
        for gap in range(WIDTH):
            key = np.full(len(minima), c * WIDTH + gap, np.uint64)
            for j in range(WIDTH):
                if j != gap:
                    key = (key << np.uint64(BITS)) | wide[:, c * WIDTH + j]
            keys[:, c * WIDTH + gap] = key
    return keys


def indexed(classes: DataFrame) -> DataFrame:
    """(key, node, size) for every key of every class."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                keys = chunk_keys(minima_of(part.column("sig")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)),
                     pa.array(np.repeat(part.column("node").to_numpy(), PARTS)),
                     pa.array(np.repeat(part.column("size").to_numpy(), PARTS))], schema=schema)

    return classes.select("node", "size", "sig").mapInArrow(run, "key long, node long, size long")


def minima_of(column: pa.Array) -> np.ndarray:
    width = PARTS * 2
    return np.frombuffer(column.buffers()[2], np.uint8)[
        np.frombuffer(column.buffers()[1], np.int32)[column.offset]:][: len(column) * width].view(np.uint16).reshape(-1, PARTS)


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in MOST_ERRORS minima at most."""
    sig = classes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (minima_of(batch.column(2)) != minima_of(batch.column(3))).sum(1) <= MOST_ERRORS
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, "a long, b long")


def set_table(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, members): the full shingle set of each of ``nodes``."""
    texts = narrowed(docs, "doc_id", nodes, "node").join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    schema = pa.schema([("node", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), NOT_SPACE):
                sets, sizes = shingles(part, k)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                                 pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(sizes)), lists], schema=schema)

    return texts.mapInArrow(run, "node long, members array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their full shingle sets."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct()
    sets = written(set_table(ends, docs, k))
    common = F.size(F.array_intersect("one", "two"))
    union = F.size("one") + F.size("two") - common
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("one")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("members").alias("two")), "b")
            .where((100 * common >= percent * union) & (common > 0)).select("a", "b").distinct())


def alike_in_size(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def star_pairs(keyed: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket with the leader of the bucket. A hash of the document alone chooses, so one document leads
    most buckets of a group, and ``distinct`` folds what they have in common."""
    order = F.struct(F.xxhash64("node").alias("o"), "node", "size")
    leaders = keyed.groupBy("key").agg(F.min(order).alias("m")).select("key", "m.node", "m.size").toDF("key", "lead", "lead_size")
    return (keyed.join(leaders, "key").where((F.col("node") != F.col("lead")) & alike_in_size("size", "lead_size", percent))
            .select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())


def labelled(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    return nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


def first_key(minima_x: np.ndarray, minima_y: np.ndarray) -> np.ndarray:
    """The number (chunk * WIDTH + gap) of the first key two signatures share; a pair is looked at there alone."""
    same = (minima_x == minima_y).reshape(-1, CHUNKS, WIDTH)
    chunk = (same.sum(2) >= WIDTH - 1).argmax(1)
    own = same[np.arange(len(same)), chunk]
    return chunk * WIDTH + np.where(own.all(1), 0, own.argmin(1))


def open_pairs(run: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y) of one cell each, in different components, whose sizes and signatures may reach the similarity."""
    key, i, j, own, node, size, comp = (run.column(c).to_numpy() for c in range(7))
    sig = minima_of(run.column(7))
    number = (key.view(np.uint64) >> np.uint64(BITS * (WIDTH - 1))).astype(np.int64)
    cell = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, len(key)):
        x = np.flatnonzero(cell[lag:] == cell[:-lag])
        if not len(x):
            break
        y = x + lag
        fit = (comp[x] != comp[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
        fit &= (size[x] * 100 >= size[y] * percent) & (size[y] * 100 >= size[x] * percent)
        x, y = x[fit], y[fit]
        near = (sig[x] != sig[y]).sum(1) <= MOST_ERRORS
        x, y = x[near], y[near]
        here = first_key(sig[x], sig[y]) == number[x]
        left.append(x[here])
        right.append(y[here])
    return np.concatenate(left), np.concatenate(right)


def forest(run: pa.RecordBatch, x: np.ndarray, y: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the candidate pairs, enough confirmed links to connect all that confirmed links connect."""
    lists = run.column(8)
    ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset: lists.offset + len(lists) + 1].astype(np.int64)
    flat = lists.values.to_numpy().view(np.uint64)
    node, size = run.column(4).to_numpy(), np.diff(ends)
    links, parent = [], {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    for at in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else []:
        a = int(x[at[0]])
        mine = flat[ends[a]: ends[a + 1]]
        others = y[at]
        width = size[others]
        take = np.repeat(ends[others] - np.cumsum(width) + width, width) + np.arange(width.sum())
        place = np.searchsorted(mine, flat[take])
        hit = mine[np.minimum(place, len(mine) - 1)] == flat[take]
        common = np.add.reduceat(hit, np.cumsum(width) - width)
        for b in others[100 * common >= percent * (len(mine) + width - common)].tolist():
            one, two = root(int(node[a])), root(int(node[b]))
            if one != two:
                parent[max(one, two)] = min(one, two)
                links.append((min(int(node[a]), int(node[b])), max(int(node[a]), int(node[b]))))
    return links


def whole_cells(batches: Iterator[pa.RecordBatch], rows: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j), cut into batches that never divide a cell."""
    rest = None
    for big in batches:
        for at in range(0, len(big), rows):
            batch = big.slice(at, rows)
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key, i, j = (batch.column(c).to_numpy() for c in range(3))
            last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield batch.slice(0, cut)
            rest = batch.slice(cut)
    if rest is not None and len(rest):
        yield rest


def across(keyed: DataFrame, classes: DataFrame, comps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links among members of a bucket that lie in different components.

    A bucket is dealt to cells: block i of its rows with block j. A first look, on signatures, keeps the
    rows that have any candidate partner in their cell; only these carry their full sets to the second.
    """
    members = labelled(keyed, comps)
    open_keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                           F.count("*").alias("n")).where("lo < hi").select("key", "n")
    rows = (members.join(open_keys, "key").join(classes.select("node", "sig"), "node")
            .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    columns = ["key", "i", "j", "own", "node", "size", "component", "sig"]
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select(*columns)
    kinds = "key long, i int, j int, own int, node long, size long, component long, sig binary"

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_cells(batches):
            x, y = open_pairs(run, percent)
            keep = np.zeros(len(run), bool)
            keep[x] = keep[y] = True
            yield run.filter(pa.array(keep))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_cells(batches):
            links = forest(run, *open_pairs(run, percent), percent)
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in links], pa.int64()),
                                              pa.array([v[1] for v in links], pa.int64())], ["a", "b"])

    alive = written(cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(partnered, kinds))
    sets = set_table(alive.select("node").distinct(), docs, k)
    return (alive.join(sets, "node").select(*columns, "members").repartition("key", "i", "j")
            .sortWithinPartitions("key", "i", "j").mapInArrow(linked, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked with,
    over any number of links), kept (it is that document). Links have a similarity of percent / 100 or more."""
    if not 80 <= percent <= 100 or shingle < 1:
        raise ValueError("percent is 80..100, as chunks and errors of the index are made for these; shingle at least 1")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    rows = written(signed(docs, shingle))
    full = rows.where("n_shingles > 0")
    by_set = ["set_a", "set_b", "n_shingles"]
    reps = full.groupBy(*by_set).agg(F.min("doc_id").alias("node"))
    classes = written(full.join(reps.withColumnRenamed("node", "doc_id"), [*by_set, "doc_id"]).groupBy("doc_id", *by_set)
                      .agg(F.first("sig").alias("sig")).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "sig"))
    keyed = indexed(classes)
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = written(keyed.join(several, "key"))

    pairs = written(agreeing(star_pairs(keyed, percent), classes))
    links = written(confirmed(pairs, docs, shingle, percent))
    rest = written(across(keyed, classes, written(components(links)), docs, shingle, percent))
    comps = written(components(links.unionByName(rest)))

    named = full.select(*by_set, "doc_id").join(reps, by_set).join(comps, "node", "left").select(
        "doc_id", *by_set, F.coalesce("component", "node").alias("component_id"))
    smallest = named.groupBy("component_id").agg(F.min("doc_id").alias("low"))  # a class may have been joined under another name
    out = named.join(smallest, "component_id").select("doc_id", "n_shingles", F.col("low").alias("component_id"))
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def first_of_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, as they are, less those that another document of their group stands for.
    Of rows that repeat a doc_id all stay or none; rows with a null doc_id stay."""
    found = near_duplicates(docs, shingle, percent).groupBy("doc_id").agg(F.min("component_id").alias("first"))
    gone = found.where("first < doc_id").select(F.col("doc_id").alias("_gone"))
    rest, maybe = parted(docs, "doc_id", gone, "_gone")
    return rest.unionByName(maybe.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti"))
