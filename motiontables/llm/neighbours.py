"""Nearest neighbours by collision counting over single projections (query-aware hashing).

Every vector is normalised and projected on ``PROJECTIONS`` random lines; a block of vectors keeps, per
line, its values sorted. A query opens a window around its own value on every line and widens all
windows step by step (virtual rehashing: the radius grows, the index stays). A vector that has come
into enough windows is verified with its exact cosine. A query is done with a block once its k-th best
distance, or the one it has against a bounded sample, lies within the radius, since closer vectors
would have collided by then with high probability; windows that cover the whole block end it anyway.

Every vector is indexed. Blocks hold a bounded number of rows, queries come in chunks of a bounded
number, and each (block, chunk) is one unit of work, so neither side passes through one task.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part,
neither do rows with a null id; vectors of different lengths are never compared; rows with the query's
id are never its neighbours; ties go to the smaller id; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stream, written

PROJECTIONS = 64
HALF_WIDTH = 1.0  # of a window at radius 1: a vector at the radius collides on 68 % of the lines
THRESHOLD = 38    # collisions that call for verification: 1.5 deviations under the 43.7 expected at the radius
FIRST_RADIUS, FIRST_SHARE, GROWTH = 0.3, 0.8, 1.15
BLOCK_ROWS, CHUNK_QUERIES, SAMPLE_ROWS = 16_384, 4_096, 4_096
HELD_QUERIES = 256  # whose counts a task holds at once


def lines(dim: int) -> np.ndarray:
    """PROJECTIONS fixed Gaussian directions."""
    u = (stream(31, 2 * dim * PROJECTIONS) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54
    return (np.sqrt(-2 * np.log(u[::2])) * np.cos(2 * np.pi * u[1::2])).reshape(dim, PROJECTIONS)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return own.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(
        ~F.exists("v", odd) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def numbers_of(n: int) -> type:
    """Holds a row number of a block; copies of a row share its block, so that a block may outgrow BLOCK_ROWS."""
    return np.uint16 if n <= 2**16 else np.uint32


def packed(rows: DataFrame, keys: list[str], project: bool) -> DataFrame:
    """One row per key: ids and vectors of a bounded group as bytes; with ``project`` its sorted lines too."""
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        v = matrix(part["v"])
        out = {**dict(zip(keys, key)), "ids": part["id"].to_numpy().tobytes(), "vectors": v.tobytes()}
        if project:
            value = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ lines(v.shape[1])
            order = np.argsort(value, axis=0, kind="stable")
            out["orders"] = np.ascontiguousarray(order.T.astype(numbers_of(len(v)))).tobytes()
            out["values"] = np.ascontiguousarray(np.take_along_axis(value, order, 0).T.astype(np.float32)).tobytes()
        return pd.DataFrame([out])

    kinds = ", ".join(f"{k} int" for k in keys) + ", ids binary, vectors binary" + ", orders binary, values binary" * project
    return rows.groupBy(*keys).applyInPandas(run, kinds)


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal numbers."""
    return (vectors * query).sum(1) / (norms * np.sqrt((query * query).sum()))


def search(ids, vectors, orders, values, q_ids, queries, known, k) -> list[tuple[int, int, float]]:
    """The k best found of this block for every query, as (query, id, cosine). ``known``: a distance within
    which each query has k vectors somewhere; the first radius lies a little below it. A widening counts the
    newly covered margins of the windows only, and verifies the vectors that reach the threshold by them."""
    norms = np.sqrt((vectors * vectors).sum(1))
    at = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ lines(queries.shape[1])
    radius = np.where(np.isfinite(known), np.maximum(FIRST_RADIUS, FIRST_SHARE * known), FIRST_RADIUS)
    counts = np.zeros((len(queries), len(ids)), np.uint8)  # PROJECTIONS at most
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
    low = high = np.stack([np.searchsorted(values[j], at[:, j]) for j in range(PROJECTIONS)], 1)
    active, out = np.arange(len(queries)), []
    while len(active):
        reach = HALF_WIDTH * radius[active]
        below = np.stack([np.searchsorted(values[j], at[active, j] - reach) for j in range(PROJECTIONS)], 1)
        above = np.stack([np.searchsorted(values[j], at[active, j] + reach, "right") for j in range(PROJECTIONS)], 1)
        open_ = np.zeros(len(active), bool)
        for i, (q, a, b, c, d) in enumerate(zip(active.tolist(), below.tolist(), low.tolist(), high.tolist(), above.tolist())):
            margins = [orders[j, x: y] for j in range(PROJECTIONS) for x, y in ((a[j], b[j]), (c[j], d[j])) if x < y]
            before = counts[q] < THRESHOLD
            if margins:
                counts[q] += np.bincount(np.concatenate(margins), minlength=len(ids)).astype(np.uint8)
            close = counts[q] >= THRESHOLD
            new = np.flatnonzero(before & close & (ids != q_ids[q]))
            some = np.concatenate([best[q][0], new])
            score = np.concatenate([best[q][1], cosines(vectors[new], norms[new], queries[q])])
            first = np.lexsort((ids[some], -score))[:k]
            best[q] = some[first], score[first]
            kth = min(known[q], np.sqrt(max(0.0, 2 - 2 * score[first[-1]])) if len(first) == k else np.inf)
            if kth <= radius[q] or close.all():
                out += zip([int(q_ids[q])] * len(first), ids[best[q][0]].tolist(), best[q][1].tolist())
            else:
                open_[i] = True
        active, low, high = active[open_], below[open_], above[open_]
        radius[active] *= GROWTH
    return out


def nearest(vectors: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``: query_id, rank, vec_id, score for the k nearest found."""
    rows = written(valid(vectors, id_col, vector_col))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per vector length
    spark = rows.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = lambda of, most: F.element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, max(1, -(-n // most)))]), of)
    dealt = lambda most, per: F.pmod(F.xxhash64("id", F.hash("v")), parts(F.col("dim"), most * per)).cast("int")
    blocks = written(packed(rows.withColumn("block", dealt(BLOCK_ROWS, 1)), ["dim", "block"], True))
    asked = rows.where(F.col("id") % every == 0)
    chunks = written(packed(asked.withColumn("chunk", dealt(CHUNK_QUERIES, every)), ["dim", "chunk"], False))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    shared = spark.sparkContext.broadcast({d: matrix(p["v"]) for d, p in sample.groupby("dim")})

    numbers = F.sequence(F.lit(0), parts(F.col("dim"), CHUNK_QUERIES * every).cast("int") - 1)
    cells = (blocks.withColumn("chunk", F.explode(numbers))  # queries against all rows, block by block
             .join(chunks.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"}), ["dim", "chunk"])
             .repartition("dim", "block", "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                c = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                v, q = (np.frombuffer(c[x]).reshape(-1, c["dim"]) for x in ("vectors", "q_vectors"))
                orders = np.frombuffer(c["orders"], numbers_of(len(v))).reshape(PROJECTIONS, -1)
                values = np.frombuffer(c["values"], np.float32).reshape(PROJECTIONS, -1)
                q_ids = np.frombuffer(c["q_ids"], np.int64)
                known = np.full(len(q), np.inf)
                some = shared.value.get(c["dim"])
                if some is not None and len(some) > 2 * k:
                    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (some / np.linalg.norm(some, axis=1, keepdims=True)).T
                    known = np.sqrt(np.maximum(0, 2 - 2 * -np.sort(-cos, axis=1)[:, k]))  # one of the sample may be the query
                ids = np.frombuffer(c["ids"], np.int64)
                found = [x for s in range(0, len(q), HELD_QUERIES) for x in search(
                    ids, v, orders, values, *(y[s: s + HELD_QUERIES] for y in (q_ids, q, known)), k)]
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*found)] if found else
                                                 [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())],
                                                 ["query_id", "vec_id", "score"])

    found = cells.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
