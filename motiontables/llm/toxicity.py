"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents; tokens get theirs from them: in a toxic document of the training rows a
word is a toxic token if it is far more frequent among toxic documents than among others. The field has
two states, features of the word, its neighbours, beginning and end, and is fitted on these labelled
tokens by the gradient that forward-backward yields. Tagging runs over whole texts as one chain with
resets: transfer matrices are multiplied within pieces of the chain, carried over piece by piece and
unrolled again, so every marginal is exact and all of it is array arithmetic.

A document's score is a calibrated function of the expected number of toxic tokens. The model is fitted
on at most ``PER_CLASS`` documents of either label, of at most ``LONGEST`` characters each, chosen by
hash from the rows the caller allows; scoring covers every document.

Defined cases: null, empty and wordless texts get the score the calibration gives to no toxic token;
rows that repeat a doc_id are scored one by one; labels that are null, out of range or of unknown
documents are left out; without labels of both kinds the score is 0; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import Logistic, labelled_ids, sigmoid
from .shared import mix64
from .words import ALNUM, BYTE_VALUE, Slice, prefix_hash, slices, span_hash

PER_CLASS, LONGEST = 2_500, 200_000
TABLE_BITS, KINDS = 17, 5  # weights per kind of feature; word, word before, word after, beginning, end
PIECE = 32
STEPS, RATE = 40, 0.5
LEAST_DOCS, LEAST_ODDS = 3, 20.0  # toxic documents a toxic word is in; odds against other documents


def features(part: Slice) -> np.ndarray:
    """(KINDS, tokens) places in the weight table."""
    h, doc = part.hashes, part.doc
    before, after = np.zeros_like(h), np.zeros_like(h)
    same = doc[1:] == doc[:-1]
    before[1:] = np.where(same, h[:-1], 0)
    after[:-1] = np.where(same, h[1:], 0)
    with np.errstate(over="ignore"):
        sums = prefix_hash(part.data, BYTE_VALUE)
        begin = mix64(span_hash(sums, part.start, np.minimum(part.start + 4, part.end)))
        end = mix64(span_hash(sums, np.maximum(part.end - 4, part.start), part.end))
    return np.stack([(x >> np.uint64(64 - TABLE_BITS)).astype(np.int64) + (k << TABLE_BITS)
                     for k, x in enumerate((h, mix64(before), mix64(after), begin, end))])


@dataclass
class Field:
    """Potentials: weights of state 1 by feature, log transitions [from, to], log weight of beginning in state 1."""

    weights: np.ndarray
    moves: np.ndarray
    begin: float

    def marginals(self, places: np.ndarray, first: np.ndarray, pairs: bool = False):
        """P(state 1) of every token; with ``pairs`` also P(state before, state) as (2, 2, tokens)."""
        n = places.shape[1]
        if not n:
            return (np.zeros(0), np.zeros((2, 2, 0))) if pairs else np.zeros(0)
        lift = np.exp(np.clip(self.weights[places].sum(0), -30, 30))
        start = np.zeros(n, bool)
        start[first] = True
        length = -(-n // PIECE) * PIECE
        # step[i, j]: from state i to state j with the token's own weight; a first token forgets what was before
        move = np.exp(self.moves)
        step = np.ones((2, 2, length))
        for i in (0, 1):
            step[i, 0, :n] = np.where(start, 1.0, move[i, 0])
            step[i, 1, :n] = np.where(start, np.exp(self.begin), move[i, 1]) * lift
        step[:, :, :n] /= step[:, :, :n].sum((0, 1))
        step[0, 1, n:] = step[1, 0, n:] = 0.0  # padding changes nothing
        grid = step.reshape(2, 2, -1, PIECE)
        ahead = _unrolled(grid, forward=True)    # ratios alpha1 / alpha0 after each token
        back = _unrolled(grid, forward=False)    # ratios beta1 / beta0 after each token
        p = (ahead * back / (1 + ahead * back)).reshape(-1)[:n]
        if not pairs:
            return p
        prior = np.concatenate([[1.0], ahead.reshape(-1)[: n - 1]])
        b = back.reshape(-1)[:n]
        joint = step[:, :, :n] * np.stack([np.ones(n), prior])[:, None] * np.stack([np.ones(n), b])[None]
        return p, joint / joint.sum((0, 1))


def _unrolled(grid: np.ndarray, forward: bool) -> np.ndarray:
    """Ratios state 1 : state 0 along the chain of (2, 2, pieces, PIECE) transfer matrices."""
    pieces = grid.shape[2]
    order = range(PIECE) if forward else range(PIECE - 1, -1, -1)
    total = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, pieces))
    for t in order:
        m = grid[:, :, :, t]
        total = np.einsum("ijp,jkp->ikp", total, m) if forward else np.einsum("ijp,jkp->ikp", m, total)
        total = total / total.sum((0, 1))
    carried, ratio = np.empty(pieces), 1.0
    a, b, c, d = total[0, 0].tolist(), total[0, 1].tolist(), total[1, 0].tolist(), total[1, 1].tolist()
    for k in range(pieces) if forward else range(pieces - 1, -1, -1):
        carried[k] = ratio
        ratio = (b[k] + ratio * d[k]) / (a[k] + ratio * c[k]) if forward else (c[k] + ratio * d[k]) / (a[k] + ratio * b[k])
        ratio = min(max(ratio, 1e-200), 1e200)
    out, now = np.empty((pieces, PIECE)), carried
    for t in order:
        m = grid[:, :, :, t]
        if forward:
            now = np.clip((m[0, 1] + now * m[1, 1]) / (m[0, 0] + now * m[1, 0]), 1e-200, 1e200)
            out[:, t] = now
        else:
            out[:, t] = now
            now = np.clip((m[1, 0] + now * m[1, 1]) / (m[0, 0] + now * m[0, 1]), 1e-200, 1e200)
    return out


def fit_field(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Field:
    """parts: (feature places, first tokens, token labels)."""
    tokens = sum(len(y) for _, _, y in parts)
    toxic = sum(int(y.sum()) for _, _, y in parts)
    field = Field(np.zeros(KINDS << TABLE_BITS), np.zeros((2, 2)), 0.0)
    share = (toxic + 0.5) / (tokens + 1)
    field.moves[:, 1] = field.begin = np.log(share / (1 - share))
    squares = np.full(len(field.weights), 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(STEPS):
        slope, moves, begin = -0.02 * field.weights, np.zeros((2, 2)), 0.0
        for places, first, y in parts:
            p, joint = field.marginals(places, first, pairs=True)
            rest = y - p
            for row in places:
                slope += np.bincount(row, weights=rest, minlength=len(slope))
            inner = np.ones(len(y), bool)
            inner[first] = False
            for i in (0, 1):
                for j in (0, 1):
                    seen = (y[:-1] == i) & (y[1:] == j) & inner[1:]
                    moves[i, j] += seen.sum() - joint[i, j, inner].sum()
            begin += (y - p)[first].sum()
        squares = squares[0] + slope**2, squares[1] + moves**2, squares[2] + begin**2
        field.weights += RATE * slope / np.sqrt(squares[0])
        field.moves += RATE * moves / np.sqrt(squares[1])
        field.begin += RATE * begin / np.sqrt(squares[2])
    field.moves -= field.moves[0, 0]
    return field


def evidence(p: np.ndarray, part: Slice) -> np.ndarray:
    """(documents, 2): log odds that some token is toxic, log expected share of toxic tokens."""
    sums = np.concatenate([[0.0], np.cumsum(-np.log1p(-np.minimum(p, 1 - 1e-9)))])
    some = np.maximum(sums[part.bounds[1:]] - sums[part.bounds[:-1]], 1e-6)
    return np.column_stack([np.log(np.expm1(np.minimum(some, 30))), np.log(some / np.maximum(part.counts, 1))])


@dataclass
class Tagger:
    field: Field
    calibration: Logistic

    def tagged(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(P(toxic) of each token, score of each document)."""
        first = part.bounds[:-1][part.counts > 0]
        p = self.field.marginals(features(part), first)
        return p, sigmoid(self.calibration.logit(evidence(p, part)))


def fit_tagger(docs: DataFrame, labels: DataFrame, where: str = "true") -> Tagger | None:
    """``where`` limits the rows of ``labels`` (doc_id, label) that may be learned from."""
    ids, sizes = labelled_ids(labels, "toxic", PER_CLASS, where)
    if set(sizes) != {0, 1}:
        return None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        F.length("text") <= LONGEST).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")  # 2 * PER_CLASS ids at most
    rows = rows.dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id").drop_duplicates("text")
    if rows["label"].nunique() < 2:
        return None
    label = rows["label"].to_numpy()
    cut = list(slices(pa.array(rows["text"], pa.string()), ALNUM))
    toxic_words = indicative(cut, label)
    parts = []
    for part in cut:
        own = np.isin(part.hashes, toxic_words) & (label[part.first + part.doc] == 1)
        parts.append((features(part), part.bounds[:-1][part.counts > 0], own.astype(np.int64)))
    field = fit_field(parts)
    x = np.concatenate([evidence(field.marginals(f, first), part) for part, (f, first, _) in zip(cut, parts)])
    weight = np.where(label == 1, sizes[1] / (label == 1).sum(), sizes[0] / (label == 0).sum())
    return Tagger(field, Logistic(x, label, weight * len(label) / weight.sum()))


def indicative(cut: list[Slice], label: np.ndarray) -> np.ndarray:
    """Words that are far more frequent among toxic documents."""
    pairs = np.concatenate([np.unique(np.stack([part.hashes, (part.first + part.doc).astype(np.uint64)], 1), axis=0) for part in cut])
    words, at = np.unique(pairs[:, 0], return_inverse=True)
    toxic = label[pairs[:, 1].astype(np.int64)] == 1
    among = np.bincount(at, weights=toxic, minlength=len(words))
    others = np.bincount(at, weights=~toxic, minlength=len(words))
    odds = (among + 0.5) / (label == 1).sum() / ((others + 0.5) / (label == 0).sum())
    return words[(among >= LEAST_DOCS) & (odds >= LEAST_ODDS)]


def toxic_documents(docs: DataFrame, labels: DataFrame, where: str = "true") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (score >= 0.5), spans of toxic words as character offsets."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_tagger(docs, labels, where))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            for part in slices(batch.column(1), ALNUM):
                n = len(part.counts)
                p, score = tagger.tagged(part) if tagger else (np.zeros(len(part.hashes)), np.zeros(n))
                spans: list[list] = [[] for _ in range(n)]
                doc = part.doc
                for i in np.flatnonzero(p >= 0.5).tolist():
                    d = int(doc[i])
                    begin = int(part.offsets[d])
                    start = len(part.data[begin: part.start[i]].tobytes().decode("utf-8", "replace"))
                    end = start + len(part.data[part.start[i]: part.end[i]].tobytes().decode("utf-8", "replace"))
                    spans[d].append({"start": start, "end": end})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, n), pa.array(score),
                                                  pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, span)],
                                                 ["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double, predicted int, spans array<struct<start: long, end: long>>")
