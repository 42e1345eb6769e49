"""Quality classifier by co-training: two views of a document teach each other.

The content view sees the text alone: shapes of its characters and words, repetition, layout. The
metadata view sees language, source and length. Both start from labelled documents; in every round each
view labels the unlabelled documents it is surest of, and these join the training rows of the other.
At the end both views are calibrated on labelled documents neither has learned from, and a logistic
model of the two calibrated scores gives the probability that a document is good.

The models are fitted on at most ``PER_CLASS`` labelled documents of either kind and ``UNLABELLED``
others, of at most ``LONGEST`` characters each, all chosen by hash; every document is scored.

Defined cases: null and empty texts are texts without words; null metadata is a value of its own; rows
that repeat a doc_id are scored one by one; labels that are null, out of range or of unknown documents
are left out; without labels of both kinds every document is good; further columns are kept by
``good_documents`` and ignored by ``quality_scores``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import Logistic, labelled_ids, sigmoid
from .words import NOT_SPACE, slices

PER_CLASS, UNLABELLED, LONGEST = 3_000, 4_000, 200_000
ROUNDS, SURE, PER_ROUND = 4, 0.95, 300
HASHED = 32

KIND = np.full(256, 10, np.int64)  # classes of bytes: other marks
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 3
for n, chars in enumerate((b" \t", b"\n\r", b".,", b"|", b"!?;:'\"", b"#*%$&=+~^_"), start=4):
    KIND[list(chars)] = n
KINDS = 11


def content(texts: pa.Array) -> np.ndarray:
    """A row of numbers per text."""
    out = []
    for part in slices(texts, NOT_SPACE):
        n = len(part.counts)
        owner = np.repeat(np.arange(n), np.diff(part.offsets))
        kind = KIND[part.data]
        single = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
        same = owner[1:] == owner[:-1]
        double = np.bincount((owner[1:] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:])[same],
                             minlength=n * KINDS * KINDS).reshape(n, -1)
        words, size = np.maximum(part.counts, 1), np.maximum(np.diff(part.offsets), 1)
        doc, h = part.doc, part.hashes
        letters = np.bincount(doc, weights=part.end - part.start, minlength=n)
        again = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=n)
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])[: len(hs)]
        distinct = np.bincount(ds[new], minlength=n)
        short = np.bincount(doc[part.end - part.start == 1], minlength=n)
        out.append(np.column_stack([
            single / size[:, None], double / size[:, None], letters / words, again / words, distinct / words, short / words,
            np.log1p(part.counts), part.counts == 0]))
    return np.concatenate(out) if out else np.zeros((0, KINDS + KINDS * KINDS + 6))


def metadata(rows: pd.DataFrame) -> np.ndarray:
    """A row of numbers per document: hashed language and source, log length and its bins."""
    out = np.zeros((len(rows), 2 * HASHED + 14))
    at = np.arange(len(rows))
    for k, name in enumerate(("lang", "source")):
        out[at, k * HASHED + rows[name].map(lambda v: zlib.crc32(str(v).encode()) % HASHED).to_numpy(np.int64)] = 1
    length = np.log1p(np.maximum(pd.to_numeric(rows["n_chars"], errors="coerce").fillna(0).to_numpy(float), 0))
    out[:, 2 * HASHED] = length
    out[at, 2 * HASHED + 1 + np.minimum(length.astype(np.int64), 12)] = 1
    return out


@dataclass
class Views:
    text: Logistic
    page: Logistic
    text_scale: Logistic
    page_scale: Logistic
    joint: Logistic

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated logits of both views and the combined probability."""
        a = self.text_scale.logit(self.text.logit(text)[:, None])
        b = self.page_scale.logit(self.page.logit(page)[:, None])
        return a, b, sigmoid(self.joint.logit(np.column_stack([a, b])))


def co_trained(text: np.ndarray, page: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Views:
    """label: 0, 1, or -1 for unlabelled rows. Every fourth labelled row is kept for calibration."""
    known = np.flatnonzero(label >= 0)
    held = known[::4]
    start = np.setdiff1d(known, held)
    learned = {"text": dict(zip(start.tolist(), label[start].tolist()))}
    learned["page"] = dict(learned["text"])
    rows = {"text": text, "page": page}
    models = {}
    for turn in range(ROUNDS + 1):
        for view, own in learned.items():
            at = np.array(list(own))
            models[view] = Logistic(rows[view][at], np.array(list(own.values())), weight[at])
        if turn == ROUNDS:
            break
        for view, other in (("text", "page"), ("page", "text")):
            free = np.array([i for i in np.flatnonzero(label < 0).tolist() if i not in learned[other]], np.int64)
            if not len(free):
                continue
            p = sigmoid(models[view].logit(rows[view][free]))
            for value, sure in ((1, p), (0, 1 - p)):
                best = np.argsort(-sure, kind="stable")[:PER_ROUND]
                learned[other].update((int(free[i]), value) for i in best if sure[i] >= SURE)
    y, w = label[held], weight[held]
    a, b = models["text"].logit(text[held]), models["page"].logit(page[held])
    scale = [Logistic(x[:, None], y, w) for x in (a, b)]
    joint = Logistic(np.column_stack([s.logit(x[:, None]) for s, x in zip(scale, (a, b))]), y, w)
    return Views(models["text"], models["page"], *scale, joint)


def shaped(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return docs.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


def featured(rows: DataFrame) -> pd.DataFrame:
    """A bounded sample on the driver, as numbers: its texts stay where they are."""
    names = ["doc_id", "lang", "source", "n_chars", "label", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [pa.array(x) for x in content(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]),
                                              pa.array([x.to_pylist() for x in own], pa.list_(pa.float64()))], names)

    out = rows.mapInArrow(run, "doc_id long, lang string, source string, n_chars double, label int, content array<double>").toPandas()
    return out.sort_values("doc_id", ignore_index=True).drop_duplicates("doc_id", ignore_index=True)


def fit_views(docs: DataFrame, labels: DataFrame) -> Views | None:
    ids, sizes = labelled_ids(labels, "quality", PER_CLASS)
    if set(sizes) != {0, 1}:
        return None
    short = shaped(docs).where("doc_id IS NOT NULL AND (text IS NULL OR length(text) <= %d)" % LONGEST)
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    others = shaped(docs).select("doc_id").where("doc_id IS NOT NULL").join(seen, "doc_id", "left_anti")
    others = others.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(UNLABELLED).distinct().withColumn("label", F.lit(-1))
    chosen = ids.unionByName(others)  # 2 * PER_CLASS + UNLABELLED ids at most
    rows = featured(short.join(F.broadcast(chosen), "doc_id"))
    count = rows["label"].value_counts()
    if min(count.get(0, 0), count.get(1, 0)) < 8:
        return None
    rows = rows.iloc[np.argsort([zlib.crc32(str(i).encode()) for i in rows["doc_id"]], kind="stable")].reset_index(drop=True)
    label = rows["label"].to_numpy(np.int64)
    share = {c: sizes[c] / max(1, (label == c).sum()) for c in (0, 1)}
    usual = (share[0] * (label == 0).sum() + share[1] * (label == 1).sum()) / (label >= 0).sum()
    weight = np.where(label == 1, share[1], np.where(label == 0, share[0], usual)) / usual
    return co_trained(np.stack(rows["content"]), metadata(rows), label, weight)


def _scored(docs: DataFrame, views: Views | None, columns: list[str]) -> DataFrame:
    """``docs`` with text_logit, page_logit and score after it; ``columns`` are the five that are read."""
    shared = docs.sparkSession.sparkContext.broadcast(views)
    place = [docs.columns.index(c) for c in columns]
    names = [*docs.columns, "_text_logit", "_page_logit", "_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                a = b = np.zeros(len(batch))
                score = np.ones(len(batch))
            else:
                text, lang, source, n_chars = (batch.column(i) for i in place[1:])
                page = pd.DataFrame({"lang": lang.to_pylist(), "source": source.to_pylist(), "n_chars": n_chars.to_pandas()})
                a, b, score = shared.value.scores(content(text), metadata(page))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b), pa.array(score)], names)

    kinds = docs.withColumns({c: F.lit(0.0) for c in names[-3:]}).schema
    return docs.mapInArrow(run, kinds)


READ = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_logit and page_logit (calibrated views), score (probability of being good), good."""
    own = shaped(docs)
    out = _scored(own, fit_views(docs, labels), READ)
    return out.select("doc_id", F.col("_text_logit").alias("text_logit"), F.col("_page_logit").alias("page_logit"),
                      F.col("_score").alias("score"), (F.col("_score") >= 0.5).alias("good"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is ``least`` or more."""
    return _scored(docs, fit_views(docs, labels), READ).where(F.col("_score") >= least).drop("_text_logit", "_page_logit", "_score")
