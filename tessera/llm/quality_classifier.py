"""Quality scores by nearest-neighbour voting among labelled documents.

Documents become weighted term vectors: hashed byte trigrams of the whole text
and a few terms for how the words repeat. A bounded sample of labelled documents
gives the term weights and, by truncated singular value decomposition, a latent
semantic space. Their latent vectors are broadcast; every document is projected
and compared with all of them by exact blocked cosine products. The nearest
ones vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import raw_text

#: Hash buckets of byte trigrams, and terms for repetition behind them.
BUCKETS = 4096
EXTRA = 24
TERMS = BUCKETS + EXTRA
#: Latent dimensions, voting neighbours, and the power of the similarity that weights a vote.
LATENT = 64
NEIGHBOURS = 25
POWER = 8
#: Labelled documents that the model is fitted on at most (chosen by a hash of their id).
SAMPLE = 4_000
#: A document is accepted from this score on.
ACCEPT = 0.7
BLOCK = 256


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(text: bytes) -> np.ndarray:
    """Term counts of a whole text: trigram buckets, then one-hot levels of repetition and length."""
    out = np.zeros(TERMS, np.float32)
    raw = np.frombuffer(text, np.uint8)
    for lo in range(0, max(0, len(raw) - 2), 1 << 20):
        b = raw[lo : lo + (1 << 20) + 2].astype(np.uint32)
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(20)
        out[:BUCKETS] += np.bincount(code, minlength=BUCKETS)
    words = text.split()
    if words:
        follow = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        variety = len(set(words)) / len(words)
        pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
        scale = max(1.0, float(out[:BUCKETS].sum()))
        # each level weighs like a share of the text, so that it counts in long ones too
        out[BUCKETS + min(7, int(follow * 8))] = 0.15 * scale if follow > 0.1 else 0
        out[BUCKETS + 8 + min(7, int((1 - pairs) * 8))] = 0.15 * scale if pairs < 0.75 else 0
        out[BUCKETS + 16 + min(7, int((1 - variety) * 8))] = 0.05 * scale
    return out


@dataclass(frozen=True)
class Space:
    """A fitted model; some 2 MB however large the corpus is."""

    weight: np.ndarray
    axes: np.ndarray
    latent: np.ndarray
    label: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors; the plain share where nothing is similar."""
        if not len(self.label):
            return np.ones(len(counts))
        prior = float(self.label.mean())
        near = self.project(counts) @ self.latent.T
        k = min(NEIGHBOURS, len(self.label))
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, at, 1), 0) ** POWER
        total = vote.sum(axis=1)
        return np.where(total > 1e-6, (vote * self.label[at]).sum(axis=1) / np.maximum(total, 1e-9), prior)


def _features(docs: DataFrame) -> DataFrame:
    """label, and the places and values of the term counts that are not zero, made on the executors."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                each = [terms(t) for t in part.column(1).to_pylist()]
                at = [np.flatnonzero(x) for x in each]
                columns = [[i.astype(np.uint16).tobytes() for i in at], [x[i].tobytes() for x, i in zip(each, at)]]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.binary()) for c in columns]], ["label", "at", "counts"])

    return docs.mapInArrow(run, "label int, at binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space:
    """Fit on at most ``sample`` labelled documents outside the held-out part.

    A document with several labels counts with its lowest, an id with several texts
    with the least of them. Null labels and ids are left out. Without labelled
    documents every score is 1.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("t"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("t").alias("t"))
    rows = _features(one.select("label", "t")).collect()
    label = np.array([r["label"] for r in rows], np.float32)
    if not len(rows):
        return Space(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), label)
    counts = np.zeros((len(rows), TERMS), np.float32)
    for own, r in zip(counts, rows):
        own[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["counts"], np.float32)
    order = np.lexsort((label, *(counts[:, j] for j in range(0, TERMS, 997)), counts.sum(axis=1)))  # whatever order they came in
    counts, label = counts[order], label[order]
    weight = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = np.log1p(counts) * weight
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    axes = _axes(x, min(LATENT, len(rows)))
    space = Space(weight, axes, np.zeros((0, 1), np.float32), label)
    return Space(weight, axes, space.project(counts).astype(np.float32), label)


def _axes(x: np.ndarray, k: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt[:k].T).astype(np.float32)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    The score sees the text alone. Null and empty texts get the share of label 1
    among the sample, as do texts too short for a trigram that resemble nothing.
    Repeated rows score alike; ties of similarity are cut at ``NEIGHBOURS`` votes;
    a null doc_id is not held out; no rows give no rows; other columns are ignored.
    """
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                score = space.value.score(np.stack([terms(t) for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(score, 0, 1).astype(np.float64))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), raw_text().alias("t")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is ``ACCEPT`` or more, with their columns as they are."""
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                score = space.value.score(np.stack([terms((t or "").encode()) for t in part.column(at).to_pylist()]))
                yield part.filter(pa.array(score >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
