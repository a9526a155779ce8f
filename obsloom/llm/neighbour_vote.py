"""Quality classifier: labelled documents as latent-semantic vectors, similarity-weighted vote of the nearest for every document."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .layout import slices, texts

# Classes of bytes whose trigrams are the terms: what a text looks like, whatever its language.
CLASSES = 12
EXTRA = 8  # terms for repetition
DIM = CLASSES ** 3 + EXTRA
_TABLE = np.full(256, 10, np.uint8)  # other punctuation
for _chars, _class in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,", 5), (b"!?", 6),
                       (b"|", 7), (b"#$%&*", 8), (b"<>{}[]()=/\\_@", 9)):
    _TABLE[list(_chars)] = _class
_TABLE[128:] = 11
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))


def counts(values: list[str]) -> np.ndarray:
    """Term counts of each text: trigrams of byte classes, and how often words and lines repeat. Whole texts, a few array passes."""
    out = np.zeros((len(values), DIM), np.float32)
    for i, value in enumerate(values):
        raw = np.frombuffer(value.encode(), np.uint8)
        if not len(raw):
            continue
        kind = _TABLE[raw].astype(np.int64)
        if len(raw) > 2:
            out[i, :CLASSES ** 3] = np.bincount(kind[:-2] * CLASSES ** 2 + kind[1:-1] * CLASSES + kind[2:], minlength=CLASSES ** 3)
        words, lines = _hashes(raw, (kind == 3) | (kind == 4)), _hashes(raw, kind == 4)
        n = len(words)
        if not n:
            continue
        tail = out[i, CLASSES ** 3:]
        tail[0] = (words[1:] == words[:-1]).sum()
        tail[1] = (words[2:] == words[:-2]).sum()
        distinct = len(np.unique(words))
        tail[2] = n - distinct
        tail[3] = distinct
        tail[4] = len(lines) - len(np.unique(lines))
        tail[5] = len(lines)
        four = words[3:] * _ODD * _ODD * _ODD + words[2:-1] * _ODD * _ODD + words[1:-2] * _ODD + words[:-3] if n > 3 else words[:0]
        tail[6] = 4 * (len(four) - len(np.unique(four)))
        tail[7] = n
    return out


def _hashes(raw: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each maximal run of bytes between gaps."""
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(raw), _ODD))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)])
        back = np.cumprod(np.full(len(raw) + 1, _INV))
        return (prefix[ends] - prefix[starts]) * back[starts]


class Space:
    """A latent-semantic space: damped counts, inverse document frequency, leading singular directions of the labelled sample."""

    def __init__(self, bank: np.ndarray, rank: int = 48):
        seen = (bank > 0).sum(axis=0)
        self.idf = (np.log((1 + len(bank)) / (1 + seen)) + 0.2).astype(np.float32)
        x = self._weigh(bank)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)

    def _weigh(self, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n / np.maximum(n[:, :CLASSES ** 3].sum(axis=1, keepdims=True), 1) * 1000) * self.idf
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def place(self, n: np.ndarray) -> np.ndarray:
        y = self._weigh(n) @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


def vote(vectors: np.ndarray, bank: np.ndarray, labels: np.ndarray, mass: np.ndarray, k: int, sharp: float, prior: float) -> np.ndarray:
    """Share of label 1 among the k most similar bank rows, weighted by similarity to ``sharp`` and by ``mass``; ``prior`` where nothing is similar."""
    like = vectors @ bank.T
    k = min(k, len(bank))
    near = np.argpartition(like, len(bank) - k, axis=1)[:, len(bank) - k:]
    weight = np.maximum(np.take_along_axis(like, near, axis=1), 0).astype(np.float64) ** sharp * mass[near]
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * labels[near]).sum(axis=1) / np.where(total > 0, total, 1), prior)


def bank_rows(docs: DataFrame, labels: DataFrame, held_out: int, per_class: int):
    """Labelled sample: of the rows outside the held-out fold, the ``per_class`` of each label with the lowest hash of doc_id, with their text counts.

    Returns (term counts, labels, share of label 1 among all labelled rows, labelled rows of each class)."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != held_out)
    sizes = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    picked = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    sample = texts(docs).join(F.broadcast(picked), "doc_id")

    def work(batches):
        for batch, values in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in counts(values)], pa.binary())], ["doc_id", "quality", "n"])

    got = sorted(tuple(r) for r in sample.select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
                 .mapInArrow(work, "doc_id long, quality int, n binary").collect())
    return np.array([np.frombuffer(r[2], np.float32) for r in got]).reshape(-1, DIM), np.array([r[1] for r in got], np.int64), sizes


def score(docs: DataFrame, labels: DataFrame, held_out: int = 2, per_class: int = 1500, k: int = 25, rank: int = 48, sharp: float = 8.0, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Learns from ``labels`` rows whose crc32(doc_id as text) mod 4 is not ``held_out``, from a sample of ``per_class`` rows of each label (the only
    bounded part; votes are weighted back to the labels' true shares). The space and the sample's vectors, at most 2 * per_class * rank
    numbers, are broadcast; every document meets every sample vector in blocked matrix products, so the neighbours are exact. A null or
    empty text gets the share of label 1. Without labels, or with labels of one kind only, the score is that share (0.5 without any).
    A null doc_id is scored (held_out false). Only the text enters a score."""
    bank, label, sizes = bank_rows(docs, labels, held_out, per_class)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    spark = docs.sparkSession
    model = None
    if len(set(label.tolist())) == 2:
        space = Space(bank, min(rank, DIM))
        seen = np.bincount(label, minlength=2)
        mass = np.array([sizes[q] / seen[q] for q in (0, 1)])[label]
        model = spark.sparkContext.broadcast((space, space.place(bank), label, mass))

    def work(batches):
        for batch, values in slices(batches):
            out = np.full(len(values), prior)
            if model:
                space, vectors, label, mass = model.value
                for a in range(0, len(values), 256):
                    n = counts(values[a:a + 256])
                    out[a:a + 256] = np.where(n.any(axis=1), vote(space.place(n), vectors, label, mass, k, sharp, prior), prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(out, 0, 1))], ["doc_id", "score"])

    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == held_out, F.lit(False))
    return texts(docs).mapInArrow(work, "doc_id long, score double").select(
        "doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
