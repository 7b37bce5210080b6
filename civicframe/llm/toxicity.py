"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w[t] + sum over pairs <v[t], v[u]>): the factors carry what an additive model misses, such as an
insult together with the mention of a group. Terms are the words of a text and their first four and five letters, so
that inflected forms share evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, pylists, ship, slices
from .quality import labelled

WORD = re.compile(r"[^\W\d_]+")
BITS = 22


def terms(text: str | None) -> set[int]:
    """Distinct hashed terms of a text, in [0, 2**BITS)."""
    out = set()
    h, mask = xxhash.xxh32_intdigest, (1 << BITS) - 1
    words = set(WORD.findall((text or "").lower()))
    for w in words:
        out.add(h(w) & mask)
    for k in (4, 5):
        for w in {w[:k] for w in words if len(w) > k}:
            out.add(h(f"{k}{w}") & mask)
    return out


@dataclass
class Machine:
    """ids: sorted hashed terms that the model knows."""

    ids: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores before the sigmoid, of rows of positions in ``ids``."""
        out = np.full(len(rows), self.w0)
        for i, r in enumerate(rows):
            if len(r):
                s = self.v[r]
                out[i] += self.w[r].sum() + 0.5 * ((s.sum(0) ** 2).sum() - (s**2).sum())
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        known = {int(t): i for i, t in enumerate(self.ids)}
        rows = [np.array(sorted(known[t] for t in terms(x) & known.keys()), np.int64) for x in texts]
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -35, 35)))


def _associated(rows: list[np.ndarray], y: np.ndarray, least_g: float, most: int) -> np.ndarray:
    """Terms whose presence goes with the label, by the log-likelihood ratio; seen in three rows at least."""
    n, p = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r, label in zip(rows, y, strict=True):  # the terms of a row are distinct
        n[r] += 1
        p[r] += label
    ids = np.flatnonzero(n >= 3)
    n, p = n[ids], p[ids]
    total, pos = len(y), y.sum()

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0)

    g = 2 * (part(p, n * pos / total) + part(n - p, n * (1 - pos / total)) + part(pos - p, (total - n) * pos / total) + part(total - n - pos + p, (total - n) * (1 - pos / total)))
    keep = np.flatnonzero(g >= least_g)
    return np.sort(ids[keep[np.argsort(-g[keep], kind="stable")[:most]]])


def learn(rows: list[np.ndarray], y: np.ndarray, factors: int = 8, epochs: int = 60, rate: float = 0.05, decay: float = 2e-4, least_g: float = 8.0, most: int = 20_000) -> Machine:
    """Adam on the logistic loss. rows: distinct hashed terms of each text. most: terms that the machine knows at most, those most associated with the label."""
    if not len(rows) or not 0 < y.sum() < len(y):
        p = float(y.mean()) if len(y) else 0.0
        return Machine(np.zeros(0, np.int64), float(np.log((p + 1e-3) / (1 - p + 1e-3))), np.zeros(0), np.zeros((0, factors)))
    ids = _associated(rows, y.astype(float), least_g, most)
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))
    own = [k[k >= 0] for k in (place[r] for r in rows)]
    rng = np.random.default_rng(11)
    base = float(np.log(y.mean() / (1 - y.mean())))
    theta = [np.array([base]), np.zeros(len(ids)), rng.normal(0, 0.05, (len(ids), factors))]
    m, s = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for epoch in range(epochs):
        lr = rate / (1 + epoch / 15)
        for part in np.array_split(rng.permutation(len(own)), max(1, len(own) // 256)):
            size = np.array([len(own[i]) for i in part])
            flat = np.concatenate([own[i] for i in part])
            row = np.repeat(np.arange(len(part)), size)
            w0, w, v = theta
            vf = v[flat]
            sums = np.zeros((len(part), factors))
            np.add.at(sums, row, vf)
            squares = np.bincount(row, weights=(vf**2).sum(1), minlength=len(part))
            z = w0[0] + np.bincount(row, weights=w[flat], minlength=len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[part]) / len(part)
            gv = np.zeros_like(v)
            np.add.at(gv, flat, err[row][:, None] * (sums[row] - vf))
            grads = [np.array([err.sum()]), np.bincount(flat, weights=err[row], minlength=len(ids)) + decay * w, gv + decay * v]
            step += 1
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                s[k] = 0.999 * s[k] + 0.001 * grads[k] ** 2
                theta[k] = theta[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(ids, float(theta[0][0]), theta[1], theta[2])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        (texts,) = pylists(b, "text")
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("toxic")), pa.array([sorted(terms(t)) for t in texts], pa.list_(pa.int32()))], names=["toxic", "terms"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000) -> Machine:
    """The machine, from the texts of ``max_rows`` labelled ids at most outside the held-out fold (``quality.labelled``).

    Only the text teaches. Rows without id or label are left out; with no rows the score is a constant. Of a text's terms, those count whose presence
    goes with the label in the sample (``least_g``), the ``most`` strongest: a pair whose members show nothing alone isn't learned.
    """
    sample = labelled(docs, labels.where(fold(F.col("doc_id")) != 2), "toxic", max_rows)
    ship(docs.sparkSession)
    got = sample.select("toxic", "text").mapInArrow(_hashed, "toxic int, terms array<int>").toArrow()
    rows = [x.values.to_numpy() if len(x) else np.zeros(0, np.int32) for x in got.column("terms").combine_chunks()] if got.num_rows else []
    y = got.column("toxic").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    order = sorted(range(len(rows)), key=lambda i: (xxhash.xxh3_128_digest(rows[i].tobytes()), y[i]))  # the same model in whatever order the rows come
    return learn([rows[i] for i in order], y[order] if order else y)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of the whole text of each row; a projection, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # at most 20,000 terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            (texts,) = pylists(b, "text")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(texts), pa.float64())], names=["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without terms. Repeated rows score alike; other columns are ignored.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
