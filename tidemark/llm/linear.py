"""Linear models over hashed presence features: a bounded labelled sample, calibration and scoring.

A feature function turns a slice of texts (bytes and row offsets) into pairs (row, bucket). A model
keeps a table from bucket to one of K kept features; scoring scatters presences into a rows x K matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, map_arrow, slices, string_buffers

#: Rows whose presences are weighed at once.
ROWS = 1024

FeatureFn = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class Linear:
    """P(label 1) = sigmoid(a * (weights of present features + bias) + c)."""

    index: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    a: float = 1.0
    c: float = 0.0

    def margins(self, raw: np.ndarray, offs: np.ndarray, features: FeatureFn) -> np.ndarray:
        out = np.zeros(len(offs) - 1)
        for lo, hi in slices(offs):
            row, bucket = features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            k = self.index[bucket]
            kept = k >= 0
            present = np.zeros((hi - lo, len(self.weights)), bool)
            present[row[kept], k[kept]] = True
            for at in range(0, hi - lo, ROWS):
                out[lo + at : min(lo + at + ROWS, hi)] = present[at : at + ROWS] @ self.weights
        return out + self.bias

    def scores(self, raw: np.ndarray, offs: np.ndarray, features: FeatureFn) -> np.ndarray:
        return sigmoid(self.a * self.margins(raw, offs, features) + self.c)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, *, mod: int, hold: int, per_class: int, features: FeatureFn, swaps: Callable[[str], list[str]] | None = None
) -> tuple[np.ndarray, list[np.ndarray], float, list[list[tuple[np.ndarray, np.ndarray]]]]:
    """Labels and distinct buckets of at most per_class documents of each label outside the held-out fold, the share of label 1 in that part,
    and for each document what its texts under `swaps` lose and gain in buckets.

    Documents are taken by a hash of their id, so the sample is the same on each run; of rows that repeat an id one is taken.
    """
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", F.col(label).alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = labels.groupBy("doc_id").agg(F.max("y").cast("int").alias("y")).filter(fold(F.col("doc_id"), mod) != hold)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64("doc_id", F.lit(17)), "doc_id"]
    ids = [known.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    chosen = docs.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").select("doc_id", "text", "y")  # at most 2 * per_class ids

    def distinct(raw: np.ndarray) -> np.ndarray:
        return np.unique(features(raw, np.array([0, len(raw)]))[1]).astype(np.uint32)

    def extract(batch: pa.RecordBatch):
        raw, offs = string_buffers(batch.column("text"))
        out, lost, won = [], [], []
        for lo, hi in slices(offs):
            row, bucket = features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            pair = np.unique(row.astype(np.int64) << 32 | bucket.astype(np.int64))
            edge = np.searchsorted(pair >> 32, np.arange(hi - lo + 1))
            out += [(pair[a:b] & 0xFFFFFFFF).astype(np.uint32) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        for text, own in zip(batch.column("text").to_pylist(), out, strict=True):
            others = [distinct(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in (swaps(text) if swaps and text else ())]
            lost.append([np.setdiff1d(own, x).tobytes() for x in others])
            won.append([np.setdiff1d(x, own).tobytes() for x in others])
        cells = [pa.array([x.tobytes() for x in out], pa.binary()), *(pa.array(x, pa.list_(pa.binary())) for x in (lost, won))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *cells], names=["doc_id", "y", "x", "lost", "won"])

    rows = map_arrow(chosen, extract, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x binary, lost array<binary>, won array<binary>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y", "lost", "won")).alias("r")).select("doc_id", "r.*").collect()  # at most 2 * per_class rows
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    total = sum(counts.values())
    ints = lambda x: np.frombuffer(x, np.uint32)
    pairs = [[(ints(a), ints(b)) for a, b in zip(r["lost"], r["won"], strict=True)] for r in rows]
    return np.array([r["y"] for r in rows], np.int64), [ints(r["x"]) for r in rows], counts.get(1, 0) / total if total else 0.5, pairs


def matrix(xs: list[np.ndarray], index: np.ndarray, k: int) -> np.ndarray:
    """Presence matrix (float32) of the kept features."""
    out = np.zeros((len(xs), k), np.float32)
    for i, x in enumerate(xs):
        at = index[x]
        out[i, at[at >= 0]] = 1
    return out


def frequencies(y: np.ndarray, xs: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the documents of label 0 and of label 1 that have it."""
    n = np.zeros((2, buckets), np.int64)
    for label, x in zip(y.tolist(), xs, strict=True):
        n[label, x] += 1
    return n[0], n[1]


def chosen_index(keep: np.ndarray, buckets: int) -> np.ndarray:
    index = np.full(buckets, -1, np.int32)
    index[keep] = np.arange(len(keep))
    return index


def calibrate(margins: np.ndarray, y: np.ndarray, prior: float, rounds: int = 100) -> tuple[float, float]:
    """Platt's a and c by Newton steps, with the two labels weighted to their share in all labelled rows."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return 0.0, float(np.log((prior + 0.01) / (1 - prior + 0.01)))
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = margins.std() or 1.0
    x = np.stack([margins / scale, np.ones(len(y))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - target)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, model: Linear, features: FeatureFn, *, mod: int, hold: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most as large as its tables of buckets and kept features

    def run(batch: pa.RecordBatch):
        p = shared.value.scores(*string_buffers(batch.column("text")), features)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), mod) == hold, F.lit(False)).alias("held_out"), "score", "predicted")
