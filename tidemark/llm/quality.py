"""Quality classifier: Naive Bayes support vector machine on n-gram indicators.

Features are n-grams (1 to 4) of a coarse view of the text, in which each character is reduced to
its class (lower or upper letter, digit, white space, or the sign itself) and runs of letters are one;
marks for repeated words; and hashed n-grams (1 and 2) of words, in lower case and without signs. Each indicator
is scaled by its class log-count ratio, those of words apart from the others, and of both kinds the FEATURES that
tell most are kept; the weights come from dual coordinate descent on the L2-regularised hinge loss. Margins
become probabilities by Platt's method on a part of the training rows that the fit leaves out.

Nulls: a null text counts as empty and gets the score of no features; a null doc_id is kept and
not held out. Rows of labels whose quality is null or not 0 or 1 are left out; of repeated ones the
larger counts. Without labelled rows all scores are 0.5 or the known share. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import ByteHash, windows, word_bounds
from tidemark.llm.linear import Linear, calibrate, chosen_index, frequencies, matrix, sample, score

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Documents of each label in the training sample.
PER_CLASS = 6000
#: Buckets of the coarse n-grams; those of the marks (runs of a repeated word of at least these lengths) and of word n-grams follow. FEATURES of each kind are kept.
MARKS = (1, 2, 4, 8, 16)
BUCKETS, WORD_BUCKETS, FEATURES, MIN_DOCS = 1 << 16, 1 << 18, 3000, 3
COARSE = BUCKETS + len(MARKS)
COST, EPOCHS, SMOOTH = 0.1, 20, 1.0

_VIEW = np.arange(256, dtype=np.uint8)
_VIEW[97:123] = 97
_VIEW[128:] = 97
_VIEW[65:91] = 65
_VIEW[48:58] = 48
_VIEW[[9, 11, 12, 13]] = 32
_RUN = np.zeros(256, bool)
_RUN[[97, 65, 48]] = True
_HASH = ByteHash(0x0A11)
#: For word n-grams: ASCII letters in lower case, and what stands between words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the n-gram indicators."""
    n = len(offs) - 1
    view = _VIEW[raw]
    row = np.repeat(np.arange(n), np.diff(offs))
    keep = np.ones(len(view), bool)
    keep[1:] = (view[1:] != view[:-1]) | ~_RUN[view[1:]] | (row[1:] != row[:-1])
    seq, row = view[keep].astype(np.uint32), row[keep]
    rows, buckets = [], []
    code = np.zeros(len(seq), np.uint32)
    for size in range(1, 5):
        m = len(seq) - size + 1
        if m <= 0:
            break
        code = code[:m] << np.uint32(8) | seq[size - 1 :]
        inside = row[:m] == row[size - 1 :]
        rows.append(row[:m][inside])
        buckets.append(_bucket(code[inside].astype(np.uint64) + np.uint64(size << 32)))
    s, e, first = word_bounds(raw, offs)
    if len(s):
        words, who = _HASH.words(raw, s, e), np.repeat(np.arange(n), np.diff(first))
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (who[1:] == who[:-1])
        runs = np.cumsum(same)
        base = np.maximum.accumulate(np.where(same, 0, runs))
        again = runs - base
        for k, level in enumerate(MARKS):
            at = who[again >= level]
            rows.append(at)
            buckets.append(np.full(len(at), BUCKETS + k, np.int64))
    s, e, first = word_bounds(raw, offs, _BETWEEN)
    if len(s):
        words, who = _HASH.words(_LOWER[raw], s, e), np.repeat(np.arange(n), np.diff(first))
        for size in (1, 2):
            grams = windows(words, size)
            inside = who[: len(grams)] == who[size - 1 :]
            rows.append(who[: len(grams)][inside])
            buckets.append(COARSE + (grams[inside] % np.uint64(WORD_BUCKETS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _bucket(code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def dual_descent(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularised hinge loss, by coordinate descent on the dual; y is -1 or 1."""
    norm, alpha, w = np.einsum("ij,ij->i", x, x) + 1, np.zeros(len(x)), np.zeros(x.shape[1] + 1)
    balance = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        change = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w[:-1] + w[-1]) - 1) / norm[i], 0.0), balance[i])
            if new != alpha[i]:
                w[:-1] += (new - alpha[i]) * y[i] * x[i]
                w[-1] += (new - alpha[i]) * y[i]
                change = max(change, abs(new - alpha[i]))
                alpha[i] = new
        if change < 1e-4 * cost:
            break
    return w


def _telling(seen: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The FEATURES of the seen buckets that tell most, and their log-count ratios."""
    p, q = (n1[seen] + SMOOTH), (n0[seen] + SMOOTH)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum()) if len(seen) else np.zeros(0)
    best = np.argsort(-np.abs(ratio) * np.sqrt(n0[seen] + n1[seen]), kind="stable")[:FEATURES]
    return seen[best], ratio[best]


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, mod: int = FOLDS, hold: int = HELD_OUT) -> Linear:
    y, xs, prior, _ = sample(docs, labels, "quality", mod=mod, hold=hold, per_class=per_class, features=features)
    part = np.arange(len(y)) % 5 == 4  # for calibration
    n0, n1 = frequencies(y[~part], [x for x, p in zip(xs, part, strict=True) if not p], COARSE + WORD_BUCKETS)
    seen = np.flatnonzero(n0 + n1 >= MIN_DOCS)
    kept = [_telling(own, n0, n1) for own in (seen[seen < COARSE], seen[seen >= COARSE])]
    keep, ratio = (np.concatenate(x) for x in zip(*kept, strict=True))
    model = Linear(chosen_index(keep, COARSE + WORD_BUCKETS), np.zeros(len(keep)))
    if not 0 < y[~part].sum() < (~part).sum():
        model.a, model.c = calibrate(np.zeros(len(y)), y, prior)
        return model
    x = matrix(xs, model.index, len(keep))
    x *= ratio.astype(np.float32)
    w = dual_descent(x[~part], np.where(y[~part] == 1, 1.0, -1.0))
    model.weights, model.bias = w[:-1] * ratio, float(w[-1])
    held = x[part] @ w[:-1] + w[-1]
    model.a, model.c = calibrate(held, y[part], prior)
    return model


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, per_class: int = PER_CLASS, mod: int = FOLDS, hold: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    return score(docs, train(docs, labels, per_class=per_class, mod=mod, hold=hold), features, mod=mod, hold=hold, threshold=threshold)
