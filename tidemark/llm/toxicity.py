"""Toxicity classifier with counterfactual regularisation.

Logistic regression on the presence of words and of their beginnings (4 to 6 bytes), hashed. For
each training text that names an identity, the same text with another identity of its group swapped in for it
must get the same score: the squared difference of the two scores is part of the loss. So a term
that merely occurs near abuse earns no weight against its neighbours, and neutral mentions stay clean. Texts are swapped
and read anew where they lie; only the features that a swap takes away and brings come to the driver, a few numbers each.

Features are chosen on the training rows by how far their frequencies in the two classes differ,
identity terms always. Margins become probabilities by Platt's method on rows the fit leaves out.

Nulls and other odd rows as in `quality`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import ByteHash, word_bounds
from tidemark.llm.linear import Linear, calibrate, chosen_index, frequencies, matrix, sample, score, sigmoid

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Documents of each label in the training sample.
PER_CLASS = 4000
BUCKETS, FEATURES, MIN_DOCS = 1 << 20, 3000, 2
L2, FAIR, ROUNDS, RATE = 1e-3, 1.0, 300, 0.1

# Terms that may stand for each other in a counterfactual text.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "arab", "indian", "mexican", "chinese", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrant", "native", "refugee", "foreigner", "citizen"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young", "old"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

_HASH = ByteHash(0x70C)
#: Words: letters and digits of ASCII and all bytes beyond.
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STARTS = (4, 5, 6)


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of words and word beginnings."""
    raw = _LOWER[raw]
    s, e, first = word_bounds(raw, offs, _GAP)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    rows, codes = [row], [_HASH.words(raw, s, e)]
    for k in _STARTS:
        long = e - s > k
        rows.append(row[long])
        codes.append(_HASH.words(raw, s[long], s[long] + k) + np.uint64(k))
    with np.errstate(over="ignore"):
        return np.concatenate(rows), ((np.concatenate(codes) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _buckets(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode(), np.uint8)
    return np.unique(features(raw, np.array([0, len(raw)]))[1])


def swapped(groups: tuple[tuple[str, ...], ...]) -> Callable[[str], list[str]]:
    """text -> the texts with all occurrences of one identity term replaced by another one of its group."""
    beside = "0-9a-z\u0080-\U0010ffff"
    terms = {t: [o for o in g if o != t] for g in groups for t in g}
    pattern = re.compile(rf"(?<![{beside}])(?:{'|'.join(sorted(map(re.escape, terms), key=len, reverse=True))})(?![{beside}])") if terms else None
    low = {i: i + 32 for i in range(65, 91)}

    def swaps(text: str) -> list[str]:
        text = text.translate(low)
        own = dict.fromkeys(pattern.findall(text)) if pattern else ()
        return [pattern.sub(lambda m, t=t, o=o: o if m[0] == t else m[0], text) for t in own for o in terms[t]]

    return swaps


#: (pair, feature, sign) of each feature that a swapped text lacks (1) or has (-1) against its text.
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def counterfactuals(diffs: list[list[tuple[np.ndarray, np.ndarray]]], index: np.ndarray) -> Pairs:
    """The kept features of the swaps' differences, one pair for each swap that changes some."""
    rows, feats, signs, n = [], [], [], 0
    for lost, won in (d for own in diffs for d in own):
        a, b = (k[k >= 0] for k in (index[lost], index[won]))
        if len(a) + len(b):
            feats += [a, b]
            signs += [np.ones(len(a)), -np.ones(len(b))]
            rows.append(np.full(len(a) + len(b), n))
            n += 1
    join = lambda x, kind: np.concatenate([np.empty(0, kind), *x]).astype(kind)
    return join(rows, np.int64), join(feats, np.int64), join(signs, np.float64)


def fit(x: np.ndarray, y: np.ndarray, pairs: Pairs | np.ndarray, *, l2: float = L2, fair: float = FAIR, rounds: int = ROUNDS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Weights and bias of balanced logistic loss + l2 + fair * mean squared difference of counterfactual scores (Adam). pairs: sparse, or one dense row each."""
    if isinstance(pairs, np.ndarray):
        row, feature = np.nonzero(pairs)
        pairs = row, feature, pairs[row, feature].astype(np.float64)
    row, feature, sign = pairs
    many = int(row.max()) + 1 if len(row) else 0
    n1 = max(1, int(y.sum()))
    balance = (np.where(y == 1, 0.5 / n1, 0.5 / max(1, len(y) - n1))).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        miss = balance * (sigmoid(x @ w + b) - y)
        grad = np.append(x.T @ miss + 2 * l2 * w, miss.sum())
        if many:
            apart = np.bincount(row, sign * w[feature], many)
            grad[:-1] += 2 * fair * np.bincount(feature, sign * apart[row], len(w)) / many
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, mod: int = FOLDS, hold: int = HELD_OUT, groups: tuple[tuple[str, ...], ...] = IDENTITIES, fair: float = FAIR) -> Linear:
    y, xs, prior, diffs = sample(docs, labels, "toxic", mod=mod, hold=hold, per_class=per_class, features=features, swaps=swapped(groups))
    part = np.arange(len(y)) % 5 == 4
    own = [x for x, p in zip(xs, part, strict=True) if not p]
    n0, n1 = frequencies(y[~part], own, BUCKETS)
    t0, t1 = max(1, int((y[~part] == 0).sum())), max(1, int((y[~part] == 1).sum()))
    terms = np.unique(np.concatenate([_buckets(t) for g in groups for t in g])) if groups else np.empty(0, np.int64)
    seen = np.flatnonzero(n0 + n1 >= MIN_DOCS)
    p, q = n1[seen] / t1, n0[seen] / t0
    z = np.abs(p - q) / np.sqrt(p * (1 - p) / t1 + q * (1 - q) / t0 + 1.0 / (t0 + t1) ** 2)
    keep = np.union1d(seen[np.argsort(-z, kind="stable")[:FEATURES]], terms)
    model = Linear(chosen_index(keep, BUCKETS), np.zeros(len(keep)))
    if not 0 < y[~part].sum() < (~part).sum():
        model.a, model.c = calibrate(np.zeros(len(y)), y, prior)
        return model
    x = matrix(xs, model.index, len(keep))
    w, b = fit(x[~part], y[~part], counterfactuals([d for d, p in zip(diffs, part, strict=True) if not p], model.index), fair=fair)
    model.weights, model.bias = w.astype(np.float64), b
    model.a, model.c = calibrate(x[part] @ w + b, y[part], prior)
    return model


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, per_class: int = PER_CLASS, mod: int = FOLDS, hold: int = HELD_OUT, groups: tuple[tuple[str, ...], ...] = IDENTITIES, fair: float = FAIR) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    return score(docs, train(docs, labels, per_class=per_class, mod=mod, hold=hold, groups=groups, fair=fair), features, mod=mod, hold=hold, threshold=threshold)
