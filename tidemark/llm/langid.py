"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 3- and 4-byte windows of the lower-cased text in which all ASCII characters but
letters are blanks; windows of blanks only are left out. A text is the average of its subwords' embeddings;
embeddings and softmax are trained together by stochastic gradient descent in numpy. Temperature
scaling on rows that training leaves out calibrates the probabilities, and the acceptance bound
is the lowest probability from which on those rows are right at the wanted rate. It is not below `floor` nor
CHANCE times the probability of a blind guess; where no bound reaches the rate, only what is above all of those
rows' probabilities is accepted. With a single language there is nothing to tell it from, and all is accepted.

For scoring, embeddings times softmax weights are one table where there are at most WIDTH languages; with more, embeddings are averaged first. So a text costs
one lookup for each window, and the model's size hardly depends on the number of languages.

Nulls: null texts and texts without a letter are `und` with score 0 and not accepted; a null lang is
not learned from; a null doc_id is kept and not held out. Extra columns are ignored by `identify` and kept
by `accepted`. All values of lang are learned, from fewer rows each where there are many, but from one at least; more than LANGS, which
cannot be languages, raise an error. Repeated rows count once in training, different texts of one doc_id each, and every row is predicted. Without
training rows everything is `und`; of an empty table nothing is accepted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fold, map_arrow, slices, string_buffers

FOLDS, HELD_OUT = 3, 1
#: Training documents of each language, and of all.
PER_LANG, SAMPLE = 800, 40_000
#: Values of lang beyond which the column does not hold languages.
LANGS = 20_000
BUCKETS, WIDTH, EPOCHS, RATE = 1 << 15, 16, 6, 0.5
PRECISION, FLOOR, CHANCE = 0.99, 0.4, 1.5
SIZES = (3, 4)

_VIEW = np.full(256, 32, np.uint8)
_VIEW[97:123] = np.arange(97, 123)
_VIEW[65:91] = np.arange(97, 123)
_VIEW[128:] = np.arange(128, 256)
#: ASCII letters.
_PLAIN = (_VIEW != 32) & (_VIEW < 128)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages, or buckets x WIDTH where `weights` follow
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = FLOOR
    weights: np.ndarray | None = None

    def probabilities(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offs) - 1, len(self.langs)))
        for lo, hi in slices(offs):
            row, code = subwords(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            order = np.argsort(row, kind="stable")
            row, code = row[order], code[order]
            n = np.bincount(row, minlength=hi - lo)
            have = np.flatnonzero(n)
            if len(have):
                sums = np.add.reduceat(self.table[code], np.searchsorted(row, have), axis=0)
                mean = sums / n[have][:, None]
                out[lo + have] = mean if self.weights is None else mean @ self.weights
        return softmax((out + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def subwords(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the windows; rows ascend within each window size."""
    view = _VIEW[raw].astype(np.uint64)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    rows, codes = [], []
    with np.errstate(over="ignore"):
        for size in SIZES:
            m = len(view) - size + 1
            if m <= 0:
                break
            code = np.zeros(m, np.uint64)
            for i in range(size):
                code = code << np.uint64(8) | view[i : i + m]
            ok = (row[:m] == row[size - 1 :]) & (code != np.uint64(int.from_bytes(b" " * size, "big")))
            rows.append(row[:m][ok])
            codes.append(((code[ok] + np.uint64(size << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(codes)) if rows else (np.empty(0, np.int32), np.empty(0, np.int64))


def _collect(docs: DataFrame, mod: int, hold: int, per_lang: int) -> tuple[list[str], list[tuple[str, np.ndarray, np.ndarray]]]:
    """Languages, and (lang, buckets, shares) of a sample: per_lang distinct (doc_id, text) of each, or SAMPLE / languages if that is less, but one at least; those first by a hash."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), mod) != hold))
    known = known.withColumn("_h", F.xxhash64("doc_id", "text", F.lit(5)))
    # repeated rows count once; where doc_ids repeat, their texts tell them apart
    distinct = known.select("lang", "_h").distinct()
    counts = {r["lang"]: r["count"] for r in distinct.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS + 1).collect()}
    if len(counts) > LANGS:
        raise ValueError(f"more than {LANGS} values of lang: these cannot be languages; raise langid.LANGS or map wrong values to null")
    if not counts:
        return [], []
    per_lang = max(1, min(per_lang, SAMPLE // len(counts)))
    # a bound on the hash that lets about twice as many through, and 64 more, so that too few come by no chance worth the name; the first of them are taken
    share = docs.sparkSession.createDataFrame([(lang, math.ceil(min(1.0, (2 * per_lang + 64) / n) * (1 << 40))) for lang, n in counts.items()], "lang string, share long")
    near = known.join(F.broadcast(share), "lang").filter(F.pmod("_h", F.lit(1 << 40)) < F.col("share")).drop("share")  # at most LANGS rows
    order = [F.pmod("_h", F.lit(1 << 40)), "_h"]
    once = near.select("lang", "_h").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_n") <= per_lang)
    chosen = near.dropDuplicates(["lang", "_h"]).join(F.broadcast(once.select("lang", "_h")), ["lang", "_h"])  # SAMPLE or LANGS rows at most

    def extract(batch: pa.RecordBatch):
        raw, offs = string_buffers(batch.column("text"))
        ids, shares = [], []
        for i in range(batch.num_rows):
            _, code = subwords(raw[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
            u, n = np.unique(code, return_counts=True)
            ids.append(u.astype(np.uint16).tobytes())
            shares.append((n / max(1, n.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_h"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["lang", "h", "ids", "shares"])

    rows = map_arrow(chosen.select("lang", "_h", "text"), extract, "lang string, h long, ids binary, shares binary").collect()  # SAMPLE or LANGS rows at most
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    return sorted(counts), [(r["lang"], np.frombuffer(r["ids"], np.uint16).astype(np.int64), np.frombuffer(r["shares"], np.float32)) for r in rows if r["ids"]]


def _parted(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[list, list]:
    """What is fitted, and every fifth row of each language for calibration (all rows, where no language has five)."""
    fit, rest, seen = [], [], {}
    for r in rows:
        n = seen[r[0]] = seen.get(r[0], 0) + 1
        (rest if n % 5 == 0 else fit).append(r)
    return fit, rest or rows


def train(docs: DataFrame, *, mod: int = FOLDS, hold: int = HELD_OUT, per_lang: int = PER_LANG, epochs: int = EPOCHS, rate: float = RATE, precision: float = PRECISION, floor: float = FLOOR, seed: int = 11) -> Model:
    langs, rows = _collect(docs, mod, hold, per_lang)
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    place = {lang: i for i, lang in enumerate(langs)}
    e = (rng.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH
    w, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    fit, rest = _parted(rows)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            lang, ids, shares = fit[i]
            lr = rate * (1 - done / steps)
            done += 1
            h = shares @ e[ids]
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[place[lang]] -= 1
            back = w @ p
            w -= lr * np.outer(h, p)
            bias -= lr * 0.1 * p
            e[ids] -= (lr * len(ids) ** 0.5) * shares[:, None] * back[None, :]
    table = e @ w if len(langs) <= WIDTH else e
    z = np.array([(shares @ e[ids]) @ w + bias for _, ids, shares in rest])
    y = np.array([place[lang] for lang, _, _ in rest])
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model = Model(langs, table.astype(np.float32), bias.astype(np.float64), float(grid[int(np.argmin(loss))]))
    if len(langs) > WIDTH:
        model.table, model.weights = e, w
    p = softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    model.accept = bound(top, right, len(langs), precision, floor)
    return model


def bound(top: np.ndarray, right: np.ndarray, langs: int, precision: float = PRECISION, floor: float = FLOOR) -> float:
    """The probability from which on a text is accepted, given probabilities and rightness of rows left out."""
    order = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(top) + 1) >= precision)
    if not len(good):
        return float(np.nextafter(top.max(), 2))
    floor = max(floor, min(1.0, CHANCE / langs))
    return max(floor, float(top[order][good[-1]])) if good[-1] + 1 < len(top) else floor


def identify(docs: DataFrame, *, model: Model | None = None, mod: int = FOLDS, hold: int = HELD_OUT, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each row of docs."""
    model = model or train(docs, mod=mod, hold=hold, per_lang=per_lang)
    docs = docs.select("doc_id", "text")
    out = map_arrow(docs, _predict(docs, model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), mod) == hold, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def accepted(docs: DataFrame, *, model: Model | None = None) -> DataFrame:
    """The rows of docs whose language is told with enough confidence."""
    predict = _predict(docs, model or train(docs))

    def keep(batch: pa.RecordBatch):
        for told in predict(batch):
            yield batch.filter(told.column("accepted"))

    return map_arrow(docs, keep, docs.schema)


def _predict(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH and WIDTH x LANGS numbers at most

    def run(batch: pa.RecordBatch):
        m = shared.value
        raw, offs = string_buffers(batch.column("text"))
        p = m.probabilities(raw, offs) if m.langs else np.zeros((batch.num_rows, 0))
        best, top = (p.argmax(axis=1), p.max(axis=1)) if m.langs else (np.zeros(batch.num_rows, int), np.zeros(batch.num_rows))
        letter = np.zeros(batch.num_rows, bool)
        for lo, hi in slices(offs):
            at = np.flatnonzero(_PLAIN[raw[offs[lo] : offs[hi]]]) + offs[lo]
            letter[lo:hi] = np.searchsorted(at, offs[lo + 1 : hi + 1]) > np.searchsorted(at, offs[lo:hi])
        for i in np.flatnonzero(~letter & (np.diff(offs) > 0)):
            letter[i] = any(c.isalpha() for c in bytes(raw[offs[i] : offs[i + 1]]).decode("utf-8", "replace"))
        told = letter & bool(m.langs)
        names = [m.langs[k] if t else "und" for k, t in zip(best.tolist(), told.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(told, top, 0.0)), pa.array(told & (top >= m.accept))], names=["doc_id", "lang_pred", "score", "accepted"])

    return run
