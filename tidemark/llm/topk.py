"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A component is a term. For each term of a block of queries the posting list of a block of
candidates (places and weights that are not 0) is scattered, times the queries' weights,
into a dense score array; the best k of each block are cut out by partition selection, and
the blocks' winners are merged. Queries and candidates meet in blocks, keyed
by the pair of block numbers, so no side is broadcast and no task sees more than one pair
of blocks at a time. The number of blocks follows from the counted queries and candidates and the longest vector, so that a block has
at most about QUERY_BLOCK or CANDIDATE_BLOCK rows and BLOCK_BYTES; ids are dealt by a hash, which leaves blocks a little above or below.

Vectors that are null, empty or hold null or non-finite components take no part, nor do null
ids. Repeated rows of an id count once (the smallest vector). Where two vectors differ in
length, the terms that one lacks are 0. Weights and scores are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, K, QUERY_EVERY = 256, 5, 50
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 16384
#: Bytes of a block, about.
BLOCK_BYTES = 1 << 25


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, v: array<bigint> of floor(scale * x), one row for each id with a usable vector."""
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    return table.filter(fine & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(v).alias("v"))


def _matrix(ids: np.ndarray, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    lengths = np.diff(offs)
    out = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(offs[:-1], lengths)] = flat
    return out


def _pack(key: str):
    def run(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        ids = table.column("id").to_numpy().astype(np.int64)
        m = _matrix(ids, v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())]))
        return pa.table({key: [table.column(key)[0].as_py()], "n": [len(ids)], "ids": [ids.tobytes()], "m": [m.tobytes()]}, pa.schema([(key, pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("m", pa.binary())]))

    return run


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates), one term after the other."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        rows, places = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        if len(rows) and len(places):
            weights = np.ascontiguousarray(candidates[places, term])
            for q in rows:
                if len(places) == len(candidates):
                    scores[q] += queries[q, term] * weights
                else:
                    scores[q, places] += queries[q, term] * weights
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, ties to the smaller id; whatever ties with the k-th is looked at."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
        scores, ids = scores[at], ids[at]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _best(k: int):
    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for row in batch.to_pylist():
                q, c = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                qm, cm = np.frombuffer(row["q_m"], np.int64).reshape(len(q), -1), np.frombuffer(row["m"], np.int64).reshape(len(c), -1)
                for lo in range(0, len(q), 64):
                    for query, line in zip(q[lo : lo + 64], accumulate(qm[lo : lo + 64], cm), strict=True):
                        other = c != query
                        ids, best = select(line[other], c[other], k) if not other.all() else select(line, c, k)
                        out[0].append(np.full(len(ids), query))
                        out[1].append(ids)
                        out[2].append(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in out], names=["query_id", "vec_id", "score"])

    return run


def top_k(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by query_every its k best other ids."""
    from pyspark.sql import Window

    rows = integer_vectors(table, id_col, vector_col, scale)
    asked = F.pmod("id", F.lit(query_every)) == 0
    n, queries, width = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.count_if(asked), F.max(F.size("v"))).head())
    most = max(1, block_bytes // (8 * max(1, width)))
    nc, nq = (max(1, -(-count // min(block, most))) for count, block in ((n, candidate_block), (queries, query_block)))
    h = F.xxhash64("id")
    packed = "{} long, n long, ids binary, m binary"
    c = rows.withColumn("cb", F.pmod(h, F.lit(nc))).groupBy("cb").applyInArrow(_pack("cb"), packed.format("cb"))
    q = rows.filter(asked).withColumn("qb", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(nq))).groupBy("qb").applyInArrow(_pack("qb"), packed.format("qb"))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")))
    q = q.select("qb", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1)).cast("array<bigint>")).alias("cb"))
    pairs = c.select("qb", "cb", "ids", "m").join(q, ["qb", "cb"]).select("ids", "m", "q_ids", "q_m")
    best = pairs.mapInArrow(_best(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
