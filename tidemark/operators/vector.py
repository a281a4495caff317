"""Retrieval over stored vectors: filtered exact top-k, thresholds, centroids, re-ranking, greedy clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import cosine, norm, unit_vector

DEFAULT_K = 5


def payload_filter(points: DataFrame, kind: str | None = None, video: str | None = None) -> DataFrame:
    """Points of a type and of a video; plain filters, so partitions and row groups are pruned."""
    if kind is not None:
        points = points.filter(F.col("type") == kind)
    return points if video is None else points.filter(F.col("video_id") == video)


def top_k(points: DataFrame, query: Sequence[float], k: int, *, vector: str = "vector", id_col: str = "raw_id", within: tuple[float, float] | None = None) -> DataFrame:
    """The k points nearest by cosine, with score and distance; ties by id.

    `within` (seconds) is a filter on closed intervals of start_time_ms and end_time_ms *after* the cut, so fewer
    than k rows may come back.
    """
    best = points.withColumn("score", cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))).orderBy(F.desc("score"), id_col).limit(k)
    best = best.withColumn("distance", 1 - F.col("score"))
    if within is not None:
        lo, hi = within
        best = best.filter((F.col("start_time_ms") / 1000 <= hi) & (F.col("end_time_ms") / 1000 >= lo))
    return best


def multi_modal(points: DataFrame, queries: dict[str, Sequence[float]], k: int, **options) -> DataFrame:
    """top_k of each modality (the point's type) with its own query; k from 1 to 20."""
    if not 1 <= k <= 20:
        raise ValueError("k must be from 1 to 20")
    out = None
    for kind, query in queries.items():
        own = top_k(payload_filter(points, kind), query, k, **options).withColumn("modality", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


def batch_top_k(
    queries: DataFrame, points: DataFrame, k: int, *, query_id: str = "query_id", query_vector: str = "query", id_col: str = "raw_id", vector: str = "vector", block: int = 256, point_block: int = 8192
) -> DataFrame:
    """(query_id, rank, id, score): exact cosine top-k of a table of queries.

    Queries and points are dealt to blocks of about `block` and `point_block` rows; each pair of blocks meets as a matrix
    product in one task and leaves k rows a query, which are then merged.
    """
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    nq, np_ = max(1, -(-queries.count() // block)), max(1, -(-points.count() // point_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    q = queries.select(F.col(query_id).alias("_id"), F.col(query_vector).cast("array<double>").alias("_v"), F.pmod(F.xxhash64(query_id), F.lit(nq)).alias("_b"), each(np_).alias("_p"))
    p = points.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), each(nq).alias("_b"), F.pmod(F.xxhash64(id_col), F.lit(np_)).alias("_p"))

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("_v").combine_chunks().flatten().to_numpy()
        return unit(flat.reshape(table.num_rows, -1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, places, best = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            for i, line in enumerate(matrix(right) @ matrix(left).T):
                at = np.flatnonzero(line >= (np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf))
                rows.append(np.full(len(at), i))
                places.append(at)
                best.append(line[at])
        rows, places, best = (np.concatenate(x) for x in (rows, places, best))
        return pa.table([right.column("_id").take(pa.array(rows)), left.column("_id").take(pa.array(places)), pa.array(best, pa.float64())], names=[query_id, id_col, "score"])

    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} {points.schema[id_col].dataType.simpleString()}, score double"
    near = p.groupBy("_b", "_p").cogroup(q.groupBy("_b", "_p")).applyInArrow(run, schema)
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_id, "rank", id_col, "score")


def centroid(vectors: DataFrame, vector: str) -> DataFrame:
    """One row: the mean vector, normalised (1e-9 is added to its length)."""
    mean = vectors.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    return mean.select(F.transform("v", lambda x: x / (norm(F.col("v")) + 1e-9)).alias("centroid"))


def above(points: DataFrame, query: DataFrame, *, vector: str = "vector", threshold: float = 0.3) -> DataFrame:
    """points with their similarity to the one query vector, where at least the threshold; the order of points stays with the caller."""
    one = query.select(F.col(query.columns[0]).alias("_q")).limit(1)
    return points.join(F.broadcast(one)).withColumn("similarity", cosine(F.col(vector), F.col("_q"))).drop("_q").filter(F.col("similarity") >= threshold)


def rerank(similarities: DataFrame, candidate: str, k: int) -> DataFrame:
    """Candidates by their mean similarity over several queries, best first."""
    return similarities.groupBy(candidate).agg(F.avg("similarity").alias("similarity")).orderBy(F.desc("similarity"), candidate).limit(k)


def mean_similarity(points: DataFrame, queries: DataFrame, k: int, *, id_col: str = "raw_id", vector: str = "vector", query_vector: str = "query") -> DataFrame:
    """The k points of the largest mean cosine over a table of queries, best first.

    The mean of cosines is the product with the mean of the unit queries, so points meet one row, however many queries there are.
    """
    units = queries.select(F.posexplode(unit_vector(F.col(query_vector).cast("array<double>"))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    mean = units.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("_m"))  # one row
    unit = unit_vector(F.col(vector).cast("array<double>"))
    dot = F.aggregate(F.zip_with(unit, F.col("_m"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return points.join(F.broadcast(mean)).withColumn("similarity", dot).drop("_m").orderBy(F.desc("similarity"), id_col).limit(k)


def verified(candidates: DataFrame, first: int = 5) -> DataFrame:
    """Of the first candidates (pos from 0) those by falling probability."""
    return candidates.filter(F.col("pos") < first).orderBy(F.desc("probability"), "pos")


def position_rule(question: Column, chunks: Column) -> Column:
    """Chunk numbers by the question's words: the first three for 'beginning', the last three for 'end', else none."""
    q = F.lower(question)
    first = F.slice(F.sequence(F.lit(0), chunks - 1), 1, 3)
    last = F.sequence(F.greatest(chunks - 3, F.lit(0)), chunks - 1)
    return F.when(chunks < 1, F.array().cast("array<int>")).when(F.contains(q, F.lit("beginning")), first).when(F.contains(q, F.lit("end")), last).otherwise(F.array().cast("array<int>"))


def greedy_clusters(items: DataFrame, key: str, order: str, *, item: str = "item", vector: str = "embedding", threshold: float = 0.7) -> DataFrame:
    """(key, order, item, cluster): each item in order joins the most similar cluster's first member above the threshold, else opens one.

    The result depends on the order, hence one pass over the sorted items of each key (a video); the clusters' first members are all that is held. Clusters are named by the
    item's text up to the first comma.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = items.select(key, order, item, vector)
    schema = to_arrow_schema(kept.select(key, order, item).withColumn("cluster", F.lit("")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads, names = None, np.zeros((0, 0)), []
        for batch in batches:
            own = []
            for k, text, v in zip(*(batch.column(c).to_pylist() for c in (key, item, vector)), strict=True):
                v = np.array(v, float)
                v = v / max(np.linalg.norm(v), 1e-300)
                if last != (k,):
                    last, heads, names = (k,), np.zeros((8, len(v))), []
                near = heads[: len(names)] @ v
                best = int(near.argmax()) if len(names) else -1
                if best < 0 or float(near[best]) <= threshold:
                    if len(names) == len(heads):
                        heads = np.concatenate([heads, np.zeros_like(heads)])
                    heads[len(names)] = v
                    names.append(str(text).split(",")[0].strip().lower())
                    best = len(names) - 1
                own.append(names[best])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, order, item)), pa.array(own, pa.string())], schema=schema)

    kind = lambda c: items.schema[c].dataType.simpleString()
    return kept.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{key} {kind(key)}, {order} {kind(order)}, {item} {kind(item)}, cluster string")
