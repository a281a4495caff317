"""Entities and the chunks that share them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks of an entity that meet in one task, and entities with more that are broadcast.
BLOCK, HOT = 1000, 100_000


def entity_chunks(mentions: DataFrame, keys: Sequence[str], chunk: str) -> DataFrame:
    """(keys, chunks): the distinct chunks of each entity, sorted."""
    return mentions.groupBy(*keys).agg(F.sort_array(F.collect_set(chunk)).alias("chunks"))


def cooccurrence(mentions: DataFrame, entity: str, chunk: str, order: str, group: Sequence[str] = (), *, block: int = BLOCK) -> DataFrame:
    """(group, src, dst, label): ordered pairs of different chunks that share an entity, labelled by the last such entity.

    The chunks of an entity that more than `block` share are dealt to blocks; every unordered pair of blocks is a join key of its own, so no task holds an
    entity. Each unordered pair of chunks is made once, partial maxima are taken before the shuffle, and the result is mirrored.
    """
    keys = [*group, entity]
    m = mentions.groupBy(*keys, chunk).agg(F.max(order).alias("_o"))
    hot = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    few = hot.limit(HOT + 1).count()
    if few:
        m = m.join(F.broadcast(hot) if few <= HOT else hot, keys, "left")
    else:
        m = m.withColumn("_blocks", F.lit(1))
    last = F.coalesce("_blocks", F.lit(1)) - 1
    m = m.withColumn("_b", F.pmod(F.xxhash64(chunk), last + 1).cast("int"))
    src = m.select(*keys, F.col(chunk).alias("src"), "_o", F.col("_b").alias("_i"), F.explode(F.sequence("_b", last)).alias("_j"))
    dst = m.select(*keys, F.col(chunk).alias("dst"), F.col("_b").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"))
    pairs = src.join(dst, [*keys, "_i", "_j"]).filter("_i < _j or src < dst")
    ends = [F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_z")]
    once = pairs.groupBy(*group, *ends).agg(F.max_by(entity, F.struct("_o", entity)).alias("label"))
    both = F.array(F.struct(F.col("_a").alias("src"), F.col("_z").alias("dst")), F.struct(F.col("_z").alias("src"), F.col("_a").alias("dst")))
    return once.select(*group, F.inline(both), "label").select(*group, "src", "dst", "label")


def subtitles_in_chunks(chunks: DataFrame, lines: DataFrame, key: str, width: float) -> DataFrame:
    """(key, chunk, text): subtitle lines with chunk_start <= t < chunk_end, for chunks of one width; an equi-join on the window's number."""
    own = lines.withColumn("chunk", F.floor(F.col("t") / width))
    text = own.groupBy(key, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "text"))), lambda x: x["text"]), " ").alias("text"))
    return chunks.select(key, "chunk").join(text, [key, "chunk"], "left").select(key, "chunk", F.coalesce("text", F.lit("")).alias("text"))
