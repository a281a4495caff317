"""Table functions: rows out of a value, or out of a table's partitions in order.

After `register` they stand in SQL: `LATERAL sentences(text, 100)`, `LATERAL clips(duration, 10.0)` and
`silences(TABLE (SELECT video, start, end FROM segments) PARTITION BY video ORDER BY (start, end))`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from tidemark.functions.text import sentences_of


@udtf(returnType="pos int, sentence string")
class Sentences:
    """The sentences of a text, long ones broken, with their position from 0."""

    def eval(self, text: str, longest: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(sentences_of(text, longest))


@udtf(returnType="clip int, clip_start double, clip_end double")
class Clips:
    """Consecutive windows of a video; one more where over a second is left; those under `LEAST` seconds are left out."""

    LEAST = 0.5

    def eval(self, duration: float, width: float) -> Iterator[tuple[int, float, float]]:
        if duration is None:
            return
        whole = int(duration // width) + (duration % width > 1)
        for i in range(whole):
            end = min(i * width + width, duration)
            if end - i * width >= self.LEAST:
                yield i, i * width, end


@udtf(returnType="video bigint, start double, end double")
class Silences:
    """Over a table (video, start, end) partitioned by video and ordered: the spans of at least `LEAST` seconds that no segment covers, between its segments. One number is kept."""

    LEAST = 5.0

    def __init__(self):
        self.until = None

    def eval(self, row: Row) -> Iterator[tuple[int, float, float]]:
        if self.until is not None and row["start"] - self.until >= self.LEAST:
            yield row["video"], self.until, row["start"]
        self.until = row["end"] if self.until is None else max(self.until, row["end"])


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL in this session."""
    for name, fn in (("sentences", Sentences), ("clips", Clips), ("silences", Silences)):
        spark.udtf.register(name, fn)
