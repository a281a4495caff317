"""A paged store of points as a data source: spark.read.format("points").

A store is asked page by page through a client, so only clients know what kind of store it is. The source cuts the ids into ranges,
one a task, hands filters on payload columns down to the client, and asks for the wanted columns only. The client that comes with it reads a
Parquet folder or file; others are named as `module:factory`, where the factory takes the options and returns an object with the methods of `ParquetClient`.

Options: path (or what the client wants), client, id (name of the id column, an integer), schema (DDL), page (points a page), partitions, columns
(comma separated; all, if not given).
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGE, PARTITIONS = 1024, 8

#: A condition on a payload column: (column, operation, value).
Condition = tuple[str, str, object]


class ParquetClient:
    """A store in Parquet that the executors read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.id = options["path"].removeprefix("file://").removeprefix("file:"), options["id"]

    def _expression(self, lo: int | None, hi: int | None, conditions: list[Condition]):
        import pyarrow.dataset as ds

        out = ds.field(self.id).is_valid()
        if lo is not None:
            out = out & (ds.field(self.id) >= lo) & (ds.field(self.id) <= hi)
        for column, operation, value in conditions:
            f = ds.field(column)
            out = out & {"=": lambda: f == value, "in": lambda: f.isin(list(value)), ">": lambda: f > value, ">=": lambda: f >= value, "<": lambda: f < value, "<=": lambda: f <= value, "known": f.is_valid}[operation]()
        return out

    def bounds(self) -> tuple[int, int] | None:
        """The least and the largest id; None for an empty store."""
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        found: list[int] = []
        for batch in ds.dataset(self.path).scanner(columns=[self.id]).to_batches():
            ends = pc.min_max(batch.column(0)).as_py()
            found += [x for x in ends.values() if x is not None]
        return (min(found), max(found)) if found else None

    def scroll(self, lo: int, hi: int, conditions: list[Condition], columns: list[str], page: int) -> Iterator[pa.RecordBatch]:
        """Points with ids from lo to hi that meet the conditions, at most `page` at a time."""
        import pyarrow.dataset as ds

        yield from ds.dataset(self.path).scanner(columns=columns, filter=self._expression(lo, hi, conditions), batch_size=page).to_batches()


@dataclass
class Range(InputPartition):
    lo: int
    hi: int

    def __post_init__(self):
        super().__init__((self.lo, self.hi))


def _client(options: dict[str, str]):
    module, _, factory = options.get("client", "tidemark.sources.store:ParquetClient").partition(":")
    return getattr(importlib.import_module(module), factory)(options)


class Points(DataSource):
    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        if "schema" not in self.options:
            raise ValueError("the option schema is missing")
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PointsReader(schema, dict(self.options))


class PointsReader(DataSourceReader):
    OPERATIONS = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.wanted, self.options, self.conditions = schema, options, []

    def pushFilters(self, filters: list[Filter]):
        """Keeps the comparisons of payload columns with values; the others stay with Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1 and isinstance(f, IsNotNull):
                self.conditions.append((column[0], "known", None))
            elif len(column) == 1 and type(f) in self.OPERATIONS and getattr(f, "value", 0) is not None:
                self.conditions.append((column[0], self.OPERATIONS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        ends = _client(self.options).bounds()
        if ends is None:
            return []
        lo, hi = ends
        n = min(int(self.options.get("partitions", PARTITIONS)), hi - lo + 1)
        cuts = [lo + (hi - lo + 1) * i // n for i in range(n + 1)]
        return [Range(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty store
            return
        kind = to_arrow_schema(self.wanted)
        for batch in _client(self.options).scroll(partition.lo, partition.hi, self.conditions, kind.names, int(self.options.get("page", PAGE))):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(kind.field(n).type) for n in kind.names], schema=kind)


def register(spark: SparkSession) -> None:
    """Make the source known to this session, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Points)


def points(spark: SparkSession, path: str, schema: str, id_col: str, **options: object):
    """The store at path as a table."""
    register(spark)
    return spark.read.format("points").options(path=path, id=id_col, schema=schema, **{k: str(v) for k, v in options.items()}).load()
