"""Scans: JSON lines, folders of JSON, CSV, id lists, file listings, configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

METADATA = (
    "video_id string, title string, channel string, duration string, view_count string, publish_date string, description string, tags string, "
    "download_date string, file_path string, status string, audio_path string, caption_path string, content_categories string"
)


def _missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = True) -> DataFrame:
    """JSON lines, blank ones skipped; a missing file is an empty table unless missing_ok is unset."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if missing_ok and _missing(error):
            return spark.createDataFrame([], schema)
        raise


def json_folder(spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.json", first: int | None = None) -> DataFrame:
    """One document a file, with `file`; with `first`, those of the first files by name."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(path).withColumn("file", F.input_file_name())
    if first is None:
        return df
    names = df.select("file").distinct().orderBy("file").limit(first)
    return df.join(F.broadcast(names), "file").select(*df.columns)  # at most `first` names


def json_or_nothing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of files that parse; broken ones are left out."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.withColumn("_bad", F.col("_corrupt_record").isNotNull()).filter(~F.col("_bad")).drop("_bad", "_corrupt_record")


def prefer_aligned(aligned: DataFrame, raw: DataFrame, key: str = "video_id") -> DataFrame:
    """Aligned rows, and raw ones of keys that have no aligned row."""
    return aligned.unionByName(raw.join(aligned.select(key), key, "left_anti"), allowMissingColumns=True)


def metadata_csv(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    """All columns as text; quoted fields may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def numbers(df: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    """The columns as double; default where they do not read as one."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(default)) for c in cols})


def id_list(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """(id): the first word of each line that is neither blank nor a # comment; with `length`, of that length only."""
    line = F.trim("value")
    out = spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(F.split(line, r"\s+")[0].alias("id"))
    return out if length is None else out.filter(F.length("id") == length)


def cached_dataset(spark: SparkSession, cache: str, schema: str, limit: int = 0, order: Sequence[str] = ()) -> DataFrame:
    """A hub dataset from its local JSON lines; the first `limit` rows in the given order where limit is above 0."""
    df = json_lines(spark, cache, schema, missing_ok=False)
    return df.orderBy(*order).limit(limit) if limit > 0 else df


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of all files below path; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "modificationTime")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_map(listing: DataFrame) -> DataFrame:
    """(id, path): files by their name without extension; of several the last path."""
    return listing.groupBy(F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "").alias("id")).agg(F.max("path").alias("path"))


def resolve_paths(ids: DataFrame, listing: DataFrame, extensions: Sequence[str] = (".mp4", ".mkv", ".webm", ".avi", ".mov")) -> DataFrame:
    """ids (id, hint) with path: the hint where such a file exists, else the first by the order of extensions, else null."""
    name = file_name(F.col("path"))
    rank = F.array_position(F.array(*(F.lit(e) for e in extensions)), F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)))
    found = listing.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), "path", rank.alias("r")).filter("r > 0").groupBy("id").agg(F.min_by("path", F.struct("r", "path")).alias("_found"))
    there = listing.select(F.col("path").alias("hint")).distinct().withColumn("_there", F.lit(True))
    out = ids.join(found, "id", "left").join(there, "hint", "left")
    return out.select("id", F.coalesce(F.when(F.col("_there"), F.col("hint")), F.col("_found")).alias("path"))


def file_stats(listing: DataFrame) -> DataFrame:
    """(extension, files, bytes)."""
    ext = F.lower(F.regexp_extract(file_name(F.col("path")), r"\.([^.]*)$", 1))
    return listing.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def ids_in_lines(spark: SparkSession, path: str, field: str = "sample_id") -> DataFrame:
    """(field): the first value of the field in each line, without parsing the line; lines without it are left out."""
    return spark.read.text(path).select(F.regexp_extract("value", rf'"{field}"\s*:\s*"([^"]+)"', 1).alias(field)).filter(F.col(field) != "")


def store_ids(points: DataFrame) -> DataFrame:
    """Distinct video ids of a store; only that column is read."""
    return points.select("video_id").distinct()


def frame_list(listing: DataFrame) -> DataFrame:
    """(folder, frames): each folder's files in order of their names."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return listing.groupBy(folder.alias("folder")).agg(F.sort_array(F.collect_list("path")).alias("frames"))


def merged(base: Mapping, over: Mapping) -> dict:
    """Configuration: nested values of `over` win."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def config(spark: SparkSession, path: str, over: Mapping | None = None) -> dict:
    """A configuration from a JSON or, by its ending, YAML file in any store that Spark reads; `over` wins. A file that holds no mapping raises an error."""
    text = text_asset(spark, path)
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, Mapping):
        raise ValueError(f"{path} holds no mapping")
    return merged(found, over or {})


def select_tasks(registry: Mapping[str, Mapping], wanted: str) -> dict[str, dict]:
    """Named tasks, comma separated, or all of them; each with the registry's defaults."""
    names = [n for n in registry if n != "defaults"] if wanted == "all" else [n.strip() for n in wanted.split(",") if n.strip()]
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise KeyError(f"unknown tasks: {', '.join(unknown)}")
    return {n: merged(registry.get("defaults", {}), registry[n]) for n in names}


def text_asset(spark: SparkSession, path: str) -> str:
    """A prompt template or a JSON schema, whole."""
    return spark.read.text(path, wholetext=True).head()[0]
