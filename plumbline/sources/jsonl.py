"""JSON-lines sources and sinks with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.jsonwalk import json_redacted


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Records of JSON-lines files; blank lines are skipped. A broken line raises, or is dropped if not ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, number, line, ok) of the lines that aren't blank, with their number in the file from 1 on and whether they parse.

    Lines are numbered from their place in their partition and the lines of the file in the partitions before; no file is
    brought into one task.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"))
    placed = lines.withColumn("part", F.shiftright("id", 33))
    parts = placed.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    ahead = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = parts.select("file", "part", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    numbered = placed.join(offsets, ["file", "part"]).where(F.trim("line") != "")
    return numbered.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("number"), "line", F.try_parse_json("line").isNotNull().alias("ok"))


def broken_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(place, line): ``file:number`` of every line that is no JSON."""
    return numbered_lines(spark, path).where("not ok").select(F.concat_ws(":", "file", "number").alias("place"), "line")


def read_sorted(spark: SparkSession, folder: str, pattern: str, schema: str | T.StructType, files: int | None = None) -> DataFrame:
    """Documents of the files of a folder that match a glob, with their file name; the first ``files`` by name, or all."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(folder).withColumn("file", F.col("_metadata.file_name"))
    if files is None:
        return rows
    names = spark.read.option("pathGlobFilter", pattern).format("binaryFile").load(folder).select(F.col("_metadata.file_name").alias("file")).orderBy("file").limit(files)
    return rows.join(names, "file", "left_semi")


def read_sources(spark: SparkSession, paths: dict[str, str], schema: str | T.StructType, limit: int | None = None) -> DataFrame:
    """The union of several sources in their order, with source_name; its first ``limit`` records by source, file and place, or
    all. A source without records raises if it alone is asked for."""
    parts = [read_jsonl(spark, path, schema).select("*", F.lit(name).alias("source_name"), F.struct(F.lit(i).alias("source"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")).alias("_order")) for i, (name, path) in enumerate(paths.items())]
    whole = reduce(DataFrame.unionByName, parts)
    return (whole if limit is None else whole.orderBy("_order").limit(limit)).drop("_order")


def first_record(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The first record of a source; raises where it has none."""
    found = read_sources(spark, {"": path}, schema, limit=1).drop("source_name")
    if found.isEmpty():
        raise ValueError(f"no record in {path}")
    return found


def earlier_results(spark: SparkSession, path: str | list[str], schema: str, experiment: str, terminal: tuple[str, ...]) -> DataFrame:
    """Results of an earlier run that have ended: of the experiment, with a terminal status; corrupt lines count as none.

    ``schema`` holds experiment_id, run_id and status.
    """
    rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where(F.col("_broken").isNull() & (F.col("experiment_id") == experiment) & F.col("status").isin(*terminal)).drop("_broken")


def read_catalogue(spark: SparkSession, catalogue: dict[str, dict], schema: str | T.StructType) -> DataFrame:
    """The union of the catalogue's sources with a column source_name; a source whose rows differ from the catalogue's
    number raises."""
    parts = {name: read_jsonl(spark, entry["path"], schema).withColumn("source_name", F.lit(name)) for name, entry in sorted(catalogue.items())}
    whole = reduce(DataFrame.unionByName, parts.values())
    counted = {r["source_name"]: r["count"] for r in whole.groupBy("source_name").count().collect()}
    wrong = [name for name, entry in catalogue.items() if entry.get("rows") is not None and counted.get(name, 0) != entry["rows"]]
    if wrong:
        raise ValueError(f"row counts differ from the catalogue: {', '.join(sorted(wrong))}")
    return whole


def write_jsonl(frame: DataFrame, path: str, fresh: bool = False) -> None:
    """Writes JSON lines, nulls kept; committed as a whole. ``fresh``: the path must not exist yet."""
    frame.write.mode("errorifexists" if fresh else "overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(frame: DataFrame, path: str) -> None:
    """Adds records to a log of JSON lines; what is there stays."""
    frame.write.mode("append").option("ignoreNullFields", False).json(path)


def write_summary(frame: DataFrame, path: str) -> None:
    """Writes a summary of one row as one JSON document; more or fewer rows raise."""
    checked = frame.withColumn("_rows", F.count("*").over(Window.partitionBy(F.lit(1))))  # one row, or an error
    one = checked.where(F.when(F.col("_rows") == 1, True).otherwise(F.raise_error(F.lit("a summary has one row")).cast("boolean"))).drop("_rows")
    one.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_redacted(frame: DataFrame, path: str, texts: list[str]) -> None:
    """Writes JSON lines with the keys to interfaces in the named columns replaced, at any depth of JSON texts."""
    write_jsonl(frame.withColumns({c: json_redacted(c) for c in texts}), path)


def write_failures(frame: DataFrame, path: str, failed: Column, text: str, letters: int = 400) -> None:
    """Writes the failed rows for diagnosis, redacted, with at most ``letters`` characters of the text each."""
    write_redacted(frame.where(failed).withColumn(text, F.left(text, F.lit(letters))), path, [text])
