"""JSON documents: a file is one document, whose rows are the objects that a JSONPath finds in it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.errors import CatalogError
from vellum.functions import values as V
from vellum.sources import jsonpath


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, sorted."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []


def files_of(spark: SparkSession, path: str) -> list[str]:
    """A file, or the .json files of a folder (not of its subfolders)."""
    if not is_directory(spark, path):
        if not exists(spark, path):
            raise CatalogError(f"There is no file {path}")
        return [path]
    found = [f"{path.rstrip('/')}/{n}" for n in listing(spark, path) if n.lower().endswith(".json")]
    if not found:
        raise CatalogError(f"The folder {path} holds no .json file")
    return found


def rows(spark: SparkSession, files: list[str], path: str) -> DataFrame:
    """row (variant), file and at: the objects that the path finds, in the order of files and of their documents."""
    steps = jsonpath.parse(path)
    text = spark.read.text(files, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    if jsonpath.native(steps):
        return _native(text, steps)
    return _evaluated(text, steps)


def _native(text: DataFrame, steps: list[jsonpath.Step]) -> DataFrame:
    df = text.select(F.parse_json("value").alias("v"), "file", F.array().cast("array<int>").alias("at"))
    taken = ""
    for step in [*steps, None]:
        if step is not None and step.kind != "each":
            taken += f"[{step.value}]" if step.kind == "index" else V.quoted(step.value)
            continue
        if taken:
            df, taken = df.withColumn("v", F.try_variant_get("v", "$" + taken, "variant")), ""
        if step is not None:
            df = _each(df, objects=True)
    if jsonpath.definite(steps):
        #: An array's elements are rows; an object is one.
        one = F.when(V.is_object(F.col("v")), F.array("v"))
        df = df.select(F.posexplode(F.coalesce(F.when(V.is_array(F.col("v")), F.col("v")).cast("array<variant>"), one)).alias("k", "v"), "file", "at").select("v", "file", F.concat("at", F.array("k")).alias("at"))
    return df.where(V.is_object(F.col("v"))).select(F.col("v").alias("row"), "file", "at")


def _each(df: DataFrame, objects: bool) -> DataFrame:
    v = F.col("v")
    elements = F.when(V.is_array(v), v).cast("array<variant>")
    if objects:
        elements = F.coalesce(elements, F.map_values(F.when(V.is_object(v), v).cast("map<string,variant>")))
    return df.select(F.posexplode(elements).alias("k", "v"), "file", "at").select("v", "file", F.concat("at", F.array("k")).alias("at"))


def _evaluated(text: DataFrame, steps: list[jsonpath.Step]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, file, at = [], [], []
            for value, name in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True):
                for k, x in enumerate(jsonpath.evaluate(json.loads(value), steps)):
                    if isinstance(x, dict):
                        found.append(json.dumps(x))
                        file.append(name)
                        at.append([k])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(file, pa.string()), pa.array(at, pa.list_(pa.int32()))], names=["found", "file", "at"])

    return text.mapInArrow(work, "found string, file string, at array<int>").select(F.parse_json("found").alias("row"), "file", "at")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file or folder of JSON lines, which splits over tasks as whole documents can't."""
    df = spark.read.text(path).where(F.trim("value") != "")
    return df.select(F.parse_json("value").alias("row"))
