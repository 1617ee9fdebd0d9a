"""Tables that are replaced as a whole: folders of their own, and a manifest renamed into place.

A write goes to a new folder; then the next manifest, which names the folders that
make the table, is written aside and renamed to its number.  Readers take the
manifest of the greatest number, so a write that fails at any step leaves the
table as it was, and a reader that began before keeps its files.  One writer at a
time: a second one that commits the same number gets ``Conflict`` where
the file system's rename or the check before it sees the first.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed since this one read the table."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its Path class."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all manifests, ascending."""
    files, kind = _files(spark, path)
    folder = kind(f"{path}/_manifest")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, the last one unless given; ``{"version": 0}`` for a table that was never written."""
    if version is None:
        version = (committed(spark, path) or [0])[-1]
    if not version:
        return {"version": 0}
    files, kind = _files(spark, path)
    stream = files.open(kind(f"{path}/_manifest/{version:08}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) | {"version": version}


def commit(spark: SparkSession, path: str, content: dict, after: int) -> dict:
    """Make ``content`` the manifest that follows version ``after``."""
    files, kind = _files(spark, path)
    folder, target = f"{path}/_manifest", kind(f"{path}/_manifest/{after + 1:08}.json")
    files.mkdirs(kind(folder))
    aside = kind(f"{folder}/.{uuid.uuid4().hex}")
    out = files.create(aside, True)
    try:
        out.write(bytearray(json.dumps(content | {"version": after + 1}).encode()))
    finally:
        out.close()
    if files.exists(target) or not files.rename(aside, target):
        files.delete(aside, False)
        raise Conflict(f"{path}: version {after + 1} is another writer's")
    return content | {"version": after + 1}


def save(table: DataFrame, path: str, vector: str | None = None) -> dict:
    """Replace the table at ``path``, also by what was read from there.

    With ``vector``, the vectors' dimension is recorded at the first write and later ones must have it.
    """
    spark = table.sparkSession
    now = manifest(spark, path)
    folder = f"{path}/{uuid.uuid4().hex}"
    table.write.parquet(folder)
    content = {"folder": folder, "schema": table.schema.json()}
    if vector is not None:
        found = spark.read.schema(table.schema).parquet(folder).agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
        dimension = now.get("dimension") or found.high
        if found.high is not None and {found.low, found.high} != {dimension}:
            raise ValueError(f"vectors of {found.low} to {found.high} numbers, the table has {dimension}")
        content["dimension"] = dimension
    return commit(spark, path, content, now["version"])


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table, or one of its earlier versions."""
    from pyspark.sql.types import StructType

    now = manifest(spark, path, version)
    if not now["version"]:
        raise FileNotFoundError(path)
    return spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(now["folder"])


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the folders of all but the last ``keep`` versions; their manifests go first."""
    files, kind = _files(spark, path)
    old = committed(spark, path)[:-keep] if keep > 0 else []
    folders = [manifest(spark, path, v).get("folder") for v in old]
    for v in old:
        files.delete(kind(f"{path}/_manifest/{v:08}.json"), False)
    for folder in filter(None, folders):
        files.delete(kind(folder), True)
