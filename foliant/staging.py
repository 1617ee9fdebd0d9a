"""Tables between two stages of a job, kept where every executor can read them.

A staged table cuts lineage: a lost executor makes Spark re-read files, not
re-run the stages before them.  The folder is the one the session names in
``spark.checkpoint.dir``.  Without that setting a local session (a unit test) gets
a temporary folder, and any other raises: its executors share no local folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="foliant-")
        named = _own[app]
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a folder of its own below the shared one."""
    return f"{shared_dir(spark)}/foliant-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made(spark: SparkSession) -> list[str]:
    """The folders of all tables that ``staged`` has written in this application."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, tables: list[str], needed: DataFrame) -> None:
    """Delete these staged tables, but for those that ``needed`` reads.

    For programs that have written what the tables were staged for, and read them no more.
    """
    bare = lambda path: path.split(":", 1)[-1].lstrip("/")
    read = {bare(f.rsplit("/", 1)[0]) for f in needed.inputFiles()}
    for table in tables:
        if bare(table) not in read:
            path = spark._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
