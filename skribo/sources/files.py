"""Reading and writing JSON lines, logs and shards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bad lines are dropped."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL").drop("_bad")


def tail(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows by a column: a report of fixed length."""
    return rows.orderBy(F.desc(order)).limit(n)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Replaces the files at the path when all are written: they are written beside it, and renamed."""
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    rows.write.json(new)
    replace_folder(rows.sparkSession, new, path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_shards(rows: DataFrame, path: str, *keys: str) -> None:
    rows.write.mode("overwrite").partitionBy(*keys).json(path)


def write_relations(relations: dict[str, DataFrame], path: str) -> None:
    """One table a relation."""
    for name, rows in relations.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text of every line. A file's parts are numbered apart and shifted by the lines of the parts before."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select("file", "block", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return rows.join(shifts, ["file", "block"]).select("file", (F.col("at") - F.col("least") + F.col("shift") + 1).alias("line"), F.col("value").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="skribo-")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read back: a cut in the lineage that lost executors don't undo."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """A written folder takes the place of another one: readers see the old files or the new ones, and the old ones go last.

    If the second renaming fails, the old files are back.
    """
    fs, source = _files(spark, new)
    _, target = _files(spark, path)
    _, old = _files(spark, f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(target)
    fs.mkdirs(target.getParent())
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(source, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{new} can't be renamed to {path}")
    if had:
        fs.delete(old, True)
