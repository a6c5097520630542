"""What the corpus operators share: word splitting, reading tables, checkpoints."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: ASCII characters that are neither digits nor lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Null ids sort after all others.
NO_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; lower() would change other letters too, but is faster where there are none."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def tokens(text: Column) -> Column:
    """What white space separates, as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, in what spark.checkpoint.dir names; a folder of our own only where it is unset in local mode, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skribo-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder as Parquet, which takes less room than a checkpoint, and the path, for removed()."""
    path = f"{shared_folder(df.sparkSession)}/stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, True)


def released(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nothing refers to any more.

    Spark removes them when the driver's garbage is collected, which may be long after; all of a query's shuffles would lie on disk together.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)  # Python tells the driver's JVM in a thread of its own what it no longer refers to
        spark.sparkContext._jvm.System.gc()


#: A key with more than one of so many rows goes by broadcast; there are no more such keys than this.
SHARES = 1000


def join_uneven(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """left joined with right by key, the rows that right has no key for left out.

    right has a row a key, and in column rows how many rows of left have it; total is the number of left's rows. Keys with more
    than a share of total are broadcast, so no task gets all rows of one.
    """
    hot = F.col(rows) * SHARES > total
    many = F.broadcast(right.where(hot).drop(rows))
    few = left.join(many.select(key), key, "left_anti").join(right.where(~hot).drop(rows), key)
    return left.join(many, key).unionByName(few)


#: Repeated ids up to which they are broadcast.
BROADCAST_IDS = 100_000


def repeated_ids(rows: DataFrame) -> DataFrame | None:
    """again: the ids of rows that more than one row has; None if they are more than BROADCAST_IDS."""
    again = rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    return None if again.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS else again
