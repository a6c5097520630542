"""Programs that read files, on odd texts and in passing trouble."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skribo.operators import external as E
from skribo.plans import registry

ODD = [None, "", " ", "\n", "\t \r\n", "\xa0", "\u3000", "\u3000\n", "\x85", "\x1c", "SCUM", "mc", "moron a idiot", "scum\xa0trash", *[None, "", "\u3000"] * 3, "a " * 120 + "moron"]


def test_odd_texts_read_again(spark, tmp_path):
    """Blank and missing texts, on both sides of the rule by id, against the SQL."""
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["io_ocr"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, found)) == sorted(db.sql(registry.ORACLE_SQL["io_ocr"]).fetchall())


@pytest.mark.parametrize("trouble, times, status", [("kill -9 $$", 1, "ok"), ("exec sleep 9", 1, "ok"), ("kill -9 $$", 9, "failed: -9"), ("exit 3", 1, "failed: 3")])
def test_programs_are_started_again(spark, tmp_path, trouble, times, status):
    """Those killed or slow once; not those that end by themselves."""
    script = f"cd {tmp_path}; echo >> n; [ $(wc -l < n) -gt {times} ] || {{ {trouble}; }}; cat"
    rows = spark.createDataFrame([(1, "text")], "id long, t string").select("id", F.encode("t", "UTF-8").alias("t")).coalesce(1)
    (row,) = E.read_by_program(rows, ["id"], "t", ["sh", "-c", script], timeout=2).collect()
    assert (row.status, row.text) == (status, "text" if status == "ok" else None)
