"""Files written and read back, and relations with their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from skribo.plans.base import query
from skribo.sources import files

_EVENT = "event_id long, user_id long, event_type string, value double"


def _events(t):
    return t("events").select("event_id", "user_id", "event_type", "value")


@query("io_json_array", "SELECT item_id, text FROM benchmark")
def json_array(t):
    """Items in files of twenty, an array a file."""
    items, path = t("benchmark"), files.scratch(t("benchmark").sparkSession)
    rows = items.groupBy(F.floor(F.col("item_id") / 20).alias("file")).agg(F.to_json(F.collect_list(F.struct("item_id", "text"))).alias("value"))
    rows.write.partitionBy("file").text(path)
    return files.read_json_array(items.sparkSession, path, "item_id long, text string").select("item_id", "text")


@query("io_jsonl", "SELECT event_id, user_id, event_type, value FROM events")
def jsonl(t):
    rows, path = _events(t), files.scratch(t("events").sparkSession)
    files.write_jsonl(rows, path)
    return files.read_jsonl(rows.sparkSession, path, _EVENT)


@query("io_jsonl_lenient", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 7 <> 0")
def jsonl_lenient(t):
    """Every seventh line is damaged."""
    rows, path = _events(t), files.scratch(t("events").sparkSession)
    line = F.to_json(F.struct(*rows.columns))
    rows.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    return files.read_jsonl_lenient(rows.sparkSession, path, _EVENT)


@query("io_jsonl_atomic", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'view'")
def jsonl_atomic(t):
    """The second writing replaces the first."""
    rows, path = _events(t), files.scratch(t("events").sparkSession)
    files.write_jsonl(rows, path)
    files.write_jsonl(rows.where("event_type = 'view'"), path)
    return files.read_jsonl(rows.sparkSession, path, _EVENT)


@query("io_append_log", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def append_log(t):
    rows, path = _events(t), files.scratch(t("events").sparkSession)
    for kind in ("view", "click"):
        files.append_log(rows.where(F.col("event_type") == kind), path)
    return files.read_jsonl(rows.sparkSession, path, _EVENT).groupBy("event_type").agg(F.count("*").alias("n"))


@query("io_jsonl_line_no", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS line FROM documents")
def line_numbers(t):
    """Records in files of a hundred, each with the number of its line."""
    docs, path = t("documents"), files.scratch(t("documents").sparkSession)
    record = docs.select(F.floor(F.col("doc_id") / 100).alias("file"), "doc_id", F.to_json(F.struct("doc_id", "lang")).alias("value"))
    record.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(path)
    return files.with_line_numbers(docs.sparkSession, path).select(F.get_json_object("text", "$.doc_id").cast("long").alias("doc_id"), "line")


_BOX = "struct<_xMin:double,_yMin:double,_xMax:double,_yMax:double"
_LAYOUT = f"page struct<_width:double,_height:double,line:array<{_BOX},word:array<{_BOX},_VALUE:string>>>>>"


def box_lines(pages, key: str, xml: str):
    """key, place, x_min, y_min, x_max, y_max, text: the lines of a page's layout in order; damaged layouts have none."""
    lines = F.from_xml(F.col(xml), _LAYOUT)["page"]["line"]
    rows = pages.select(key, F.posexplode(lines).alias("place", "l"))
    return rows.select(key, F.col("place").cast("long").alias("place"), *[F.col(f"l._{a}{b}").alias(f"{a}_{b.lower()}") for b in ("Min", "Max") for a in "xy"], F.array_join(F.transform("l.word", lambda w: F.trim(w["_VALUE"])), " ").alias("text"))


@query("io_bbox", "SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_linestatus) - 1 AS place, l_linenumber::DOUBLE AS x_min, l_quantity AS y_min, l_linenumber + 10.0::DOUBLE AS x_max, l_quantity + 2.0::DOUBLE AS y_max, l_returnflag || ' ' || l_linestatus AS text FROM lineitem")
def boxes(t):
    """A page's layout made of each order's rows, and read."""
    box = F.format_string('xMin="%s" yMin="%s" xMax="%s" yMax="%s"', F.col("l_linenumber").cast("double"), F.col("l_quantity"), F.col("l_linenumber") + F.lit(10.0), F.col("l_quantity") + F.lit(2.0))
    line = F.concat(F.lit("<line "), box, F.lit("><word "), box, F.lit(">"), "l_returnflag", F.lit("</word><word "), box, F.lit(">"), "l_linestatus", F.lit("</word></line>"))
    pages = t("lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", line.alias("x")))), lambda s: s["x"]), "").alias("x"))
    return box_lines(pages.select("page", F.concat(F.lit('<doc><page width="600" height="800">'), "x", F.lit("</page></doc>")).alias("xml")), "page", "xml")
