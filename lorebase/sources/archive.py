"""Archived payloads: JSON files of an act and its items, written and read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<uuid:string,handle:string,name:string,metadata:map<string,array<struct<value:string>>>>"
PAYLOAD = f"fetched_at string, source_url string, act_id string, act_item {ITEM}, items array<{ITEM}>"


def read_archive(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Payloads under `path`, one for each line, or one for each file with `multi_line`; with the file's name. Malformed ones give nulls."""
    return spark.read.schema(PAYLOAD).option("multiLine", multi_line).json(path).withColumn("file", F.input_file_name())


def first_value(metadata: Column, key: str) -> Column:
    """The first value of a key, '' if it is missing or null."""
    return F.coalesce(F.get(F.try_element_at(metadata, F.lit(key)), 0)["value"], F.lit(""))


def section_items(payloads: DataFrame) -> DataFrame:
    """(act_id, pos, uuid, section_no, order_number, title) of items that are numbered sections of their act, in no order."""
    i = payloads.select("act_id", F.posexplode("items").alias("pos", "item"))
    get = lambda key: first_value(F.col("item.metadata"), key)
    number = F.when(get("order.number").rlike("^[0-9]+$"), get("order.number").cast("int"))
    own = (get("act.id") == F.col("act_id")) & (get("collection") == "SECTION") & (get("section.number") != "")
    return i.where(own).select("act_id", "pos", F.col("item.uuid").alias("uuid"), F.regexp_replace(get("section.number"), r"\.+$", "").alias("section_no"), number.alias("order_number"), get("title").alias("title"))
