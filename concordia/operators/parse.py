"""Reader payloads: JSON objects found in text, and their keys mapped to the record's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions.text import clean_value, strip

CONFIDENCES = ("HIGH", "MEDIUM", "LOW")


def json_object(c: Column, kind: str = "map<string,string>") -> Column:
    """The text's widest {...} as a map; trailing commas are forgiven; an empty map if nothing parses."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(F.from_json(body, kind), F.from_json(F.regexp_replace(body, r",\s*([}\]])", "$1"), kind), F.from_json(F.lit("{}"), kind))


def _labelled(entries: DataFrame, variants: DataFrame) -> DataFrame:
    """entries (id, pos, key, ...) with the label of the key, exactly or lower-cased and stripped; of a label the last entry."""
    exact = F.broadcast(variants.select(F.col("variant").alias("key"), F.col("label").alias("exact")))
    loose = F.broadcast(variants.select(F.col("variant").alias("low"), F.col("label").alias("loose")))
    named = entries.withColumn("low", strip(F.lower("key"))).join(exact, "key", "left").join(loose, "low", "left")
    return named.withColumn("label", F.coalesce("exact", "loose")).where("label IS NOT NULL").drop("exact", "loose", "low")


def remap_values(payloads: DataFrame, variants: DataFrame, id_col: str = "record_id", text_col: str = "payload") -> DataFrame:
    """record_id, label, value (cleaned) of every field that the payload names; of a repeated one the last."""
    entries = payloads.select(F.col(id_col).alias("record_id"), F.posexplode(F.map_entries(json_object(F.col(text_col)))).alias("pos", "e"))
    named = _labelled(entries.select("record_id", "pos", F.col("e.key").alias("key"), F.col("e.value").alias("v")), variants)
    return named.groupBy("record_id", "label").agg(F.max_by("v", "pos").alias("v")).select("record_id", "label", clean_value(F.col("v")).alias("value"))


def remap_cells(payloads: DataFrame, variants: DataFrame, id_col: str = "record_id", text_col: str = "payload") -> DataFrame:
    """record_id, label, value, confidence, evidence of every field that the payload names, cells being objects or scalars."""
    kind = "struct<value:string,confidence:string,evidence:string>"
    entries = payloads.select(F.col(id_col).alias("record_id"), F.posexplode(F.map_entries(json_object(F.col(text_col)))).alias("pos", "e"))
    named = _labelled(entries.select("record_id", "pos", F.col("e.key").alias("key"), F.col("e.value").alias("raw")), variants)
    last = named.groupBy("record_id", "label").agg(F.max_by("raw", "pos").alias("raw"))
    cell = F.when(F.startswith(F.ltrim("raw"), F.lit("{")), F.from_json("raw", kind))
    value = clean_value(F.when(cell.isNotNull(), cell["value"]).otherwise(F.col("raw")))
    said = F.substring(strip(F.upper(F.coalesce(cell["confidence"], F.lit("")))), 1, 6)
    out = last.select("record_id", "label", value.alias("value"), said.alias("said"), F.substring(strip(F.coalesce(cell["evidence"], F.lit(""))), 1, 140).alias("evidence"))
    confidence = F.when((F.col("value") != "") & ~F.col("said").isin(*CONFIDENCES), F.lit("MEDIUM")).otherwise(F.col("said"))
    return out.select("record_id", "label", "value", confidence.alias("confidence"), "evidence")
