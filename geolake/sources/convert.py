"""GeoJSON feature collections to feature lines, and cells to GeoJSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feature_lines(spark: SparkSession, path) -> DataFrame:
    """``value``: the features of whole collections (files or a glob; one file is one row), each with properties."""
    files = spark.read.text(path, wholetext=True)
    files.createOrReplaceTempView("__geolake_collections")
    features = spark.sql("SELECT e.value AS v FROM __geolake_collections, LATERAL variant_explode(variant_get(try_parse_json(value), '$.features', 'variant')) AS e")
    text = F.to_json("v")
    have = F.get_json_object(text, "$.properties")
    with_properties = F.when(F.is_variant_null(F.try_variant_get("v", "$.properties", "variant")), F.regexp_replace(text, '"properties":null', '"properties":{}')).when(have.isNull(), F.concat(F.expr("substring(to_json(v), 1, length(to_json(v)) - 1)"), F.lit(',"properties":{}}'))).otherwise(text)
    return features.select(with_properties.alias("value"))


def convert_collections(spark: SparkSession, path, out: str) -> None:
    """Write the features of collections as lines under ``out``."""
    feature_lines(spark, path).write.text(out)


def stream_features(path: str, chunk: int = 1 << 20) -> Iterator[str]:
    """Features of one local collection of any size, read piece by piece; stops after the first features array."""
    decoder, buffer, started = json.JSONDecoder(), "", False
    with open(path, encoding="utf-8") as f:
        while True:
            more = f.read(chunk)
            buffer += more
            if not started:
                at = buffer.find('"features"')
                begin = buffer.find("[", at) if at >= 0 else -1
                if begin < 0:
                    if not more:
                        return
                    continue
                buffer, started = buffer[begin + 1 :], True
            while True:
                buffer = buffer.lstrip(" \t\r\n,")
                if buffer[:1] == "]":
                    return
                try:
                    feature, end = decoder.raw_decode(buffer)
                except ValueError:
                    break
                buffer = buffer[end:]
                if feature.get("properties") is None:
                    feature["properties"] = {}
                yield json.dumps(feature, ensure_ascii=False, separators=(",", ":"))
            if not more:
                return


def convert_stream(path: str, out: str) -> int:
    """:func:`stream_features` into a file of lines; returns their number."""
    n = 0
    with open(out, "w", encoding="utf-8") as f:
        for line in stream_features(path):
            f.write(line + "\n")
            n += 1
    return n


def cells_geojson(cells: DataFrame) -> DataFrame:
    """``value``: one MultiPolygon of all cells (xmin, ymin, xmax, ymax), each a closed counter-clockwise ring."""
    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin"))
    all_ = F.sort_array(F.collect_list(F.array(ring)))
    return cells.agg(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), all_.alias("coordinates"))).alias("value"))
