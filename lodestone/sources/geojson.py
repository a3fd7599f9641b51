"""GeoJSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def features(points: DataFrame, lng: str = "longitude", lat: str = "latitude") -> DataFrame:
    """One column `feature` of JSON text: a Feature for each point, its properties the columns whose names speak of neither axis."""
    kept = [c for c in points.columns if "lat" not in c and "lon" not in c and c not in (lng, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lng), F.col(lat)).alias("coordinates"))
    props: Column = F.struct(*[F.col(c) for c in kept]) if kept else F.create_map()
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))


def feature_collection(points: DataFrame, lng: str = "longitude", lat: str = "latitude") -> DataFrame:
    """One row, one document: for as many points as a reader of one document can hold."""
    joined = features(points, lng, lat).agg(F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("f"))
    return joined.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("f"), F.lit("]}")).alias("geojson"))


def write_features(points: DataFrame, path: str, lng: str = "longitude", lat: str = "latitude") -> None:
    """Part files of one feature a line, for any number of points."""
    features(points, lng, lat).write.mode("overwrite").text(path)
