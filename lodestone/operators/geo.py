"""Nearest neighbours on the map by shrinking tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.geo import haversine, quadkey


def quadkey_knn(points: DataFrame, k: int, min_zoom: int = 20, start_zoom: int = 22, ident: str = "id", lng: str = "lng", lat: str = "lat", axis_order: str = "geo") -> DataFrame:
    """id, neighbor_id, distance (radians), rank, zoom, done: up to k nearest points of the same tile.

    A point is searched in the finest tile that holds k other points, by cutting
    its key digit by digit; at min_zoom it takes what there is (done is then
    false).  Points of coarser searches see all points of their tile.  Each
    level counts tiles first, and only points that end there are joined, so a
    point meets about the points of one tile, whatever the number of levels.
    Neighbours across a tile's border are missed, as the method has it.
    """
    rows = points.select(F.col(ident).alias("id"), F.col(lng).alias("lng"), F.col(lat).alias("lat")).filter("id is not null and lng is not null and lat is not null")
    rows = rows.withColumn("key", quadkey(F.col("lng"), F.col("lat"), start_zoom))
    found = None
    open_ = rows
    for zoom in range(start_zoom, min_zoom - 1, -1):
        tile = F.left("key", F.lit(zoom))
        sizes = rows.groupBy(tile.alias("tile")).agg(F.count(F.lit(1)).alias("n"))
        level = open_.withColumn("tile", tile).join(sizes, "tile")
        enough = F.col("n") > k
        here = level if zoom == min_zoom else level.filter(enough)
        open_ = level.filter(~enough).drop("tile", "n")
        others = rows.select(F.col("id").alias("neighbor_id"), F.col("lng").alias("lng2"), F.col("lat").alias("lat2"), tile.alias("tile"))
        pairs = here.join(others, "tile").filter("id <> neighbor_id")
        pairs = pairs.select("id", "neighbor_id", haversine(F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2"), axis_order).alias("distance"), F.lit(zoom).alias("zoom"), enough.alias("done"))
        found = pairs if found is None else found.union(pairs)
    best = Window.partitionBy("id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("id", "neighbor_id", "distance", "rank", "zoom", "done")


def neighbor_lists(points: DataFrame, found: DataFrame, ident: str = "id") -> DataFrame:
    """Every point with its neighbours as an array of structs, empty where it has none."""
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "distance"))).alias("l"), F.max("done").alias("done"))
    none = F.array().cast("array<struct<neighbor_id:bigint,distance:double>>")
    bare = F.transform("l", lambda x: F.struct(x["neighbor_id"].cast("long").alias("neighbor_id"), x["distance"].alias("distance")))
    return points.select(F.col(ident).alias("id")).join(lists, "id", "left").select("id", F.coalesce(bare, none).alias("neighbors"), F.coalesce("done", F.lit(False)).alias("done"))
