"""Nearest records by distance: a grid-cell equi-join before the exact distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.geo import DIAMETER_KM, RADIUS_M, km, metres
from quillstone.session import written

#: Sides of the prefilter box in degrees, at middle latitudes more than 60 km.
BOX_LAT, BOX_LNG = 1.0, 1.5
#: A first look is into cells of at most so many places (spots, not rows), or cells halved so often.
FULL, HALVINGS = 16, 10


def nearby(points: DataFrame, places: DataFrame, max_km: float, box: tuple[float, float] = (BOX_LAT, BOX_LNG)) -> DataFrame:
    """points (lat, lng) with each place (p_lat, p_lng) within max_km and inside the box, and km.

    Every place is in one grid cell; a point looks into the 3 x 3 cells around its own. The join is on the cell, so it
    shuffles by cell and never compares far-away pairs. Rows without coordinates match nothing.
    """
    cell = lambda lat, lng: (F.floor(lat / box[0]).alias("_y"), F.floor(lng / box[1]).alias("_x"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = points.select("*", *cell(F.col("lat"), F.col("lng")), around.alias("_d"))
    asked = asked.withColumns({"_y": F.col("_y") + F.col("_d.i"), "_x": F.col("_x") + F.col("_d.j")}).drop("_d")
    held = places.select("*", *cell(F.col("p_lat"), F.col("p_lng")))
    in_box = (F.abs(F.col("lat") - F.col("p_lat")) <= box[0]) & (F.abs(F.col("lng") - F.col("p_lng")) <= box[1])
    far = km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    return asked.join(held, ["_y", "_x"]).where(in_box).withColumn("km", far).where(F.col("km") <= max_km).drop("_y", "_x")


def first_box(places: DataFrame) -> tuple[float, float]:
    """The largest box, halved from BOX_LAT by BOX_LNG at most HALVINGS times, of which no cell holds more than FULL places.

    Cells are counted at every size at once: one aggregation, and one figure a size for the driver.
    """
    size = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(2**i)).alias("n")) for i in range(HALVINGS + 1)])).alias("_s")
    cells = places.select("p_lat", "p_lng", size).groupBy("_s.i", F.floor(F.col("p_lat") * F.col("_s.n") / BOX_LAT).alias("y"), F.floor(F.col("p_lng") * F.col("_s.n") / BOX_LNG).alias("x"))
    most = {r["i"]: r["most"] for r in cells.agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.max("n").alias("most")).collect()}
    halved = next((i for i in range(HALVINGS + 1) if most.get(i, 0) <= FULL), HALVINGS)
    return BOX_LAT / 2**halved, BOX_LNG / 2**halved


def edge_metres(box: tuple[float, float]) -> Column:
    """What is outside a box around lat is as far as this at least: so many degrees of latitude, or the way to the meridian of its side."""
    side = F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.lit(min(box[1], 90.0)))))
    return RADIUS_M * F.least(F.radians(F.lit(box[0])), side)


def k_nearest(points: DataFrame, key: str, places: DataFrame, place_key: str, k: int, max_km: float) -> DataFrame:
    """The k nearest places of each point within max_km and inside the box, ties to the smaller place; rank from 1.

    Points look around themselves in a box that fits the densest places first; those that may have nearer places outside
    of it ask again with a box twice as wide, up to the whole one. Of places at one spot no more than k can be among the
    k nearest, so the work grows with the points, not with points times places.
    """
    spot = Window.partitionBy("p_lat", "p_lng").orderBy(place_key)
    held = written(places.where("p_lat IS NOT NULL AND p_lng IS NOT NULL").withColumn("_n", F.row_number().over(spot)).where(F.col("_n") <= k).drop("_n"), "places")
    box, left, found = first_box(held.dropDuplicates(["p_lat", "p_lng"])), points.where("lat IS NOT NULL AND lng IS NOT NULL"), None
    order = Window.partitionBy(key).orderBy("km", place_key)
    while True:
        last = box[0] >= BOX_LAT
        near = nearby(left, held, max_km, box).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if not last:
            near = written(near, "near")
            # km are of a slightly smaller globe than the edge; a margin keeps ties inside
            farthest = near.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("km").alias("far"), F.first("lat").alias("lat"))
            ended = written(farthest.where((F.col("n") == k) & (F.col("far") * 1000.001 < edge_metres(box) * (DIAMETER_KM * 500 / RADIUS_M))).select(key), "ended")
            near = near.join(ended, key, "left_semi")
            left = written(left.join(ended, key, "left_anti"), "left")
        found = near if found is None else found.unionByName(near)
        if last or left.isEmpty():
            return found
        box = (box[0] * 2, box[1] * 2)


def nearest_place(points: DataFrame, key: str, places: DataFrame, place_key: str) -> DataFrame:
    """key, place_key and metres of the nearest place of each point at any distance, ties to the smaller place.

    Points whose nearest place in the box may not be the nearest of all are asked again with a box twice as wide; the
    first box fits the densest places. What is outside a box is as far as its edge at least. Of places at one spot only
    the smallest is held. Points without coordinates and all points where there is no place get no row.
    """
    left = points.select(key, "lat", "lng").where("lat IS NOT NULL AND lng IS NOT NULL")
    held = places.where("p_lat IS NOT NULL AND p_lng IS NOT NULL").groupBy("p_lat", "p_lng").agg(F.min(place_key).alias(place_key))
    # places on both sides of the date line
    held = written(held.withColumn("p_lng", F.explode(F.transform(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)), lambda turn: F.col("p_lng") + turn))), "places")
    box, found = first_box(held), None
    while True:
        far = metres(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
        near = nearby(left, held, float("inf"), box).withColumn("m", far).groupBy(key).agg(
            F.min_by(place_key, F.struct("m", place_key)).alias(place_key), F.min("m").alias("metres"), F.first("lat").alias("lat")
        )
        whole = min(box) >= 180
        # metres are rounded: a place that ties must be inside as well
        near = written(near.where(F.lit(whole) | (F.col("metres") + 1 < edge_metres(box))).select(key, place_key, "metres"), "nearest")
        found = near if found is None else found.unionByName(near)
        left = written(left.join(near, key, "left_anti"), "left")
        if whole or left.isEmpty():
            return found
        box = (box[0] * 2, box[1] * 2)
