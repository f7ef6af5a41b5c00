"""Column functions on coordinates: distances, cells, the national grid and positional accuracy."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import capture_scale_metres, let, round_half_up

EARTH_M = 6371008.8
METRES_A_DEGREE = 111195.0
CELL = 0.05
#: Airy 1830 and WGS84 ellipsoids, the grid's true origin and scale, and the Helmert parameters to WGS84.
AIRY_A, AIRY_B = 6377563.396, 6356256.909
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
SCALE0, LAT0, LON0, EAST0, NORTH0 = 0.9996012717, math.radians(49.0), math.radians(-2.0), 400000.0, -100000.0
SHIFT = {"tx": 446.448, "ty": -125.157, "tz": 542.06, "s": -20.4894e-6}
TURN = {"rx": math.radians(0.1502 / 3600), "ry": math.radians(0.2470 / 3600), "rz": math.radians(0.8421 / 3600)}
DATUM_RESIDUAL_M = 5.0


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle metres between two points."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_box(lng: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (west, south, east, north), edges included."""
    return lng.between(box[0], box[2]) & lat.between(box[1], box[3])


def box_around(lng: float, lat: float, metres: float) -> tuple[float, float, float, float]:
    """A box that holds the circle, for pushing down to the scan before the exact test."""
    up = metres / METRES_A_DEGREE * 1.001
    side = min(180.0, up / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + up)))))
    return lng - side, lat - up, lng + side, lat + up


def cell_of(x: Column, size: float = CELL) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def lng_cells(lat: Column, metres: float, size: float = CELL) -> Column:
    """Cells to look either side so that a distance east or west at this latitude is covered."""
    span = F.least(F.lit(180.0), F.lit(metres / METRES_A_DEGREE) / F.greatest(F.lit(0.01), F.cos(F.radians(lat))))
    return F.ceil(span / size).cast("int")


def grid_plausible(easting: Column, northing: Column) -> Column:
    return easting.isNotNull() & northing.isNotNull() & easting.between(0, 800000) & northing.between(0, 1400000)


def meridian_arc(lat: Column) -> Column:
    """Distance along the meridian from the grid's origin."""
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    d, s = lat - LAT0, lat + LAT0
    terms = (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d
        - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(s)
        + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * s)
        - (35 / 24 * n**3) * F.sin(3 * d) * F.cos(3 * s)
    )
    return F.lit(AIRY_B * SCALE0) * terms


def grid_to_osgb36(easting: Column, northing: Column, rounds: int = 5) -> Column:
    """Struct (lat, lng) in radians on the Airy ellipsoid; five rounds settle the latitude far below a micrometre."""
    first = (northing - NORTH0) / (AIRY_A * SCALE0) + LAT0
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda x, _: x + (northing - NORTH0 - meridian_arc(x)) / (AIRY_A * SCALE0))
    e2 = (AIRY_A**2 - AIRY_B**2) / AIRY_A**2

    def point(p: Column) -> Column:
        sin2, t, sec = F.sin(p) * F.sin(p), F.tan(p), 1 / F.cos(p)
        nu, rho = F.lit(AIRY_A * SCALE0) / F.sqrt(1 - e2 * sin2), F.lit(AIRY_A * SCALE0 * (1 - e2)) / F.pow(1 - e2 * sin2, F.lit(1.5))
        eta, t2, d = nu / rho - 1, t * t, easting - EAST0
        north = (
            t / (2 * rho * nu) * F.pow(d, F.lit(2))
            - t / (24 * rho * F.pow(nu, F.lit(3))) * (5 + 3 * t2 + eta - 9 * t2 * eta) * F.pow(d, F.lit(4))
            + t / (720 * rho * F.pow(nu, F.lit(5))) * (61 + 90 * t2 + 45 * t2 * t2) * F.pow(d, F.lit(6))
        )
        east = (
            sec / nu * d
            - sec / (6 * F.pow(nu, F.lit(3))) * (nu / rho + 2 * t2) * F.pow(d, F.lit(3))
            + sec / (120 * F.pow(nu, F.lit(5))) * (5 + 28 * t2 + 24 * t2 * t2) * F.pow(d, F.lit(5))
            - sec / (5040 * F.pow(nu, F.lit(7))) * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2) * F.pow(d, F.lit(7))
        )
        return F.struct((p - north).alias("lat"), (F.lit(LON0) + east).alias("lng"))

    return F.when(grid_plausible(easting, northing), let(lat, point))


def osgb36_to_wgs84(osgb: Column, rounds: int = 6) -> Column:
    """Struct (lat, lng) in degrees, to 7 places, by the Helmert shift."""
    e2 = (AIRY_A**2 - AIRY_B**2) / AIRY_A**2
    we2 = 2 * WGS84_F - WGS84_F**2

    def shifted(o: Column) -> Column:
        nu = F.lit(AIRY_A) / F.sqrt(1 - e2 * F.sin(o["lat"]) * F.sin(o["lat"]))
        x = nu * F.cos(o["lat"]) * F.cos(o["lng"])
        y = nu * F.cos(o["lat"]) * F.sin(o["lng"])
        z = (1 - e2) * nu * F.sin(o["lat"])
        k = 1 + SHIFT["s"]
        return F.struct(
            (SHIFT["tx"] + x * k - y * TURN["rz"] + z * TURN["ry"]).alias("x"),
            (SHIFT["ty"] + x * TURN["rz"] + y * k - z * TURN["rx"]).alias("y"),
            (SHIFT["tz"] - x * TURN["ry"] + y * TURN["rx"] + z * k).alias("z"),
        )

    def geodetic(c: Column) -> Column:
        p = F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])
        nu = lambda t: F.lit(WGS84_A) / F.sqrt(1 - we2 * F.sin(t) * F.sin(t))
        lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(c["z"], p * (1 - we2)), lambda t, _: F.atan2(c["z"] + we2 * nu(t) * F.sin(t), p))
        return F.struct(round_half_up(F.degrees(lat), 7).alias("lat"), round_half_up(F.degrees(F.atan2(c["y"], c["x"])), 7).alias("lng"))

    return F.when(osgb.isNotNull(), let(let(osgb, shifted), geodetic))


def equivalent_radius_m(hectares: Column) -> Column:
    """Radius of a circle of this area; 0 where it isn't positive."""
    return F.when(hectares > 0, F.sqrt(hectares * 10000.0 / math.pi)).otherwise(0.0)


def position_estimate(scale: Column, hectares: Column, is_area: Column) -> Column:
    """Struct (method, accuracy_m): the digitising floor of a point, or an area's radius if larger."""
    floor = capture_scale_metres(scale) + DATUM_RESIDUAL_M
    extent = F.when(is_area, equivalent_radius_m(hectares)).otherwise(0.0)
    return F.struct(F.when(is_area, "geometry_centroid").otherwise("source_coordinate").alias("method"), round_half_up(F.greatest(floor, extent), 1).alias("accuracy_m"))


def stated_accuracy_m(precision_degrees: Column) -> Column:
    """Metres of a precision in degrees, 25 at least."""
    return F.greatest(F.lit(25.0), precision_degrees * 111320.0)


def positions_conflict(metres: Column, accuracy_a: Column, accuracy_b: Column) -> Column:
    return metres > accuracy_a + accuracy_b + 25.0
