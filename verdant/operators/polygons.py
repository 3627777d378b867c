"""Polygons as columns: rings of GeoJSON, label points, projections. No shuffle: each geometry stays in its row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_POSITION = "array<double>"


def _nested(depth: int) -> str:
    return "array<" * depth + _POSITION + ">" * depth


def parts(geometry: Column | str) -> Column:
    """The parts of a GeoJSON geometry (text), each an array of rings, each an array of positions.

    A polygon has its outer ring first and then its holes; a line is a part
    with one ring, a point one with one position. A collection has the parts
    of its members, one level deep. Null for what is no geometry.
    """
    g = F.col(geometry) if isinstance(geometry, str) else geometry

    def simple(one: Column) -> Column:
        kind, inner = F.get_json_object(one, "$.type"), F.get_json_object(one, "$.coordinates")
        read = lambda depth: F.from_json(inner, _nested(depth))
        return (
            F.when(kind == "Point", F.array(F.array(F.array(F.from_json(inner, _POSITION)))))
            .when(kind == "LineString", F.array(F.array(read(1))))
            .when(kind == "MultiPoint", F.transform(read(1), lambda p: F.array(F.array(p))))
            .when(kind == "MultiLineString", F.transform(read(2), lambda ring: F.array(ring)))
            .when(kind == "Polygon", F.array(read(2)))
            .when(kind == "MultiPolygon", read(3))
        )

    members = F.from_json(g, "struct<geometries: array<string>>")["geometries"]
    return F.when(F.get_json_object(g, "$.type") == "GeometryCollection", F.flatten(F.transform(members, simple))).otherwise(simple(g))


def features(texts: DataFrame, column: str = "value") -> DataFrame:
    """(feature, properties, geometry, crs) of GeoJSON texts: of collections each feature, else the feature or the geometry itself.

    ``feature`` tells them apart and follows their order; crs is the code that
    the file states, null if none. A null or broken text has no features.
    """
    kind = F.get_json_object(column, "$.type")
    every = F.from_json(column, "struct<features: array<string>>")["features"]
    own = F.when(kind == "FeatureCollection", every).when(kind.isNotNull(), F.array(column))
    code = F.regexp_extract(F.get_json_object(column, "$.crs.properties.name"), r"([0-9]+)\s*$", 1).try_cast("int")
    rows = texts.select(code.alias("crs"), F.explode(own).alias("_f")).select("*", F.monotonically_increasing_id().alias("feature"))
    bare = F.get_json_object("_f", "$.type") != "Feature"
    return rows.select("feature", F.get_json_object("_f", "$.properties").alias("properties"), F.when(bare, F.col("_f")).otherwise(F.get_json_object("_f", "$.geometry")).alias("geometry"), "crs")


def rings(df: DataFrame, geometry: str, *keep: str) -> DataFrame:
    """(keep…, part, ring, position, lon, lat, altitude), a row for each position; part, ring and position count from 0."""
    out = df.select(*keep, F.posexplode(parts(geometry)).alias("part", "_part"))
    out = out.select(*keep, "part", F.posexplode("_part").alias("ring", "_ring"))
    out = out.select(*keep, "part", "ring", F.posexplode("_ring").alias("position", "_p"))
    return out.select(*keep, "part", "ring", "position", F.get("_p", F.lit(0)).alias("lon"), F.get("_p", F.lit(1)).alias("lat"), F.get("_p", F.lit(2)).alias("altitude"))


def label_points(df: DataFrame, geometry: str) -> DataFrame:
    """``df`` with (label_lon, label_lat), a point inside each row's polygon: in the middle of the widest stretch that its interior has on a scan line.

    A part's line runs halfway between the vertices next above and below its
    middle height, so it meets no vertex; of several parts the widest stretch
    counts, of equals the first. A geometry without area has its first
    position; null and broken text have none. Rows stay as they are, no key is
    needed and nothing is shuffled.
    """
    names = df.columns

    def step(rows: DataFrame, value: Column) -> DataFrame:
        """Values for each part, generated so that the next step reads them instead of computing them again in each of its lambdas."""
        return rows.select(*names, "_first", F.explode(F.array(value)).alias("_p"))

    edge = lambda ring: F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))
    heights = lambda part: F.flatten(F.transform(part, lambda ring: F.transform(ring, lambda p: F.get(p, F.lit(1)))))
    rows = df.select(*names, F.explode(F.array(parts(geometry))).alias("_p"))
    rows = rows.select(*names, F.get(F.get(F.get("_p", F.lit(0)), F.lit(0)), F.lit(0)).alias("_first"), "_p")
    rows = step(rows, F.transform("_p", lambda part: F.struct(F.flatten(F.transform(part, edge)).alias("edges"), heights(part).alias("ys"))))
    rows = step(rows, F.transform("_p", lambda x: F.struct(x["edges"].alias("edges"), x["ys"].alias("ys"), ((F.array_min(x["ys"]) + F.array_max(x["ys"])) / 2).alias("middle"))))
    nearest = lambda x: (F.array_max(F.filter(x["ys"], lambda v: v <= x["middle"])) + F.array_min(F.filter(x["ys"], lambda v: v > x["middle"]))) / 2
    rows = step(rows, F.transform("_p", lambda x: F.struct(x["edges"].alias("edges"), nearest(x).alias("y"))))
    crossed = lambda x: F.filter(x["edges"], lambda e: (e["ay"] <= x["y"]) != (e["by"] <= x["y"]))
    rows = step(rows, F.transform("_p", lambda x: F.struct(F.array_sort(F.transform(crossed(x), lambda e: e["ax"] + (x["y"] - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"]))).alias("xs"), x["y"].alias("y"))))
    # Crossings 0 and 1, 2 and 3 … bound the stretches.
    ends = lambda x: F.filter(F.transform(x["xs"], lambda right, i: F.struct(F.get(x["xs"], i - 1).alias("left"), right.alias("right"), x["y"].alias("y"), (i % 2).alias("odd"))), lambda e: e["odd"] == 1)
    rows = step(rows, F.flatten(F.transform("_p", ends)))
    rows = step(rows, F.transform("_p", lambda e, i: F.struct((e["right"] - e["left"]).alias("width"), (-i).alias("order"), ((e["left"] + e["right"]) / 2).alias("lon"), e["y"].alias("lat"))))
    best = F.array_max("_p")
    return rows.select(*names, F.coalesce(best["lon"], F.get("_first", F.lit(0))).alias("label_lon"), F.coalesce(best["lat"], F.get("_first", F.lit(1))).alias("label_lat"))


# Semi-axes and flattenings of the ellipsoids, scale and false origins of the zones.
_WGS84 = (6378137.0, 1 / 298.257223563)
_GRS80 = (6378137.0, 1 / 298.257222101)
_SCALE, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0


def zone_of(code: int) -> tuple[float, bool, tuple[float, float]] | None:
    """(central meridian, southern half, ellipsoid) of a transverse Mercator code: WGS 84 and SIRGAS 2000 zones; None for others."""
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return -183.0 + 6 * (code % 100), code >= 32700, _WGS84
    if 31965 <= code <= 31976:  # zones 11 to 22, north
        return -183.0 + 6 * (code - 31954), False, _GRS80
    if 31977 <= code <= 31985:  # zones 17 to 25, south
        return -183.0 + 6 * (code - 31960), True, _GRS80
    return None


def _series(ellipsoid: tuple[float, float]) -> tuple[float, list[float], list[float], list[float], float]:
    """Of Krüger's series to the third order: rectifying radius, forward, inverse and latitude coefficients, third flattening."""
    a, f = ellipsoid
    n = f / (2 - f)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), forward, inverse, latitude, n


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_degrees(x: Column | str, y: Column | str, code: int) -> Column:
    """(lon, lat) of projected coordinates: transverse Mercator zones (``zone_of``), 3857; 4326 and 4674 are degrees already.

    ValueError for another code. A null coordinate gives null ones.
    """
    x, y = _c(x).cast("double"), _c(y).cast("double")
    if code in (4326, 4674):
        return F.struct(x.alias("lon"), y.alias("lat"))
    if code == 3857:
        radius = _WGS84[0]
        return F.struct(F.degrees(x / radius).alias("lon"), F.degrees(2 * F.atan(F.exp(y / radius)) - math.pi / 2).alias("lat"))
    zone = zone_of(code)
    if zone is None:
        raise ValueError(f"coordinates of code {code} can't be read")
    meridian, south, ellipsoid = zone
    radius, _, inverse, latitude, _ = _series(ellipsoid)
    xi, eta = (y - (_SOUTH if south else 0.0)) / (_SCALE * radius), (x - _EAST) / (_SCALE * radius)
    xi0 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(inverse, 1)), F.lit(0.0))
    eta0 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(inverse, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(latitude, 1)), F.lit(0.0))
    return F.struct((F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + meridian).alias("lon"), F.degrees(lat).alias("lat"))


def from_degrees(lon: Column | str, lat: Column | str, code: int) -> Column:
    """(x, y) in a zone, the inverse of ``to_degrees``."""
    lon, lat = _c(lon).cast("double"), _c(lat).cast("double")
    zone = zone_of(code)
    if zone is None:
        raise ValueError(f"coordinates of code {code} can't be written")
    meridian, south, ellipsoid = zone
    radius, forward, _, _, n = _series(ellipsoid)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, away = F.radians(lat), F.radians(lon - meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi0, eta0 = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    xi = xi0 + sum((a * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0) for j, a in enumerate(forward, 1)), F.lit(0.0))
    eta = eta0 + sum((a * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0) for j, a in enumerate(forward, 1)), F.lit(0.0))
    return F.struct((_EAST + _SCALE * radius * eta).alias("x"), ((_SOUTH if south else 0.0) + _SCALE * radius * xi).alias("y"))


def reprojected(geometry: Column | str, code: int) -> Column:
    """A geometry's parts with every position in degrees; altitudes stay."""
    one = lambda p: F.concat(F.array(to_degrees(p[0], p[1], code)["lon"], to_degrees(p[0], p[1], code)["lat"]), F.slice(p, 3, 1))
    return F.transform(parts(geometry), lambda part: F.transform(part, lambda ring: F.transform(ring, one)))


def multi_polygon(every: Column | str) -> Column:
    """GeoJSON text of parts."""
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), _c(every).alias("coordinates")))
