import json
import math
import random

import pytest
from pyspark.sql import functions as F

from verdant.operators import polygons as P
from verdant.sources import geojson


def frame(spark, *geometries):
    return spark.createDataFrame([(i, None if g is None else g if isinstance(g, str) else json.dumps(g)) for i, g in enumerate(geometries)], "id int, g string")


def inside(x, y, rings):
    hit = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay <= y) != (by <= y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                hit = not hit
    return hit


def test_rings_of_every_kind(spark):
    square = [[0, 0], [4, 0], [4, 4, 7], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 1]]
    shapes = [
        {"type": "Polygon", "coordinates": [square, hole]}, {"type": "MultiPolygon", "coordinates": [[square], [hole, square]]}, {"type": "Point", "coordinates": [1, 2, 3]},
        {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, {"type": "MultiLineString", "coordinates": [[[1, 2]], [[3, 4]]]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [5, 6]}, {"type": "Polygon", "coordinates": [hole]}]}, None, "{broken", {"type": "Polygon", "coordinates": []},
    ]
    got = {}
    for r in P.rings(frame(spark, *shapes), "g", "id").orderBy("id", "part", "ring", "position").collect():
        got.setdefault(r["id"], []).append((r["part"], r["ring"], r["position"], r["lon"], r["lat"], r["altitude"]))
    of = lambda part, ring, ps: [(part, ring, k, *p[:2], p[2] if len(p) > 2 else None) for k, p in enumerate(ps)]
    assert got[0] == of(0, 0, square) + of(0, 1, hole) and got[1] == of(0, 0, square) + of(1, 0, hole) + of(1, 1, square)
    assert got[2] == [(0, 0, 0, 1, 2, 3)] and got[3] == [(0, 0, 0, 1, 2, None), (1, 0, 0, 3, 4, None)] and got[4] == of(0, 0, [[1, 2], [3, 4]]) and got[5] == of(0, 0, [[1, 2]]) + of(1, 0, [[3, 4]])
    assert got[6] == of(0, 0, [[5, 6]]) + of(1, 0, hole) and not {7, 8, 9} & set(got)


def test_features_of_collections_and_bare_geometries(spark):
    collection = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::31980"}}, "features": [{"type": "Feature", "properties": {"a": k}, "geometry": {"type": "Point", "coordinates": [k, 0]}} for k in range(3)]}
    texts = spark.createDataFrame([(json.dumps(collection),), ('{"type":"Point","coordinates":[9,9]}',), (None,), ("x",)], "value string")
    got = [(r["properties"], r["geometry"], r["crs"]) for r in P.features(texts).orderBy("feature").collect()]
    assert [g[0] for g in got] == ['{"a":0}', '{"a":1}', '{"a":2}', None] and got[3][1] == '{"type":"Point","coordinates":[9,9]}' and [g[2] for g in got] == [31980] * 3 + [None]


def test_label_points_are_inside(spark):
    rng = random.Random(1)
    shapes = []
    for _ in range(60):  # stars round a point, some with a hole round the middle
        n = rng.randint(3, 12)
        star = [[round(math.cos(2 * math.pi * k / n) * r, 3), round(math.sin(2 * math.pi * k / n) * r, 3)] for k in range(n) for r in [rng.uniform(1, 9)]]
        hole = [[-0.2, -0.2], [0.2, -0.2], [0.2, 0.2], [-0.2, 0.2], [-0.2, -0.2]]
        shapes.append([[*star, star[0]]] + ([hole] if n > 4 else []))
    shapes.append([[[0, 0], [10, 0], [10, 10], [9, 10], [9, 1], [1, 1], [1, 10], [0, 10], [0, 0]]])
    df = frame(spark, *({"type": "Polygon", "coordinates": s} for s in shapes))
    for r in P.label_points(df, "g").collect():
        assert inside(r["label_lon"], r["label_lat"], shapes[r["id"]]), shapes[r["id"]]
    odd = frame(spark, None, {"type": "Polygon", "coordinates": [[[1, 2], [3, 2], [1, 2]]]}, {"type": "Point", "coordinates": [5, 6]}, "x")
    none = (None, None)
    assert {r["id"]: (r["label_lon"], r["label_lat"]) for r in P.label_points(odd, "g").collect()} == {0: none, 1: (1.0, 2.0), 2: (5.0, 6.0), 3: none}


def test_projections(spark):
    """The equator and 45 degrees on a central meridian (a meridian arc of 4,984,944.378 m, as published), then there and back."""
    one = spark.range(1)
    degrees = lambda x, y, code: tuple(one.select(P.to_degrees(F.lit(x), F.lit(y), code).alias("p")).first()["p"])
    assert degrees(500000.0, 0.0, 32631) == pytest.approx((3, 0), abs=1e-9) and degrees(500000.0, 10000000.0, 31980) == pytest.approx((-63, 0), abs=1e-9)
    assert degrees(500000.0, 0.9996 * 4984944.378, 32631) == pytest.approx((3, 45), abs=1e-8) and degrees(500000.0, 1e7 - 0.9996 * 4984944.378, 32720) == pytest.approx((-63, -45), abs=1e-8)
    assert degrees(20037508.342789244, 0.0, 3857) == pytest.approx((180, 0), abs=1e-9) and degrees(1.0, 2.0, 4326) == (1.0, 2.0) and degrees(None, 2.0, 31980)[0] is None
    grid = spark.range(2000).selectExpr("-66 + (id % 61) / 10D as lon", "(id % 160) - 80D as lat")
    back = grid.withColumn("p", P.from_degrees("lon", "lat", 32620)).withColumn("d", P.to_degrees("p.x", "p.y", 32620)).selectExpr("max(abs(d.lon - lon) + abs(d.lat - lat))").first()[0]
    assert back < 1e-8
    with pytest.raises(ValueError):
        P.to_degrees("x", "y", 2154)
    moved = frame(spark, {"type": "Polygon", "coordinates": [[[500000, 10000000, 5], [500000, 10000000]]]}).select(P.reprojected("g", 31980).alias("p")).first()["p"]
    assert [round(v, 9) for v in moved[0][0][0]] == [-63, 0, 5] and len(moved[0][0][1]) == 2


def test_written_features_come_back(spark, tmp_path):
    rows = [(json.dumps({"a": k, "name": 'é"'}), json.dumps({"type": "Point", "coordinates": [k, k / 8]})) for k in range(50)] + [(None, None)]
    path = f"{tmp_path}/out"
    for _ in range(2):  # the second run replaces the first
        geojson.write_geojson(spark.createDataFrame(rows, "properties string, geometry string").repartition(4), path)
    files = [p for p in tmp_path.joinpath("out").iterdir() if not p.name.startswith(".")]
    assert files and all(json.loads(p.read_text())["type"] == "FeatureCollection" for p in files)
    got = P.features(spark.read.text(f"{path}/part-*", wholetext=True)).select("properties", "geometry").collect()
    assert sorted(((json.loads(r["properties"] or "null"), json.loads(r["geometry"] or "null")) for r in got), key=repr) == sorted(((json.loads(p or "null"), json.loads(g or "null")) for p, g in rows), key=repr)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = [("{}", '{"type":"Point"}')] * 20 + [("{}", "broken")]
    with pytest.raises(Exception, match="(?i)json|broken|expecting"):
        geojson.write_geojson(spark.createDataFrame(rows, "properties string, geometry string").repartition(3), f"{tmp_path}/out")
    assert not list(tmp_path.rglob("*.geojson")) and not list(tmp_path.rglob("_temporary*"))
