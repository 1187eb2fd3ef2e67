import random

from pyspark.sql import functions as F

from hazelake.operators import geo

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
NOTCHED = [(2.0, 0.0), (2.5, 0.5), (3.0, 0.0), (3.0, 1.0), (2.0, 1.0), (2.0, 0.0)]
HOLE = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4)]


def polygons(spark, **rings):
    rows = [(name, [[{"x": x, "y": y} for x, y in ring] for ring in parts]) for name, parts in rings.items()]
    return spark.createDataFrame(rows, "Province string, rings array<array<struct<x:double,y:double>>>")


def points(spark, *places):
    return spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "id int, longitude double, latitude double"
    )


def located(spark, places, **kwargs):
    shapes = polygons(spark, square=[SQUARE], notched=[NOTCHED])
    joined = geo.spatial_join(points(spark, *places), shapes, how="left", **kwargs)
    return {r.id: r.Province for r in joined.collect()}


def test_inside_outside_and_notch(spark):
    got = located(spark, [(0.5, 0.5), (2.5, 0.25), (2.5, 0.75), (5, 5), (-0.5, 0.5)])
    assert got == {0: "square", 1: None, 2: "notched", 3: None, 4: None}


def test_boundary_is_outside(spark):
    got = located(spark, [(0, 0.5), (1, 0.5), (0.5, 0), (0.5, 1), (0, 0), (1, 1), (2.25, 0.25)])
    assert set(got.values()) == {None}


def test_cell_size_and_salts_do_not_matter(spark):
    rng = random.Random(3)
    places = [(rng.uniform(-0.5, 3.5), rng.uniform(-0.5, 1.5)) for _ in range(300)]
    expected = located(spark, places, cell=10.0, salts=1)
    assert expected == located(spark, places, cell=0.07, salts=5)
    assert expected == located(spark, places, cell=0.5, salts=3)
    assert set(expected.values()) == {None, "square", "notched"}


def test_hole_and_second_part(spark):
    island = [(9.0, 9.0), (9.5, 9.0), (9.5, 9.5), (9.0, 9.5), (9.0, 9.0)]
    shapes = polygons(spark, land=[SQUARE, HOLE, island])
    got = geo.spatial_join(points(spark, (0.5, 0.5), (0.2, 0.2), (9.2, 9.2)), shapes)
    assert {r.id for r in got.collect()} == {1, 2}


def test_overlap_gives_one_row_per_polygon(spark):
    shifted = [(x + 0.5, y) for x, y in SQUARE]
    shapes = polygons(spark, a=[SQUARE], b=[shifted])
    got = geo.spatial_join(points(spark, (0.75, 0.5), (0.25, 0.5)), shapes)
    assert sorted((r.id, r.Province) for r in got.collect()) == [(0, "a"), (0, "b"), (1, "a")]


def test_identical_points_are_all_kept(spark):
    many = spark.range(5000).select(F.lit(0.5).alias("longitude"), F.lit(0.5).alias("latitude"))
    assert geo.spatial_join(many, polygons(spark, square=[SQUARE])).count() == 5000


def test_report(spark):
    joined = geo.spatial_join(
        points(spark, (0.5, 0.5), (7, 7), (8, 8), (0.1, 0.1)), polygons(spark, square=[SQUARE]), how="left"
    )
    assert geo.match_report(joined).first().asDict() == {"total": 4, "outside": 2, "outside_pct": 50.0, "matched": 2}


def test_bbox(spark):
    got = geo.in_bbox(points(spark, (97.3, 17.5), (99, 19), (102, 19)), (97.3, 17.5, 101.5, 20.5))
    assert {r.id for r in got.collect()} == {0, 1}


def test_regions_are_renamed_and_selected(spark):
    shapes = polygons(spark, **{"first": [SQUARE], "other": [NOTCHED]})
    mapping = spark.createDataFrame([("first", "ours")], "Province string, ours string")
    assert [r.Province for r in geo.map_regions(shapes, mapping, "Province", "ours").collect()] == ["ours"]
