"""Point-in-polygon join: grid cells for the equi-join, ray casting for the exact answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CELL_DEGREES = 0.25
SALTS = 8


def in_bbox(df: DataFrame, bbox, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    west, south, east, north = (float(edge) for edge in bbox)
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def ring_edges(rings: str = "rings") -> Column:
    """All edges of all rings (holes and further parts are just more rings) as one array."""

    def edges_of(ring):
        starts = F.slice(ring, 1, F.size(ring) - 1)
        ends = F.slice(ring, 2, F.size(ring) - 1)
        return F.zip_with(
            starts,
            ends,
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(F.col(rings), edges_of))


def _crosses(edge, x, y) -> Column:
    straddles = (edge["y1"] > y) != (edge["y2"] > y)
    cut_x = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) / (edge["y2"] - edge["y1"]) + edge["x1"]
    return F.when(straddles, x < cut_x).otherwise(F.lit(False))


def _touches(edge, x, y) -> Column:
    cross = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) - (edge["y2"] - edge["y1"]) * (x - edge["x1"])
    return (
        (cross == 0.0)
        & x.between(F.least(edge["x1"], edge["x2"]), F.greatest(edge["x1"], edge["x2"]))
        & y.between(F.least(edge["y1"], edge["y2"]), F.greatest(edge["y1"], edge["y2"]))
    )


def strictly_inside(edges, x, y) -> Column:
    """Odd number of crossings and not on the boundary."""
    odd = F.size(F.filter(edges, lambda e: _crosses(e, x, y))) % 2 == 1
    return odd & ~F.exists(edges, lambda e: _touches(e, x, y))


def polygon_cells(polygons: DataFrame, name: str, cell: float = CELL_DEGREES, salts: int = 1) -> DataFrame:
    """One row per polygon, covered grid cell and salt, with the edges a point in the cell can meet.

    A ray to the east only meets edges in the cell's latitude band that do not end west of it, so
    a polygon of thousands of vertices costs each point a handful of comparisons.
    """
    edges = polygons.select(name, ring_edges().alias("_edges"))

    def extreme(pick, over, a, b):
        # never NULL, so that no null check is pushed down to where the polygons come from
        return F.coalesce(pick(F.transform("_edges", lambda e: over(e[a], e[b]))), F.lit(0.0))

    boxed = edges.select(
        "*",
        extreme(F.array_min, F.least, "x1", "x2").alias("_west"),
        extreme(F.array_max, F.greatest, "x1", "x2").alias("_east"),
        extreme(F.array_min, F.least, "y1", "y2").alias("_south"),
        extreme(F.array_max, F.greatest, "y1", "y2").alias("_north"),
    )

    def span(lo, hi):
        return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))

    cells = boxed.select("*", F.explode(span("_west", "_east")).alias("_cx")).select(
        "*", F.explode(span("_south", "_north")).alias("_cy")
    )
    south, north, west = F.col("_cy") * cell, (F.col("_cy") + 1) * cell, F.col("_cx") * cell

    def reachable(edge):
        return (
            (F.greatest(edge["y1"], edge["y2"]) >= south)
            & (F.least(edge["y1"], edge["y2"]) <= north)
            & (F.greatest(edge["x1"], edge["x2"]) >= west)
        )

    cells = cells.withColumn("_edges", F.filter("_edges", reachable)).where(F.size("_edges") > 0)
    return cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def spatial_join(
    points: DataFrame,
    polygons: DataFrame,
    name: str = "Province",
    lon: str = "longitude",
    lat: str = "latitude",
    how: str = "inner",
    cell: float = CELL_DEGREES,
    salts: int = SALTS,
) -> DataFrame:
    """Points with the polygon they lie strictly within; one row per match if polygons overlap.

    A cell in a burning valley can hold a third of all points. Points are spread over ``salts``
    copies of the (small) cell table, so that cell is worked on by as many tasks. ``how="left"``
    keeps unmatched points with a NULL name.
    """
    cells = polygon_cells(polygons, name, cell, salts)
    keyed = points.withColumns({
        "_cx": F.floor(F.col(lon) / cell),
        "_cy": F.floor(F.col(lat) / cell),
        "_salt": F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"),
    })
    x, y = F.col(lon), F.col(lat)
    p, c = keyed.alias("p"), cells.alias("c")
    same_cell = (
        (F.col("p._cx") == F.col("c._cx"))
        & (F.col("p._cy") == F.col("c._cy"))
        & (F.col("p._salt") == F.col("c._salt"))
    )
    in_box = x.between(F.col("c._west"), F.col("c._east")) & y.between(F.col("c._south"), F.col("c._north"))
    hit = same_cell & in_box & strictly_inside(F.col("c._edges"), x, y)
    joined = p.join(c, hit, "left" if how == "left" else "inner")
    return joined.select(*[F.col(f"p.{column}") for column in points.columns], F.col(f"c.{name}"))


def match_report(joined: DataFrame, name: str = "Province") -> DataFrame:
    """Totals of a left spatial join: rows, rows outside every polygon and their share, matches."""
    outside = F.count_if(F.col(name).isNull())
    total = F.count(F.lit(1))
    return joined.agg(
        total.alias("total"),
        outside.alias("outside"),
        F.try_divide(outside * 100.0, total).alias("outside_pct"),
        F.count(name).alias("matched"),
    )


def map_regions(polygons: DataFrame, mapping: DataFrame, name: str, ours: str) -> DataFrame:
    """Keep the polygons a mapping knows, under the names it gives them."""
    kept = polygons.join(mapping.select(name, F.col(ours).alias("_ours")), name)
    return kept.withColumn(name, F.col("_ours")).drop("_ours")
