"""Grid operators on the hexagonal lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.constants import DEFAULT_RESOLUTION, ORIGIN_LON
from cellweft.errors import DataError
from cellweft.functions import geo
from cellweft.functions.display import world_bbox_problem

# Bin widths in degrees for box joins against cells: about one cell for points, wider for
# request boxes, which touch many bins each.
POINT_BIN_DEGREES = 0.0125
CELL_BIN_DEGREES = 0.05


def with_axial(df: DataFrame, lon: str = "lon", lat: str = "lat",
               resolution: int = DEFAULT_RESOLUTION) -> DataFrame:
    """Add the lattice coordinates ``q`` and ``r`` of each point."""
    x, y = geo.to_metric(lon, lat)
    placed = df.withColumns({"_x": x, "_y": y})
    q, r = geo.axial("_x", "_y", resolution)
    return placed.withColumns({"q": q, "r": r}).drop("_x", "_y")


def with_cell(df: DataFrame, lon: str = "lon", lat: str = "lat",
              resolution: int = DEFAULT_RESOLUTION, name: str = "cell_id") -> DataFrame:
    """Add the cell id of each point; null outside the world range."""
    placed = with_axial(df, lon, lat, resolution)
    cell = F.when(geo.in_world(F.col(lon), F.col(lat)), geo.cell_id(F.col("q"), F.col("r"), resolution))
    return placed.withColumn(name, cell).drop("q", "r")


def with_ring(df: DataFrame, resolution: int = DEFAULT_RESOLUTION) -> DataFrame:
    """Add centroid, corner ring and box in degrees to rows that have ``q`` and ``r``."""
    cx, cy = geo.centre("q", "r", resolution)
    placed = df.withColumns({"_cx": cx, "_cy": cy})
    spots = [(0.0, 0.0), *geo.corner_offsets(resolution)]
    polar, degrees = {}, {}
    for k, (ox, oy) in enumerate(spots):
        polar[f"_angle{k}"], polar[f"_half{k}"] = geo.to_polar(f"(_cx + {ox!r}D)", f"(_cy + {oy!r}D)")
        degrees[f"_lon{k}"], degrees[f"_lat{k}"] = geo.polar_degrees(f"_angle{k}", f"_half{k}")
    placed = placed.withColumns(polar).select(*df.columns, *[c.alias(n) for n, c in degrees.items()])
    corners = [F.struct(F.col(f"_lon{k}").alias("lon"), F.col(f"_lat{k}").alias("lat")) for k in range(1, 7)]
    lons, lats = ([F.col(f"_{axis}{k}") for k in range(1, 7)] for axis in ("lon", "lat"))
    cell = F.struct(
        F.col("_lon0").alias("centroid_lon"), F.col("_lat0").alias("centroid_lat"),
        F.array(*corners, corners[0]).alias("geometry"),
        F.least(*lons).alias("lon_min"), F.least(*lats).alias("lat_min"),
        F.greatest(*lons).alias("lon_max"), F.greatest(*lats).alias("lat_max"),
    )
    # A generator, so that later tests on these columns are not pushed below (and copied
    # into) the trigonometry above.
    return placed.select(*df.columns, F.inline(F.array(cell)))


GRID_COLUMNS = ("cell_id", "resolution", "centroid_lat", "centroid_lon", "geometry",
                "lon_min", "lat_min", "lon_max", "lat_max")


def cell_boundary(cells: DataFrame, cell: str = "cell_id",
                  resolution: int = DEFAULT_RESOLUTION) -> DataFrame:
    """Grid rows (centroid, closed ring, box) of each cell id."""
    _, q, r = geo.cell_parts(F.col(cell))
    rows = cells.select(F.col(cell).alias("cell_id"), q.alias("q"), r.alias("r"))
    return with_ring(rows, resolution).withColumn("resolution", F.lit(resolution)).select(*GRID_COLUMNS)


def cell_neighbors(cells: DataFrame, cell: str = "cell_id", resolution: int = DEFAULT_RESOLUTION,
                   with_self: bool = True) -> DataFrame:
    """Each cell with the cells of its one-ring, and with itself when asked."""
    steps = geo.DISK if with_self else geo.DISK[1:]
    _, q, r = geo.cell_parts(F.col(cell))
    around = F.explode(F.array(*[F.struct(F.lit(dq).alias("dq"), F.lit(dr).alias("dr")) for dq, dr in steps]))
    rows = cells.select(F.col(cell).alias("cell_id"), q.alias("q"), r.alias("r"), around.alias("d"))
    near = geo.cell_id(F.col("q") + F.col("d.dq"), F.col("r") + F.col("d.dr"), resolution)
    return rows.select("cell_id", near.alias("neighbor_id"))


def ring_meets_box(ring: str, box: tuple[str, str, str, str]) -> Column:
    """Exact test that a convex closed ring and a box share a point (separating axes).

    The box axes are left to the caller's box test; this tests the axis of each ring edge:
    an edge separates when the whole box lies beyond its line, seen from the ring's middle.
    """
    west, south, east, north = box
    middle = f"aggregate({ring}, 0D, (s, p) -> s + p.%s) / size({ring})"
    return F.expr(f"""NOT exists(
      transform(sequence(1, size({ring}) - 1), i -> struct(
        {ring}[i - 1].lon AS ax, {ring}[i - 1].lat AS ay,
        {ring}[i].lat - {ring}[i - 1].lat AS nx, {ring}[i - 1].lon - {ring}[i].lon AS ny,
        {middle % 'lon'} AS mx, {middle % 'lat'} AS my)),
      g -> CASE WHEN g.nx * (g.mx - g.ax) + g.ny * (g.my - g.ay) > 0
        THEN greatest(g.nx * {west}, g.nx * {east}) + greatest(g.ny * {south}, g.ny * {north}) < g.nx * g.ax + g.ny * g.ay
        ELSE least(g.nx * {west}, g.nx * {east}) + least(g.ny * {south}, g.ny * {north}) > g.nx * g.ax + g.ny * g.ay END)""")


def grid_fill(boxes: DataFrame, box: tuple[str, str, str, str] = ("west", "south", "east", "north"),
              resolution: int = DEFAULT_RESOLUTION, check: bool = True) -> DataFrame:
    """Every cell whose ring meets any of the boxes, once, as a grid table."""
    candidates = cells_of_boxes(boxes, box, resolution, check)
    cells = candidates.select("q", "r").distinct()
    rows = with_ring(cells, resolution).withColumns(
        {"cell_id": geo.cell_id(F.col("q"), F.col("r"), resolution), "resolution": F.lit(resolution)}
    )
    return rows.select(*GRID_COLUMNS)


def cells_of_boxes(boxes: DataFrame, box: tuple[str, str, str, str] = ("west", "south", "east", "north"),
                   resolution: int = DEFAULT_RESOLUTION, check: bool = True) -> DataFrame:
    """Each box row with ``q`` and ``r`` of every cell whose ring meets it.

    The lattice rows of a box are spread over tasks before their cells are listed, so one
    very large box is not one task.
    """
    west, south, east, north = (F.col(c) for c in box)
    if check and not boxes.filter(world_bbox_problem(west, south, east, north).isNotNull()).isEmpty():
        raise DataError("corners are not in west, south, east, north order")
    a = geo.edge_m(resolution)
    step_x, step_y = a * geo.SQRT3, a * 1.5
    # A box's metric extremes lie on its corners or where its south side crosses the
    # central meridian.
    w, s, e, n = box
    lowest = f"least(greatest({w}, {ORIGIN_LON!r}D), {e})"
    marks = [geo.to_metric(lon, lat) for lon, lat in ((w, s), (w, n), (e, s), (e, n), (lowest, s))]
    placed = boxes.withColumns({f"_{axis}{k}": mark[i] for k, mark in enumerate(marks)
                                for i, axis in enumerate("xy")})
    xs, ys = ([F.col(f"_{axis}{k}") for k in range(5)] for axis in "xy")
    placed = placed.withColumns({
        "_x_low": F.least(*xs), "_x_high": F.greatest(*xs),
        "_r_low": F.floor(F.least(*ys) / step_y) - 1, "_r_high": F.ceil(F.greatest(*ys) / step_y) + 1,
    })
    rows = placed.select(*boxes.columns, "_x_low", "_x_high",
                         F.explode(F.sequence("_r_low", "_r_high")).alias("r"))
    # A fixed count keeps the adaptive planner from merging these short rows again.
    rows = rows.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *boxes.columns, "r")
    q_low = F.floor(F.col("_x_low") / step_x - F.col("r") / 2) - 1
    q_high = F.ceil(F.col("_x_high") / step_x - F.col("r") / 2) + 1
    cells = with_ring(rows.withColumn("q", F.explode(F.sequence(q_low, q_high))), resolution)
    meets = (
        (F.col("lon_min") <= east) & (F.col("lon_max") >= west)
        & (F.col("lat_min") <= north) & (F.col("lat_max") >= south)
    )
    exact = ring_meets_box("geometry", box)
    return cells.filter(meets).filter(exact).select(*boxes.columns, "q", "r")


def with_edge_length(grid: DataFrame, resolution: str = "resolution") -> DataFrame:
    """Add the mean edge length of each row's resolution; null for a resolution outside 0..15."""
    known = F.col(resolution).between(0, 15)
    edge = F.lit(geo.edge_km(8)) * F.pow(F.lit(7.0), (F.lit(8) - F.col(resolution)) / 2)
    return grid.withColumn("edge_length_km", F.when(known, edge))

