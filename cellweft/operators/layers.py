"""Point and line layers on cells: overlay and aggregation.

On our own lattice the cell of a point or of a line piece is arithmetic, so nothing is
joined before the aggregate. On a polygon table the overlay is a box join on bins followed
by an exact test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.constants import DEFAULT_RESOLUTION, VINTAGE_YEAR, YEAR_BUILT_RANGE
from cellweft.errors import DataError
from cellweft.functions import geo
from cellweft.functions.text import to_number
from cellweft.operators.joins import MIN_HOT_ROWS, box_join
from cellweft.operators.keys import duplicate_keys
from cellweft.operators.lattice import POINT_BIN_DEGREES, with_cell
from cellweft.operators.rings import (
    MAX_CORNERS,
    corner_columns,
    holds_point,
    inner_point,
    level_parts,
    outward_sides,
    ring_edges,
    ring_problem,
    share_inside,
    share_inside_convex,
    share_inside_corners,
    share_inside_part,
    usable_rings,
    with_corner_sides,
    with_corners,
)
from cellweft.session import scratch_path

LINE_KINDS = ("water", "road")


# Points ---------------------------------------------------------------------------------


def points_in_cells(points: DataFrame, lon: str = "lon", lat: str = "lat",
                    resolution: int = DEFAULT_RESOLUTION) -> DataFrame:
    """Points with their cell on our lattice; points outside the world range drop out."""
    return with_cell(points, lon, lat, resolution).filter(F.col("cell_id").isNotNull())


def points_in_polygons(points: DataFrame, polygons: DataFrame, lon: str = "lon", lat: str = "lat",
                       bin_size: float = POINT_BIN_DEGREES, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Points joined to the polygons (cell_id, geometry and box; rings of any shape) that strictly hold them."""
    sides = usable_rings(polygons).select("cell_id", ring_edges("geometry").alias("_edges"),
                                          "lon_min", "lat_min", "lon_max", "lat_max")
    near = box_join(points, sides, (lon, lat, lon, lat),
                    ("lon_min", "lat_min", "lon_max", "lat_max"), bin_size, min_rows, left_span=0.0)
    inside = near.filter(holds_point("_edges", lon, lat))
    return inside.select(*points.columns, "cell_id")


def require_layer(layer: DataFrame, label: str, columns: Sequence[str] = ("objectid", "geometry")) -> DataFrame:
    """The layer itself, once it has the columns; an empty layer is fine and gives every cell its default."""
    missing = sorted(set(columns) - set(layer.columns))
    if missing:
        raise DataError(f"{label} are missing columns: {', '.join(missing)}")
    return layer


def building_points(buildings: DataFrame) -> DataFrame:
    """Buildings with one point each: their ``lon`` and ``lat``, or for a ring in ``geometry`` a point surely inside it.

    A ring without an area has no point and drops out.
    """
    if {"lon", "lat"} <= set(buildings.columns):
        return require_layer(buildings, "buildings", ("objectid", "year_built"))
    placed = inner_point(require_layer(buildings, "buildings", ("objectid", "year_built", "geometry")))
    return placed.filter(F.col("lon").isNotNull())


def building_rows(buildings: DataFrame) -> DataFrame:
    """Buildings with a usable year: numeric and inside the accepted range."""
    year = to_number(F.col("year_built").cast("string"))
    return buildings.withColumn("year_built", year).filter(F.col("year_built").between(*YEAR_BUILT_RANGE))


def building_features(placed: DataFrame) -> DataFrame:
    """Per cell: distinct buildings, exact median year, share built before the vintage year.

    The year side shuffles one row per (cell, year) and task, the count side one row per
    (cell, building); neither sends a crowded cell's raw rows to one task. The middle is found by a
    running count over the cell's distinct years, which spills to disk where they are many.
    """
    years = placed.groupBy("cell_id", "year_built").agg(F.count("*").alias("n"))
    early = F.when(F.col("year_built") < VINTAGE_YEAR, F.col("n")).otherwise(0)
    cell = Window.partitionBy("cell_id")
    known = F.when(F.col("year_built").isNotNull(), F.col("n")).otherwise(0)
    ranked = years.withColumn("known", known).withColumns({
        "upto": F.sum("known").over(cell.orderBy("year_built").rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("known").over(cell),
    })

    def year_at(place):
        """The year at a place (from 1) among the cell's buildings in order of year."""
        holds = (F.col("upto") >= place) & (F.col("upto") - F.col("known") < place)
        return F.max(F.when(holds, F.col("year_built")))

    lower, upper = year_at(F.floor((F.col("total") + 1) / 2)), year_at(F.floor((F.col("total") + 2) / 2))
    vintage = ranked.groupBy("cell_id").agg(
        (lower + (upper - lower) / 2).alias("median_year_built"),
        (F.sum(early) / F.sum("n")).alias("pct_pre_1980"),
    )
    counted = placed.select("cell_id", "objectid").distinct().groupBy("cell_id").agg(
        F.count("objectid").alias("building_count")
    )
    joined = counted.join(vintage, "cell_id")
    return joined.select("cell_id", "building_count", "median_year_built", "pct_pre_1980")


def polygon_point(df: DataFrame, ring: str = "geometry") -> DataFrame:
    """Add the area centroid of a closed convex ring as ``lon`` and ``lat``; null where the ring has no area."""
    origin = F.element_at(F.col(ring), 1)
    steps = F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))

    def parts(i: Column) -> Column:
        a, b = F.get(ring, i - 1), F.get(ring, i)
        ax, ay = a["lon"] - origin["lon"], a["lat"] - origin["lat"]
        bx, by = b["lon"] - origin["lon"], b["lat"] - origin["lat"]
        cross = ax * by - bx * ay
        return F.struct(cross.alias("w"), ((ax + bx) * cross).alias("x"), ((ay + by) * cross).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(F.transform(steps, parts), zero, lambda s, p: F.struct(
        (s["w"] + p["w"]).alias("w"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
    rows = df.withColumn("_sum", total)
    return rows.withColumns({
        "lon": origin["lon"] + F.try_divide(F.col("_sum.x"), F.col("_sum.w") * 3),
        "lat": origin["lat"] + F.try_divide(F.col("_sum.y"), F.col("_sum.w") * 3),
    }).drop("_sum")


# Lines ----------------------------------------------------------------------------------


def _dealt(lines: DataFrame) -> DataFrame:
    """Lines dealt by content: cutting costs far more than reading, and lines read in few tasks would all be cut there."""
    return lines.select("objectid", "geometry").repartition(F.xxhash64("objectid", "geometry"))


def line_pieces(lines: DataFrame, piece_m: float) -> DataFrame:
    """Straight metric pieces (px, py, vx, vy) of at most ``piece_m`` metres of each line."""
    path = F.col("geometry")
    step = F.explode(F.sequence(F.lit(1), F.size(path) - 1))
    legs = _dealt(lines).filter(F.size(path) > 1).select("objectid", "geometry", step.alias("_i"))
    ax, ay = geo.to_metric("geometry[_i - 1].lon", "geometry[_i - 1].lat")
    bx, by = geo.to_metric("geometry[_i].lon", "geometry[_i].lat")
    legs = legs.select("objectid", ax.alias("_ax"), ay.alias("_ay"), bx.alias("_bx"), by.alias("_by"))
    legs = legs.withColumns({"_dx": F.col("_bx") - F.col("_ax"), "_dy": F.col("_by") - F.col("_ay")})
    metres = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    legs = legs.withColumn("_n", F.ceil(metres / piece_m)).filter(F.col("_n") > 0)
    cut = legs.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return cut.select(
        "objectid",
        (F.col("_ax") + F.col("_dx") * F.col("_k") / F.col("_n")).alias("px"),
        (F.col("_ay") + F.col("_dy") * F.col("_k") / F.col("_n")).alias("py"),
        (F.col("_dx") / F.col("_n")).alias("vx"),
        (F.col("_dy") / F.col("_n")).alias("vy"),
    )


def line_turns(lines: DataFrame, piece_m: float) -> DataFrame:
    """Straight metric pieces of each line, two in a row: (px, py, vx, vy) and (qx, qy, ux, uy).

    Every two legs in a row share one where both are at most ``piece_m`` metres long. Longer legs are cut, and
    their pieces have a row each with a point for the second piece.
    """
    # Corners and pieces by functions of arrays: written out, the step would be too long for the JVM to compile.
    x, y = geo.metric_text("p.lon", "p.lat")
    paths = _dealt(lines).filter(F.size("geometry") > 1).select("objectid", F.expr(f"transform(geometry, p -> struct({x} AS x, {y} AS y))").alias("_path"))
    legs = paths.select("objectid", "_path", F.explode(F.expr("sequence(1, size(_path) - 1, 2)")).alias("_i"))
    corners = {"a": "get(_path, _i - 1)", "b": "get(_path, _i)", "c": "get(_path, _i + 1)"}
    legs = legs.select("objectid", *[F.expr(f"{corner}.{c}").alias(f"_{name}{c}") for name, corner in corners.items() for c in "xy"])
    legs = legs.withColumns({f"_d{c}{k}": F.col(f"_{b}{c}") - F.col(f"_{a}{c}") for k, a, b in ((1, "a", "b"), (2, "b", "c")) for c in "xy"})
    legs = legs.withColumns({f"_n{k}": F.coalesce(F.ceil(F.expr(f"sqrt(_dx{k} * _dx{k} + _dy{k} * _dy{k})") / piece_m), F.lit(0)) for k in (1, 2)})
    legs = legs.withColumn("_both", F.expr("_n1 = 1 AND _n2 = 1")).filter("_n1 + _n2 > 0")
    pieces = {}
    for c in "xy":
        pieces[f"p{c}"] = f"IF(k < _n1, _a{c} + _d{c}1 * k / greatest(_n1, 1), _b{c} + _d{c}2 * (k - _n1) / greatest(_n2, 1))"
        pieces[f"v{c}"] = f"IF(k < _n1, _d{c}1 / greatest(_n1, 1), _d{c}2 / greatest(_n2, 1))"
    cut = ", ".join(f"{text} AS {name}" for name, text in pieces.items())
    rows = legs.select("objectid", "_both", "_bx", "_by", "_dx2", "_dy2", F.expr(
        f"inline(transform(sequence(0L, IF(_both, 0L, _n1 + _n2 - 1)), k -> struct({cut})))"))
    return rows.select("objectid", *pieces, *[F.expr(f"IF(_both, {there}, {here})").alias(name) for name, there, here in (
        ("qx", "_bx", "px"), ("qy", "_by", "py"), ("ux", "_dx2", "0D"), ("uy", "_dy2", "0D"))])


def require_kind(kind: str) -> None:
    if kind not in LINE_KINDS:
        raise ValueError("kind must be 'water' or 'road'")


def _per_cell(clipped: DataFrame, keys: list[str], kind: str) -> DataFrame:
    require_kind(kind)
    return clipped.groupBy(*keys).agg(
        F.sum("km").alias(f"line_length_km_{kind}"),
        F.count_distinct("objectid").alias(f"line_count_{kind}"),
    )


def _per_told_cell(clipped: DataFrame, kind: str) -> DataFrame:
    """Like ``_per_cell``; ids of rows that are not ``_again`` are counted, without a look at which they are."""
    require_kind(kind)
    again, met, line = F.col("_again"), F.col("_met"), F.col("objectid")
    ids = clipped.groupBy("cell_id", F.when(again & met, line).alias("_id")).agg(
        F.sum("km").alias("km"), F.count(F.when(~again & met, line)).alias("_alone"))
    cells = ids.groupBy("cell_id").agg(
        F.sum("km").alias(f"line_length_km_{kind}"),
        (F.sum("_alone") + F.count("_id")).alias(f"line_count_{kind}"),
    )
    return cells.filter(F.col(f"line_length_km_{kind}") > 0)


def line_density(lines: DataFrame, kind: str = "water", resolution: int = DEFAULT_RESOLUTION,
                 grid: DataFrame | None = None) -> DataFrame:
    """Per lattice cell: clipped kilometres and number of distinct lines.

    With ``grid`` only its cells are kept, after the aggregate, so the join is one row per cell.
    """
    pieces = line_pieces(lines, geo.edge_m(resolution))
    pieces = pieces.withColumns({
        "_mx": F.col("px") + F.col("vx") / 2, "_my": F.col("py") + F.col("vy") / 2,
        "_km": F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) / 1000,
        **{f"_rate{k}": part for k, part in enumerate(geo.strip_parts("vx", "vy"))},
    })
    q, r = geo.axial("_mx", "_my", resolution)
    around = F.explode(F.array(*[F.struct(F.lit(dq).alias("dq"), F.lit(dr).alias("dr")) for dq, dr in geo.DISK]))
    near = pieces.withColumns({"_q": q, "_r": r}).select("*", around.alias("_d"))
    near = near.withColumns({"q": F.col("_q") + F.col("_d.dq"), "r": F.col("_r") + F.col("_d.dr")})
    cx, cy = geo.centre("q", "r", resolution)
    near = near.withColumns({"_dx": F.col("px") - cx, "_dy": F.col("py") - cy})
    near = near.withColumns({f"_start{k}": part for k, part in enumerate(geo.strip_parts("_dx", "_dy"))})
    share = geo.strip_share(resolution, ("_start0", "_start1", "_start2"), ("_rate0", "_rate1", "_rate2"))
    # Generated one by one, so that the filter on the length does not repeat its expression.
    clipped = near.select("objectid", "q", "r", F.explode(F.array(share * F.col("_km"))).alias("km"))
    clipped = clipped.filter(F.col("km") > 0)
    cells = _per_cell(clipped, ["q", "r"], kind)
    cells = cells.withColumn("cell_id", geo.cell_id(F.col("q"), F.col("r"), resolution)).drop("q", "r")
    if grid is not None:
        cells = cells.join(grid.select("cell_id"), "cell_id", "left_semi")
    return cells.select("cell_id", f"line_length_km_{kind}", f"line_count_{kind}")


def metric_polygons(polygons: DataFrame) -> DataFrame:
    """Polygons in metres: their ``_edges`` and metric boxes, and ``_sides`` where the ring is convex (else null)."""
    x, y = geo.metric_text("p.lon", "p.lat")
    ring = F.expr(f"transform(geometry, p -> struct({x} AS x, {y} AS y))")
    rows = polygons.select("cell_id", ring.alias("_ring"), ring_problem().isNull().alias("_convex"))
    rows = rows.withColumns({
        "x_min": F.array_min(F.col("_ring.x")), "y_min": F.array_min(F.col("_ring.y")),
        "x_max": F.array_max(F.col("_ring.x")), "y_max": F.array_max(F.col("_ring.y")),
        "_edges": ring_edges("_ring", "x", "y"),
    })
    return rows.withColumn("_sides", F.when(F.col("_convex"), outward_sides("_edges"))).drop("_ring", "_convex")


def polygon_parts(metric: DataFrame) -> DataFrame:
    """``metric_polygons`` by how they are tried: concave rings as their corners (see ``with_corners``) or, with more edges,
    as one row per part (see ``level_parts``); other rings stay one row."""
    told = level_parts(metric, wanted="_sides IS NULL")
    told = with_corners(told, wanted="_parts IS NOT NULL").withColumn("_parts", F.when(F.col("_corners").isNull(), F.col("_parts")))
    parts = told.select("*", F.explode_outer("_parts").alias("_p"))
    names = ("y0", "y1", "lx", "ly", "lrun", "rx", "ry", "rrun")
    whole = F.col("_p").isNull() & F.col("_corners").isNull()
    box = {"x_min": "x0", "y_min": "y0", "x_max": "x1", "y_max": "y1"}
    return parts.select("cell_id", F.when(whole, F.col("_edges")).alias("_edges"), "_sides", *[f"_p.{n}" for n in names],
                        "_corners", *[F.coalesce(f"_p.{n}", c).alias(c) for c, n in box.items()])


def told_again(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``_again``: whether others have their key too. A null key counts as one that others have."""
    path = scratch_path(rows.sparkSession, "repeated-keys")
    duplicate_keys(rows, [key]).write.parquet(path)
    twice = rows.sparkSession.read.parquet(path).select(key, F.lit(True).alias("_again"))
    if twice.isEmpty():
        return rows.withColumn("_again", F.col(key).isNull())
    return rows.join(twice, key, "left").withColumn("_again", F.coalesce("_again", F.col(key).isNull()))


def clip_by_corners(lines: DataFrame, rings: DataFrame, bin_m: float, min_rows: int) -> DataFrame:
    """(cell_id, objectid, _again, _met, km) of line pieces and rings given by their corners.

    A pair of a line and a cell that has one row here and no other row anywhere is told by ``_again`` being false.
    """
    turns = told_again(line_turns(lines, 2 * bin_m), "objectid").withColumnRenamed("_again", "_line_again")
    ends = {c: (f"p{c}", f"p{c} + v{c}", f"q{c}", f"q{c} + u{c}") for c in "xy"}
    turns = turns.withColumns({f"_{c}{k}": F.expr(f"{fn}({', '.join(ends[c])})") for k, fn in ((0, "least"), (1, "greatest")) for c in "xy"})
    near = box_join(turns, rings, ("_x0", "_y0", "_x1", "_y1"), ("x_min", "y_min", "x_max", "y_max"), bin_m, min_rows, left_span=4 * bin_m)
    numbers = [*[f"c{c}{k}" for k in range(MAX_CORNERS) for c in "xy"], "px", "py", "vx", "vy", "qx", "qy", "ux", "uy"]
    # None is null, which Spark has to be told: with checks for nulls the step would be too long for the JVM to compile.
    near = near.select("cell_id", "objectid", F.coalesce(F.col("_line_again") | F.col("_again"), F.lit(True)).alias("_again"),
                       *[F.coalesce(c, F.lit(0.0)).alias(c) for c in numbers])
    sided = with_corner_sides(with_corner_sides(near, "first"), "second", "qx", "qy", "ux", "uy")
    first, second = share_inside_corners("first"), share_inside_corners("second", "qx", "qy")
    # Each share stands in two columns, so Spark makes a method of its own for it: in one with the join they would not be compiled.
    return sided.select("cell_id", "objectid", "_again", (F.greatest(first, second) > 0).alias("_met"), (
        (first * F.expr("sqrt(vx * vx + vy * vy)") + second * F.expr("sqrt(ux * ux + uy * uy)")) / 1000).alias("km"))


def clip_by_parts(lines: DataFrame, parts: DataFrame, bin_m: float, min_rows: int, whole: bool) -> DataFrame:
    """(cell_id, objectid, km) of line pieces and rings or their parts; ``whole`` says that some are no parts."""
    pieces = line_pieces(lines, bin_m).withColumns({
        "_x0": F.least(F.col("px"), F.col("px") + F.col("vx")), "_y0": F.least(F.col("py"), F.col("py") + F.col("vy")),
        "_x1": F.greatest(F.col("px"), F.col("px") + F.col("vx")), "_y1": F.greatest(F.col("py"), F.col("py") + F.col("vy")),
    })
    near = box_join(pieces, parts, ("_x0", "_y0", "_x1", "_y1"), ("x_min", "y_min", "x_max", "y_max"), bin_m, min_rows, left_span=bin_m)
    share = share_inside_part()
    # Functions of arrays are not compiled, nor is the step that holds them; parts alone need none.
    if whole:
        share = F.when(F.col("y0").isNotNull(), share).when(
            F.col("_sides").isNotNull(), share_inside_convex("_sides")).otherwise(share_inside("_edges"))
    metres = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    # Generated one by one, so that the filter on the length does not repeat the clip.
    return near.select("cell_id", "objectid", F.explode(F.array(share * metres / 1000)).alias("km")).filter(F.col("km") > 0)


def line_density_on_polygons(lines: DataFrame, polygons: DataFrame, kind: str = "water",
                             bin_m: float = 1_000.0, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Like ``line_density`` for a table of polygons (cell_id, geometry), rings of any simple shape.

    Corners are projected and joined by straight metric edges. Rings without an area hold nothing. A stretch along the
    boundary counts for convex rings; along a concave one rounding decides.

    Pairs of a line and a cell that stand in one row are counted where they are made: as many as lines times cells of
    a place, they would fill the disks if they were shuffled to be told apart.
    """
    spark = polygons.sparkSession
    path = scratch_path(spark, "polygon-parts")
    # Dealt by content, as lines are.
    dealt = polygons.select("cell_id", "geometry").repartition(F.xxhash64("cell_id", "geometry"))
    polygon_parts(metric_polygons(usable_rings(dealt))).write.parquet(path)
    parts = spark.read.parquet(path)
    cornered, part = F.col("_corners").isNotNull(), F.col("y0").isNotNull()
    small, cut, whole = parts.agg(*[F.coalesce(F.bool_or(kind_of), F.lit(False)) for kind_of in (cornered, part, ~cornered & ~part)]).first()
    clipped = None
    if cut or whole or not small:
        clipped = clip_by_parts(lines, parts.filter(~cornered).drop("_corners"), bin_m, min_rows, whole).withColumns({"_again": F.lit(True), "_met": F.lit(True)})
    if small:
        rings = told_again(parts, "cell_id").filter(cornered).select("cell_id", "_again", *corner_columns(), "x_min", "y_min", "x_max", "y_max")
        alone = clip_by_corners(lines, rings, bin_m, min_rows)
        clipped = alone if clipped is None else clipped.unionByName(alone)
    return _per_told_cell(clipped, kind)
