"""Tests of closed rings (arrays of corners, the first one repeated at the end), convex or not.

Edges are listed once per polygon, before any join; a test per pair only reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring_problem(ring: str = "geometry") -> Column:
    """Why a ring is no closed convex one: 'points' (under four), 'open', 'area' (none) or 'concave'; else null.

    Turns are compared with a billionth of the area, so rounding does not make a straight run concave.
    """
    at = lambda i, c: f"get({ring}, {i}).{c}"
    after = f"IF(i + 1 < size({ring}), i + 1, 1)"
    steps = f"sequence(1, greatest(size({ring}) - 1, 1))"
    turns = f"""transform({steps}, i -> ({at('i', 'lon')} - {at('i - 1', 'lon')}) * ({at(after, 'lat')} - {at('i', 'lat')})
      - ({at('i', 'lat')} - {at('i - 1', 'lat')}) * ({at(after, 'lon')} - {at('i', 'lon')}))"""
    area = f"""aggregate(transform({steps}, i -> ({at('i - 1', 'lon')} - {at('0', 'lon')}) * ({at('i', 'lat')} - {at('0', 'lat')})
      - ({at('i', 'lon')} - {at('0', 'lon')}) * ({at('i - 1', 'lat')} - {at('0', 'lat')})), 0D, (s, x) -> s + x)"""
    return F.expr(f"""CASE WHEN {ring} IS NULL OR size({ring}) < 4 THEN 'points'
      WHEN get({ring}, 0) <> get({ring}, size({ring}) - 1) THEN 'open'
      WHEN coalesce({area}, 0D) = 0 THEN 'area'
      WHEN array_min({turns}) < -1e-9 * abs({area}) AND array_max({turns}) > 1e-9 * abs({area}) THEN 'concave' END""")


def ring_report(polygons: DataFrame, ring: str = "geometry") -> DataFrame:
    """(reason, polygons): how many rings each reason rejects."""
    told = polygons.select(ring_problem(ring).alias("reason")).filter("reason IS NOT NULL")
    return told.groupBy("reason").agg(F.count("*").alias("polygons"))


def usable_rings(polygons: DataFrame, ring: str = "geometry") -> DataFrame:
    """Polygons with an area; rings without one hold nothing (``ring_report`` counts them)."""
    bad = ring_problem(ring).isin("points", "open", "area")
    # Generated, so that the filter does not copy the making of the ring into every look at a corner.
    told = polygons.select("*", F.explode(F.array(F.coalesce(bad, F.lit(False)))).alias("_bad"))
    return told.filter(~F.col("_bad")).drop("_bad")


def ring_edges(ring: str, x: str = "lon", y: str = "lat") -> Column:
    """Edges (ax, ay, bx, by, run) of a ring; ``run`` is x per y, null for a level edge."""
    a, b = f"{ring}[i - 1]", f"{ring}[i]"
    return F.expr(f"""transform(sequence(1, size({ring}) - 1), i -> struct({a}.{x} AS ax, {a}.{y} AS ay, {b}.{x} AS bx, {b}.{y} AS by,
      try_divide({b}.{x} - {a}.{x}, {b}.{y} - {a}.{y}) AS run))""")


def holds_point(edges: str, x: str, y: str) -> Column:
    """True strictly inside a ring (crossing count); the boundary is outside."""
    crossings = f"size(filter({edges}, e -> (e.ay > {y}) <> (e.by > {y}) AND {x} < e.ax + ({y} - e.ay) * e.run))"
    touches = f"""exists({edges}, e -> (e.bx - e.ax) * ({y} - e.ay) = (e.by - e.ay) * ({x} - e.ax)
      AND {x} BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND {y} BETWEEN least(e.ay, e.by) AND greatest(e.ay, e.by))"""
    return F.expr(f"{crossings} % 2 = 1 AND NOT {touches}")


def meets_box(edges: str, box: tuple[str, str, str, str]) -> Column:
    """True where a ring and a box share a point: an edge crosses or touches the box, or the ring holds all of it.

    An edge meets the box where their ranges overlap and the box has corners on both sides of the edge's line (or on it).
    """
    west, south, east, north = box
    line = "(e.by - e.ay) * e.ax + (e.ax - e.bx) * e.ay"
    low, high = (f"{f}((e.by - e.ay) * {west}, (e.by - e.ay) * {east}) + {f}((e.ax - e.bx) * {south}, (e.ax - e.bx) * {north})"
                 for f in ("least", "greatest"))
    crossed = f"""exists({edges}, e -> greatest(e.ax, e.bx) >= {west} AND least(e.ax, e.bx) <= {east}
      AND greatest(e.ay, e.by) >= {south} AND least(e.ay, e.by) <= {north} AND {low} <= {line} AND {high} >= {line})"""
    return F.expr(crossed) | holds_point(edges, west, south)


def spans_ring(box: tuple[str, str, str, str], extent: tuple[str, str, str, str]) -> Column:
    """True where a box meets the extent (west, east, south, north) of a ring and reaches over all of it one way.

    A ring is in one piece, so such a box meets it; most wide boxes are told from this without a look at the edges.
    """
    west, south, east, north = (F.col(c) for c in box)
    ring_west, ring_east, ring_south, ring_north = (F.col(c) for c in extent)
    meets = (west <= ring_east) & (east >= ring_west) & (south <= ring_north) & (north >= ring_south)
    return meets & (((west <= ring_west) & (east >= ring_east)) | ((south <= ring_south) & (north >= ring_north)))


def share_inside(edges: str, px: str = "px", py: str = "py", vx: str = "vx", vy: str = "vy") -> Column:
    """Share of the segment p + t*v, 0 <= t <= 1, inside any simple ring.

    The segment's line meets the ring at an even number of places. In order, each odd one enters
    and each even one leaves, so the share is their alternating sum, cut to the segment.
    """
    side = lambda c: f"{vx} * (e.{c}y - {py}) - {vy} * (e.{c}x - {px})"
    place = f"""((e.ax - {px}) * (e.by - e.ay) - (e.ay - {py}) * (e.bx - e.ax))
      / ({vx} * (e.by - e.ay) - {vy} * (e.bx - e.ax))"""
    met = f"filter({edges}, e -> ({side('a')} > 0) <> ({side('b')} > 0))"
    places = f"array_sort(transform({met}, e -> least(1D, greatest(0D, {place}))))"
    return F.expr(f"aggregate(transform({places}, (t, i) -> IF(i % 2 = 1, t, -t)), 0D, (s, t) -> s + t)")


def share_inside_convex(ring_sides: str, px: str = "px", py: str = "py", vx: str = "vx", vy: str = "vy") -> Column:
    """The same for a convex ring given by ``outward_sides``; a segment along the boundary counts as inside."""
    rooms = f"""transform({ring_sides}, g -> struct(g.nx * (g.ax - {px}) + g.ny * (g.ay - {py}) AS room,
      g.nx * {vx} + g.ny * {vy} AS rate))"""
    return F.expr(f"""aggregate({rooms}, named_struct('low', 0D, 'high', 1D), (s, g) -> named_struct(
        'low', CASE WHEN g.rate < 0 THEN greatest(s.low, g.room / g.rate) WHEN g.rate = 0 AND g.room < 0 THEN 2D ELSE s.low END,
        'high', CASE WHEN g.rate > 0 THEN least(s.high, g.room / g.rate) ELSE s.high END),
      s -> greatest(0D, s.high - s.low))""")


#: Rings with more edges are not cut: the parts of a ring can be as many as the square of its edges.
MAX_PART_EDGES = 32


def level_parts(df: DataFrame, edges: str = "_edges", wanted: str = "true") -> DataFrame:
    """Add ``_parts``: a simple ring cut at the heights of its corners; null where it stays whole.

    A part lies from height y0 up to y1 between a left edge (lx, ly, lrun) and a right one (rx, ry, rrun) that reach over
    both heights. A ring stays whole where ``wanted`` is false, beyond MAX_PART_EDGES edges, and where its edges cross.
    """
    heights = F.expr(f"CASE WHEN {wanted} AND size({edges}) <= {MAX_PART_EDGES} THEN array_sort(array_distinct(transform({edges}, e -> e.ay))) END")
    slabs = "transform(sequence(1, size(_heights) - 1), i -> struct(_heights[i - 1] AS y0, _heights[i] AS y1))"
    at = lambda y: f"e.ax + ({y} - e.ay) * e.run"
    reaching = f"filter({edges}, e -> least(e.ay, e.by) <= h.y0 AND greatest(e.ay, e.by) >= h.y1)"
    cuts = f"""transform({slabs}, h -> struct(h.y0 AS y0, h.y1 AS y1, array_sort(transform({reaching}, e -> struct(
      {at('(h.y0 + h.y1) / 2')} AS x, {at('h.y0')} AS x0, {at('h.y1')} AS x1, e.ax AS ax, e.ay AS ay, e.run AS run))) AS s))"""
    # Edges that share a corner differ there by rounding, far below a micrometre.
    apart = """forall(_cuts, h -> size(h.s) > 1 AND size(h.s) % 2 = 0 AND forall(transform(h.s, (e, k) -> k = 0 OR (
      e.x0 >= get(h.s, k - 1).x0 - 1e-6 AND e.x1 >= get(h.s, k - 1).x1 - 1e-6)), b -> b))"""
    parts = """flatten(transform(_cuts, h -> transform(sequence(0, size(h.s) div 2 - 1), k -> struct(h.y0 AS y0, h.y1 AS y1,
      h.s[2 * k].ax AS lx, h.s[2 * k].ay AS ly, h.s[2 * k].run AS lrun, h.s[2 * k + 1].ax AS rx, h.s[2 * k + 1].ay AS ry,
      h.s[2 * k + 1].run AS rrun, least(h.s[2 * k].x0, h.s[2 * k].x1) AS x0, greatest(h.s[2 * k + 1].x0, h.s[2 * k + 1].x1) AS x1))))"""
    rows = df.withColumn("_heights", heights).withColumn("_cuts", F.expr(f"CASE WHEN _heights IS NOT NULL THEN {cuts} END"))
    return rows.withColumn("_parts", F.expr(f"CASE WHEN {apart} THEN {parts} END")).drop("_heights", "_cuts")


def share_inside_part(px: str = "px", py: str = "py", vx: str = "vx", vy: str = "vy") -> Column:
    """Share of the segment p + t*v, 0 <= t <= 1, inside one of ``level_parts``, whose fields are columns.

    The lower height belongs to a part and the upper one does not, so a level segment counts in one part. Plain
    arithmetic without functions of arrays, which Spark compiles.
    """
    low, high = ["0D"], ["1D"]
    sides = ((f"(({px} - lx) - ({py} - ly) * lrun)", f"({vx} - {vy} * lrun)"),
             (f"((rx - {px}) + ({py} - ry) * rrun)", f"({vy} * rrun - {vx})"))
    for room, rate in sides:
        low.append(f"CASE WHEN {rate} > 0 THEN - {room} / {rate} WHEN {rate} = 0 AND {room} < 0 THEN 2D ELSE 0D END")
        high.append(f"CASE WHEN {rate} < 0 THEN - {room} / {rate} ELSE 1D END")
    low.append(f"CASE WHEN {vy} > 0 THEN (y0 - {py}) / {vy} WHEN {vy} < 0 THEN (y1 - {py}) / {vy} WHEN {py} >= y0 AND {py} < y1 THEN 0D ELSE 2D END")
    high.append(f"CASE WHEN {vy} > 0 THEN (y1 - {py}) / {vy} WHEN {vy} < 0 THEN (y0 - {py}) / {vy} ELSE 1D END")
    return F.expr(f"greatest(0D, least({', '.join(high)}) - greatest({', '.join(low)}))")


#: Simple rings of at most this many edges are held corner by corner in columns, so that a pair is tried in one compiled row.
MAX_CORNERS = 8


def with_corners(df: DataFrame, wanted: str, edges: str = "_edges") -> DataFrame:
    """Add ``_corners``: the corners (x, y) of a simple ring of at most MAX_CORNERS edges, counter-clockwise.

    A ring with fewer edges repeats its last corner, which adds edges without a length. Null where ``wanted`` is false.
    """
    area = f"""aggregate({edges}, 0D, (s, e) -> s + (e.ax - {edges}[0].ax) * (e.by - {edges}[0].ay)
      - (e.bx - {edges}[0].ax) * (e.ay - {edges}[0].ay))"""
    full = f"concat({edges}, array_repeat(element_at({edges}, -1), {MAX_CORNERS} - size({edges})))"
    corners = f"transform({full}, e -> struct(e.ax AS x, e.ay AS y))"
    return df.withColumn("_corners", F.expr(
        f"CASE WHEN {wanted} AND size({edges}) <= {MAX_CORNERS} THEN IF({area} < 0, reverse({corners}), {corners}) END"))


def corner_columns() -> list[Column]:
    """The corners of ``with_corners`` as columns (cx0, cy0), (cx1, cy1), ..."""
    return [F.expr(f"get(_corners, {k}).{c}").alias(f"c{c}{k}") for k in range(MAX_CORNERS) for c in "xy"]


def with_corner_sides(df: DataFrame, piece: str, px: str = "px", py: str = "py", vx: str = "vx", vy: str = "vy") -> DataFrame:
    """Add how far each of ``corner_columns`` lies to the left of the segment p + t*v, and whether it does, under names of ``piece``."""
    side = {f"_{piece}_side{k}": F.expr(f"{vx} * (cy{k} - {py}) - {vy} * (cx{k} - {px})") for k in range(MAX_CORNERS)}
    return df.withColumns(side).withColumns({f"_{piece}_left{k}": F.expr(f"_{piece}_side{k} > 0") for k in range(MAX_CORNERS)})


def share_inside_corners(piece: str, px: str = "px", py: str = "py") -> Column:
    """Share of the segment p + t*v, 0 <= t <= 1, inside a simple ring, from the columns of ``with_corner_sides``.

    The segment's line leaves a counter-clockwise ring where an edge comes from its right to its left and enters it where one
    goes from left to right: places left less places entered, each cut to the segment. A point has no share.
    """
    places = []
    for a in range(MAX_CORNERS):
        b = (a + 1) % MAX_CORNERS
        place = f"((cx{a} - {px}) * (cy{b} - {py}) - (cy{a} - {py}) * (cx{b} - {px})) / (_{piece}_side{b} - _{piece}_side{a})"
        places.append(f"IF(_{piece}_left{a} = _{piece}_left{b}, 0D, IF(_{piece}_left{a}, -1D, 1D) * least(1D, greatest(0D, {place})))")
    return F.expr(f"greatest(0D, {' + '.join(places)})")


def outward_sides(edges: str) -> Column:
    """Edges of a convex ring as a corner (ax, ay) and a normal (nx, ny) that points away from the ring's middle."""
    middle = {c: f"aggregate({edges}, 0D, (s, e) -> s + e.a{c}) / size({edges})" for c in "xy"}
    away = "(e.by - e.ay) * (m.x - e.ax) + (e.ax - e.bx) * (m.y - e.ay) > 0"
    return F.expr(f"""flatten(transform(array(struct({middle['x']} AS x, {middle['y']} AS y)), m -> transform({edges}, e -> struct(
      e.ax AS ax, e.ay AS ay, IF({away}, e.ay - e.by, e.by - e.ay) AS nx, IF({away}, e.bx - e.ax, e.ax - e.bx) AS ny))))""")


def inner_point(df: DataFrame, ring: str = "geometry") -> DataFrame:
    """Add a point surely inside a ring of any shape as ``lon`` and ``lat``; null where the ring has no area or is open.

    A level line is drawn halfway between the corner heights next to the middle of the ring's
    extent, so it passes no corner; the point is the middle of its widest stretch inside.
    """
    heights = f"transform({ring}, c -> c.lat)"
    middle = f"(array_min({heights}) + array_max({heights})) / 2"
    rows = df.withColumn("_ok", ~F.coalesce(ring_problem(ring).isin("points", "open", "area"), F.lit(False)))
    rows = rows.withColumn("_edges", F.when(F.col("_ok"), ring_edges(ring))).withColumn("_middle", F.when(F.col("_ok"), F.expr(middle)))
    below = f"array_max(filter({heights}, h -> h <= _middle))"
    above = f"array_min(filter({heights}, h -> h > _middle))"
    rows = rows.withColumn("_level", F.expr(f"({below} + {above}) / 2"))
    met = "array_sort(transform(filter(_edges, e -> (e.ay > _level) <> (e.by > _level)), e -> e.ax + (_level - e.ay) * e.run))"
    rows = rows.withColumn("_met", F.expr(met))
    # Widest first; of equal widths the western one.
    stretches = "transform(filter(sequence(0, size(_met) - 1), i -> i % 2 = 0), i -> struct(_met[i + 1] - _met[i] AS w, -_met[i] AS a))"
    rows = rows.withColumn("_widest", F.expr(f"CASE WHEN size(_met) > 1 THEN array_max({stretches}) END"))
    point = F.struct(F.expr("_widest.w / 2 - _widest.a").alias("lon"), F.when(F.col("_widest").isNotNull(), F.col("_level")).alias("lat"))
    # A generator, so that later tests on the point are not pushed below (and copied into) the steps above.
    return rows.select(*[c for c in df.columns if c not in ("lon", "lat")], F.inline(F.array(point)))
