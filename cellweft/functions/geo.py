"""Column expressions for the metric plane and the hexagonal lattice in it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweft.constants import (
    DEFAULT_RESOLUTION,
    EDGE_KM_RES_8,
    FALSE_EASTING,
    FALSE_NORTHING,
    INVERSE_FLATTENING,
    ORIGIN_LAT,
    ORIGIN_LON,
    PARALLELS,
    SEMI_MAJOR_M,
)

SQRT3 = math.sqrt(3.0)
_FLATTENING = 1.0 / INVERSE_FLATTENING
ECCENTRICITY = math.sqrt(_FLATTENING * (2.0 - _FLATTENING))


def _cone_m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1.0 - (ECCENTRICITY * math.sin(phi)) ** 2)


def _cone_t(phi: float) -> float:
    s = ECCENTRICITY * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (ECCENTRICITY / 2)


_P1, _P2 = (math.radians(p) for p in PARALLELS)
CONE_N = (math.log(_cone_m(_P1)) - math.log(_cone_m(_P2))) / (
    math.log(_cone_t(_P1)) - math.log(_cone_t(_P2))
)
CONE_AF = SEMI_MAJOR_M * _cone_m(_P1) / (CONE_N * _cone_t(_P1) ** CONE_N)
CONE_RHO0 = CONE_AF * _cone_t(math.radians(ORIGIN_LAT)) ** CONE_N


def _number(value: float) -> str:
    return f"({value!r}D)"


def metric_text(lon: str, lat: str) -> tuple[str, str]:
    """SQL text of metric x and y; the formulas take SQL text so that each is parsed in one go."""
    phi = f"radians({lat})"
    s = f"({_number(ECCENTRICITY)} * sin({phi}))"
    t = f"tan(pi() / 4 - {phi} / 2) / power((1 - {s}) / (1 + {s}), {_number(ECCENTRICITY / 2)})"
    rho = f"({_number(CONE_AF)} * power({t}, {_number(CONE_N)}))"
    theta = f"({_number(CONE_N)} * radians({lon} - {_number(ORIGIN_LON)}))"
    return (
        f"{_number(FALSE_EASTING)} + {rho} * sin({theta})",
        f"{_number(FALSE_NORTHING + CONE_RHO0)} - {rho} * cos({theta})",
    )


def to_metric(lon: str, lat: str) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to metres (conformal conic, EPSG:3347)."""
    x, y = metric_text(lon, lat)
    return F.expr(x), F.expr(y)


def to_polar(x: str, y: str) -> tuple[Column, Column]:
    """Metres to (angle, half conformal colatitude), the costly half of ``to_degrees``."""
    dx, dy = f"({x} - {_number(FALSE_EASTING)})", f"({_number(FALSE_NORTHING + CONE_RHO0)} - ({y}))"
    reach = f"sqrt({dx} * {dx} + {dy} * {dy}) / {_number(CONE_AF)}"
    return F.expr(f"atan2({dx}, {dy})"), F.expr(f"atan(power({reach}, {_number(1.0 / CONE_N)}))")


_N = _FLATTENING / (2.0 - _FLATTENING)
# Published series in the third flattening for geodetic from conformal latitude:
# coefficients of sin 2, 4, 6, 8 and 10 times the latitude (fixed values).
LATITUDE_SERIES = (
    2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4 + 26 / 45 * _N**5,
    7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4 + 2704 / 315 * _N**5,
    56 / 15 * _N**3 - 136 / 35 * _N**4 - 1262 / 105 * _N**5,
    4279 / 630 * _N**4 - 332 / 35 * _N**5,
    4174 / 315 * _N**5,
)


def polar_degrees(angle: str, half: str) -> tuple[Column, Column]:
    """Longitude and latitude of a polar pair; pass column names, since ``half`` is used five times."""
    s, c = f"sin(4 * {half})", f"cos(4 * {half})"
    a1, a2, a3, a4, a5 = LATITUDE_SERIES
    # sin 2k of the conformal latitude, written in powers of c.
    powers = (a1 - a3 + a5, 2 * a2 - 4 * a4, 4 * a3 - 12 * a5, 8 * a4, 16 * a5)
    p0, p1, p2, p3, p4 = (_number(v) for v in powers)
    bend = f"({p0} - {c} * ({p1} - {c} * ({p2} - {c} * ({p3} - {c} * {p4}))))"
    phi = f"pi() / 2 - 2 * {half} + {s} * {bend}"
    return F.expr(f"degrees({angle} / {_number(CONE_N)}) + {_number(ORIGIN_LON)}"), F.expr(f"degrees({phi})")


def edge_km(resolution: int) -> float:
    """Mean hexagon edge length of a resolution in kilometres."""
    if not 0 <= resolution <= 15:
        raise ValueError("resolution must be between 0 and 15")
    return EDGE_KM_RES_8 * 7.0 ** ((DEFAULT_RESOLUTION - resolution) / 2)


def edge_m(resolution: int) -> float:
    return edge_km(resolution) * 1000.0


def axial(x: str, y: str, resolution: int) -> tuple[Column, Column]:
    """Lattice coordinates of the cell that holds a metric point (pointy-top, cube rounding).

    Pass column names: the coordinates are used many times.
    """
    a = _number(edge_m(resolution))
    q = f"(({x}) * {_number(SQRT3 / 3)} - ({y}) / 3) / {a}"
    r = f"({y}) * {_number(2.0 / 3)} / {a}"
    cube = (q, r, f"(- ({q}) - ({r}))")
    rq, rr, rs = (f"floor({v} + 0.5D)" for v in cube)
    dq, dr, ds = (f"abs({near} - ({v}))" for near, v in zip((rq, rr, rs), cube, strict=True))
    q_worst = f"({dq} > {dr} AND {dq} > {ds})"
    return (
        F.expr(f"CASE WHEN {q_worst} THEN - {rr} - {rs} ELSE {rq} END"),
        F.expr(f"CASE WHEN NOT {q_worst} AND {dr} > {ds} THEN - {rq} - {rs} ELSE {rr} END"),
    )


def in_world(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def cell_id(q: Column, r: Column, resolution: int) -> Column:
    return F.concat_ws("_", F.lit(f"r{resolution}"), q.cast("string"), r.cast("string"))


def cell_parts(cell: Column) -> tuple[Column, Column, Column]:
    """(resolution, q, r) of a cell id; nulls when it is not one."""
    pattern = r"^r(\d{1,2})_(-?\d{1,9})_(-?\d{1,9})$"
    return tuple(
        F.nullif(F.regexp_extract(cell, pattern, i), F.lit("")).cast("int") for i in (1, 2, 3)
    )


def is_cell(cell: Column, resolution: int) -> Column:
    """True for a well-formed id of the wanted resolution."""
    return F.coalesce(cell_parts(cell)[0] == resolution, F.lit(False))


def centre(q: str, r: str, resolution: int) -> tuple[Column, Column]:
    """Metric centre of a cell."""
    a = edge_m(resolution)
    return F.expr(f"({q} + {r} / 2) * {_number(a * SQRT3)}"), F.expr(f"{r} * {_number(a * 1.5)}")


def corner_offsets(resolution: int) -> list[tuple[float, float]]:
    """Metric offsets of the six corners from the centre, counter-clockwise."""
    a = edge_m(resolution)
    return [
        (a * math.cos(math.radians(30 + 60 * k)), a * math.sin(math.radians(30 + 60 * k)))
        for k in range(6)
    ]


# The cell itself and its six neighbours, as (dq, dr).
DISK = ((0, 0), (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


# A hexagon is the overlap of three strips; these are the unit normals of the strips.
STRIPS = ((1.0, 0.0), (0.5, SQRT3 / 2), (-0.5, SQRT3 / 2))


def strip_parts(x: str, y: str) -> list[Column]:
    """Components of a vector across the three strips."""
    return [F.expr(f"({x}) * {_number(nx)} + ({y}) * {_number(ny)}") for nx, ny in STRIPS]


def strip_share(resolution: int, starts: tuple[str, str, str], rates: tuple[str, str, str]) -> Column:
    """Share of a segment inside a hexagon, from columns with its start (seen from the centre)
    and its whole run across each strip."""
    h = _number(edge_m(resolution) * SQRT3 / 2)
    low, high = ["0D"], ["1D"]
    for start, rate in zip(starts, rates, strict=True):
        ends = f"(- {h} - {start}) / {rate}, ({h} - {start}) / {rate}"
        beside = f"CASE WHEN abs({start}) <= {h} THEN 0D ELSE 2D END"
        low.append(f"CASE WHEN {rate} = 0 THEN {beside} ELSE least({ends}) END")
        high.append(f"CASE WHEN {rate} = 0 THEN 1D ELSE greatest({ends}) END")
    return F.expr(f"greatest(0D, least({', '.join(high)}) - greatest({', '.join(low)}))")
