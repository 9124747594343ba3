"""DuckDB text of the geometry, for the queries' counterparts."""

from __future__ import annotations

import math

R = "6371008.8e0"
KY = repr(math.radians(1.0) * 6371008.8) + "e0"


def hav(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    s = lambda x, y: f"pow(sin(radians(({y}) - ({x})) / 2e0), 2)"
    h = f"({s(a_lat, b_lat)} + cos(radians({a_lat})) * cos(radians({b_lat})) * {s(a_lon, b_lon)})"
    return f"(2e0 * {R} * atan2(sqrt({h}), sqrt(greatest(0e0, 1e0 - {h}))))"


def seg_t(p_lat: str, p_lon: str, a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    kx = f"({KY} * cos(radians((({a_lat}) + ({b_lat})) / 2e0)))"
    bx, by = f"((({b_lon}) - ({a_lon})) * {kx})", f"((({b_lat}) - ({a_lat})) * {KY})"
    px, py = f"((({p_lon}) - ({a_lon})) * {kx})", f"((({p_lat}) - ({a_lat})) * {KY})"
    return f"greatest(0e0, least(1e0, ({px} * {bx} + {py} * {by}) / ({bx} * {bx} + {by} * {by})))"


def seg_dist(p_lat: str, p_lon: str, a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    kx = f"({KY} * cos(radians((({a_lat}) + ({b_lat})) / 2e0)))"
    t = seg_t(p_lat, p_lon, a_lat, a_lon, b_lat, b_lon)
    dx = f"(((({p_lon}) - ({a_lon})) - {t} * (({b_lon}) - ({a_lon}))) * {kx})"
    dy = f"(((({p_lat}) - ({a_lat})) - {t} * (({b_lat}) - ({a_lat}))) * {KY})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def seg_box(a_lat: str, a_lon: str, b_lat: str, b_lon: str, low_lat: str, low_lon: str, high_lat: str, high_lon: str) -> str:
    enter, leave = ["0e0"], ["1e0"]
    for a, b, low, high in ((a_lat, b_lat, low_lat, high_lat), (a_lon, b_lon, low_lon, high_lon)):
        flat = f"({a}) = ({b})"
        s, t = f"(({low}) - ({a})) / (({b}) - ({a}))", f"(({high}) - ({a})) / (({b}) - ({a}))"
        inside = f"({a}) between ({low}) and ({high})"
        enter.append(f"case when {flat} then case when {inside} then 0e0 else 2e0 end else least({s}, {t}) end")
        leave.append(f"case when {flat} then case when {inside} then 1e0 else -1e0 end else greatest({s}, {t}) end")
    return f"greatest({', '.join(enter)}) <= least({', '.join(leave)})"


def ring_values(ring: list[tuple[float, float]]) -> str:
    sides = list(zip(ring, [*ring[1:], ring[0]], strict=True))
    return "(values " + ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in sides) + ") s(y1, x1, y2, x2)"


def in_ring(lat: str, lon: str, ring: list[tuple[float, float]]) -> str:
    cross = f"((y1 > {lat}) <> (y2 > {lat})) and {lon} < (x2 - x1) * ({lat} - y1) / (y2 - y1) + x1"
    return f"(select count(*) % 2 = 1 from {ring_values(ring)} where y1 <> y2 and {cross})"


def segments_cross(a_lat: str, a_lon: str, b_lat: str, b_lon: str, ring: list[tuple[float, float]]) -> str:
    side = lambda ay, ax, by, bx, y, x: f"sign(({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax}))"
    one = f"{side(a_lat, a_lon, b_lat, b_lon, 'y1', 'x1')} <> {side(a_lat, a_lon, b_lat, b_lon, 'y2', 'x2')}"
    two = f"{side('y1', 'x1', 'y2', 'x2', a_lat, a_lon)} <> {side('y1', 'x1', 'y2', 'x2', b_lat, b_lon)}"
    return f"exists (select 1 from {ring_values(ring)} where {one} and {two})"
