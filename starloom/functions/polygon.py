"""Polygons and rotated rectangles. A polygon is ARRAY<STRUCT<x, y>> in native pixels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def edges(vertices: Column) -> Column:
    """Each vertex with the one before it (the last before the first)."""
    n = F.size(vertices)
    return F.transform(
        vertices,
        lambda v, i: F.struct(
            v["x"].alias("x"),
            v["y"].alias("y"),
            F.element_at(vertices, F.when(i == 0, n).otherwise(i))["x"].alias("px"),
            F.element_at(vertices, F.when(i == 0, n).otherwise(i))["y"].alias("py"),
        ),
    )


def point_in_rect(x, y, cx, cy, half_w, half_h, ux, uy, vx, vy) -> Column:
    """Edges count as inside."""
    dx, dy = x - cx, y - cy
    return (F.abs(dx * ux + dy * uy) <= half_w) & (F.abs(dx * vx + dy * vy) <= half_h)


def point_in_polygon(x: Column, y: Column, vertices: Column) -> Column:
    return point_in_edges(x, y, edges(vertices))


def point_in_edges(x: Column, y: Column, sides: Column) -> Column:
    """Even-odd rule: count the edges (see :func:`edges`) that span y and cross to the right of x."""
    crossings = F.filter(
        sides,
        lambda e: ((e["y"] > y) != (e["py"] > y))
        & (x < e["px"] + (y - e["py"]) / (e["y"] - e["py"]) * (e["x"] - e["px"])),
    )
    return F.size(crossings) % 2 == 1


def is_valid(vertices: Column) -> Column:
    """At least three vertices, all finite."""
    inf = float("inf")
    return (F.size(vertices) >= 3) & F.forall(
        vertices,
        lambda v: v["x"].isNotNull()
        & v["y"].isNotNull()
        & ~F.isnan(v["x"])
        & ~F.isnan(v["y"])
        & (F.abs(v["x"]) < inf)
        & (F.abs(v["y"]) < inf),
    )


def summary(vertices: Column) -> Column:
    """struct(cx, cy, bound_radius): vertex mean and the farthest vertex from it."""
    n = F.size(vertices)
    cx = F.aggregate(vertices, F.lit(0.0), lambda a, v: a + v["x"]) / n
    cy = F.aggregate(vertices, F.lit(0.0), lambda a, v: a + v["y"]) / n
    reach = F.array_max(F.transform(vertices, lambda v: F.hypot(v["x"] - cx, v["y"] - cy)))
    return F.struct(cx.alias("cx"), cy.alias("cy"), reach.alias("bound_radius"))


def signed_area2(vertices: Column) -> Column:
    """Twice the signed area."""
    return F.aggregate(
        edges(vertices), F.lit(0.0), lambda a, e: a + e["px"] * e["y"] - e["x"] * e["py"]
    )


def arc_lengths(vertices: Column) -> Column:
    """Length along the outline at every vertex, then once more back at the first."""
    n = F.size(vertices)
    steps = F.transform(
        vertices,
        lambda v, i: F.hypot(
            F.element_at(vertices, F.when(i == n - 1, 1).otherwise(i + 2))["x"] - v["x"],
            F.element_at(vertices, F.when(i == n - 1, 1).otherwise(i + 2))["y"] - v["y"],
        ),
    )
    return F.aggregate(
        steps, F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s))
    )
