"""Polygons: array<struct<x:double,y:double>>, all as native expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_AREA = 1e-5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def point(x: Column, y: Column) -> Column:
    """A point."""
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def from_pairs(pairs: Column) -> Column:
    """A polygon from an array of [x, y] arrays."""
    return F.transform(pairs, lambda p: point(p[0], p[1]))


def rotate(p: Column, n: Column | int = 1) -> Column:
    """The polygon from its point number n on, counted from 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.slice(p, n + 1, F.greatest(F.size(p) - n, F.lit(0))), F.slice(p, 1, n))


def _edges(p: Column) -> Column:
    return let(p, lambda q: F.zip_with(q, rotate(q), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def _cross(a: Column, b: Column, c: Column) -> Column:
    return (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)


def signed_area(p: Column) -> Column:
    """Shoelace area, positive for points in the order of rising angles; 0 below three points."""
    total = lambda q: F.aggregate(_edges(q), F.lit(0.0), lambda s, e: s + (e.a.x * e.b.y - e.b.x * e.a.y)) / 2
    return let(p, lambda q: F.when(F.size(q) < 3, 0.0).otherwise(total(q)))


def area(p: Column) -> Column:
    """Shoelace area without its sign."""
    return F.abs(signed_area(p))


def self_intersects(p: Column) -> Column:
    """Whether two edges that share no point properly cross."""

    def crosses(e: Column, g: Column) -> Column:
        return (_cross(e.a, e.b, g.a) * _cross(e.a, e.b, g.b) < 0) & (_cross(g.a, g.b, e.a) * _cross(g.a, g.b, e.b) < 0)

    def found(e: Column) -> Column:
        numbered = F.transform(e, lambda x, i: F.struct(i.alias("i"), x.a.alias("a"), x.b.alias("b")))
        # edges that share a point never cross properly, so they need no test of their own
        return let(numbered, lambda n: F.exists(n, lambda x: F.exists(n, lambda y: (y.i > x.i) & crosses(x, y))))

    return F.when(F.size(p) < 4, False).otherwise(let(_edges(p), found))


def canonical(p: Column) -> Column:
    """Points by angle about their mean, from the one of least x + y on."""

    def ordered(c: Column) -> Column:
        keyed = F.transform(p, lambda q, i: F.struct(F.atan2(q.y - c.y, q.x - c.x).alias("angle"), i.alias("i"), q.alias("q")))
        return F.transform(F.array_sort(keyed), lambda k: k.q)

    def started(o: Column) -> Column:
        sums = F.transform(o, lambda q: q.x + q.y)
        return let(sums, lambda s: rotate(o, (F.array_position(s, F.array_min(s)) - 1).cast("int")))

    n = F.size(p)
    total = F.aggregate(p, point(F.lit(0.0), F.lit(0.0)), lambda s, q: point(s.x + q.x, s.y + q.y))
    return F.when(n < 3, p).otherwise(let(let(let(total, lambda t: point(t.x / n, t.y / n)), ordered), started))


def _clearly_sound(pairs: Column) -> Column:
    """Whether pairs are four points of [0, 1] in convex order, by so much that no rounding changes what validity() says.

    Each corner's cross product is beyond 2 * MIN_AREA, all with one sign. Four such turns go round
    once, so their order by angle is the given one, opposite edges do not meet and the area, half
    the sum of two of them, is above MIN_AREA. No lambda is needed, so all of it is compiled.
    """
    value = [[F.get(F.get(pairs, F.lit(i)), F.lit(j)) for j in (0, 1)] for i in range(4)]
    shaped = all_of(F.size(pairs) == 4, *(F.size(F.get(pairs, F.lit(i))) == 2 for i in range(4)))
    inside = all_of(*((v >= 0) & (v <= 1) for xy in value for v in xy))

    def turn(i: int) -> Column:
        (ax, ay), (bx, by), (cx, cy) = (value[(i + k) % 4] for k in range(3))
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    turns = [turn(i) for i in range(4)]
    return shaped & inside & ((F.least(*turns) > 2 * MIN_AREA) | (F.greatest(*turns) < -2 * MIN_AREA))


def _reason(pairs: Column) -> Column:
    """validity() in full."""
    any_value = lambda test: F.exists(pairs, lambda p: F.exists(p, test))
    shape = lambda o: F.when(self_intersects(o), "self_intersection").when(area(o) < MIN_AREA, "area_too_small")
    return (
        F.when(pairs.isNull() | (F.size(pairs) < 3), "fewer_than_three_points")
        .when(F.exists(pairs, lambda p: p.isNull() | (F.size(p) != 2)), "invalid_point")
        .when(any_value(lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "non_finite_coordinate")
        .when(any_value(lambda v: (v < 0) | (v > 1)), "coordinate_out_of_bounds")
        .otherwise(let(canonical(from_pairs(pairs)), shape))
    )


def validity(pairs: Column) -> Column:
    """Null for sound geometry, else the first reason against it; pairs is array<array<double>>."""
    return F.when(~F.coalesce(_clearly_sound(pairs), F.lit(False)), _reason(pairs))


def acceptable_quad(pairs: Column) -> Column:
    """Whether there are four points in [0, 1] that extend in both directions."""
    extent = lambda i: F.array_max(F.transform(pairs, lambda p: p[i])) - F.array_min(F.transform(pairs, lambda p: p[i]))
    inside = F.forall(pairs, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: (v >= 0) & (v <= 1)))
    return (F.size(pairs) == 4) & inside & (extent(0) >= 1e-4) & (extent(1) >= 1e-4)


def _upright(p: Column) -> Column:
    return F.when(signed_area(p) < 0, F.reverse(p)).otherwise(p)


def clip(subject: Column, window: Column) -> Column:
    """The part of one convex polygon inside another: one half-plane cut for each edge of window."""

    def cut(poly: Column, edge: Column) -> Column:
        sided = F.transform(poly, lambda q: F.struct(q.x.alias("x"), q.y.alias("y"), _cross(edge.a, edge.b, q).alias("side")))

        def step(e: Column) -> Column:
            t = F.try_divide(e.a.side, e.a.side - e.b.side)
            met = point(e.a.x + t * (e.b.x - e.a.x), e.a.y + t * (e.b.y - e.a.y))
            here = point(e.a.x, e.a.y)
            inside, leaves = e.a.side >= 0, (e.a.side >= 0) != (e.b.side >= 0)
            return F.when(inside & leaves, F.array(here, met)).when(inside, F.array(here)).when(leaves, F.array(met)).otherwise(F.slice(F.array(here), 1, 0))

        return let(sided, lambda s: F.flatten(F.transform(_edges(s), step)))

    return F.aggregate(_edges(_upright(window)), _upright(subject), cut)


def iou(a: Column, b: Column) -> Column:
    """Common over joint area of two convex polygons; zero where that is empty."""
    joint = lambda common: F.coalesce(F.try_divide(common, area(a) + area(b) - common), F.lit(0.0))
    return let(area(clip(a, b)), joint)


def coverage(a: Column, b: Column) -> Column:
    """Shares of a and of b that the other covers; zeros where either is empty."""

    def shares(v: Column) -> Column:
        fine = (v.a > 0) & (v.b > 0)
        share = lambda x: F.when(fine, F.try_divide(v.common, x)).otherwise(0.0)
        return F.struct(share(v.a).alias("first"), share(v.b).alias("second"))

    return let(F.struct(area(clip(a, b)).alias("common"), area(a).alias("a"), area(b).alias("b")), shares)


def contains(p: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon or on its edge, by ray casting."""
    q = point(x, y)

    def on_edge(e: Column) -> Column:
        within = (x >= F.least(e.a.x, e.b.x)) & (x <= F.greatest(e.a.x, e.b.x)) & (y >= F.least(e.a.y, e.b.y)) & (y <= F.greatest(e.a.y, e.b.y))
        return (_cross(e.a, e.b, q) == 0) & within

    def crossed(e: Column) -> Column:
        at = e.a.x + (y - e.a.y) * F.try_divide(e.b.x - e.a.x, e.b.y - e.a.y)
        return ((e.a.y > y) != (e.b.y > y)) & (x < at)

    edges = _edges(p)
    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crossed)) % 2 == 1)


def corner_error(a: Column, b: Column) -> Column:
    """Mean corner distance of two quads in the best cyclic order, over the root of b's area."""
    distance = lambda u, v: F.sqrt(F.pow(u.x - v.x, 2) + F.pow(u.y - v.y, 2))
    mean = lambda shift: F.aggregate(F.zip_with(rotate(a, shift), b, distance), F.lit(0.0), lambda s, d: s + d) / 4
    return F.try_divide(F.least(*(mean(i) for i in range(4))), F.sqrt(area(b)))


def shorter_side(p: Column) -> Column:
    """The shorter of a quad's two mean opposite sides; null for other polygons."""
    lengths = F.transform(_edges(p), lambda e: F.sqrt(F.pow(e.a.x - e.b.x, 2) + F.pow(e.a.y - e.b.y, 2)))
    return let(lengths, lambda s: F.when(F.size(s) == 4, F.least((s[0] + s[2]) / 2, (s[1] + s[3]) / 2)))


def bounds(p: Column) -> Column:
    """The axis-aligned box around a polygon."""
    part = lambda f, o, name: f(F.transform(o, lambda q: q[name]))
    return let(p, lambda o: F.struct(part(F.array_min, o, "x").alias("x1"), part(F.array_min, o, "y").alias("y1"), part(F.array_max, o, "x").alias("x2"), part(F.array_max, o, "y").alias("y2")))


def rotated_box(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """The corners of a box turned by an angle in radians about its centre."""
    corner = lambda sx, sy: point(cx + F.cos(angle) * w / 2 * sx - F.sin(angle) * h / 2 * sy, cy + F.sin(angle) * w / 2 * sx + F.cos(angle) * h / 2 * sy)
    return F.array(*(corner(sx, sy) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def rectangle_quad(x: Column, y: Column, w: Column, h: Column, width: float, height: float) -> Column:
    """A pixel rectangle as a quad in shares of the picture."""
    return F.array(*(point((x + w * i) / width, (y + h * j) / height) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))))


def line_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the lines through a, b and c, d meet; null for parallel ones."""
    denominator = (b.x - a.x) * (d.y - c.y) - (b.y - a.y) * (d.x - c.x)
    t = F.try_divide((c.x - a.x) * (d.y - c.y) - (c.y - a.y) * (d.x - c.x), denominator)
    return F.when(F.abs(denominator) > 1e-12, point(a.x + t * (b.x - a.x), a.y + t * (b.y - a.y)))


def label_line(kind: Column, p: Column, digits: int = 6) -> Column:
    """A label text: the class and the flattened coordinates, for detector training files."""
    numbers = F.flatten(F.transform(p, lambda q: F.array(q.x, q.y)))
    return F.concat_ws(" ", kind.cast("string"), F.array_join(F.transform(numbers, lambda v: F.format_number(v, digits)), " "))


def all_of(*conditions: Column) -> Column:
    """The conjunction of conditions."""
    return reduce(lambda a, b: a & b, conditions)


def least_rectangle(p: Column) -> Column:
    """The rectangle of least area about a polygon's points, as a quad; the points themselves below two distinct ones.

    One side of it lies along an edge of the convex hull, which is a pair of points with all others
    on one side; so such pairs' directions are tried, the first of equal areas winning.
    """

    def along(a: Column, b: Column) -> Column:
        ux, uy = b.x - a.x, b.y - a.y
        norm = F.sqrt(ux * ux + uy * uy)
        over = lambda q: (q.x * ux + q.y * uy) / norm
        across = lambda q: (q.y * ux - q.x * uy) / norm
        ends = F.struct(
            (ux / norm).alias("ux"), (uy / norm).alias("uy"), F.array_min(F.transform(p, over)).alias("a"), F.array_max(F.transform(p, over)).alias("b"), F.array_min(F.transform(p, across)).alias("c"), F.array_max(F.transform(p, across)).alias("d")
        )
        return let(ends, lambda e: F.struct(((e.b - e.a) * (e.d - e.c)).alias("size"), e.alias("e")))

    def hull_pair(a: Column, b: Column) -> Column:
        slack = 1e-12 * ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))
        return ((a.x != b.x) | (a.y != b.y)) & F.forall(p, lambda q: _cross(a, b, q) >= -slack)

    pairs = F.flatten(F.transform(p, lambda a: F.transform(F.filter(p, lambda b: hull_pair(a, b)), lambda b: along(a, b))))
    corner = lambda e, s, t: point(s * e.ux - t * e.uy, s * e.uy + t * e.ux)
    quad = lambda best: F.array(*(corner(best.e, best.e[s], best.e[t]) for s, t in (("a", "c"), ("b", "c"), ("b", "d"), ("a", "d"))))
    return let(F.array_min(pairs), lambda best: F.when(best.isNull(), p).otherwise(quad(best)))
